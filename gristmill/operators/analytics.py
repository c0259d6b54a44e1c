"""Comparisons over metric tables in which "not measured" is never taken for zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["suite", "name", "variant"]


def measured(value: Column, state: Column) -> Column:
    return F.when(F.coalesce(state, F.lit("measured")) == "measured", value)


def run_diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """(suite, name, variant, a, b, delta) of all metrics that either has; delta null unless both are measured."""
    left = one.select(*KEYS, measured(F.col("value"), F.col("state")).alias("a"))
    right = two.select(*KEYS, measured(F.col("value"), F.col("state")).alias("b"))
    return left.join(right, KEYS, "full_outer").withColumn("delta", F.bround(F.col("b") - F.col("a"), 6))


def against(metrics: DataFrame, keys: list[str], variant: str, baseline: str) -> DataFrame:
    """Every variant's value beside the baseline variant's, and their difference."""
    base = metrics.where(F.col(variant) == baseline).select(*keys, F.col("value").alias("base"))
    return metrics.where(F.col(variant) != baseline).join(base, keys, "left").withColumn("delta", F.bround(F.col("value") - F.col("base"), 6))


def worst_of(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, value): the largest value; unknown if an applicable one is unmeasured, inapplicable if all are."""
    state = F.coalesce("state", F.lit("measured"))
    live = state != "inapplicable"
    unknown = F.bool_or(live & ((state != "measured") | F.col("value").isNull()))
    out = metrics.groupBy(*keys).agg(F.bool_or(live).alias("any"), unknown.alias("unknown"), F.max(F.when(live, F.col("value"))).alias("most"))
    return out.select(*keys, F.when(~F.col("any"), "inapplicable").when(F.col("unknown"), "unknown").otherwise("measured").alias("state"), F.when(F.col("any") & ~F.col("unknown"), F.col("most")).alias("value"))


def share_of_total(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row's share of its key's total; null where the total is 0."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.when(total > 0, F.bround(F.col(value) / total, 4)))


def not_measured(metrics: DataFrame) -> DataFrame:
    """(state, reason, labels, amount): which metrics weren't measured, by why."""
    rows = metrics.where(F.coalesce("state", F.lit("measured")) != "measured")
    label = F.concat_ws("/", "suite", "name", F.when(F.length("variant") > 0, F.col("variant")))
    return rows.groupBy("state", "reason").agg(F.array_sort(F.collect_set(label)).alias("labels"), F.count("*").alias("amount"))


BASELINE = "none"
# Rates that are better when higher, compromise rates with the rates of success beside them.
HIGHER_IS_BETTER = ("clean_answer_accuracy",)
COMPROMISE_PAIRS = (("poison_compromise_rate", "knowledge_corruption_rate"), ("injection_compromise_rate", "injection_compliance_rate"))
COMPETITION, CONTAMINATION = "attack_competition_rate", "cross_question_contamination_rate"


def one_per_metric(metrics: DataFrame) -> DataFrame:
    """(run_id, suite, name, variant, state, value): one row per metric of a run; repeated rows are one, values of unmeasured ones null."""
    state = F.coalesce("state", F.lit("measured"))
    rows = metrics.groupBy("run_id", "suite", "name", F.coalesce("variant", F.lit("")).alias("variant")).agg(F.max(F.struct((state == "measured").alias("m"), F.when(state == "measured", F.col("value")).alias("value"), state.alias("state"))).alias("x"))
    return rows.select("run_id", "suite", "name", "variant", "x.state", "x.value")


def judge_gap(metrics: DataFrame) -> DataFrame:
    """(run_id, accuracy, grounded, gap) of the runs that measured both answer accuracy and groundedness."""
    rows = one_per_metric(metrics).where("suite = 'faithfulness' and variant = ''")
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = rows.groupBy("run_id").agg(pick("answer_accuracy").alias("accuracy"), pick("groundedness").alias("grounded"))
    return wide.where("accuracy is not null and grounded is not null").withColumn("gap", F.bround(F.col("accuracy") - F.col("grounded"), 6))


def defense_groups(metrics: DataFrame) -> DataFrame:
    """(run_id, suite, name, defense, state, value, delta, tone): each metric that has conditions, against the one without a defense.

    The difference needs both sides measured; its tone says whether the defense made it better.
    """
    rows = one_per_metric(metrics).where("startswith(variant, 'defense=')").withColumn("defense", F.substring("variant", len("defense=") + 1, 1_000)).drop("variant")
    base = rows.where(F.col("defense") == BASELINE).select("run_id", "suite", "name", F.col("value").alias("base"))
    delta = F.when(F.col("defense") != BASELINE, F.bround(F.col("value") - F.col("base"), 6))
    better = F.when(F.col("name").isin(*HIGHER_IS_BETTER), F.col("delta") > 0).otherwise(F.col("delta") < 0)
    joined = rows.join(base, ["run_id", "suite", "name"], "left").withColumn("delta", delta).drop("base")
    return joined.withColumn("tone", F.when(F.coalesce(F.col("delta"), F.lit(0.0)) == 0, "neutral").when(better, "good").otherwise("bad"))


def understatements(metrics: DataFrame) -> DataFrame:
    """(run_id, defense, success, hit, any_marker): where the rate of one's own success is under the rate of any planted marker."""
    rows = defense_groups(metrics.where("suite = 'security'")).where("value is not null").select("run_id", "defense", "name", "value")
    pairs = F.create_map(*[F.lit(x) for pair in COMPROMISE_PAIRS for x in pair])
    wide = rows.withColumn("success", F.try_element_at(pairs, F.col("name"))).where("success is not null").select("run_id", "defense", "success", F.col("value").alias("any_marker"))
    hits = rows.select("run_id", "defense", F.col("name").alias("success"), F.col("value").alias("hit"))
    return wide.join(hits, ["run_id", "defense", "success"]).where("any_marker > hit").select("run_id", "defense", "success", "hit", "any_marker")


def contamination(metrics: DataFrame) -> DataFrame:
    """(run_id, kind, arms): escaping, with the conditions in which attacks reach other questions, or contained, where all conditions were
    measured, none lets them, and attacks do compete for their own question. Other runs have no row."""
    rows = defense_groups(metrics.where("suite = 'security'"))
    own = rows.where(F.col("name").isin(COMPETITION, CONTAMINATION))
    every = rows.groupBy("run_id").agg(F.count_distinct("defense").alias("defenses"))
    cross, value = F.col("name") == CONTAMINATION, F.col("value")
    per = own.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(cross & (value > 0), F.struct("defense", "value")))).alias("arms"), F.count_if(cross & value.isNotNull()).alias("known"), F.count_if(cross).alias("listed"), F.count_if(~cross & (value > 0)).alias("competing"),
    )
    joined = per.join(every, "run_id")
    kind = F.when(F.size("arms") > 0, "escaping").when((F.col("listed") > 0) & (F.col("known") == F.col("defenses")) & (F.col("competing") > 0), "contained")
    return joined.withColumn("kind", kind).where("kind is not null").select("run_id", "kind", "arms")


def breakdown(metrics: DataFrame) -> DataFrame:
    """(run_id, suite, name, part, state, value): metrics split by a part, as in leakage_rate@direct, outside conditions."""
    rows = one_per_metric(metrics).where("variant = '' and contains(name, '@')")
    return rows.select("run_id", "suite", F.substring_index("name", "@", 1).alias("name"), F.get(F.split("name", "@"), F.lit(1)).alias("part"), "state", "value")


def headline(metrics: DataFrame) -> DataFrame:
    """(run_id, card, state, value): retrieval quality with reranking or else without, answer accuracy, the worse attack and leakage without a defense."""
    rows = one_per_metric(metrics)
    key = F.concat_ws("|", "suite", "name", "variant")
    cards = {
        "retrieval|ndcg@10|rerank=on": ("retrieval", 0), "retrieval|ndcg@10|rerank=off": ("retrieval", 1), "faithfulness|answer_accuracy|": ("faithfulness", 0), "security|knowledge_corruption_rate|defense=none": ("security", 0),
        "security|injection_compliance_rate|defense=none": ("security", 0), "privacy|leakage_rate|defense=none": ("privacy", 0),
    }
    named = F.create_map(*[F.lit(x) for k, (c, p) in cards.items() for x in (k, f"{c}{p}")])
    rows = rows.withColumn("slot", F.try_element_at(named, key)).where("slot is not null").withColumn("card", F.expr("substring(slot, 1, length(slot) - 1)"))
    attack = worst_of(rows.where("card = 'security'"), ["run_id", "card"])
    first = F.min_by(F.struct("state", "value"), F.struct((F.col("state") == "inapplicable").alias("i"), "slot"))
    others = rows.where("card != 'security'").groupBy("run_id", "card").agg(first.alias("x")).select("run_id", "card", "x.state", "x.value")
    return others.unionByName(attack)


def flagged(payload: Column) -> Column:
    """Whether a record's payload (JSON text) shows something to look at: an attack that worked, a leak, a wrong answer, a first hit below the top."""
    is_ = lambda name, v: F.coalesce(F.get_json_object(payload, f"$.{name}").try_cast("boolean") == v, F.lit(False))
    rank = F.coalesce(F.get_json_object(payload, "$.first_hit_rank_reranked").try_cast("int") > 1, F.lit(False))
    return is_("succeeded", True) | is_("compromised", True) | is_("leaked", True) | is_("answer_match", False) | rank


def suite_counts(metrics: DataFrame, records: DataFrame) -> DataFrame:
    """(run_id, suite, metrics, records): how many rows each suite of a run left."""
    m = metrics.groupBy("run_id", "suite").agg(F.count("*").alias("metrics"))
    r = records.groupBy("run_id", "suite").agg(F.count("*").alias("records"))
    joined = m.join(r, m["run_id"].eqNullSafe(r["run_id"]) & m["suite"].eqNullSafe(r["suite"]), "full_outer")
    return joined.select(F.coalesce(m["run_id"], r["run_id"]).alias("run_id"), F.coalesce(m["suite"], r["suite"]).alias("suite"), F.coalesce("metrics", F.lit(0)).alias("metrics"), F.coalesce("records", F.lit(0)).alias("records"))


def dangling(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, rows): references to runs that aren't there."""
    gone = rows.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("rows"))
    return gone.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti")
