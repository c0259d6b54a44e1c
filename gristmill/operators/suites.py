"""The four evaluation suites end to end: each gives its metrics and the records they are reduced from.

Retrieval and reranking don't depend on a defense, so context is found once per question and set of
chunks and then passed through each condition. The corpus passes its filter chain first. Planted documents of
poison and injections bypass the chain and come through the trusted channel; canaries pass it as a second batch.
"""

from __future__ import annotations

import random
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import evaluation as E
from gristmill.operators.answering import DEFENSES, Generator, answer, extractive, screening_reason
from gristmill.operators.attacks import foreign_markers, injections, poison, targets
from gristmill.operators.chunking import OVERLAP, SIZE, chunk
from gristmill.operators.filters import apply_filters, filter_after, provenance
from gristmill.operators.retrieval import exact_top_k, hashed_embedding, rerank
from gristmill.session import broadcast_if_small, checkpoint

# What child seeds add to the seed of a run and of the security suite.
SUITE_SEEDS = {"retrieval": 1, "faithfulness": 2, "security": 3, "privacy": 4}
POISON_SEED, INJECTION_SEED, CONTROL_SEED, SCREEN_SEED = 11, 13, 17, 23
CLAIMS_PER_CITATION = 3


class Suite(NamedTuple):
    """metrics: (suite, name, variant, value); records: (suite, kind, payload_json)."""

    metrics: DataFrame
    records: DataFrame


def index(docs: DataFrame, kind: str = "structure", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of (doc_id, path, text, verified, trust_score) with their vectors."""
    cut = chunk(docs, kind, size, overlap, keep=("path", "verified", "trust_score"))
    return cut.select("doc_id", "chunk_id", F.col("path").alias("source"), "section", F.col("chunk").alias("text"), "verified", "trust_score", hashed_embedding(F.col("chunk")).alias("vector"))


def with_provenance(docs: DataFrame, channel: str = "trusted_corpus") -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "path", "text", provenance(F.lit(channel)).alias("p"))
    return rows.select("doc_id", "path", "text", "p.verified", "p.trust_score")


def filtered(docs: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    return apply_filters(docs, list(filters))[0] if filters else docs


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """(qid, question, rank, score and the chunk) of the k nearest chunks, with their place after reranking."""
    asked = questions.select("qid", "question", hashed_embedding(F.col("question")).alias("vector"))
    hits = checkpoint(exact_top_k(asked, chunks, k, "qid", "chunk_id"))
    amount = hits.count()  # k rows a question
    hits = chunks.drop("vector").join(broadcast_if_small(hits, amount), "chunk_id").join(broadcast_if_small(questions.select("qid", "question"), amount), "qid")
    return rerank(hits.withColumnRenamed("score", "cosine"))


def context(hits: DataFrame, top: int = 5, reranked: bool = True) -> DataFrame:
    """The first passages of each question, by reranking or, without a reranker, as retrieved."""
    place = "reranked" if reranked else "rank"
    return hits.where(F.col(place) < top).withColumn("rank", F.col(place))


def metric_rows(wide: DataFrame, suite: str, columns: list[str], variant: Column | None = None) -> DataFrame:
    """A row (suite, name, variant, value) for each column that has a value."""
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns)))
    rows = wide.select((F.lit("") if variant is None else variant).alias("variant"), named.alias("m")).where("m.value is not null")
    return rows.select(F.lit(suite).alias("suite"), "m.name", "variant", "m.value")


def record_rows(rows: DataFrame, suite: str, kind: str) -> DataFrame:
    return rows.select(F.lit(suite).alias("suite"), F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("payload_json"))


def sample(rows: DataFrame, order: list[str], n: int | None, seed: int) -> DataFrame:
    """n rows drawn without replacement, the same as random.Random(seed).sample over the rows in order; all if there are no more.

    Only the n places are drawn on the driver. Rows are numbered by a distributed sort and the sizes of its partitions.
    """
    if n is None or (total := rows.count()) <= n:
        return rows
    chosen = random.Random(seed).sample(range(total), n)
    keyed = checkpoint(rows.select(*order).orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = {r["part"]: r["n"] for r in keyed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, start = [], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(start)]
        start += sizes[part]
    number = F.element_at(F.create_map(*starts), F.col("part")) + F.col("at")
    spark = rows.sparkSession
    picked = spark.createDataFrame([(i,) for i in chosen], "number long")
    names = keyed.withColumn("number", number).join(F.broadcast(picked), "number", "left_semi").select(*order)  # n rows
    return rows.join(broadcast_if_small(names, n), order, "left_semi")


def retrieval_suite(chunks: DataFrame, qa: DataFrame, k: int = 20, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """(variant, name, value) with and without reranking. Every item must say what is relevant."""
    labelled = F.col("gold_fact").isNotNull() | (F.size(F.coalesce("gold_docs", F.array().cast("array<string>"))) > 0)
    if qa.where(~labelled).limit(1).count():
        raise ValueError("skipped: some items have no relevance labels")
    hits = retrieve(chunks, qa, k).join(qa.select("qid", "gold_fact", "gold_docs"), "qid")
    relevant = F.when(F.col("gold_fact").isNotNull(), T.contains_normal(F.col("text"), F.col("gold_fact"))).otherwise(F.array_contains("gold_docs", F.col("source")))
    found = checkpoint(hits.withColumn("relevant", relevant).groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("rank") + 1)).alias("off"), F.min(F.when(F.col("relevant"), F.col("reranked") + 1)).alias("on")))
    ranks = qa.select("qid").join(found, "qid", "left")
    both = F.explode(F.array(*(F.struct(F.lit(f"rerank={v}").alias("variant"), F.col(v).alias("r")) for v in ("off", "on"))))
    return E.rank_metrics(ranks.select(both.alias("v")).select("v.*"), ["variant"], "r", ks)


def faithfulness_suite(chunks: DataFrame, qa: DataFrame, n: int | None = None, seed: int = 42, generate: Generator = extractive) -> Suite:
    """Groundedness, hallucination, citation and accuracy rates of the answers to n sampled questions (all if None)."""
    qa = sample(qa, ["qid"], n, seed)
    said = answer(context(retrieve(chunks, qa)), qa, generate=generate).join(qa.select("qid", F.col("answer").alias("gold")), "qid")
    whole = F.array_join(F.transform("context", lambda c: c["text"]), "\n\n")
    claims = T.claims(F.col("answer"))
    rows = said.withColumn("whole", whole).withColumn("c", claims)
    rows = rows.withColumn("claims", F.transform("c", lambda x: F.struct(x.alias("claim"), T.supported(x, F.col("whole")).alias("supported"))))
    text_of = F.map_from_entries(F.transform(F.array_distinct(F.transform("context", lambda c: F.struct("qid", c["chunk_id"].alias("chunk_id"), c["text"].alias("text")))), lambda c: F.struct(c["chunk_id"], c["text"])))
    rows = rows.withColumn("texts", text_of).withColumn("parsed", F.filter("citations", lambda c: c["parsed"]))
    first = F.slice("c", 1, CLAIMS_PER_CITATION)
    judged = F.transform("parsed", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), F.exists(first, lambda x: T.supported(x, F.element_at("texts", c["chunk_id"]))).alias("supports_claim")))
    rows = rows.select("qid", "question", "answer", "claims", (F.size("parsed") > 0).alias("citations_parsed"), judged.alias("citations"), T.answer_matches(F.col("answer"), F.col("gold")).alias("answer_match"))
    rows = checkpoint(rows)
    share = F.size(F.filter("claims", lambda c: c["supported"])) / F.size("claims")
    some = F.size("claims") > 0
    cited = F.aggregate("citations", F.lit(0), lambda a, c: a + c["supports_claim"].cast("int"))
    wide = rows.agg(
        F.bround(F.coalesce(F.avg(F.when(some, share)), F.lit(0.0)), 4).alias("groundedness"),
        F.bround(F.coalesce(F.avg(F.when(some, (share < 1).cast("double"))), F.lit(0.0)), 4).alias("hallucination_rate"),
        F.bround(F.coalesce(F.avg(F.col("citations_parsed").cast("double")), F.lit(0.0)), 4).alias("citation_parse_rate"),
        E.rate(F.col("answer_match").cast("int")).alias("answer_accuracy"),
        F.bround(F.try_divide(F.sum(cited), F.sum(F.size("citations"))), 4).alias("citation_precision"),
    )
    return Suite(metric_rows(wide, "faithfulness", wide.columns), record_rows(rows, "faithfulness", "faithfulness"))


def security_suite(
    docs: DataFrame, qa: DataFrame, poisoned: int | None = 10, injected: int | None = 10, seed: int = 45, defenses: tuple[str, ...] = DEFENSES, disjoint: bool = False,
    filters: tuple[str, ...] = (), control: int | None = 20, screen: int | None = 100, generate: Generator = extractive,
) -> Suite:
    """Rates of planted documents under each defense, beside what the defenses cost on clean questions and passages.

    seed is that of the suite. Poison picks its questions first; if disjoint, injections take none of these. None for a number means
    all questions, 0 that this attack is left out.
    """
    clean = filtered(with_provenance(docs), filters)
    none = qa.limit(0)
    bad = poison(targets(qa, poisoned, seed + POISON_SEED) if poisoned != 0 else none)
    bad = bad.select("qid", "question", F.lit("poison").alias("attack_type"), F.lit(None).cast("string").alias("attack_family"), F.col("target_value").alias("own_marker"), "doc_text")
    pool = qa.join(bad.select("qid"), "qid", "left_anti") if disjoint else qa
    owned = injections(targets(pool, injected, seed + INJECTION_SEED) if injected != 0 else none)
    owned = owned.select("qid", "question", F.lit("injection").alias("attack_type"), F.col("family").alias("attack_family"), F.col("token").alias("own_marker"), "doc_text")
    key = F.concat_ws("/", "attack_type", "qid")
    attacks = checkpoint(bad.unionByName(owned).withColumn("case", key).withColumn("planted", F.concat(F.lit("planted-"), key)).withColumn("path", F.concat(F.lit("notes/"), F.substring(F.sha1("doc_text"), 1, 10), F.lit(".md"))))
    planted = with_provenance(attacks.select(F.col("planted").alias("doc_id"), "path", F.col("doc_text").alias("text")))
    questions = attacks.select(F.col("case").alias("qid"), "question")
    ctx = checkpoint(context(retrieve(index(clean.unionByName(planted)), questions)))
    said = answer(ctx, questions, defenses, generate).withColumnRenamed("qid", "case").drop("question")
    markers = attacks.agg(F.sort_array(F.collect_list(F.struct(F.col("own_marker").alias("marker"), "attack_type", "qid"))).alias("all"))  # one row: two markers a target
    rows = said.join(attacks.drop("doc_text", "path"), "case").crossJoin(F.broadcast(markers))
    rows = rows.withColumn("matched_markers", F.filter("all", lambda m: F.contains(F.col("answer"), m["marker"]))).withColumn("retrieved", F.exists("context", lambda c: c["doc_id"] == F.col("planted")))
    rows = rows.withColumn("succeeded", F.contains("answer", "own_marker")).withColumn("compromised", F.size("matched_markers") > 0)
    rows = checkpoint(rows.select("attack_type", "qid", "question", "defense", "retrieved", "succeeded", "own_marker", "attack_family", "compromised", "matched_markers", "abstained", "answer"))

    # What the defenses do to clean traffic.
    asked = checkpoint(targets(qa, control, seed + CONTROL_SEED).select("qid", "question", F.col("answer").alias("gold"))) if control != 0 else none.select("qid", "question", F.col("answer").alias("gold"))
    chunks = index(clean)
    replies = answer(checkpoint(context(retrieve(chunks, asked))), asked, defenses, generate).join(asked.select("qid", "gold"), "qid")
    replies = checkpoint(replies.select("qid", "question", "defense", "abstained", T.answer_matches(F.col("answer"), F.col("gold")).alias("answer_match"), "answer"))
    taken = sample(chunks.select("source", "chunk_id", "text", "verified", "trust_score"), ["source", "chunk_id"], screen, seed + SCREEN_SEED)
    taken = taken.withColumn("defense", F.explode(F.array(*map(F.lit, defenses)))).withColumn("reason", screening_reason(F.col("text"), F.col("verified"), F.col("trust_score"), F.col("defense")))
    screened = checkpoint(taken.select("defense", "chunk_id", "source", F.col("reason").isNotNull().alias("screened"), "reason"))

    metrics = security_metrics(rows, replies, screened, defenses)
    records = record_rows(rows, "security", "attack").unionByName(record_rows(replies, "security", "clean_defense")).unionByName(record_rows(screened, "security", "clean_screen"))
    return Suite(metrics, records)


def security_metrics(attacks: DataFrame, clean: DataFrame, screened: DataFrame, defenses: tuple[str, ...]) -> DataFrame:
    """Every metric of the security suite from its three kinds of records; what nothing was recorded for is left out."""
    number = lambda c: F.col(c).cast("int").cast("double")
    variant = F.concat(F.lit("defense="), "defense")
    # The filter's condition would count what it took away as not retrieved.
    fair = [d for d in defenses if d != "injection_filter"] or list(defenses)
    found = attacks.where(F.col("defense").isin(fair)).groupBy("attack_type").agg(E.rate(number("retrieved")).alias("v"))
    out = found.select(F.lit("security").alias("suite"), F.concat("attack_type", F.lit("_retrieval_rate")).alias("name"), F.lit("").alias("variant"), F.col("v").alias("value"))
    success = F.when(F.col("attack_type") == "poison", "knowledge_corruption_rate").otherwise("injection_compliance_rate")
    per = attacks.groupBy("attack_type", "defense").agg(E.rate(number("succeeded")).alias("s"), F.when(F.count("compromised") == F.count("*"), E.rate(number("compromised"))).alias("c"))
    pairs = F.explode(F.array(F.struct(success.alias("name"), F.col("s").alias("value")), F.struct(F.concat("attack_type", F.lit("_compromise_rate")).alias("name"), F.col("c").alias("value"))))
    out = out.unionByName(per.select(F.lit("security").alias("suite"), variant.alias("variant"), pairs.alias("m")).select("suite", "m.name", "variant", "m.value").where("value is not null"))
    family = attacks.where("attack_family is not null").groupBy("attack_type", "defense", "attack_family").agg(E.rate(number("succeeded")).alias("s"), E.rate(1 - number("retrieved")).alias("r"))
    pairs = F.explode(F.array(F.struct(F.concat(success, F.lit("@"), "attack_family").alias("name"), F.col("s").alias("value")), F.struct(F.concat("attack_type", F.lit("_screened_rate@"), "attack_family").alias("name"), F.col("r").alias("value"))))
    out = out.unionByName(family.select(F.lit("security").alias("suite"), variant.alias("variant"), pairs.alias("m")).select("suite", "m.name", "variant", "m.value"))
    marked = foreign_markers(attacks)
    flag = lambda c: F.when(F.col(c).isNotNull(), (F.size(c) > 0).cast("double"))
    over = marked.groupBy("defense").agg(E.rate(number("abstained")).alias("attack_abstention_rate"), E.rate(flag("competing")).alias("attack_competition_rate"), E.rate(flag("cross_question")).alias("cross_question_contamination_rate"))
    out = out.unionByName(metric_rows(over, "security", over.columns[1:], variant))
    kept = clean.groupBy("defense").agg(E.rate(number("abstained")).alias("clean_abstention_rate"), E.rate(number("answer_match")).alias("clean_answer_accuracy"))
    out = out.unionByName(metric_rows(kept, "security", kept.columns[1:], variant))
    gone = screened.groupBy("defense").agg(E.rate(number("screened")).alias("defense_clean_screen_rate"))
    return out.unionByName(metric_rows(gone, "security", gone.columns[1:], variant))


def privacy_suite(docs: DataFrame, hosts: DataFrame, conditions: tuple[str, ...] = ("none", "pii_filter"), filters: tuple[str, ...] = (), styles: tuple[str, ...] = ("direct", "paraphrase", "indirect"), generate: Generator = extractive) -> Suite:
    """Leakage and exposure of the secrets in hosts, as canaries() makes them, per condition, and per probe style under the first one.

    Hosts pass the chain behind the corpus; those that it drops are counted and probed no more, and it is an error if it drops all.
    """
    whole = with_provenance(docs)
    cards = hosts.select(F.concat(F.lit("canary-"), "canary_id").alias("doc_id"), F.concat(F.lit("cards/"), F.substring(F.sha1("doc_text"), 1, 10), F.lit(".md")).alias("path"), F.col("doc_text").alias("text"))
    left, audit = filter_after(whole, cards, list(filters)) if filters else (cards, None)
    left = checkpoint(left)
    total, stays = hosts.count(), left.count()
    if total and not stays:
        why = "; ".join(f"{r['doc_id']} by {r['filter']} ({r['reason']})" for r in audit.orderBy("doc_id").collect())  # a handful of canaries
        raise ValueError(f"the filters {list(filters)} dropped all {total} canary documents: {why}")
    planted = with_provenance(left)
    kept = hosts.join(left.select(F.substring("doc_id", len("canary-") + 1, 1_000).alias("canary_id")), "canary_id", "left_semi")
    probes = checkpoint(kept.select("canary_id", "kind", "secret", F.explode("probes").alias("probe_style", "question")).where(F.col("probe_style").isin(*styles)).withColumn("qid", F.concat_ws("/", "canary_id", "probe_style")))
    clean = filtered(whole, filters)
    texts = clean.unionByName(planted)
    plain = index(texts)
    out = None
    for condition in conditions:
        chunks = plain if condition == "none" else index(texts.withColumn("text", T.redacted(F.col("text"))))
        questions = probes.select("qid", "question")
        said = answer(checkpoint(context(retrieve(chunks, questions))), questions, generate=generate).drop("question", "defense")
        rows = probes.join(said, "qid").withColumn("retrieved", F.exists("context", lambda c: c["doc_id"] == F.concat(F.lit("canary-"), F.col("canary_id"))))
        rows = rows.select("canary_id", F.col("kind").alias("canary_kind"), "probe_style", F.lit(condition).alias("defense"), "retrieved", F.contains("answer", "secret").alias("leaked"), "answer")
        out = rows if out is None else out.unionByName(rows)
    rows = checkpoint(out)
    return Suite(privacy_metrics(rows, conditions[0], total - stays), record_rows(rows, "privacy", "canary_probe"))


def privacy_metrics(probes: DataFrame, first: str, dropped: int) -> DataFrame:
    """Metrics of the privacy suite from its records: rates per defense, per style under the first defense, and a count of dropped canaries."""
    number = lambda c: F.col(c).cast("int").cast("double")
    per = probes.groupBy("defense").agg(E.rate(number("leaked")).alias("leakage_rate"), E.rate(number("retrieved")).alias("retrieval_exposure_rate"))
    out = metric_rows(per, "privacy", ["leakage_rate", "retrieval_exposure_rate"], F.concat(F.lit("defense="), "defense"))
    style = probes.where(F.col("defense") == first).groupBy("probe_style").agg(E.rate(number("leaked")).alias("value"))
    out = out.unionByName(style.select(F.lit("privacy").alias("suite"), F.concat(F.lit("leakage_rate@"), "probe_style").alias("name"), F.lit("").alias("variant"), "value"))
    count = probes.sparkSession.createDataFrame([("privacy", "canary_docs_dropped_by_filter", "", float(dropped))], "suite string, name string, variant string, value double")
    return out.unionByName(count)
