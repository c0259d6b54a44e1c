"""The audited filter chain of ingestion, provenance, and the guard on drop rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.functions.filtering import with_steps
from gristmill.session import checkpoint

REASONS = {"dedup": "exact_duplicate", "language": "not_english", "boilerplate": "too_little_content", "pii": "redacted"}


def path_key(path: str = "path") -> Column:
    """Paths are ordered component by component."""
    return F.split(F.col(path), "/")


def keep_first(docs: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """Of documents with equal normalised text, the first in order; by groups keep their own firsts.

    A minimum over ordering keys per digest, so that a text with most of the rows is reduced before
    the shuffle; null texts count as empty.
    """
    by = by or []
    keyed = docs.withColumn("_digest", F.sha1(T.normal(F.coalesce("text", F.lit(""))))).withColumn("_order", F.struct(*order, "doc_id"))
    first = keyed.groupBy(*by, "_digest").agg(F.min("_order").alias("_order"))
    return keyed.join(first, [*by, "_digest", "_order"], "left_semi").drop("_digest", "_order")


def apply_filter(docs: DataFrame, name: str, order: list[Column] | None = None) -> DataFrame:
    """One named filter; texts may change, ids don't."""
    if name == "dedup":
        return keep_first(docs, order or [path_key()])
    text, passes = row_filter(name)
    return docs.withColumn("text", text).where(passes)


def row_filter(name: str) -> tuple[Column, Column]:
    """A filter that looks at one document: the text it leaves, and whether that text stays."""
    text = F.coalesce("text", F.lit(""))
    if name == "language":
        return F.col("text"), T.is_english(text)
    if name == "boilerplate":
        return T.without_boilerplate(text), F.length("text") >= T.LEAST_CHARS
    if name == "pii":
        return T.redacted(text), F.lit(True)
    raise ValueError(f"unknown filter {name!r}; there are {', '.join(REASONS)}")


def _checked(names: list[str]) -> list[str]:
    for name in names:
        if name not in REASONS:
            raise ValueError(f"unknown filter {name!r}; there are {', '.join(REASONS)}")
    return names


def outcomes(docs: DataFrame, chains: list[list[str]], chain: Column, group: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """(group, doc_id, dropped): which filter of its chain, counted from 0, drops a document; null if none does.

    chain is an array of names, one of the chains. Each text is read once, in one pass that leaves digests and
    flags; what follows are aggregations and joins over these, one for each place in which a chain has dedup. Of equal
    texts of a group the first in order, ties by doc_id, stays.
    """
    places = sorted({i for names in chains for i, n in enumerate(_checked(names)) if n == "dedup"})
    rows = docs.select((F.lit(0) if group is None else group).alias("group"), "doc_id", F.struct(*(order or [path_key()]), "doc_id").alias("order"), "text", chain.alias("chain"))
    state = with_steps(rows, ["group", "doc_id", "order"], "chain")
    failed = F.array_position(F.transform("steps", lambda x: F.coalesce(x["ok"], F.lit(True))), False) - 1
    state = state.select("group", "doc_id", "order", F.when(failed >= 0, failed.cast("int")).alias("dropped"), *(F.get("steps", F.lit(i))["digest"].alias(f"d{i}") for i in places))
    state = checkpoint(state) if places else state  # narrow, and read twice for each place
    for i in places:
        inside = F.col(f"d{i}").isNotNull() & (F.col("dropped").isNull() | (F.col("dropped") > i))
        first = state.where(inside).groupBy("group", F.col(f"d{i}").alias("digest")).agg(F.min("order").alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("group").alias("g"), "digest", "first")
        joined = state.join(first, (F.col("group") == F.col("g")) & (F.col(f"d{i}") == F.col("digest")), "left")
        copy = inside & F.col("first").isNotNull() & (F.col("order") != F.col("first"))
        state = joined.withColumn("dropped", F.when(copy, i).otherwise(F.col("dropped"))).drop("g", "digest", "first")
    return state.select("group", "doc_id", "dropped")


def dropped(docs: DataFrame, names: list[str], order: list[Column] | None = None) -> DataFrame:
    """(filter_no, filter, doc_id, reason) of each document that a chain of filters drops, in the order given."""
    listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    reasons = F.array(*(F.lit(REASONS[n]) for n in _checked(names))) if names else F.array().cast("array<string>")
    gone = outcomes(docs, [names], listed, order=order).where("dropped is not null")
    return gone.select(F.col("dropped").alias("filter_no"), F.get(listed, F.col("dropped")).alias("filter"), "doc_id", F.get(reasons, F.col("dropped")).alias("reason"))


def rewritten(docs: DataFrame, names: list[str]) -> DataFrame:
    """Documents with the texts that the chain's filters leave, whether they stay or not."""
    for name in names:
        if name != "dedup":
            docs = docs.withColumn("text", row_filter(name)[0])
    return docs


def apply_filters(docs: DataFrame, names: list[str], order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents that are left, with their texts as the filters leave them, and dropped() of the others.

    Rows of equal doc_id are the same document.
    """
    gone = dropped(docs, names, order)
    return rewritten(docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns), names), gone


def filter_after(corpus: DataFrame, batch: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Filter a second batch behind a corpus: the corpus's copy of a text always wins; only the batch's outcome returns.

    Ids that both have are an error.
    """
    if corpus.select("doc_id").join(batch.select("doc_id"), "doc_id", "left_semi").limit(1).count():
        raise ValueError("the second batch has ids of the corpus")
    both = corpus.select("doc_id", "path", "text").withColumn("_batch", F.lit(0)).unionByName(batch.select("doc_id", "path", "text").withColumn("_batch", F.lit(1)))
    own = dropped(both, names, [F.col("_batch"), path_key()]).join(batch.select("doc_id"), "doc_id", "left_semi").select("filter_no", "filter", "doc_id", "reason")
    left = batch.select("doc_id", "path", "text").join(own.select("doc_id"), "doc_id", "left_anti")
    return rewritten(left, names), own


def drop_rates(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """(corpus, filter_no, filter, loaded, dropped, rate, exceeds) of each filter of each specification.

    The rate is over all loaded documents, and exceeds is null where the specification has no limit.
    All specifications, a handful that the driver reads, take one pass over the documents.
    """
    known = [(r["spec_id"], r["documents"], list(r["filters"] or []), r["max_filter_drop_rate"]) for r in specs.orderBy("spec_id").collect()]
    spark = docs.sparkSession
    table = spark.createDataFrame(known, "spec_id int, documents string, filters array<string>, most double")
    own = docs.select("doc_id", "path", "text", "corpus").join(F.broadcast(table.where("size(filters) > 0").select("spec_id", F.col("documents").alias("corpus"), "filters")), "corpus")  # as many rows as specifications
    counted = outcomes(own, [names for _, _, names, _ in known], F.col("filters"), F.col("spec_id")).groupBy("group", "dropped").agg(F.count("*").alias("n"))
    per = counted.groupBy("group").agg(F.sum("n").alias("loaded"), F.map_from_entries(F.collect_list(F.struct(F.coalesce("dropped", F.lit(-1)), "n"))).alias("by"))
    listed = table.select("spec_id", F.col("documents").alias("corpus"), "most", F.posexplode("filters").alias("filter_no", "filter"))
    rows = listed.join(F.broadcast(per), F.col("spec_id") == F.col("group"), "left").withColumn("loaded", F.coalesce("loaded", F.lit(0))).withColumn("dropped", F.coalesce(F.try_element_at("by", F.col("filter_no")), F.lit(0)))  # a row a specification
    rate = F.when(F.col("loaded") > 0, F.col("dropped") / F.col("loaded")).otherwise(0.0)
    return rows.select("corpus", "filter_no", "filter", "loaded", "dropped", F.bround(rate, 4).alias("rate"), (rate > F.col("most")).alias("exceeds"))


def guard(docs: DataFrame, specs: DataFrame) -> None:
    """Raise if any filter of any specification drops more than it may."""
    bad = drop_rates(docs, specs).where("exceeds").collect()
    if bad:
        raise ValueError("; ".join(f"{r['corpus']}: {r['filter']} drops {r['rate']:.4f}" for r in bad))


def provenance(channel: Column) -> Column:
    """Trust by the channel a document came through, whatever it says about itself."""
    trusted = channel == "trusted_corpus"
    return F.struct(channel.alias("source_type"), F.coalesce(trusted, F.lit(False)).alias("verified"), F.when(trusted, 1.0).when(channel == "user_upload", 0.2).otherwise(0.0).alias("trust_score"))


def is_trusted(origin: Column) -> Column:
    return origin["verified"] & (origin["trust_score"] >= 0.5)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, reduced before the shuffle."""
    everything = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(everything, F.struct(*order)).alias("_r")).select("_r.*")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Places from 0 within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
