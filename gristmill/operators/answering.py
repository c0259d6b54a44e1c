"""Answers from contexts under defenses: screening, conflict resolution, abstention, generation, citations.

All questions and all defenses go through together, as rows keyed by (defense, qid); a context is at most
some passages a question, so its arrays are small whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.filters import is_trusted
from gristmill.operators.retrieval import extractive_answers

DEFENSES = ("none", "prompt_isolation", "injection_filter", "answer_integrity")

# What is said, and the reason given, when no answer is.
UNTRUSTED_TEXT = "The retrieved evidence has no sufficiently trusted source. I cannot provide a reliable answer."
CONFLICT_HEAD, CONFLICT_TAIL = "The retrieved sources conflict (", "). I cannot provide a reliable answer from the available evidence."
CONFLICT_REASON, UNTRUSTED_REASON = "conflicting_sources_without_a_unique_verified_winner", "no_sufficiently_trusted_source"
INJECTED_REASON, PROVENANCE_REASON = "resembles_injected_instruction", "untrusted_provenance"

KEYS = ["defense", "qid"]
#: (context rows of keys, questions of keys) -> (defense, qid, answer).
Generator = Callable[[DataFrame, DataFrame], DataFrame]


def screening_reason(text: Column, verified: Column, trust: Column, defense: Column) -> Column:
    """Why a defense takes a passage out of a context by itself; null where it stays."""
    trusted = verified & (trust >= 0.5)
    return F.when((defense == "injection_filter") & T.looks_injected(text), INJECTED_REASON).when((defense == "answer_integrity") & ~F.coalesce(trusted, F.lit(False)), PROVENANCE_REASON)


def numeric_claims(context: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit, value, doc_id, chunk_id, verified, trust_score): each quantity once per document, at its first passage by rank."""
    each = context.select(*keys, "rank", "doc_id", "chunk_id", "verified", "trust_score", F.explode(T.quantities(F.coalesce("text", F.lit("")))).alias("q"))
    first = each.groupBy(*keys, "doc_id", F.col("q.unit").alias("unit"), F.col("q.value").alias("value")).agg(F.min_by(F.struct("chunk_id", "verified", "trust_score"), "rank").alias("c"))
    return first.select(*keys, "unit", "value", "doc_id", "c.chunk_id", "c.verified", "c.trust_score")


def resolve(context: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, conflicts, decided) of the contexts whose documents contradict one another, and (keys, chunk_id) of the passages that lost.

    A unit is in conflict if at least two documents assert different values for it. A value's evidence is the sum over documents
    of the trust with which each asserts it; the most, the smaller number on ties, wins if some of it is verified and it is
    strictly ahead. One unit without a winner leaves the whole question undecided; then nothing loses.
    """
    claims = numeric_claims(context, keys)
    per = claims.groupBy(*keys, "unit", "value").agg(F.collect_set("doc_id").alias("docs"), F.sum("trust_score").alias("score"), F.bool_or("verified").alias("ok"), F.collect_set("chunk_id").alias("chunks"))
    value = F.struct((-F.col("score")).alias("s"), F.col("value").cast("double").alias("n"), "value", "ok", "docs", "chunks")
    units = per.groupBy(*keys, "unit").agg(F.array_sort(F.collect_list(value)).alias("v"))
    many = F.size(F.array_distinct(F.flatten(F.transform("v", lambda x: x["docs"])))) > 1
    units = units.where((F.size("v") > 1) & many)
    decided = F.col("v")[0]["ok"] & (F.col("v")[0]["s"] < F.col("v")[1]["s"])
    values = F.transform(F.array_sort(F.transform("v", lambda x: F.struct(x["n"].alias("n"), x["value"].alias("value")))), lambda x: x["value"])
    units = units.select(*keys, "unit", values.alias("values"), decided.alias("decided"), F.flatten(F.transform(F.slice("v", 2, 1_000_000), lambda x: x["chunks"])).alias("lost"))
    whole = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("unit", "values"))).alias("conflicts"), F.bool_and("decided").alias("decided"), F.array_distinct(F.flatten(F.collect_list("lost"))).alias("lost"))
    return whole.select(*keys, "conflicts", "decided"), whole.where("decided").select(*keys, F.explode("lost").alias("chunk_id"))


def conflict_text(conflicts: Column) -> Column:
    details = F.array_join(F.transform(conflicts, lambda c: F.concat(c["unit"], F.lit(": "), F.array_join(c["values"], ", "))), "; ")
    return F.concat(F.lit(CONFLICT_HEAD), details, F.lit(CONFLICT_TAIL))


def extractive(context: DataFrame, questions: DataFrame) -> DataFrame:
    """The generator that quotes: it reads no system prompt, so isolation changes nothing."""
    key = lambda df: df.withColumn("qid", F.to_json(F.struct("defense", "qid")))
    said = extractive_answers(key(context), key(questions))
    both = F.from_json("qid", "defense string, qid string")
    return said.select(both.alias("k"), "answer").select("k.defense", "k.qid", "answer")


def citations(answer: Column, context: Column) -> Column:
    """Array of (chunk_id, marker, parsed): the markers of an answer within its context, by first appearance; all passages, not parsed, if there are none."""
    parsed = F.transform(T.markers(answer, F.size(context)), lambda m: F.struct(F.element_at(context, m)["chunk_id"].alias("chunk_id"), m.alias("marker"), F.lit(True).alias("parsed")))
    whole = F.transform(context, lambda c, i: F.struct(c["chunk_id"].alias("chunk_id"), (i + 1).cast("int").alias("marker"), F.lit(False).alias("parsed")))
    return F.when(F.size(parsed) > 0, parsed).otherwise(whole)


def answer(context: DataFrame, questions: DataFrame, defenses: tuple[str, ...] = ("none",), generate: Generator = extractive) -> DataFrame:
    """(defense, qid, question, answer, abstained, reason, context, citations) of every question under every defense.

    context has (qid, rank, chunk_id, doc_id, source, section, text, verified, trust_score), at most a few rows a
    question. injection_filter drops what looks like an instruction; answer_integrity resolves contradicting quantities or
    abstains, then drops untrusted passages, and abstains if none is left. A question without context is answered from none.
    """
    unknown = set(defenses) - set(DEFENSES)
    if unknown:
        raise ValueError(f"unknown defenses {sorted(unknown)}")
    listed = F.explode(F.array(*map(F.lit, defenses))).alias("defense")
    asked = questions.select("qid", "question", listed)
    rows = context.select("qid", "rank", "chunk_id", "doc_id", "source", "section", "text", "verified", "trust_score", listed)
    rows = rows.where(~((F.col("defense") == "injection_filter") & T.looks_injected(F.coalesce("text", F.lit("")))))
    checked = rows.where("defense = 'answer_integrity'")
    found, lost = resolve(checked, KEYS)
    undecided = found.where("not decided").select(*KEYS, "conflicts")
    whole = rows.join(undecided.select(*KEYS, F.lit(True).alias("stuck")), KEYS, "left")
    whole = whole.join(lost.withColumn("lost", F.lit(True)), [*KEYS, "chunk_id"], "left").where(F.col("lost").isNull()).drop("lost")
    trusted = F.coalesce(is_trusted(F.struct("verified", "trust_score")), F.lit(False))
    kept = whole.where((F.col("defense") != "answer_integrity") | F.coalesce("stuck", F.lit(False)) | trusted)
    place = Window.partitionBy(*KEYS).orderBy("rank")
    kept = kept.withColumn("rank", F.row_number().over(place) - 1)
    one = F.struct("rank", "chunk_id", "doc_id", "source", "section", "text")
    arrays = kept.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("context"))
    none = F.array().cast("array<struct<rank:int,chunk_id:string,doc_id:string,source:string,section:string,text:string>>")
    base = asked.join(arrays, KEYS, "left").join(undecided, KEYS, "left").withColumn("context", F.coalesce(F.col("context").cast(none_type(arrays)), none.cast(none_type(arrays))))
    reason = F.when(F.col("conflicts").isNotNull(), CONFLICT_REASON).when((F.col("defense") == "answer_integrity") & (F.size("context") == 0), UNTRUSTED_REASON)
    base = base.withColumn("reason", reason)
    said = generate(kept, base.where("reason is null").select(*KEYS, "question"))
    text = F.when(F.col("reason") == CONFLICT_REASON, conflict_text(F.col("conflicts"))).when(F.col("reason") == UNTRUSTED_REASON, UNTRUSTED_TEXT).otherwise(F.col("answer"))
    out = base.join(said, KEYS, "left").withColumn("answer", text).withColumn("abstained", F.col("reason").isNotNull())
    cited = F.when(~F.col("abstained"), citations(F.col("answer"), F.col("context")))
    return out.select("defense", "qid", "question", "answer", "abstained", "reason", "context", F.coalesce(cited, F.array().cast("array<struct<chunk_id:string,marker:int,parsed:boolean>>")).alias("citations"))


def none_type(arrays: DataFrame) -> str:
    return arrays.schema["context"].dataType.simpleString()
