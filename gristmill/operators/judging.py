"""Judgments whether contexts support claims: by rule, or by a model with a cache of its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.session import checkpoint

# Version of the wording, which is part of each key, and what stands around context and claim.
VERSION = "v1"
BEFORE, BETWEEN, AFTER = "Context:\n", "\n\nClaim: ", "\n\nSupported? Answer YES or NO:"
MODES = ("auto", "cached", "live")


class CacheMiss(LookupError):
    """A judgment is not in the cache, which is the only source in this mode."""


def key(claim: Column, context: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(VERSION), F.lit(model), claim, context).cast("binary"), 256)


def verdict(said: Column, claim: Column, context: Column) -> Column:
    """(supported, parse_ok) from what a model said: its first word, or the rule where that is neither YES nor NO."""
    word = F.upper(T.strip(F.coalesce(said, F.lit(""))))
    yes, no = F.startswith(word, F.lit("YES")), F.startswith(word, F.lit("NO"))
    return F.struct(F.when(yes, True).when(no, False).otherwise(T.supported(claim, context)).alias("supported"), (yes | no).alias("parse_ok"))


def judge(pairs: DataFrame, model: str, mode: str = "auto", cache: DataFrame | None = None, ask=None) -> tuple[DataFrame, DataFrame]:
    """The pairs (claim, context and any other columns) with supported, parse_ok and cached; and the new rows (key, supported) of the cache.

    cache has (key, supported), one row per key. auto asks the model for what the cache lacks, cached raises instead, live asks for all.
    ask is a function of a column of prompts that gives a column of replies, once for each distinct pair. Null claims or contexts count as empty.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    rows = pairs.withColumn("_claim", F.coalesce("claim", F.lit(""))).withColumn("_context", F.coalesce("context", F.lit("")))
    rows = rows.withColumn("_key", key(F.col("_claim"), F.col("_context"), model))
    distinct = rows.select("_key", "_claim", "_context").groupBy("_key").agg(F.first("_claim").alias("_claim"), F.first("_context").alias("_context"))
    if mode == "live" or cache is None:
        known, todo = None, distinct
        if mode == "cached":
            raise ValueError("mode cached needs a cache")
    else:
        known = distinct.select("_key").join(cache.select(F.col("key").alias("_key"), "supported"), "_key")
        todo = distinct.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti")
    if mode == "cached":
        missing = todo.select("_claim").limit(1).collect()
        if missing:
            raise CacheMiss(f"no judgment of the claim {missing[0][0][:60]!r} in the cache; run in mode auto to add it")
        fresh = todo.select("_key", F.lit(None).cast("boolean").alias("supported"), F.lit(True).alias("parse_ok"))
    else:
        prompt = F.concat(F.lit(BEFORE), F.col("_context"), F.lit(BETWEEN), F.col("_claim"), F.lit(AFTER))
        fresh = todo.withColumn("_said", ask(prompt)).select("_key", verdict(F.col("_said"), F.col("_claim"), F.col("_context")).alias("v")).select("_key", "v.*")
        fresh = checkpoint(fresh)  # models are asked once, whoever reads the result
    found = fresh.withColumn("cached", F.lit(False))
    if known is not None:
        found = found.unionByName(known.select("_key", "supported", F.lit(True).alias("parse_ok"), F.lit(True).alias("cached")))
    return rows.join(found, "_key").drop("_key", "_claim", "_context"), fresh.select(F.col("_key").alias("key"), "supported")


def append(cache: DataFrame, folder: str) -> None:
    """Add judgments to a cache of JSON lines; a file of a later run has a later name, so the last of repeated keys counts."""
    cache.write.mode("append").json(folder)
