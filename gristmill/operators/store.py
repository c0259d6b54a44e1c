"""Result store on Parquet: runs replace their own partitions, reads take the last version of each row."""

from __future__ import annotations

import hashlib
import json
import secrets
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.drift import instant
from gristmill.operators.filters import last_per_key

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"  # Fixed value: Crockford's base 32.


def new_run_id() -> str:
    """A ULID: 48 bits of milliseconds, 80 random bits."""
    number = (int(time.time() * 1000) << 80) | secrets.randbits(80)
    return "".join(ALPHABET[number >> 5 * i & 31] for i in range(25, -1, -1))


def canonical_json(spec: dict) -> str:
    return json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def spec_hash(spec: dict) -> str:
    return hashlib.sha256(canonical_json(spec).encode()).hexdigest()


class ResultStore:
    """Tables runs, metrics, records, stage_timings and suite_results under one folder.

    A run's rows are one partition per table; saving again replaces just that partition, so a job
    that was retried leaves one copy.
    """

    TABLES = ("runs", "metrics", "records", "stage_timings", "suite_results")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, table: str, rows: DataFrame) -> None:
        if table not in self.TABLES:
            raise ValueError(f"no table {table!r}")
        key = "id" if table == "runs" else "run_id"
        if table != "runs":
            rows = rows.withColumn("_run", F.col("run_id"))
        else:
            rows = rows.withColumn("_run", F.col(key))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run").parquet(f"{self.folder}/{table}")

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{table}")
        return (rows if run_id is None else rows.where(F.col("_run") == run_id)).drop("_run")

    def page(self, run_id: str, suite: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = self.read("records", run_id)
        return (rows if suite is None else rows.where(F.col("suite") == suite)).orderBy("id").offset(offset).limit(limit)


def latest_results(results: DataFrame) -> DataFrame:
    """Of artifacts sent again, the last by time of writing."""
    return last_per_key(results.where("run_id is not null"), ["run_id"], ["written_at", "result_id"])


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.withColumn("created", instant("created_at")).orderBy(F.desc_nulls_last("created"), F.desc("id")).limit(limit).drop("created")


def next_pending(runs: DataFrame) -> DataFrame:
    """The head of the queue: the oldest run that waits."""
    return runs.where("status = 'pending'").withColumn("created", instant("created_at")).orderBy(F.asc_nulls_last("created"), "id").limit(1).drop("created")


def drill_down(records: DataFrame, needle: str | None = None, **equal: str) -> DataFrame:
    """Records whose columns equal the given texts and whose payload contains the needle in any case."""
    for name, value in equal.items():
        records = records.where(F.col(name).cast("string") == value)
    return records if needle is None else records.where(F.contains(F.lower("payload_json"), F.lit(needle.lower())))
