"""Ingestion as one operation: load, filter, guard, chunk, embed, save, audit; or reuse of what it made before."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.config import RunSpec
from gristmill.operators.chunking import chunk
from gristmill.operators.filters import apply_filters, provenance
from gristmill.operators.retrieval import VectorIndex
from gristmill.session import checkpoint
from gristmill.sources.loaders import load_corpus


class DropRateExceeded(ValueError):
    """A filter dropped a larger share of the loaded documents than the specification allows."""


class NothingToIndex(ValueError):
    """No chunk is left to be embedded."""


def build_index(spark: SparkSession, spec: RunSpec, folder: str, documents: DataFrame | None = None, channel: str = "trusted_corpus") -> tuple[VectorIndex, dict]:
    """The index of a specification's corpus, saved under its fingerprint, and the audit of how it came about.

    documents (doc_id, path, text) may be given instead of files. The audit has what was loaded, skipped and dropped, by which filter and
    why, and the numbers of chunks. It is written last: an index without it is not there.
    """
    if documents is None:
        loaded, skipped = load_corpus(spark, spec.corpus.documents)
        documents = loaded.withColumnRenamed("source", "path").select("doc_id", "path", "text", "title", "filetype")
        by_suffix = {r["suffix"]: r["n"] for r in skipped.groupBy("suffix").agg(F.count("*").alias("n")).collect()}  # a row a suffix
    else:
        by_suffix = {}
    documents = checkpoint(documents)
    total = documents.count()
    names = list(spec.ingest.filters)
    kept, gone = apply_filters(documents, names)
    gone = checkpoint(gone)
    counts = {r["filter_no"]: r["n"] for r in gone.groupBy("filter_no").agg(F.count("*").alias("n")).collect()}
    filters = [{"filter": n, "dropped": counts.get(i, 0), "rate": round(counts.get(i, 0) / total, 4) if total else 0.0} for i, n in enumerate(names)]
    most = spec.ingest.max_filter_drop_rate
    for i, n in enumerate(names):
        if most is not None and total and counts.get(i, 0) / total > most:
            raise DropRateExceeded(f"filter {n!r} dropped {counts[i]} of {total} documents, more than {most:.0%}")
    chunker = spec.ingest.chunker
    marked = kept.withColumn("origin", provenance(F.lit(channel)))
    chunks = chunk(marked, chunker.type, chunker.size_tokens, chunker.overlap_tokens, keep=("path", "origin"))
    chunks = checkpoint(chunks.select("doc_id", "chunk_no", "chunk_id", "start", "end", F.col("path").alias("source"), "section", "chunk", "origin.*"))
    amount = chunks.count()
    if not amount:
        raise NothingToIndex("no chunk is left after filtering")
    print_ = spec.ingest_fingerprint()
    index = VectorIndex.build(chunks, print_)
    index.save(f"{folder}/{print_}")
    gone.write.mode("overwrite").parquet(f"{folder}/{print_}/dropped")
    audit = {
        "built_at": datetime.now(UTC).isoformat(timespec="seconds"), "fingerprint": print_, "loaded": total, "kept": total - sum(counts.values()), "chunks": amount, "skipped_by_suffix": by_suffix, "filters": filters,
    }
    spark.createDataFrame([(json.dumps(audit, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{print_}/audit")
    return index, audit


def load_or_build(spark: SparkSession, spec: RunSpec, folder: str, documents: DataFrame | None = None) -> tuple[VectorIndex, dict, bool]:
    """The index, its audit and whether it was there: reused only if both its description and its audit are, under this fingerprint."""
    at = f"{folder}/{spec.ingest_fingerprint()}"
    try:
        audit = json.loads(spark.read.text(f"{at}/audit").first()[0])
        return VectorIndex.load(spark, at, spec.ingest_fingerprint()), audit, True
    except Exception as error:  # nothing there, or not what it should be
        if "PATH_NOT_FOUND" not in str(error) and not isinstance(error, (ValueError, TypeError)):
            raise
    return (*build_index(spark, spec, folder, documents), False)
