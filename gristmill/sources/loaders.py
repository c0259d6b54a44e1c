"""Documents from files: a recursive scan, a registry of loaders by suffix, and a record of what was skipped."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import short_sha1

BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "blockquote")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

QA_SCHEMA = "qid string, question string, answer string, gold_doc string, gold_fact string, gold_docs array<string>, label_source string"


class _Reader(HTMLParser):
    """Texts of block elements in document order, each with all text inside it; and the title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, int | None]] = []
        self.hidden = 0
        self.title: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        place = None
        if tag in BLOCKS:
            place = len(self.found)
            self.found.append((tag, []))
        self.open.append((tag, place))

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1
        if tag == "title":
            self.in_title = False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if self.hidden or not data.strip():
            return
        for _, place in self.open:
            if place is not None:
                self.found[place][1].append(data.strip())


def html_text(source: str) -> tuple[str, str | None]:
    """(text, title): blocks parted by blank lines, headings marked with as many # as their level."""
    reader = _Reader()
    reader.feed(source)
    reader.close()
    lines = []
    for tag, parts in reader.found:
        if content := " ".join(parts):
            lines.append(f"{'#' * int(tag[1])} {content}" if tag[0] == "h" and tag[1:].isdigit() else content)
    return "\n\n".join(lines), None if reader.title is None else "".join(reader.title).strip()


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")


def load_text(data: bytes, stem: str) -> tuple[str, str]:
    return plain_text(data), stem


def load_markdown(data: bytes, stem: str) -> tuple[str, str]:
    text = plain_text(data)
    return text, next((line[2:].strip() for line in text.split("\n") if line.startswith("# ")), stem)


def load_html(data: bytes, stem: str) -> tuple[str, str]:
    text, title = html_text(plain_text(data))
    return text, stem if title is None else title


def load_pdf(data: bytes, stem: str) -> tuple[str, str]:
    """Pages parted by blank lines; needs pypdf, without which the file is skipped with that reason."""
    import io

    from pypdf import PdfReader

    return "\n\n".join((page.extract_text() or "") for page in PdfReader(io.BytesIO(data)).pages).strip(), stem


LOADERS: dict[str, Callable[[bytes, str], tuple[str, str]]] = {".txt": load_text, ".md": load_markdown, ".html": load_html, ".htm": load_html, ".pdf": load_pdf}


def register_loader(suffix: str, loader: Callable[[bytes, str], tuple[str, str]]) -> None:
    LOADERS[suffix.lower()] = loader


def suffix_of(path) -> object:
    """Lower-cased suffix with its dot, "<none>" where there is none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)), F.lit("")), F.lit("<none>"))


def load_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) of all files under root.

    documents: doc_id, source (path under root), text, title, filetype; skipped: source, suffix, reason,
    detail. Order is that of split(source, "/"). Files are read where they are parsed, one by one.
    """
    loaders = dict(LOADERS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/").removeprefix("file://")
    source = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/*", "/"), "^\\Q" + prefix + "\\E/", "")
    listed = files.select(source.alias("source"), "content").withColumn("suffix", suffix_of(F.col("source")))

    @F.pandas_udf("text string, title string, error string")
    def parse(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for name, data in zip(names, contents):
            path = PurePosixPath(name)
            try:
                rows.append((*loaders[path.suffix.lower()](bytes(data), path.stem), None))
            except Exception as error:  # a file that can't be read is a record, not a failed job
                rows.append((None, None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["text", "title", "error"])

    known = listed.where(F.col("suffix").isin(*loaders)).withColumn("p", parse("source", "content"))
    documents = known.where("p.error is null").select(short_sha1(F.col("source"), F.col("p.text")).alias("doc_id"), "source", F.col("p.text").alias("text"), F.col("p.title").alias("title"), F.substring("suffix", 2, 10).alias("filetype"))
    failed = known.where("p.error is not null").select("source", "suffix", F.lit("loader_error").alias("reason"), F.col("p.error").alias("detail"))
    other = listed.where(~F.col("suffix").isin(*loaders)).select("source", "suffix", F.lit("unsupported_suffix").alias("reason"), F.lit(None).cast("string").alias("detail"))
    return documents, failed.unionByName(other)


def load_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; a malformed line or a file without questions is an error.

    label_source, only where a line lacks the key, says whether there are labels: a gold fact, gold documents or an answer.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = spark.read.schema(QA_SCHEMA).option("mode", "FAILFAST").json(path)
    if not lines.limit(1).count():
        raise ValueError(f"no questions in {path}")
    keyed = lines.select(F.from_json("value", QA_SCHEMA, {"mode": "FAILFAST"}).alias("q"), F.coalesce(F.array_contains(F.json_object_keys("value"), "label_source"), F.lit(False)).alias("named")).select("q.*", "named")
    docs = F.coalesce("gold_docs", F.array().cast("array<string>"))
    labelled = F.col("gold_fact").isNotNull() | (F.size(docs) > 0) | (F.length("answer") > 0)
    default = F.when(F.coalesce(labelled, F.lit(False)), "legacy").otherwise("none")
    return keyed.withColumn("gold_docs", docs).withColumn("label_source", F.when(F.col("named"), F.col("label_source")).otherwise(default)).select(*rows.columns)


def load_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(key, supported): of repeated keys the last line counts, files in order of their names."""
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.text(path).select(F.from_json("value", "key string, supported boolean").alias("j"), place.alias("line"))
    return rows.where("j.key is not null").groupBy("j.key").agg(F.max_by("j.supported", "line").alias("supported"))


def qrels(rows: DataFrame) -> DataFrame:
    """(qid, gold_docs) from (query-id, corpus-id, score): documents of positive score, each once, in order."""
    return rows.where("score > 0").groupBy(F.col("query-id").alias("qid")).agg(F.array_sort(F.collect_set("corpus-id")).alias("gold_docs"))


def load_spec(text: str) -> dict:
    """A run's specification from YAML (or JSON, where PyYAML is missing); it must be a mapping."""
    try:
        import yaml

        spec = yaml.safe_load(text)
    except ImportError:
        spec = json.loads(text)
    if not isinstance(spec, dict):
        raise ValueError("a specification is a mapping")
    return spec


def load_relevance(spark: SparkSession, folder: str, corpus: str = "corpus.jsonl", queries: str = "queries.jsonl", judgments: str = "qrels/test.tsv") -> tuple[DataFrame, DataFrame]:
    """(documents, questions) from a benchmark's folder: JSON lines of texts and of queries, a table of judgments with a header.

    Questions are those with a judgment above 0, in order of their ids, numbers as numbers; a document's text follows its title.
    """
    texts = spark.read.schema("_id string, title string, text string").json(f"{folder}/{corpus}")
    body = F.concat_ws("\n\n", F.when(F.length("title") > 0, F.concat(F.lit("# "), F.col("title"))), F.coalesce("text", F.lit("")))
    documents = texts.select(F.col("_id").alias("doc_id"), F.concat("_id", F.lit(".md")).alias("path"), body.alias("text"), "title")
    found = qrels(spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score double").csv(f"{folder}/{judgments}"))
    asked = spark.read.schema("_id string, text string").json(f"{folder}/{queries}").select(F.col("_id").alias("qid"), F.col("text").alias("question"))
    questions = asked.join(found, "qid").withColumn("gold_docs", F.transform("gold_docs", lambda d: F.concat(d, F.lit(".md")))).withColumn("label_source", F.lit("qrels"))
    return documents, questions.orderBy(F.col("qid").try_cast("bigint").asc_nulls_last(), "qid")
