"""Pieces of texts over a size limit, packed from the tree of their structure.

A text is a tree: sections by the levels of their headings (of Markdown, outside fenced code, or of HTML), then
blocks between blank lines or block tags, items of lists by their indentation, lines, sentences,
words and, for a word longer than a piece, characters. Bottom-up, sibling subtrees are merged from left to
right while they fit; only a node that is too large itself is opened. Sections merge with sections
only: what is left over from an opened section never takes in what follows under a later heading. Inside one
section, the rest of an opened block, item, line or sentence may take in what comes next. Pieces tile
the text; each but the first also repeats the end of the one before.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import texts_of
from gristmill.session import broadcast_if_small

CHARS_PER_TOKEN = 4
#: What a cut may follow, from coarse to fine; the match stays with the part before it.
LINES, SENTENCES, WORDS = (re.compile(p) for p in (r"\n", r"[.!?…:;。！？][\"'”’»)\]]*\s+", r"\s+"))
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
#: What a part begins with: headings of two kinds, block tags, items of lists.
HEADING = re.compile(r"^(#{1,6})[ \t]+\S|<h([1-6])\b[^>]*>", re.M | re.I)
FENCE = re.compile(r"^[ \t]*(```|~~~).*$", re.M)
TAG = re.compile(r"<(?:p|ul|ol|dl|li|dt|dd|table|tr|div|section|article|pre|blockquote)\b[^>]*>", re.I)
ITEM = re.compile(r"^([ \t]*)(?:[-*+•]|\d{1,3}[.)])[ \t]+\S", re.M)
NAMES = ("heading", "block", "item", "line", "sentence", "word", "character")
SECTION, BLOCK, ITEMS, CHARACTER = 0, 1, 2, 6


def headings(text: str) -> tuple[list[int], list[int]]:
    """Places and depths of all headings; lines of fenced code aren't headings."""
    fences = [m.start() for m in FENCE.finditer(text)]
    found = [(m.start(), len(m.group(1)) if m.group(1) else int(m.group(2))) for m in HEADING.finditer(text)]
    found = [(at, depth) for at, depth in found if bisect(fences, at) % 2 == 0 or bisect(fences, at) == len(fences)] if fences else found
    return [at for at, _ in found], [depth for _, depth in found]


class Tree:
    """The nodes of one text, found where they are needed; a node is a span and the level at which it is opened."""

    def __init__(self, text: str, limit: int):
        self.text, self.limit = text, limit
        self.at, self.depth = headings(text)

    def parts(self, start: int, end: int, level: int) -> list[int]:
        """Where the children of a node begin."""
        text = self.text
        if level == SECTION:
            low, high = bisect(self.at, start), bisect_left(self.at, end)
            top = min(self.depth[low:high], default=0)
            marks = [self.at[i] for i in range(low, high) if self.depth[i] == top]
        elif level == BLOCK:
            marks = sorted({m.end() for m in BLANK.finditer(text, start, end)} | {m.start() for m in TAG.finditer(text, start, end)})
        elif level == ITEMS:
            found = [(m.start(), len(m.group(1).expandtabs(4))) for m in ITEM.finditer(text, start, end)]
            below = [(at, indent) for at, indent in found if at > start]
            least = min((indent for _, indent in below), default=0)
            marks = [at for at, indent in below if indent == least]
        else:
            marks = [m.end() for m in (LINES, SENTENCES, WORDS)[level - 3].finditer(text, start, end)]
        return [start, *(m for m in marks if start < m < end)]

    def pack(self, start: int, end: int, level: int = SECTION) -> list[list[int]]:
        """Pieces [start, end, level of the cut before it] of a node: whole if it fits, else those of its children, merged."""
        if end - start <= self.limit:
            return [[start, end, level]]
        if level == CHARACTER:
            return [[a, min(a + self.limit, end), level] for a in range(start, end, self.limit)]
        marks = self.parts(start, end, level)
        if len(marks) == 1:
            return self.pack(start, end, level + 1)
        # Sections have sections below them and lists have lists; all else is opened at the next level.
        below = level if level in (SECTION, ITEMS) else level + 1
        out: list[list[int]] = []
        merging = False
        for a, b in zip(marks, [*marks[1:], end]):
            if b - a > self.limit:
                opened = self.pack(a, b, below)
                opened[0][2] = level
                out += opened
                merging = level != SECTION
            elif merging and b - out[-1][0] <= self.limit:
                out[-1][1] = b
            else:
                out.append([a, b, level])
                merging = True
        return out


def cut(text: str, limit: int) -> list[tuple[int, int, int]]:
    """Spans of at most limit characters that tile the text, each with the level at which it was cut off."""
    return [tuple(x) for x in Tree(text, limit).pack(0, len(text))] if text else []


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, own, end, level): the piece is text[start:end], of which text[start:own] repeats its predecessor.

    A text within the limit is one piece. Otherwise a piece repeats the last overlap characters, or
    fewer so as to begin with a whole word if one begins there.
    """
    if len(text) <= limit:
        return [(0, 0, len(text), 0)]
    out = []
    for own, end, level in cut(text, limit - overlap):
        start = max(own - overlap, 0)
        if 0 < start < own and not text[start - 1].isspace():
            gap = WORDS.search(text, start, own)
            start = gap.end() if gap and gap.end() < own else start
        out.append((start, own, end, level))
    return out


def split(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus_col: str = "corpus") -> DataFrame:
    """One row per input row: id, limit (characters, null if its corpus has no specification) and pieces.

    The specification with the smallest spec_id counts where a corpus has several. A null or empty
    text has no pieces; a text without a limit is one piece. Overlaps must be smaller than sizes.
    Repeated rows give repeated results; columns that aren't named aren't read.
    """
    sizes = specs.where("documents is not null and size_tokens is not null").groupBy("documents").agg(F.min_by(F.struct("size_tokens", "overlap_tokens"), "spec_id").alias("s"))
    sizes = sizes.select(F.col("documents").alias("corpus"), (F.col("s.size_tokens") * CHARS_PER_TOKEN).cast("int").alias("limit"), (F.coalesce("s.overlap_tokens", F.lit(0)) * CHARS_PER_TOKEN).cast("int").alias("overlap"))
    count, bad = sizes.agg(F.count("*"), F.coalesce(F.max((F.col("limit") <= F.col("overlap")) | (F.col("overlap") < 0)), F.lit(False))).first()
    if bad:
        raise ValueError("an overlap must be at least 0 and smaller than its size")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(corpus_col).alias("corpus"))
    texts = texts.join(broadcast_if_small(sizes, count), "corpus", "left").select("id", "text", "limit", "overlap")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            limits, overlaps = part.column("limit").to_pylist(), part.column("overlap").to_pylist()
            offsets, rows = [0], []
            for text, limit, overlap in zip(texts_of(part.column("text")), limits, overlaps):
                if text:
                    rows += pieces(text, limit or len(text), overlap or 0)
                offsets.append(len(rows))
            table = np.array(rows, dtype=np.int32).reshape(-1, 4)
            struct = pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(4)], ["start", "own", "end", "level"])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("limit"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], ["id", "limit", "pieces"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, limit int, pieces array<struct<start:int,own:int,end:int,level:int>>").withColumnRenamed("id", id_col)


def piece_rows(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, own, end (code points) and what it was cut at."""
    rows = split(docs, specs).select("doc_id", F.posexplode("pieces").alias("piece", "p"))
    return rows.select("doc_id", "piece", "p.start", "p.own", "p.end", F.element_at(F.array(*map(F.lit, NAMES)), F.col("p.level") + 1).alias("cut_at"))


def oversized(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """doc_id of the documents that had to be split."""
    return split(docs, specs).where(F.size("pieces") > 1).select("doc_id")
