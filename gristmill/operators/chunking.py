"""Chunks of documents: windows of words, or the sections between headings; ids address their content.

Whole batches of texts are cut at once with array operations over code points. Where the next window
begins is known for every word beforehand, so that only the chain of windows has to be followed, for
all texts of the batch together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import texts_of
from gristmill.functions.codepoints import Batch, batches
from gristmill.functions.text import short_sha1
from gristmill.session import broadcast_if_small

CHARS_PER_TOKEN = 4
# Kinds of chunkers, default sizes in tokens, deepest heading, what joins a path of headings.
KINDS = ("fixed", "structure")
SIZE, OVERLAP, DEEPEST, JOINT = 350, 60, 6, " › "
BREAKS = np.array([0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029])


def headings(batch: Batch, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each heading: where its line begins, its level, and where its title begins and ends."""
    cp, n = batch.cp, len(batch.cp)
    mark_start, mark_end = batch.runs(cp == ord("#"))
    ends_line = np.isin(cp, BREAKS) | (cp == 0)
    stops = np.flatnonzero(ends_line)
    opens = (mark_start == 0) | ends_line[mark_start - 1]
    level = mark_end - mark_start
    good = opens & (level <= DEEPEST) & ~solid[np.minimum(mark_end, n - 1)]
    start, level, after = mark_start[good], level[good], mark_end[good]
    stop = stops[np.searchsorted(stops, after)]
    at = np.where(solid, np.arange(n), n)
    first = np.minimum.accumulate(at[::-1])[::-1][after] if len(after) else after
    last = np.maximum.accumulate(np.where(solid, np.arange(n), -1))[stop] if len(stop) else stop
    named = first < stop
    return start[named], level[named], first[named], last[named] + 1


def paths(level: np.ndarray, doc: np.ndarray) -> list[list[int]]:
    """Of each heading the numbers of the headings above it and itself: at each level the last one seen, unless one of a higher level came after it."""
    k = np.arange(len(level))
    fresh = np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), k, 0)) if len(k) else k
    highest = fresh - 1  # the latest heading of a level above the one looked at
    out: list[list[int]] = [[] for _ in k]
    for depth in range(1, DEEPEST + 1):
        seen = np.maximum.accumulate(np.where(level == depth, k, -1)) if len(k) else k
        for i in np.flatnonzero((seen > highest) & (seen >= fresh) & (depth <= level)):
            out[i].append(int(seen[i]))
        highest = np.maximum(highest, seen)
    return out


def spans(batch: Batch, texts: list[str], structure: bool, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Document, start, end (within its text) and section of each chunk, in order."""
    solid = ~batch.has("space") & (batch.cp != 0)
    start, end, label = batch.start, batch.end, np.full(batch.n, -1)
    windowed = np.ones(batch.n, dtype=bool)
    names: list[str] = []
    if structure:
        at, level, title, title_end = headings(batch, solid)
        doc = batch.doc_of(at)
        words = [texts[d][a - batch.start[d] : b - batch.start[d]] for d, a, b in zip(doc, title, title_end)]
        names = [JOINT.join(words[i] for i in path) for path in paths(level, doc)]
        # Texts begin parts, too, with what is before their first heading, which may be nothing.
        start = np.concatenate([batch.start, at])
        order = np.argsort(start, kind="stable")
        label = np.concatenate([label, np.arange(len(at))])[order]
        start = start[order]
        owner = batch.doc_of(start)
        end = np.minimum(np.append(start[1:], len(batch.cp)), batch.end[owner])
        windowed = (np.bincount(doc, minlength=batch.n) == 0)[owner] | (end - start > size)
    filled = np.concatenate([[0], np.cumsum(solid)])
    whole = np.flatnonzero(~windowed & (filled[end] > filled[start]))
    w_start, w_end = batch.runs(solid) if len(solid) else (np.empty(0, np.int64),) * 2
    part = np.searchsorted(start, w_start, side="right") - 1
    inside = windowed[part] if len(part) else np.empty(0, bool)
    w_start, w_end, part = w_start[inside], w_end[inside], part[inside]
    i = np.arange(len(part))
    final = np.searchsorted(part, part, side="right") - 1
    last = np.maximum(i, np.minimum(np.searchsorted(w_end, w_start + size, side="right") - 1, final))
    following = np.clip(np.searchsorted(w_start, w_end[last] - overlap), i + 1, last + 1) if len(i) else i
    current = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(i) else i
    firsts = [np.empty(0, np.int64)]
    while len(current):
        firsts.append(current)
        current = following[current[last[current] < final[current]]]
    first = np.concatenate(firsts)
    begin, stop, which = (np.concatenate(x) for x in ((start[whole], w_start[first]), (end[whole], w_end[last[first]]), (whole, part[first])))
    order = np.argsort(begin, kind="stable")
    begin, stop, which = begin[order], stop[order], label[which[order]]
    owner = batch.doc_of(begin)
    return owner, begin - batch.start[owner], stop - batch.start[owner], [names[j] if j >= 0 else None for j in which]


def checked(kind: str, size: int, overlap: int) -> tuple[str, int, int]:
    if kind not in KINDS:
        raise ValueError(f"unknown chunker {kind!r}; there are {', '.join(KINDS)}")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    return kind, size, overlap


def chunk(docs: DataFrame, kind: str = "fixed", size_tokens: int = SIZE, overlap_tokens: int = OVERLAP, id_col: str = "doc_id", keep: tuple[str, ...] = (), settings: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc id, kept columns, chunk_no, chunk_id, start, end, section, chunk): spans of at most size_tokens * 4 characters.

    A window takes whole words while they fit (a longer word is one by itself); the next begins with the first word
    that lies within the last overlap_tokens * 4 characters of it, but later than it began. Structure takes
    the sections between headings whole where they fit, and windows of the others and of texts without headings. Offsets are
    code points. Null and blank texts have no chunks. settings names columns with kind, size and overlap
    of each row instead of the three arguments; rows where they are null have none either.
    """
    if settings is None:
        checked(kind, size_tokens, overlap_tokens)
    columns = [F.col(id_col), *map(F.col, keep), F.col("text")]
    columns += [F.lit(v).alias(n) for v, n in zip((kind, size_tokens, overlap_tokens), ("_kind", "_size", "_overlap"))] if settings is None else [F.col(c).alias(n) for c, n in zip(settings, ("_kind", "_size", "_overlap"))]
    rows = docs.select(*columns)
    passed = [id_col, *keep]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            how = list(zip(*(part.column(c).to_pylist() for c in ("_kind", "_size", "_overlap"))))
            for setting in dict.fromkeys(how):
                if None in setting:
                    continue
                name, size, overlap = checked(*setting)
                own = part.take(pa.array([i for i, h in enumerate(how) if h == setting]))
                texts = texts_of(own.column("text"))
                for first, last, batch in batches(texts):
                    some = texts[first:last]
                    owner, start, end, section = spans(batch, some, name == "structure", size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN)
                    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    slices = [some[d][a:b] for d, a, b in zip(owner.tolist(), start.tolist(), end.tolist())]
                    take = pa.array(first + owner)
                    yield pa.RecordBatch.from_arrays([*(own.column(c).take(take) for c in passed), pa.array(number.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(section, pa.string()), pa.array(slices, pa.string())], [*passed, "chunk_no", "start", "end", "section", "chunk"])

    typed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    cut = rows.where("text is not null").mapInArrow(run, f"{typed}, chunk_no int, start int, end int, section string, chunk string")
    return cut.select(*passed, "chunk_no", short_sha1(F.col(id_col).cast("string"), F.col("start").cast("string"), F.col("end").cast("string")).alias("chunk_id"), "start", "end", "section", "chunk")


def chunk_by_specs(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of each document by the chunker of its corpus; documents of a corpus without one have none. The smallest spec_id counts."""
    own = specs.where("documents is not null").groupBy(F.col("documents").alias("corpus")).agg(F.min_by(F.struct("chunker_type", "size_tokens", "overlap_tokens"), "spec_id").alias("s")).select("corpus", "s.*")
    joined = docs.select(*dict.fromkeys([id_col, *keep, "text", "corpus"])).join(broadcast_if_small(own, own.count()), "corpus")
    return chunk(joined, id_col=id_col, keep=keep, settings=("chunker_type", "size_tokens", "overlap_tokens"))
