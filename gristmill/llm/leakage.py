"""Held-out passages inside a corpus: a prefix-filtered join of word runs with exact verification.

A document leaks an item if it has `window` consecutive words of the item's text. Each such window is a
set of window - RUN + 1 overlapping runs of RUN words, all of which the document must have, so one of them is
enough as the window's prefix: the one that is rarest in the corpus. A first pass over the corpus counts
the items' runs, which orders them by rarity; a second one gathers, of the prefixes only, each place
with the words around it. Places are joined with the items that have the prefix; length and
positional bounds drop alignments in which a window would not fit, and the others are verified word by
word on both sides of the run.

All items take part in the same two passes, however many there are: a bitmap of the buckets of their runs, of
bounded size, is what every task knows, and the joins by runs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import texts_of
from gristmill.functions.codepoints import batches, shingles
from gristmill.session import checkpoint

RUN = 5
#: The bitmap has 2 to the power of so many bits, at least and at most (32 MB); more runs than a quarter of its bits take none.
LEAST_BITS, MOST_BITS = 22, 28
#: Items are worked on in groups of about so many characters.
BLOCK_CHARS = 1_000_000


def bitmap(runs: DataFrame, amount: int) -> np.ndarray | None:
    """One bit for each bucket of run hashes, set where there is a run; None where it would let most through."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * max(amount, 1)).bit_length()))
    if amount > 1 << (MOST_BITS - 2):
        return None
    table = runs.select(F.shiftrightunsigned("run", 64 - bits).cast("int").alias("b")).distinct().toArrow()  # at most a number for each bit
    out = np.zeros(1 << bits, dtype=bool)
    out[table["b"].to_numpy()] = True
    return np.packbits(out, bitorder="little")


def passes(filter_bits: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Places of the values whose bucket's bit is set."""
    if filter_bits is None:
        return np.arange(len(values))
    bucket = (values >> np.uint64(64 - (len(filter_bits) * 8).bit_length() + 1)).astype(np.int64)
    return np.flatnonzero((filter_bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1)


def runs_of(items: DataFrame) -> DataFrame:
    """(block, run): the distinct runs of the items of each block."""

    def run(part: pa.Table) -> pa.Table:
        found = [np.empty(0, np.uint64)]
        for _, _, batch in batches(texts_of(part["text"])):
            _, _, words, owner = batch.words()
            found.append(shingles(words, owner, RUN)[0])
        distinct = np.unique(np.concatenate(found))
        return pa.table({"block": pa.array(np.full(len(distinct), part["block"][0].as_py(), np.int64)), "run": pa.array(distinct.view(np.int64))})

    return items.select("block", "text").groupBy("block").applyInArrow(run, "block bigint, run bigint")


def frequencies(docs: DataFrame, filter_bits: np.ndarray | None) -> DataFrame:
    """(run, docs): in how many documents each run that passes the bitmap is."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, _, batch in batches(texts_of(part.column("text"))):
                _, _, words, owner = batch.words()
                values, at = shingles(words, owner, RUN)
                hit = passes(shared.value, values)
                if len(hit):
                    pair = np.unique(np.stack([values[hit], owner[at[hit]].astype(np.uint64)], axis=1), axis=0)
                    distinct, amount = np.unique(pair[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(amount.astype(np.int64))], ["run", "docs"])

    return docs.select("text").mapInArrow(count, "run bigint, docs bigint").groupBy("run").agg(F.sum("docs").alias("docs"))


def around(words: np.ndarray, owner: np.ndarray, at: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each run and up to side words before and after it in its text (0 beyond), and how many there are on each side."""
    begin, end = np.searchsorted(owner, owner[at]), np.searchsorted(owner, owner[at], side="right")
    left, right = np.minimum(at - begin, side), np.minimum(end - at - RUN, side)
    place = at[:, None] + np.arange(-side, RUN + side)
    inside = (place >= begin[:, None]) & (place < end[:, None])
    return np.where(inside, words[np.clip(place, 0, max(len(words) - 1, 0))], np.uint64(0)), left, right


def places_table(ids: pa.Array, values: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, names: list[str]) -> list[pa.Array]:
    data = np.ascontiguousarray(near)
    width = data.shape[1] * 8
    offsets = (np.arange(len(data) + 1, dtype=np.int64) * width).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.view(np.uint8))])
    return [pa.array(values.view(np.int64)), ids, packed, pa.array(left.astype(np.int8)), pa.array(right.astype(np.int8))]


def prefixes(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(run, item, words, left, right): the rarest run of each window of each item, with the words around it. Runs that no document has are left out."""
    side, span = window - RUN, window - RUN + 1
    kind = items.schema["item"].dataType.simpleString()
    names = ["run", "item", "words", "left", "right"]

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        runs, amount = known["run"].to_numpy().view(np.uint64), known["docs"].to_numpy()
        order = np.argsort(runs)
        runs, amount = runs[order], amount[order]
        out = []
        for first, last, batch in batches(texts_of(part["text"])):
            _, _, words, owner = batch.words()
            chosen = []
            edges = np.searchsorted(owner, np.arange(last - first + 1))
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < window:
                    continue
                values, _ = shingles(words[a:b], np.zeros(b - a, np.int64), RUN)
                slot = np.minimum(np.searchsorted(runs, values), max(len(runs) - 1, 0))
                rarity = np.where(runs[slot] == values, amount[slot], 0) if len(runs) else np.zeros(len(values), np.int64)
                place = np.empty(len(values), np.int64)
                place[np.lexsort((values, rarity))] = np.arange(len(values))
                least = np.unique(np.lib.stride_tricks.sliding_window_view(place, span).argmin(axis=1) + np.arange(len(values) - span + 1))
                chosen.append(a + least[rarity[least] > 0])
            at = np.concatenate([*chosen, np.empty(0, np.int64)]).astype(np.int64)
            if len(at):
                near, left, right = around(words, owner, at, side)
                values = shingles(words, np.zeros(len(words), np.int64), RUN)[0][at]
                out.append(pa.Table.from_arrays(places_table(part["item"].combine_chunks().take(pa.array(first + owner[at])), values, near, left, right, names), names))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], k) for n, k in zip(names, (pa.int64(), part["item"].type, pa.binary(), pa.int8(), pa.int8()))})

    return items.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, f"run bigint, item {kind}, words binary, left tinyint, right tinyint")


def places(docs: DataFrame, filter_bits: np.ndarray | None, window: int) -> DataFrame:
    """(run, id, words, left, right): each place of a run that passes the bitmap and has room for a window, with the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_bits)
    names = ["run", "id", "words", "left", "right"]

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, _, batch in batches(texts_of(part.column("text"))):
                _, _, words, owner = batch.words()
                values, at = shingles(words, owner, RUN)
                hit = passes(shared.value, values)
                if not len(hit):
                    continue
                near, left, right = around(words, owner, at[hit], window - RUN)
                fits = np.flatnonzero(left + RUN + right >= window)
                ids = part.column("id").take(pa.array(first + owner[at[hit[fits]]]))
                yield pa.RecordBatch.from_arrays(places_table(ids, values[hit[fits]], near[fits], left[fits], right[fits], names), names)

    return docs.select("id", "text").mapInArrow(find, f"run bigint, id {docs.schema['id'].dataType.simpleString()}, words binary, left tinyint, right tinyint")


def agree(one: np.ndarray, two: np.ndarray, window: int) -> np.ndarray:
    """Whether the words of two places agree on a window that has the run: rows of 2 * (window - RUN) + RUN word hashes, 0 where there is none."""
    side = window - RUN
    same = (one == two) & (one != 0)
    before = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
    after = np.cumprod(same[:, side + RUN :], axis=1).sum(axis=1)
    return same[:, side : side + RUN].all(axis=1) & (before + RUN + after >= window)


def leaks(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id): the document has window consecutive words of the item.

    Null or empty texts and items of fewer words never match; equal texts under several ids each
    give their own rows; repeated rows give one. Other columns aren't read.
    """
    if window < RUN:
        raise ValueError(f"a window has at least {RUN} words")
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("item is not null and length(text) > 0").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    items = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(-(-max(chars, 1) // BLOCK_CHARS))))
    own = checkpoint(runs_of(items))
    distinct = own.select("run").distinct()
    counts = frequencies(docs, bitmap(distinct, own.count()))
    rarity = own.join(counts, "run").select("block", "run", "docs")
    wanted = checkpoint(prefixes(items, rarity, window))
    found = places(docs, bitmap(wanted.select("run").distinct(), wanted.count()), window)
    both = found.join(wanted.select("run", "item", F.col("words").alias("own"), F.col("left").alias("l"), F.col("right").alias("r")), "run")
    both = both.where(F.least("left", "l") + F.least("right", "r") + RUN >= window).select("id", "item", "words", "own")
    width = 2 * (window - RUN) + RUN

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            one, two = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint64).reshape(part.num_rows, width) for c in ("words", "own"))
            keep = pa.array(np.flatnonzero(agree(one, two, window)))
            yield pa.RecordBatch.from_arrays([part.column("id").take(keep), part.column("item").take(keep)], ["id", "item"])

    pairs = both.mapInArrow(verify, f"id {docs.schema['id'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}")
    return pairs.distinct().select(F.col("id").alias(doc_id), F.col("item").alias(item_id))


def leak_report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row for each item that leaked: its suite, the number of documents and the smallest of them."""
    found = leaks(docs, items, window)
    names = items.select("item_id", "suite").groupBy("item_id").agg(F.min("suite").alias("suite"))
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).join(names, "item_id")
