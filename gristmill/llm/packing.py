"""Items packed into containers of fixed capacity: best fit with conflicts, over open bins ordered by residual.

Sizes are tokens of a public byte-pair tokeniser. Texts are cut into the tokeniser's own words by array
operations, and each distinct word is encoded once per process, so counts are those of the tokeniser
although most text never passes through it. Items go, largest first, into the bin with the least
room that still takes them; each bin carries bitmaps of its sources and duplicate clusters, and
the search goes on to the next larger residual until a compatible bin is found. Two members of one cluster
(equal texts, or the groups that the caller names) never share a bin. Sources are kept apart as long as some open
bin allows it; an item that finds none takes the tightest bin without its cluster and is marked, or opens a
new one if the caller refuses such conflicts, which costs space where a source has most of the rows.

Packing runs in shards of some ten thousand items, spread by hash; each leaves a few bins open, so the
waste against one global packing is under a bin or two per shard.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import texts_of
from gristmill.functions.codepoints import Batch, batches, mix, worker_cache

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
SHARD = 10_000
MOST_TASKS = 20_000


def encoding(path: str, data: bytes | None = None):
    """The tokeniser of a vocabulary file; executors are given its bytes, so that only the driver needs the file."""
    cache = worker_cache()
    if ("encoding", path) not in cache:
        import tiktoken

        if data is None:
            with open(path, "rb") as file:
                data = file.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        cache["encoding", path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["encoding", path]


def word_spans(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokeniser's words; NUL separators between texts are in none."""
    cp = batch.cp
    n = len(cp)
    letter, number, space = batch.has("letter"), batch.has("number"), batch.has("space") & ~np.isin(cp, (0x1C, 0x1D, 0x1E, 0x1F))
    kind = np.where(letter, 1, np.where(number, 2, np.where(space, 3, 4))).astype(np.int8)
    kind[batch.end] = 0
    new = np.ones(n, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    # The last blank before other characters joins them if it is a plain one, and else stands alone.
    before = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & (kind[1:] != 0))
    new[before] = True
    new[before[cp[before] == 32] + 1] = False
    # English endings after an apostrophe that begins a word.
    mark = np.flatnonzero((cp == 39) & new)
    nxt = cp[np.minimum(mark + 1, n - 1)]
    third = cp[np.minimum(mark + 2, n - 1)]
    one = np.isin(nxt, [ord(c) for c in "stmd"])
    two = ((nxt == ord("r")) & (third == ord("e"))) | ((nxt == ord("v")) & (third == ord("e"))) | ((nxt == ord("l")) & (third == ord("l")))
    for at, length in ((mark[one], 1), (mark[two & ~one], 2)):
        new[at + 1] = False
        if length == 2:
            new[at + 2] = False
        stop = at + 1 + length
        # A letter that follows goes on as a word of its own; if the run ended there, a boundary exists already.
        new[stop[kind[stop] != 0]] |= kind[stop[kind[stop] != 0]] == 1
    start = np.flatnonzero(new & (kind != 0))
    edges = np.flatnonzero(new | (kind == 0))
    end = edges[np.searchsorted(edges, start, side="right")]
    return start, end


def token_counts(batch: Batch, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and token counts of the tokeniser's words."""
    start, end = word_spans(batch)
    keys = batch.span_hash(start, end, exact=True)
    distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
    known_keys, known_counts = worker_cache().get(("counts", path), (np.empty(0, np.uint64), np.empty(0, np.int32)))
    at = np.searchsorted(known_keys, distinct)
    at[at == len(known_keys)] = 0
    hit = known_keys[at] == distinct if len(known_keys) else np.zeros(len(distinct), dtype=bool)
    counts = np.where(hit, known_counts[at] if len(known_keys) else 0, 0).astype(np.int32)
    todo = np.flatnonzero(~hit)
    encode, cp = encoding(path).encode_ordinary, batch.cp
    for i in todo:
        a, b = start[first[i]], end[first[i]]
        counts[i] = len(encode(cp[a:b].tobytes().decode("utf-32-le", "replace")))
    if len(todo) and len(known_keys) < 3_000_000:
        keys_now, counts_now = np.concatenate([known_keys, distinct[todo]]), np.concatenate([known_counts, counts[todo]])
        order = np.argsort(keys_now)
        worker_cache()["counts", path] = (keys_now[order], counts_now[order])
    return start, end, counts[back]


def items(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    """Texts, or pieces of texts above the capacity: id, piece, start, end (code points), tokens, copy (hash)."""
    with open(path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding(path, vocabulary.value)
        for part in parts:
            texts = texts_of(part.column("text"))
            for first, _, batch in batches(texts):
                start, end, count = token_counts(batch, path)
                owner = batch.doc_of(start)
                sizes = np.bincount(owner, weights=count, minlength=batch.n).astype(np.int64)
                copy = batch.span_hash(batch.start, batch.end)
                fits = np.flatnonzero((sizes > 0) & (sizes <= capacity))
                rows, zero = [first + fits], np.zeros(len(fits), dtype=np.int64)
                piece, begin, stop, tokens, same = [zero], [zero], [(batch.end - batch.start)[fits]], [sizes[fits]], [copy[fits]]
                for i in np.flatnonzero(sizes > capacity):
                    low, high = np.searchsorted(owner, i), np.searchsorted(owner, i, side="right")
                    spans = divided(start[low:high] - batch.start[i], end[low:high] - batch.start[i], count[low:high], capacity, texts[first + i], path)
                    k = len(spans)
                    rows.append(np.full(k, first + i))
                    piece.append(np.arange(k))
                    begin.append(spans[:, 0])
                    stop.append(spans[:, 1])
                    tokens.append(spans[:, 2])
                    same.append(mix(copy[i] + np.arange(k, dtype=np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(np.concatenate(rows))), part.column("source").take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (piece, begin, stop, tokens)), pa.array(np.concatenate(same).view(np.int64)),
                ], ["id", "source", "piece", "start", "end", "tokens", "copy"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, source string, piece int, start int, end int, tokens int, copy bigint")


def divided(start: np.ndarray, end: np.ndarray, count: np.ndarray, capacity: int, text: str, path: str) -> np.ndarray:
    """(start, end, tokens) of pieces within the capacity, cut between words; a longer word is cut between characters."""
    encode, out, total, begin = encoding(path).encode_ordinary, [], 0, 0
    for a, b, c in zip(start.tolist(), end.tolist(), count.tolist()):
        if total + c > capacity and total:
            out.append((begin, a, total))
            begin, total = a, 0
        while c > capacity:
            size = min(capacity // 4, b - a)  # a character is at most four tokens
            out.append((a, a + size, len(encode(text[a : a + size]))))
            a = begin = a + size
            c = len(encode(text[a:b])) if a < b else 0
        total += c
    if total:
        out.append((begin, len(text), total))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


class Bins:
    """Open bins by residual and, within one residual, by the bitmap of their sources.

    A bitmap of the residuals that have bins finds the next larger one in one step; all bins with the
    same sources are passed over together.
    """

    def __init__(self, capacity: int, refuse: bool = False):
        self.capacity, self.refuse, self.present = capacity, refuse, 0
        self.groups: dict[int, dict[int, list[int]]] = {}
        self.copies: list[int] = []
        self.last: tuple = (None, 0)

    def find(self, size: int, source: int, copy: int) -> tuple[int, int, int] | None:
        """(residual, sources, place in the list) of the tightest bin without a copy, if possible one without the source."""
        spare = None
        # The same item came just before: all residuals under the one it took still have none for it.
        at = max(size, self.last[1]) if self.last[0] == (size, source, copy) else size
        above = self.present >> at
        while above:
            step = (above & -above).bit_length() - 1
            at += step
            for sources, bins in self.groups[at].items():
                if sources & source and (spare is not None or self.refuse):
                    continue
                for place in range(len(bins) - 1, -1, -1):
                    if not self.copies[bins[place]] & copy:
                        if not sources & source:
                            self.last = ((size, source, copy), at)
                            return at, sources, place
                        spare = None if self.refuse else (at, sources, place)
                        break
            above >>= step + 1
            at += 1
        return spare

    def put(self, size: int, source: int, copy: int) -> tuple[int, bool]:
        """The bin for an item, and whether it holds its source already; source and copy are single bits."""
        found = self.find(size, source, copy)
        if found is None:
            residual, sources, b = self.capacity, 0, len(self.copies)
            self.copies.append(0)
        else:
            residual, sources, place = found
            bins = self.groups[residual][sources]
            b = bins.pop(place)
            if not bins:
                del self.groups[residual][sources]
                if not self.groups[residual]:
                    self.present &= ~(1 << residual)
        self.copies[b] |= copy
        if residual > size:
            self.groups.setdefault(residual - size, {}).setdefault(sources | source, []).append(b)
            self.present |= 1 << (residual - size)
        return b, bool(sources & source)


def pack_shard(tokens: list[int], sources: list, copies: list[int], capacity: int, refuse: bool = False) -> list[tuple[int, bool]]:
    """The bin of each item and whether its source was in there: largest first, members of one cluster next to one another."""
    bins, out = Bins(capacity, refuse), [(0, False)] * len(tokens)
    source_bit: dict = {}
    copy_bit: dict[int, int] = {}
    often: dict[int, int] = {}
    for c in copies:
        often[c] = often.get(c, 0) + 1
    for i in sorted(range(len(tokens)), key=lambda i: (-tokens[i], copies[i], str(sources[i]))):
        source = source_bit.setdefault(sources[i], 1 << len(source_bit))
        copy = copy_bit.setdefault(copies[i], 1 << len(copy_bit)) if often[copies[i]] > 1 else 0
        out[i] = bins.put(tokens[i], source, copy)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None, refuse: bool = False) -> DataFrame:
    """One row per text or piece: id, piece, start, end (code points), tokens, container, same_source.

    Only texts above the capacity have more than one piece. Null and empty texts have no row; a null
    source is a source of its own. Repeated rows are texts of their own. Other columns aren't read. clusters
    (id, group) names groups of near duplicates, one row per id; of two texts of a group, the pieces in the same place never
    share a container. Without it, or for ids that it lacks, groups are equal texts. same_source marks an item that was put
    beside one of its source, as no other open container had room; with refuse there are none. tokenizer is
    a file that the driver can read.
    """
    if capacity < 16:
        raise ValueError("a container holds at least 16 tokens")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source")).where("length(text) > 0")
    shards = -(-max(texts.count(), 1) // SHARD)
    kind = texts.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        placed = pack_shard(table["tokens"].to_pylist(), table["source"].to_pylist(), table["copy"].to_pylist(), capacity, refuse)
        shard = table["shard"].to_numpy().astype(np.int64)
        bins = np.array([b for b, _ in placed], dtype=np.int64)
        return table.drop_columns(["shard", "source", "copy"]).append_column("container", pa.array((shard << 32) | bins)).append_column("same_source", pa.array([c for _, c in placed]))

    found = items(texts, capacity, tokenizer)
    if clusters is not None:
        named = clusters.select(F.col(clusters.columns[0]).alias("id"), F.xxhash64(F.col(clusters.columns[1])).alias("cluster"))
        found = found.join(named, "id", "left").withColumn("copy", F.when(F.col("cluster").isNotNull(), F.xxhash64("cluster", "piece")).otherwise(F.col("copy"))).drop("cluster")
        found = found.select("id", "source", "piece", "start", "end", "tokens", "copy")
    spread = found.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))
    spread = spread.repartition(min(shards, MOST_TASKS), "shard")  # by number, as its bytes don't tell the work of a shard
    packed = spread.groupBy("shard").applyInArrow(run, f"id {kind}, piece int, start int, end int, tokens int, container bigint, same_source boolean")
    return packed.withColumnRenamed("id", id_col)
