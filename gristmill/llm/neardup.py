"""Near-duplicate documents: packed sketches compared in tiles with exclusive-or and bit counts.

A document is the set of its runs of three words. Packed one-bit codes (128 min-wise hashes, one bit
of each) are compared tile by tile: rows are ordered by the size of their sets; tile pairs whose codes'
population counts differ beyond the radius, or whose sizes differ beyond what the similarity allows, are
skipped, the others take exclusive-or and bit counts for all their pairs at once. Groups of any
size go this one way. Pairs within the radius are verified exactly on the sets.

Comparing all tiles would take quadratic time, so tiles are formed among rows that agree on three
of the min-wise hashes in at least one of 32 bands; a pair of similarity 0.6 misses all bands with
probability 4e-4, one of 0.7 with 2e-6. Sets that are equal are one row from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import binary_rows, hash_bytes, sorted_groups, texts_of
from gristmill.functions.codepoints import batches, mix, shingles
from gristmill.operators.components import connected_components
from gristmill.session import broadcast_if_small, checkpoint

HASHES, BANDS, ROWS = 128, 32, 3
SET_BITS = np.uint64(16)  # sets hold the upper 48 bits of their hashes, in six bytes each
TILE = 128
#: Rows of one band key that a task takes whole; beyond, they are spread over pairs of cells of about so many.
CELL = 20_000
#: Code pairs that are compared at once.
AT_ONCE = 1 << 21
#: A table of ids is broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20


def shingle_sets(texts: list[str], width: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, set sizes and the concatenated sorted sets of the texts that have enough words."""
    for first, last, batch in batches(texts):
        _, _, hashes, docs = batch.words()
        enough = np.bincount(docs, minlength=batch.n) >= max(min_words, width)
        values, at = shingles(hashes, docs, width)
        owner = docs[at]
        keep = enough[owner]
        values, owner = values[keep] >> SET_BITS, owner[keep]
        for low in range(0, batch.n, 1 << 15):  # 15 bits of row, 48 of hash
            part = (owner >= low) & (owner < low + (1 << 15))
            keys = np.unique(((owner[part] - low).astype(np.uint64) << np.uint64(48)) | values[part])
            if len(keys):
                rows, sizes = np.unique(keys >> np.uint64(48), return_counts=True)
                yield rows.astype(np.int64) + low + first, sizes, keys & np.uint64((1 << 48) - 1)


def sketch(docs: DataFrame, width: int, min_words: int) -> DataFrame:
    """id, n (population), same (hash of the whole set), bits (packed sketch) and bands of each document."""
    seeds = np.random.default_rng(20240607).integers(1, 1 << 32, size=(HASHES, 2), dtype=np.uint32) | np.uint32(1)

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("id")
            for rows, sizes, values in shingle_sets(texts_of(part.column("text")), width, min_words):
                offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                mixed = mix(values)
                high, low = (mixed >> np.uint64(32)).astype(np.uint32), mixed.astype(np.uint32)
                least = np.empty((len(rows), HASHES), dtype=np.uint32)
                with np.errstate(over="ignore"):
                    for i, (a, b) in enumerate(seeds):
                        least[:, i] = np.minimum.reduceat(high * a + low * b, offsets)
                    bits = np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31), axis=1)
                    keys = np.zeros((len(rows), BANDS), dtype=np.uint64)
                    for r in range(ROWS):
                        keys = mix(keys * np.uint64(31) + least[:, r : BANDS * ROWS : ROWS].astype(np.uint64))
                    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                    same = mix(np.add.reduceat(mixed, offsets) + sizes.astype(np.uint64))
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * BANDS, keys.astype(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(sizes.astype(np.int32)), pa.array(same.astype(np.int64)), hash_bytes(bits), lists], ["id", "n", "same", "bits", "bands"])

    return docs.mapInArrow(make, f"id {docs.schema['id'].dataType.simpleString()}, n int, same bigint, bits binary, bands array<bigint>")


def tile_pairs(edge: np.ndarray, n: np.ndarray, ones: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the two tiles of each pair of tiles that has to be compared; groups begin at edge, their rows ordered by n."""
    size = np.diff(edge)
    amount = np.where(size > 1, -(-size // TILE), 0)
    group = np.repeat(np.arange(len(size)), amount)
    start = edge[:-1][group] + TILE * (np.arange(len(group)) - np.repeat(np.cumsum(amount) - amount, amount))
    length = np.minimum(start + TILE, edge[1:][group]) - start
    base = np.cumsum(amount) - amount
    one = [base[amount == 1]]
    two = [base[amount == 1]]
    for g in np.flatnonzero(amount > 1):
        i, j = np.triu_indices(int(amount[g]))
        one.append(base[g] + i)
        two.append(base[g] + j)
    one, two = np.concatenate(one), np.concatenate(two)
    if len(start):
        # Tiles of one group lie side by side, but rows of groups of one may stand between those of two groups.
        bounds = np.stack([start, start + length], axis=1).ravel()
        high, low = np.maximum.reduceat(np.append(ones, 0), bounds)[::2], np.minimum.reduceat(np.append(ones, 1 << 14), bounds)[::2]
        near = (low[two] - high[one] <= radius) & (low[one] - high[two] <= radius) & (n[start[one] + length[one] - 1] >= similarity * n[start[two]] - 1e-9)
        one, two = one[near], two[near]
    return start[one], length[one], start[two], length[two]


def compare_groups(similarity: float, radius: int):
    """Pairs within the radius, of Arrow batches sorted by key and population."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(parts, "key"):
            key, n = table["key"].to_numpy(), table["n"].to_numpy()
            bits = binary_rows(table["bits"].combine_chunks(), np.uint64, HASHES // 64)
            ids = table["id"].combine_chunks()
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            one, rows, two, columns = tile_pairs(edge, n, np.bitwise_count(bits).sum(axis=1, dtype=np.int32), similarity, radius)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            shape = rows * (TILE + 1) + columns
            order = np.argsort(shape, kind="stable")
            for these in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1) if len(order) else ():  # all tile pairs of one shape
                r, c = int(rows[these[0]]), int(columns[these[0]])
                step = max(1, AT_ONCE // (r * c))
                for k in range(0, len(these), step):
                    x = one[these[k : k + step], None] + np.arange(r)
                    y = two[these[k : k + step], None] + np.arange(c)
                    apart = np.zeros((len(x), r, c), dtype=np.uint8)
                    for w in range(HASHES // 64):
                        apart += np.bitwise_count(bits[x, w][:, :, None] ^ bits[y, w][:, None, :])
                    t, i, j = np.nonzero(apart <= radius)
                    x, y = x[t, i], y[t, j]
                    keep = (x < y) & (n[x] >= similarity * n[y] - 1e-9)
                    left.append(x[keep])
                    right.append(y[keep])
            x, y = np.concatenate(left), np.concatenate(right)
            if len(x):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], ["x", "y"])

    return run


def hot_keys(banded: DataFrame, total: int, limit: int) -> DataFrame | None:
    """(key, n) of the keys that more than limit rows have; None if there are none. Keys are counted only where a bucket of keys is crowded."""
    buckets = 1 << max(10, (4 * total // limit).bit_length())
    bucket = F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket")
    crowded = checkpoint(banded.select(bucket).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("bucket"))
    amount = crowded.count()
    if not amount:
        return None
    rows = banded.select("key", bucket).join(broadcast_if_small(crowded, amount), "bucket", "left_semi")
    hot = checkpoint(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    return hot if hot.limit(1).count() else None


def candidate_pairs(reps: DataFrame, similarity: float, cell: int | None = None) -> DataFrame:
    """Distinct pairs (a < b) that share a band and whose codes are within the radius.

    A key with more than cell rows is spread: its rows are put in cells by the size of their sets and a hash, and each
    pair of cells within reach is compared in a task of its own.
    """
    cell = cell or CELL
    spread = (HASHES * (1 - similarity) / 4) ** 0.5 * 1.1
    radius = int(HASHES * (1 - similarity) / 2 + 4.5 * spread)
    banded = reps.select("id", "n", "bits", F.explode("bands").alias("key"))
    plain, hot = banded, hot_keys(banded, reps.count() * BANDS, cell)
    if hot is not None:
        marked = banded.join(broadcast_if_small(hot.withColumnRenamed("n", "rows"), hot.count()), "key", "left")
        plain = marked.where("rows is null").select("id", "n", "bits", "key")
        step = F.floor(F.log(F.col("n")) / float(np.log(1 / similarity)) * 2).cast("int")  # rows in reach are within two steps
        salted = marked.where("rows is not null").withColumn("cells", F.ceil(F.col("rows") / cell).cast("int")).withColumn("cell", step * F.col("cells") + F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
        near = F.sequence((step - 2) * F.col("cells"), (step + 3) * F.col("cells") - 1)
        salted = salted.withColumn("other", F.explode(near))
        plain = plain.unionByName(salted.select("id", "n", "bits", F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other")).alias("key")))
    kind = reps.schema["id"].dataType.simpleString()
    found = plain.repartition("key").sortWithinPartitions("key", "n").mapInArrow(compare_groups(similarity, radius), f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def set_table(docs: DataFrame, width: int, min_words: int) -> DataFrame:
    """id and shingles (six bytes each, sorted) of each document."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, sizes, values in shingle_sets(texts_of(part.column("text")), width, min_words):
                data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                offsets = np.concatenate([[0], np.cumsum(sizes)]) * 6
                blob = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), blob.cast(pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(make, f"id {docs.schema['id'].dataType.simpleString()}, shingles binary")


def unpack_set(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have the similarity, with it."""

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            last, keep, values = (None, None), [], []
            left, right = part.column("left").to_pylist(), part.column("right").to_pylist()
            for i, (x, y) in enumerate(zip(left, right)):
                if last[0] != y:
                    last = (y, unpack_set(y))
                one, two = unpack_set(x), last[1]
                both = np.concatenate([one, two])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                value = common / (len(both) - common)
                if value >= similarity:
                    keep.append(i)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([part.column("a").take(pa.array(keep, pa.int64())), part.column("b").take(pa.array(keep, pa.int64())), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(check, f"a {kind}, b {kind}, similarity double")


def short_texts(docs: DataFrame, least: int) -> DataFrame:
    """(id, same) of the texts of fewer than least words: same is a hash of the words, of a text without words its own hash, and null where the text is blank or null."""

    def key(text: str, words: np.ndarray) -> str | None:
        if len(words):
            return "w" + hashlib.sha1(words.tobytes()).hexdigest()
        return "t" + hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest() if text.strip() else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = texts_of(part.column("text"))
            for first, _, batch in batches(texts):
                _, _, hashes, owner = batch.words()
                edge = np.searchsorted(owner, np.arange(batch.n + 1))
                few = np.flatnonzero(np.diff(edge) < least)
                same = [key(texts[first + i], hashes[edge[i] : edge[i + 1]]) for i in few]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(first + few)), pa.array(same, pa.string())], ["id", "same"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, same string")


class NearDuplicates:
    """Documents whose sets of word runs reach a similarity.

    Of the input only the id and text columns are read, so other columns of any name don't matter.
    Rows with null id or null text and texts of fewer than min_words words are left out; repeated
    ids count once, with the smallest text. An empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, min_words: int = 40, unique_ids: bool = False):
        docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
        if not unique_ids:
            docs = docs.groupBy("id").agg(F.min("text").alias("text"))
        self.documents, self.least = docs, max(width, min_words)
        docs = docs.where("text is not null")
        self.similarity = similarity
        self.sketches = checkpoint(sketch(docs, width, min_words))
        #: One row for each distinct set: its smallest id and how many documents have it.
        self.classes = checkpoint(self.sketches.groupBy("same", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
        pairs = checkpoint(candidate_pairs(self.classes, similarity))
        ends = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        size = ends.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 32)).first()[0] or 0
        needed = docs.join(F.broadcast(ends) if size <= BROADCAST_BYTES else ends, "id", "left_semi")
        #: Pairs of class representatives, with their exact similarity.
        self.links = checkpoint(verified(pairs, set_table(needed, width, min_words), similarity))

    def members(self) -> DataFrame:
        """(id, rep) of every document; rep is the smallest id with the same set."""
        many = self.classes.where("copies > 1").select("same", "n", F.col("id").alias("rep"))
        single = self.classes.where("copies = 1").select("id", F.col("id").alias("rep"))
        return self.sketches.select("id", "same", "n").join(many, ["same", "n"]).select("id", "rep").unionByName(single)

    def representative_pairs(self) -> DataFrame:
        """(a, b, similarity, copies_a, copies_b): the links between distinct texts, each by its smallest id; with members() the whole result at any size."""
        copies = self.classes.select("id", "copies")
        one = self.links.join(copies.select(F.col("id").alias("a"), F.col("copies").alias("copies_a")), "a")
        return one.join(copies.select(F.col("id").alias("b"), F.col("copies").alias("copies_b")), "b").select("a", "b", "similarity", "copies_a", "copies_b")

    def pairs(self, expand: int = 1000) -> DataFrame:
        """Pairs of documents (a < b), written out from representative_pairs() and members().

        A group of up to expand exact copies has all its pairs and all links of each copy. A larger group, whose
        pairs would grow with its square, is a star: each member with its representative, which has the links
        of all. So every link between different texts is there at any size of groups.
        """
        members = checkpoint(self.members().join(self.classes.where("copies > 1").select(F.col("id").alias("rep"), "copies"), "rep"))
        copies = members.where(F.col("copies") <= expand).select("id", "rep")
        inside = copies.select(F.col("id").alias("a"), "rep").join(copies.select(F.col("id").alias("b"), "rep"), "rep").where("a < b").select("a", "b")
        star = members.where((F.col("copies") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
        lists = copies.groupBy("rep").agg(F.collect_list("id").alias("ids"))  # at most expand ids each
        across = self.links.select("a", "b").join(lists.select(F.col("rep").alias("a"), F.col("ids").alias("xs")), "a", "left").join(lists.select(F.col("rep").alias("b"), F.col("ids").alias("ys")), "b", "left")
        across = across.select(F.explode(F.coalesce("xs", F.array("a"))).alias("x"), F.coalesce("ys", F.array("b")).alias("ys")).select("x", F.explode("ys").alias("y"))
        across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return across.unionByName(inside).unionByName(star)

    def groups(self) -> DataFrame:
        """(id, group, links, copies) of every compared document: group is the smallest id reached through links, links the number of other texts linked to its own."""
        parts = connected_components(self.links)
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        reps = self.classes.select(F.col("id").alias("rep"), "copies").join(parts.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
        return self.members().join(reps, "rep").select("id", F.coalesce("component", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"), "copies")

    def every_group(self) -> DataFrame:
        """groups() of all documents: texts that are too short to be compared are grouped where they have the same words, blank and null ones are groups of their own."""
        short = checkpoint(short_texts(self.documents, self.least))
        named = short.where("same is not null").groupBy("same").agg(F.min("id").alias("group"), F.lit(0).cast("bigint").alias("links"), F.count("*").alias("copies"))
        equal = short.join(named, "same").select("id", "group", "links", "copies")
        own = short.where("same is null").select("id", F.col("id").alias("group"), F.lit(0).cast("bigint").alias("links"), F.lit(1).cast("bigint").alias("copies"))
        return self.groups().unionByName(equal).unionByName(own)
