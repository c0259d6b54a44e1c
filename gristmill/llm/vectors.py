"""The k most similar vectors of every vector: randomly rotated one-bit codes with error bounds.

Unit vectors are spread over areas, the nearest of some centroids that are fitted on a sample. A query
goes once to its own area and to each area whose centroid is, within the spread that differences of
similar vectors have, as near as its own. Inside an area, cells are fitted on the spot, so that what
every task must know grows only with the number of areas.

Within a cell, a vector is its residual from the cell's centroid: the signs of the residual after a
random rotation, packed into words of 64 bits, and three scalars (its length, its inner product with the
centroid and how well the signs stand for its direction). A query's rotated residual is quantised to
four bits, kept as bit planes, and its inner products with codes are counted bits of the planes
and the codes. Only vectors whose upper bound reaches both the wanted similarity and the k-th largest lower
bound of their cell are compared exactly, in double precision.

What limits recall is the choice of areas and cells and the bound's confidence, not the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.arrow import sorted_groups
from gristmill.functions.codepoints import BASE, MASK, mix
from gristmill.session import checkpoint

#: Vectors per area that the number of areas aims at; areas are fitted on so many vectors of the sample each.
AREA, SAMPLE_OF_AREA, LEAST_SAMPLE = 20_000, 64, 8_192
#: There are no more areas than this, so that centroids stay some 10 MB; larger areas are searched in blocks.
MOST_AREAS = 25_000
#: A query goes to so many areas and, in each, so many cells at most.
AREAS, PROBES = 8, 16
CELL = 250  # vectors per cell
CELL_SAMPLE = 4_096
#: Rows of one area that a task compares at once; a larger area is searched in blocks, each by all its queries.
BLOCK = 40_000
#: Without a wanted similarity, areas and cells are chosen as for this one.
LEAST_REACH = 0.5
BOUND = 2.6  # half-width of the error bound, in standard deviations of the estimate (0.3 % of the bounds fail)
PLANES = 4  # bits of a query's quantised coordinates
SLICE = 256  # queries that are compared with a cell at once


def rotation(dim: int, bits: int) -> np.ndarray:
    """dim rows of bits columns: a random rotation of vectors padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(7919 + bits).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit vectors from a fixed start; empty cells keep their centroid."""
    rng = np.random.default_rng(104729)
    centre = sample[rng.choice(len(sample), size=min(cells, len(sample)), replace=False)].astype(np.float32)
    sample = sample.astype(np.float32)
    for _ in range(rounds if len(centre) > 1 else 1):
        best = np.concatenate([(sample[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(best, kind="stable")
        filled, edge = np.unique(best[order], return_index=True)
        sums = np.zeros_like(centre)
        sums[filled] = np.add.reduceat(sample[order], edge, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centre).astype(np.float32)
    return centre


class Codes:
    """Packed bit codes of a cell's vectors around its centroid, with the scalars that correct the estimates.

    For unit q and x with residuals q - c and x - c, <q, x> = <q, c> + <x - c, c> + <q - c, x - c>. The
    first two are scalars; the last is estimated as the inner product of the query's rotated residual with the
    signs that the packed bits stand for, divided by how well the signs fit the direction. With residuals
    quantised to low + step * u, that inner product is a sum over the bit planes of u of the counted bits
    that plane and code share.
    """

    def __init__(self, base: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        bits = turn.shape[1]
        residual = base - centre
        rotated = residual @ turn
        length = np.linalg.norm(residual, axis=1)
        fit = np.where(length > 1e-9, np.abs(rotated).sum(axis=1) / np.sqrt(bits) / np.maximum(length, 1e-12), 1.0)
        self.centre, self.turn, self.bits = centre, turn, bits
        self.code = np.packbits(rotated > 0, axis=1, bitorder="little").view(np.uint64)
        self.ones = np.bitwise_count(self.code).sum(axis=1).astype(np.float32)
        self.weight = (length / np.sqrt(bits) / np.maximum(fit, 1e-6)).astype(np.float32)
        self.spread = (length * np.sqrt(np.maximum(1 - fit**2, 0)) / np.maximum(fit, 1e-6) / np.sqrt(max(bits - 1, 1))).astype(np.float32)
        self.along = (residual @ centre).astype(np.float32)

    def estimates(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of unit queries with all vectors, and half-widths of their bounds."""
        residual = (query - self.centre) @ self.turn
        low = residual.min(axis=1, keepdims=True)
        step = np.maximum((residual.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-12)
        u = np.rint((residual - low) / step).astype(np.uint8)
        planes = [np.packbits((u >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]
        shared = np.zeros((len(query), len(self.code)), dtype=np.float32)
        for w in range(self.code.shape[1]):
            for j in range(0, PLANES, 2):  # two planes add up to at most 192 in a byte
                pair = np.bitwise_count(planes[j + 1][:, w, None] & self.code[:, w])
                pair <<= 1
                pair += np.bitwise_count(planes[j][:, w, None] & self.code[:, w])
                shared += np.multiply(pair, np.float32(1 << j), dtype=np.float32)
        total = low[:, 0] * self.bits + step[:, 0] * u.sum(axis=1)  # of the quantised residual
        # value = (2 * (low * ones + step * shared) - total) * weight + along + <q, c>, with the terms that don't need a pair taken together
        shared *= 2 * step.astype(np.float32)
        shared -= total.astype(np.float32)[:, None]
        shared += 2 * low.astype(np.float32) * self.ones
        shared *= self.weight
        shared += self.along
        shared += (query @ self.centre).astype(np.float32)[:, None]
        value = shared
        length = np.linalg.norm(residual, axis=1).astype(np.float32)
        rough = (step[:, 0] * np.sqrt(self.bits / 12)).astype(np.float32)  # what quantising adds
        return value, BOUND * (length[:, None] * self.spread + rough[:, None] * self.weight)

    def bounds(self, query: np.ndarray, side: int) -> np.ndarray:
        """Upper (side 1) or lower (side -1) bounds of the cosines of queries with all vectors, or the estimates (0)."""
        value, width = self.estimates(query)
        return value + side * width


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def first_of(groups: np.ndarray, similarity: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each group the k first rows by similarity, ties to the smaller id."""
    order = np.lexsort((ids, -similarity, groups))
    own = groups[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    place = np.arange(len(own)) - np.repeat(start, np.diff(np.concatenate([start, [len(own)]])))
    return order[place < k]


def within_reach(rows: np.ndarray, centre: np.ndarray, most: int, least: float, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, centroid) of the centroids near each row, the nearest and up to most in all, where the other of two vectors of similarity least may be.

    That one may have another nearest centroid by what the difference of the two has along the line between
    the centroids, which for a difference in a random direction is normal with deviation length / sqrt(dim).
    """
    near = rows @ centre.T
    best = near.argmax(axis=1)
    if most < len(centre):
        listed = np.argpartition(-near, most - 1, axis=1)[:, :most]
    else:
        listed = np.broadcast_to(np.arange(len(centre)), near.shape)
    apart = np.sqrt(max(2 - 2 * max(least, LEAST_REACH), 0.0))
    product = centre @ centre.T if len(centre) <= 1024 else None
    along = product[listed, best[:, None]] if product is not None else np.einsum("ijk,ik->ij", centre[listed], centre[best])
    between = np.sqrt(np.maximum(2 - 2 * along, 0))
    behind = near[np.arange(len(rows)), best][:, None] - np.take_along_axis(near, listed, axis=1)
    row, column = np.nonzero((behind <= BOUND * apart / np.sqrt(centre.shape[1]) * between) | (listed == best[:, None]))
    return row + first, listed[row, column].astype(np.int64)


def search_area(q_ids: np.ndarray, query: np.ndarray, b_ids: np.ndarray, base: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, ids and exact rounded cosines of the k best of each query among the base, itself left out."""
    dim = base.shape[1]
    turn = rotation(dim, -(-dim // 64) * 64)
    b_unit, q_unit = unit(base), unit(query)
    pick = np.random.default_rng(15485863).permutation(len(base))[:CELL_SAMPLE]
    centre = centroids(b_unit[pick], max(1, len(base) // CELL), 4)
    home = np.concatenate([(b_unit[i : i + 8192].astype(np.float32) @ centre.T).argmax(axis=1) for i in range(0, len(base), 8192)])
    order = np.argsort(home, kind="stable")
    b_unit, b_ids = b_unit[order], b_ids[order]
    edges = np.searchsorted(home[order], np.arange(len(centre) + 1))
    p = min(PROBES, len(centre))
    who, cell = (np.concatenate(x) for x in zip(*(within_reach(q_unit[i : i + 8192].astype(np.float32), centre, p, least, i) for i in range(0, len(query), 8192))))
    asked = np.argsort(cell, kind="stable")
    who = who[asked]
    marks = np.searchsorted(cell[asked], np.arange(len(centre) + 1))
    found: list[list[np.ndarray]] = [[], [], []]
    for c in range(len(centre)):
        a, b = edges[c], edges[c + 1]
        own = who[marks[c] : marks[c + 1]]
        if a == b or not len(own):
            continue
        codes = Codes(b_unit[a:b], centre[c].astype(np.float64), turn)
        for start in range(0, len(own), SLICE):
            rows = own[start : start + SLICE]
            value, width = codes.estimates(q_unit[rows])
            upper = value + width
            floor = np.full(len(rows), least)
            if b - a > 4 * k:
                many = np.flatnonzero((upper >= least).sum(axis=1) > 4 * k)
                if len(many):  # the k-th best lower bound, one more because the query itself may be in the cell
                    floor[many] = np.maximum(least, np.partition(value[many] - width[many], b - a - k - 1, axis=1)[:, b - a - k - 1])
            x, y = np.nonzero(upper >= floor[:, None] - 1e-6)
            exact = np.round(np.einsum("ij,ij->i", q_unit[rows[x]], b_unit[a + y]), 6)
            good = np.flatnonzero((exact >= least) & (b_ids[a + y] != q_ids[rows[x]]))
            for to, part in zip(found, (rows[x[good]], b_ids[a + y[good]], exact[good])):
                to.append(part)
    if not found[0]:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    q, ids, exact = map(np.concatenate, found)
    keep = first_of(q, exact, ids, k)
    return q[keep], ids[keep], exact[keep]


def exploded(batches: DataFrame) -> DataFrame:
    """(model, vec_id, batch_id, place, vector): one row per vector of a batch with as many elements as the batch says."""
    rows = batches.select(F.coalesce("batch_id", F.lit((1 << 63) - 1)).alias("batch_id"), "model", "dim", F.posexplode(F.arrays_zip("vec_ids", "vectors")).alias("place", "v"))
    rows = rows.select("model", F.col("v.vec_ids").alias("vec_id"), "batch_id", "place", F.col("v.vectors").alias("vector"), "dim")
    return rows.where("vec_id is not null and model is not null and dim > 0 and size(vector) = dim").drop("dim")


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of one length) as a matrix, and which of them are usable: no null, all finite, not all zero."""
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return values, np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)


def of_models(part: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    models = np.array(part.column("model").to_pylist(), dtype=object)
    for model in dict.fromkeys(models.tolist()):
        yield model, part.take(pa.array(np.flatnonzero(models == model)))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(model, vec_id, batch_id, place, same) of the usable vectors; same is a hash of the values."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, own in of_models(part):
                for size in np.unique(own.column("vector").value_lengths().to_numpy()):
                    some = own.take(pa.array(np.flatnonzero(own.column("vector").value_lengths().to_numpy() == size)))
                    values, good = matrix(some.column("vector"))
                    with np.errstate(over="ignore"):
                        bits = (values.astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.uint64)  # -0 is 0
                        odd = mix(np.arange(1, bits.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
                        same = mix((mix(bits + odd) * odd).sum(axis=1, dtype=np.uint64) * np.uint64(BASE & MASK) + np.uint64(size))
                    keep = pa.array(np.flatnonzero(good))
                    yield pa.RecordBatch.from_arrays([*(some.column(c).take(keep) for c in ("model", "vec_id", "batch_id", "place")), pa.array(same.view(np.int64)).take(keep)], ["model", "vec_id", "batch_id", "place", "same"])

    return rows.mapInArrow(run, "model string, vec_id bigint, batch_id bigint, place int, same bigint")


def usable(batches: DataFrame) -> DataFrame:
    """(model, vec_id, batch_id, place, same) of the vectors that are not null, have dim elements, all finite, and are not all zero.

    A vector sent several times counts once; should its values differ, those of the smallest batch_id count.
    """
    first = fingerprints(exploded(batches)).groupBy("model", "vec_id").agg(F.min(F.struct("batch_id", "place", "same")).alias("f"))
    return first.select("model", "vec_id", "f.batch_id", "f.place", "f.same")


class SimilarVectors:
    """Index over usable(batches): each distinct vector once, in the area of its nearest centroid.

    Copies of one vector under several ids are one row of the index with all searches done once; their
    ids come back in the results, the smallest first, as ties go to the smaller id. What is shuffled
    of vectors are the rows of areas and their queries; ids, copies and batches are settled on narrow tables.
    """

    def __init__(self, batches: DataFrame, k: int = 5, areas: int = AREAS):
        self.k, self.areas = k, areas
        rows = exploded(batches)
        sent = checkpoint(fingerprints(rows))
        first = sent.groupBy("model", "vec_id").agg(F.min(F.struct("batch_id", "place", "same")).alias("f"))
        self.vectors = checkpoint(first.select("model", "vec_id", "f.batch_id", "f.place", "f.same"))
        # One row of the index per distinct vector: its smallest id, and the k + 1 smallest of its ids.
        ranked = Window.partitionBy("model", "same").orderBy("vec_id")
        self.classes = checkpoint(self.vectors.groupBy("model", "same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
        few = self.vectors.join(self.classes.where("copies > 1").select("model", "same"), ["model", "same"]).select("model", "same", "vec_id")
        self.first_ids = few.withColumn("r", F.row_number().over(ranked)).where(f"r <= {k + 1}").select("model", "same", "vec_id")
        kept = self.vectors.join(self.classes.select("model", "same", "vec_id"), ["model", "same", "vec_id"], "left_semi")
        key = ["model", "vec_id", "batch_id", "place"]
        others = sent.select(*key).join(kept.select(*key), key, "left_anti")  # re-sent ones and copies, by far the fewer
        self.points = rows.join(others, key, "left_anti").select("model", "vec_id", "vector")
        self.amounts = {r["model"]: r["n"] for r in self.classes.groupBy("model").agg(F.count("*").alias("n")).collect()}
        self.index = self.fit()

    def fit(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """By model: centroids of areas, and the number of blocks that each area is searched in."""
        out, wanted = {}, F.lit(0.0)
        for model, amount in self.amounts.items():
            areas = max(1, min(MOST_AREAS, amount // AREA))
            take = max(LEAST_SAMPLE, SAMPLE_OF_AREA * areas)
            wanted = F.when(F.col("model") == model, min(1.0, take / amount)).otherwise(wanted)
            out[model] = areas
        # At most SAMPLE_OF_AREA * MOST_AREAS vectors of a model are expected.
        chosen = self.points.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < wanted * (1 << 30)).select("model", "vec_id", "vector").toArrow()
        for model, areas in out.items():
            own = chosen.filter(pa.compute.equal(chosen["model"], model)).sort_by("vec_id")
            values, good = matrix(own["vector"].combine_chunks()) if own.num_rows else (np.ones((1, 1)), np.ones(1, bool))
            sample = unit(values[good].astype(np.float64))
            centre = centroids(sample, areas)
            share = np.bincount((sample @ centre.T).argmax(axis=1), minlength=len(centre)) / len(sample)
            out[model] = (centre, np.maximum(1, np.ceil(share * self.amounts[model] / BLOCK)).astype(np.int32))
        return out

    def spread(self, least: float, queries: Column | None = None) -> DataFrame:
        """(key, home, asked, vec_id, vector): each vector in its own area, as part of the base and, if asked for, as a query; and as a query in other areas."""
        shared = self.points.sparkSession.sparkContext.broadcast(self.index)
        order = {m: i for i, m in enumerate(sorted(self.index))}
        most = self.areas

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part in parts:
                for model, own in of_models(part):
                    values, good = matrix(own.column("vector"))
                    own = own.take(pa.array(np.flatnonzero(good)))
                    if not own.num_rows:
                        continue
                    values = unit(values[good].astype(np.float64)).astype(np.float32)
                    ids, asked = own.column("vec_id").to_numpy(), own.column("asked").to_numpy(zero_copy_only=False)
                    centre, blocks = index[model]
                    best = (values @ centre.T).argmax(axis=1)
                    source, area = within_reach(values, centre, most, least)
                    source, area = source[asked[source]], area[asked[source]]
                    times = blocks[area]
                    source, area = np.repeat(source, times), np.repeat(area, times)
                    block = np.arange(len(area)) - np.repeat(np.cumsum(times) - times, times)
                    spot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks[best]
                    other = np.flatnonzero((area != best[source]) | (block != spot[source]))  # where it is at home it is one row
                    keys = np.concatenate([(order[model] << 48) | (best.astype(np.int64) << 24) | spot, (order[model] << 48) | (area[other] << 24) | block[other]])
                    take = np.concatenate([np.arange(len(ids)), source[other]])
                    home = np.concatenate([np.ones(len(ids), bool), np.zeros(len(other), bool)])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(home), pa.array(np.concatenate([asked, np.ones(len(other), bool)])), pa.array(ids[take]), own.column("vector").take(pa.array(take))], ["key", "home", "asked", "vec_id", "vector"])

        points = self.points
        if queries is None:
            points = points.withColumn("asked", F.lit(True))
        else:  # a distinct vector is asked for if any of its ids is
            wanted = self.vectors.where(queries).select("model", "same").distinct().join(self.classes, ["model", "same"]).select("model", "vec_id", F.lit(True).alias("asked"))
            points = points.join(wanted, ["model", "vec_id"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        return points.select("model", "vec_id", "vector", "asked").mapInArrow(run, "key bigint, home boolean, asked boolean, vec_id bigint, vector array<float>")

    def neighbours(self, least: float = -1.0, queries: Column | None = None) -> DataFrame:
        """(model, vec_id, other, similarity): for each distinct vector its k most similar distinct vectors of at least that similarity."""
        names = sorted(self.index)
        k = self.k

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in sorted_groups(parts, "key", 20_000):
                keys, home, asked, ids = (table[c].to_numpy() for c in ("key", "home", "asked", "vec_id"))
                column = table["vector"].combine_chunks()
                offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
                edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
                for a, b in zip(edges[:-1], edges[1:]):
                    rows = values[offsets[a] : offsets[b]].reshape(b - a, -1).astype(np.float64)
                    at = np.unique(ids[a:b], return_index=True)[1]  # a row that was repeated as a whole counts once
                    own, ask = at[home[a:b][at]], at[asked[a:b][at]]
                    if not len(own) or not len(ask):
                        continue
                    q, other, value = search_area(ids[a:b][ask], rows[ask], ids[a:b][own], rows[own], k, least)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array([names[int(keys[a]) >> 48]] * len(q)), pa.array(ids[a:b][ask][q]), pa.array(other), pa.array(value)], ["model", "vec_id", "other", "similarity"])

        found = self.spread(least, queries).repartition("key").sortWithinPartitions("key").mapInArrow(run, "model string, vec_id bigint, other bigint, similarity double")
        best = Window.partitionBy("model", "vec_id").orderBy(F.desc("similarity"), "other")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")

    def top(self, least: float = -1.0, queries: Column | None = None) -> DataFrame:
        """(model, vec_id, other, similarity, rank): the k most similar vectors of every vector, copies included.

        Given a condition on vec_id, only of the vectors that it holds for, still against all vectors.
        """
        classes = self.classes.select("model", F.col("vec_id").alias("rep"), "same", "copies")
        near = self.neighbours(least, queries)
        # Distinct vectors found, and the vector itself, become the ids of their copies; k + 1 ids of each are enough.
        itself = classes.where("copies > 1").select("model", F.col("rep").alias("vec_id"), F.col("rep").alias("other"), F.lit(1.0).alias("similarity"))
        named = self.first_ids.join(classes.select("model", "same", F.col("rep").alias("other")), ["model", "same"]).select("model", "other", F.col("vec_id").alias("id"))
        wide = near.unionByName(itself).join(named, ["model", "other"], "left").select("model", "vec_id", F.coalesce("id", "other").alias("other"), "similarity")
        best = Window.partitionBy("model", "vec_id").orderBy(F.desc("similarity"), "other")
        wide = wide.withColumn("r", F.row_number().over(best)).where(F.col("r") <= self.k + 1).drop("r")
        wanted = self.vectors if queries is None else self.vectors.where(queries)
        many = wanted.select("model", "same", F.col("vec_id").alias("member")).join(classes.where("copies > 1"), ["model", "same"]).select("model", F.col("rep").alias("vec_id"), "member")
        named_rows = wide.join(many, ["model", "vec_id"])
        single = wide.join(classes.where("copies = 1").select("model", F.col("rep").alias("vec_id")), ["model", "vec_id"], "left_semi")
        out = named_rows.select("model", F.col("member").alias("vec_id"), "other", "similarity").unionByName(single).where("vec_id != other")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k)

    def close_pairs(self, least: float = 0.8) -> DataFrame:
        """(vec_id_a, vec_id_b): a < b, similar enough, and one among the other's k most similar."""
        return self.top(least).select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
