"""Schemas that drift between runs: profiles of JSON fields, changes from run to run, one unified table.

Fields are profiled per run and place: in how many objects they are, their JSON types, and a sketch
of their values (least of eight hashes over all values). Versions that follow one another are compared
by a bipartite matching between the fields that vanished and those that appeared, whose weights come
from types, value sketches and the similarity of names. The strict report keeps only what types alone
make certain; all else (renames with their scores, names under which fields are unified) follows the matching.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.session import broadcast_if_small, checkpoint

TYPES = ("boolean", "number", "string", "array", "object")
SKETCH = 8
#: Weights of equal types, of value sketches and of names in the score of a match, and the score from which it counts.
TYPE_WEIGHT, SKETCH_WEIGHT, NAME_WEIGHT, LIKELY = 0.25, 0.35, 0.4, 0.4
#: Types that are unknown (only nulls), or that differ, count so much.
UNKNOWN_TYPE, OTHER_TYPE = 0.5, 0.25
#: So many (place, field) names, or distinct renames, come to the driver at most: the most frequent ones. Other fields keep their names.
MOST_NAMES = 10_000
#: Columns of a unified table; rarer fields share its column _rest.
MOST_COLUMNS = 1_000
#: Profiles that a task holds before it hands them on.
HELD = 100_000


def refuse(name: str) -> None:
    raise ValueError(name)


def json_type(value) -> int:
    """One bit per JSON type; 0 for null."""
    if value is None:
        return 0
    if isinstance(value, bool):
        return 1
    if isinstance(value, (int, float)):
        return 2
    return 4 if isinstance(value, str) else 8 if isinstance(value, list) else 16


def plain(value) -> str:
    """A value's text, the same for 5 and "5", so that sketches tell values of changed types."""
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def walk(place: str, obj: dict) -> Iterator[tuple[str, str | None, object]]:
    """(place, field, value) of an object and of the objects in its arrays; field None once per object."""
    yield place, None, None
    for key, value in obj.items():
        yield place, key, value
        if isinstance(value, list):
            for part in value:
                if isinstance(part, dict):
                    yield from walk(f"{place}.{key}", part)


def profile_json(rows: DataFrame) -> DataFrame:
    """Profiles of the objects in rows (run_id, place, body); a row with field null stands for the place itself.

    Text that isn't JSON, or isn't an object, is ignored.
    """
    odd = np.random.default_rng(31337).integers(1, 1 << 32, size=SKETCH, dtype=np.uint32) | np.uint32(1)

    def flush(index: dict, at: list, types: list, hashes: list) -> pa.RecordBatch:
        n = len(index)
        at, types, hashes = np.array(at, np.int64), np.array(types, np.int32), np.array(hashes, np.uint32)
        masks = np.zeros(n, np.int32)
        np.bitwise_or.at(masks, at, types)
        order = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[order], np.arange(n))
        with np.errstate(over="ignore"):
            mixed = hashes[order, None] * odd
            mixed ^= mixed >> np.uint32(15)
        least = np.minimum.reduceat(mixed, edges, axis=0) if n else np.empty((0, SKETCH), np.uint32)
        keys = list(index)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(masks), pa.array(np.bincount(at, minlength=n).astype(np.int64)), pa.array(np.bincount(at, weights=types > 0, minlength=n).astype(np.int64))] + [pa.array(least[:, i].astype(np.int64)) for i in range(SKETCH)],
            ["run_id", "place", "field", "types", "objects", "values", *(f"s{i}" for i in range(SKETCH))],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple, int] = {}
        at, types, hashes = [], [], []
        for part in parts:
            for run_id, place, body in zip(*(part.column(c).to_pylist() for c in ("run_id", "place", "body"))):
                try:
                    obj = json.loads(body, parse_constant=refuse)
                except (ValueError, RecursionError):
                    continue
                if not isinstance(obj, dict):
                    continue
                for where, field, value in walk(place, obj):
                    at.append(index.setdefault((run_id, where, field), len(index)))
                    types.append(json_type(value))
                    hashes.append(zlib.crc32(plain(value).encode("utf-8", "replace")) if value is not None else 0xFFFFFFFF)
            if len(index) > HELD or len(at) > 20 * HELD:
                yield flush(index, at, types, hashes)
                index, at, types, hashes = {}, [], [], []
        yield flush(index, at, types, hashes)

    schema = "run_id string, place string, field string, types int, objects bigint, values bigint, " + ", ".join(f"s{i} bigint" for i in range(SKETCH))
    return rows.where("run_id is not null and place is not null and body is not null").mapInArrow(run, schema)


def layouts(profiles: DataFrame) -> DataFrame:
    """(run_id, place, objects, fields): the layout of each place of each run, its fields with types, counts and sketches.

    One shuffle by run and place serves both steps; a run with most of the rows is already one row per task and field.
    """
    least = [F.min(f"s{i}").alias(f"s{i}") for i in range(SKETCH)]
    per = profiles.repartition("run_id", "place").groupBy("run_id", "place", "field").agg(F.bit_or("types").alias("types"), F.sum("objects").alias("objects"), F.sum("values").alias("values"), *least)
    one = F.struct("field", "types", "objects", "values", F.array(*(f"s{i}" for i in range(SKETCH))).alias("sketch"))
    return per.groupBy("run_id", "place").agg(F.max(F.when(F.col("field").isNull(), F.col("objects"))).alias("objects"), F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), one))).alias("fields"))


def flat(found: DataFrame) -> DataFrame:
    """Layouts as profiles again, a row for each field and one for the place."""
    sketch = [F.col("f.sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    each = found.select("run_id", "place", F.explode("fields").alias("f")).select("run_id", "place", "f.field", "f.types", "f.objects", "f.values", *sketch)
    none = [F.lit(0xFFFFFFFF).cast("bigint").alias(f"s{i}") for i in range(SKETCH)]
    return each.unionByName(found.select("run_id", "place", F.lit(None).cast("string").alias("field"), F.lit(0).alias("types"), "objects", F.lit(0).cast("bigint").alias("values"), *none))


def metric_profiles(metrics: DataFrame) -> DataFrame:
    """Profiles of metrics_v1: its rows, and its states where they aren't null."""
    known = F.col("state").isNotNull()
    hashed = F.crc32(F.col("state").cast("binary"))
    least = [F.coalesce(F.min(F.when(known, F.pmod(hashed * (2 * i + 1), F.lit(1 << 32)))), F.lit(0xFFFFFFFF)).cast("bigint").alias(f"s{i}") for i in range(SKETCH)]
    runs = metrics.where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("rows"), F.count("state").alias("states"), *least)
    lit = lambda v, k: F.lit(v).cast(k)
    kinds = F.array(F.struct(lit(None, "string").alias("field"), lit(0, "int").alias("types"), F.col("rows").alias("objects"), lit(0, "bigint").alias("values")), F.struct(lit("state", "string").alias("field"), lit(4, "int").alias("types"), F.col("states").alias("objects"), F.col("states").alias("values")))
    return runs.withColumn("k", F.explode(kinds)).where("k.field is null or states > 0").select("run_id", F.lit("metrics_v1").alias("place"), "k.*", *(f"s{i}" for i in range(SKETCH)))


def profiles(eval_results: DataFrame, records: DataFrame, metrics: DataFrame, kind: str | None = None) -> DataFrame:
    """Layouts of all places of all runs: result bodies, payloads by kind, and the state of metrics; or of one kind and its arrays."""
    bodies = eval_results.select("run_id", F.lit("eval_results").alias("place"), F.col("body"))
    payloads = records.select("run_id", F.col("kind").alias("place"), F.col("payload_json").alias("body"))
    if kind is not None:
        return layouts(profile_json(bodies if kind == "eval_results" else payloads.where(F.col("place") == kind)))
    return layouts(profile_json(bodies.unionByName(payloads)).unionByName(metric_profiles(metrics)))


def instant(text: str) -> Column:
    """The timestamp of an ISO-8601 text in any of its spellings of zones; no zone means UTC; null if it isn't one."""
    clean = F.regexp_replace(F.upper(F.trim(F.col(text))), r"\s*(Z|UTC|GMT)$", "+00:00")
    clean = F.regexp_replace(clean, r"(?<=:\d\d|:\d\d\.\d{1,9})\s*([+-]\d\d):?(\d\d)?$", "$1:$2")
    clean = F.regexp_replace(clean, r"([+-]\d\d):$", "$1:00")
    clean = F.when(clean.rlike(r"[+-]\d\d:\d\d$"), clean).otherwise(F.concat(clean, F.lit("+00:00")))
    return clean.try_cast("timestamp")


def steps(found: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, prev_id, place): each run with the run before it of the same worker that has the place.

    The order is by started_at, ties by id. The lag is taken within days and then across the last
    runs of days, so no task has to hold all runs of one worker.
    """
    when = runs.where("id is not null and claimed_by is not null").groupBy("id").agg(F.min("claimed_by").alias("worker"), F.min(instant("started_at")).alias("at")).where("at is not null").select(F.col("id").alias("run_id"), "worker", "at")
    seen = found.where("objects is not null").select("run_id", "place").join(when, "run_id").withColumn("day", F.to_date("at"))
    inner = Window.partitionBy("worker", "place", "day").orderBy("at", "run_id")
    outer = Window.partitionBy("worker", "place").orderBy("day")
    days = seen.groupBy("worker", "place", "day").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("last")).withColumn("before", F.lag("last").over(outer)).drop("last")
    lagged = seen.withColumn("prev", F.lag("run_id").over(inner))
    joined = lagged.join(days, ["worker", "place", "day"])
    return joined.select("run_id", F.coalesce("prev", "before").alias("prev_id"), "place").where("prev_id is not null")


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, case and underscores aside."""
    grams = [defaultdict(int), defaultdict(int)]
    for name, own in zip((a, b), grams):
        plain = f"^{name.replace('_', '').lower()}$"
        for i in range(len(plain) - 1):
            own[plain[i : i + 2]] += 1
    return 2 * sum(min(n, grams[1][g]) for g, n in grams[0].items()) / max(1, sum(grams[0].values()) + sum(grams[1].values()))


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a matching with the largest total score; pairs without a positive score are left out.

    Shortest augmenting paths with potentials on the (few) fields that changed in one step.
    """
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], column = i, 0
        reach, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            done[column] = True
            slack = cost[owner[column] - 1] - row_price[owner[column]] - column_price[1:]
            better = ~done[1:] & (slack < reach[1:])
            reach[1:][better], back[1:][better] = slack[better], column
            nearest = int(np.where(done[1:], np.inf, reach[1:]).argmin()) + 1
            delta = reach[nearest]
            np.add.at(row_price, owner[done], delta)
            column_price[done] -= delta
            reach[1:][~done[1:]] -= delta
            column = nearest
            if owner[column] == 0:
                break
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j] and score[(j - 1, owner[j] - 1) if flip else (owner[j] - 1, j - 1)] > 0]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def scores(old: dict, new: dict, gone: list[str], come: list[str], strict: bool) -> np.ndarray:
    """How well each vanished field matches each that appeared, from 0 to 1: types, value sketches and names. Strict: 0 unless types are equal and known."""
    types = np.array([[1.0 if old[a][0] == new[b][0] != 0 else UNKNOWN_TYPE if not old[a][0] or not new[b][0] else OTHER_TYPE for b in come] for a in gone])
    sketch = np.array([[np.mean(np.equal(old[a][1], new[b][1])) if old[a][0] and new[b][0] else 0.0 for b in come] for a in gone])
    names = np.array([[name_similarity(a, b) for b in come] for a in gone])
    score = TYPE_WEIGHT * types + SKETCH_WEIGHT * sketch + NAME_WEIGHT * names
    return np.where(types == 1, score, 0) if strict else score


def compare(old: dict, new: dict, strict: bool) -> list[tuple[str, str | None, str, float, float, bool]]:
    """(field, earlier name, kind of drift, score, runner-up's score, retyped) from one version's profiles to the next's.

    A profile is (types, sketch). The best matching by types, value sketches and names tells renamed fields
    from removed and added ones, where its score is likely or no other field has the two fields' types. A
    field can be renamed and retyped in one step. The runner-up is the best other match of either field. Strict
    keeps a match only if types are equal and neither field could, by types, have matched another one.
    """
    gone, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    out = [(f, None, "retyped", 1.0, 0.0, True) for f in sorted(set(old) & set(new)) if old[f][0] and new[f][0] and old[f][0] != new[f][0]]
    matched: list[tuple[int, int]] = []
    if gone and come:
        score = scores(old, new, gone, come, strict)
        fits = np.array([[old[a][0] == new[b][0] != 0 for b in come] for a in gone])
        alone = (fits.sum(axis=1, keepdims=True) == 1) & (fits.sum(axis=0, keepdims=True) == 1) & fits
        for i, j in assignment(score):
            if alone[i, j] or (not strict and score[i, j] >= LIKELY):
                matched.append((i, j))
                rest = np.concatenate([np.delete(score[i], j), np.delete(score[:, j], i)])
                out.append((come[j], gone[i], "renamed", float(score[i, j]), float(rest.max(initial=0.0)), not fits[i, j]))
    left, right = {i for i, _ in matched}, {j for _, j in matched}
    out += [(f, None, "removed", 1.0, 0.0, False) for i, f in enumerate(gone) if i not in left]
    return out + [(f, None, "added", 1.0, 0.0, False) for j, f in enumerate(come) if j not in right]


def changes(found: DataFrame, pairs: DataFrame, strict: bool = True) -> DataFrame:
    """(run_id, place, field, earlier, drift_kind, score, runner_up, retyped) of each step in pairs.

    Layouts are compared by their hashes first; fields are fetched only for the few steps that changed anything.
    """
    layout = found.select("run_id", "place", F.xxhash64(F.transform("fields", lambda x: F.concat_ws(":", x["field"], x["types"]))).alias("layout"))
    now, before = layout.withColumnRenamed("layout", "l1"), layout.select(F.col("run_id").alias("prev_id"), "place", F.col("layout").alias("l0"))
    differ = checkpoint(pairs.join(now, ["run_id", "place"]).join(before, ["prev_id", "place"]).where("l0 != l1").select("run_id", "prev_id", "place"))
    amount = differ.count()
    differ = broadcast_if_small(differ, amount)
    fields = F.transform("fields", lambda x: F.struct(x["field"].alias("field"), x["types"].alias("types"), x["sketch"].alias("sketch")))
    ends = found.select("run_id", "place", fields.alias("fields"))
    new = ends.join(differ, ["run_id", "place"]).select("run_id", "prev_id", "place", F.col("fields").alias("new"))
    old = ends.withColumnRenamed("run_id", "prev_id").join(differ, ["prev_id", "place"]).select("run_id", "prev_id", "place", F.col("fields").alias("old"))
    both = new.join(old, ["run_id", "prev_id", "place"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for r in part.select(["run_id", "place", "old", "new"]).to_pylist():
                old, new = ({f["field"]: (f["types"], f["sketch"]) for f in r[k] or []} for k in ("old", "new"))
                rows += [(r["run_id"], r["place"], *x) for x in compare(old, new, strict)]
            columns = list(zip(*rows)) or [[]] * 8
            arrays = [*(pa.array(c, pa.string()) for c in columns[:5]), *(pa.array(c, pa.float64()) for c in columns[5:7]), pa.array(columns[7], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["run_id", "place", "field", "earlier", "drift_kind", "score", "runner_up", "retyped"])

    return both.mapInArrow(run, "run_id string, place string, field string, earlier string, drift_kind string, score double, runner_up double, retyped boolean")


def drift_report(runs: DataFrame, eval_results: DataFrame, records: DataFrame, metrics: DataFrame, strict: bool = True) -> DataFrame:
    """Every field that was added, removed, renamed or retyped, by run and place.

    Null run ids, kinds and bodies are ignored, as are runs without worker or start; repeated rows
    change nothing; other columns aren't read; empty tables give an empty report.
    """
    found = checkpoint(profiles(eval_results, records, metrics))
    return changes(found, steps(found, runs), strict)


def canonical_names(found: DataFrame, renames: DataFrame) -> dict[tuple[str, str], str]:
    """The canonical name of every (place, field) that renames join with others: the most frequent name of each group.

    Two names are never joined if one run has both. At most MOST_NAMES distinct renames, the surest, come to the
    driver; a field that isn't in the result keeps its own name.
    """
    edges = renames.where("drift_kind = 'renamed'").groupBy("place", "earlier", "field").agg((F.count("*") * F.avg("score")).alias("w"))
    edges = sorted(map(tuple, edges.orderBy(F.desc("w"), "place", "earlier", "field").limit(MOST_NAMES).collect()), key=lambda r: (-r[3], r[:3]))
    if not edges:
        return {}
    named = found.sparkSession.createDataFrame(sorted({(p, x) for p, a, b, _ in edges for x in (a, b)}), "place string, field string")
    fields = found.select("run_id", "place", F.explode("fields").alias("f")).select("run_id", "place", "f.field").join(F.broadcast(named), ["place", "field"])  # at most 2 * MOST_NAMES rows
    sets = checkpoint(fields.groupBy("run_id", "place").agg(F.sort_array(F.collect_set("field")).alias("f")).groupBy("place", "f").agg(F.count("*").alias("runs")))
    counts = {(r[0], r[1]): r[2] for r in sets.select("place", F.explode("f").alias("field"), "runs").groupBy("place", "field").agg(F.sum("runs")).collect()}
    both = sets.select("place", "f", F.explode("f").alias("a")).select("place", "a", F.explode("f").alias("b")).where("a < b").distinct().collect()
    together = defaultdict(set)
    for place, a, b in both:
        together[place, a].add(b)
        together[place, b].add(a)
    group = {k: {k[1]} for k in counts}
    for place, a, b, _ in edges:
        one, two = group.get((place, a)), group.get((place, b))
        if one is None or two is None or one is two or any(together[place, x] & two for x in one):
            continue
        one |= two
        for name in two:
            group[place, name] = one
    return {(place, name): max(names, key=lambda x: (counts[place, x], x)) for (place, name), names in group.items() if len(names) > 1}


def field_column(entries: Column, members: list[str], mask: int, inner: list[tuple[str, list[str], int]]) -> Column:
    """The value of a field under the first of its names that an object (a map of JSON texts) has, in its one type.

    An array of objects whose canonical fields are given as inner becomes an array of structs; other arrays, objects
    and mixed types stay JSON text.
    """
    value = F.coalesce(*(F.try_element_at(entries, F.lit(m)) for m in members))
    if mask == 1:
        return value.try_cast("boolean")
    if mask == 2:
        return value.try_cast("double")
    if mask == 8 and inner:
        parts = F.filter(F.from_json(value, "array<string>"), lambda x: F.startswith(F.ltrim(x), F.lit("{")))  # other elements aren't objects
        objects = F.filter(F.transform(parts, lambda x: F.from_json(x, "map<string,string>")), lambda m: m.isNotNull())
        return F.transform(objects, lambda m: F.struct(*(field_column(m, own, t, []).alias(name) for name, own, t in inner)))
    return value


def canonical_fields(found: DataFrame, names: dict[tuple[str, str], str], place: str) -> list[tuple[str, list[str], int]]:
    """(canonical name, its names, types) of the most frequent fields of a place, at most MOST_COLUMNS + 1 names."""
    own = found.where(F.col("place") == place).select(F.explode("fields").alias("f")).groupBy("f.field").agg(F.bit_or("f.types").alias("t"), F.count("*").alias("n"))
    groups: dict[str, list] = defaultdict(lambda: [[], 0])
    for name, types, _ in own.orderBy(F.desc("n"), "field").limit(MOST_COLUMNS + 1).collect():
        canonical = names.get((place, name), name)
        groups[canonical][0].append(name)
        groups[canonical][1] |= types
    return [(c, sorted(own, key=lambda m: (m != c, m)), t) for c, (own, t) in sorted(groups.items())]


def unified(rows: DataFrame, fields: list[tuple[str, list[str], int]], inner: dict[str, list], keep: list[str]) -> DataFrame:
    """One table for all layouts of a place: a typed column per canonical field, after the columns in keep.

    rows has the JSON in body. Fields of a single scalar type keep it, arrays of objects in inner become arrays of
    structs, all else comes as text, arrays and objects as JSON. A column of keep whose name clashes
    with a field keeps its name, and the field gets the suffix _field. Where a place has more than MOST_COLUMNS names,
    the rarer ones are in a map column _rest. Rows whose JSON isn't an object are left out.
    """
    base = rows.withColumn("_m", F.from_json("body", "map<string,string>")).where("_m is not null")
    taken = {k.lower() for k in keep}
    many = sum(len(m) for _, m, _ in fields) > MOST_COLUMNS
    columns = [field_column(F.col("_m"), members, mask, inner.get(name, [])).alias(name + "_field" if name.lower() in taken else name) for name, members, mask in fields]
    if many:
        listed = F.array(*(F.lit(m) for _, members, _ in fields for m in members))
        columns.append(F.map_filter("_m", lambda k, v: ~F.array_contains(listed, k)).alias("_rest"))
    return base.select(*keep, *columns)


def nested(rows: DataFrame, members: list[str], keep: list[str]) -> DataFrame:
    """The elements of the arrays that rows have under one of the names: keep, path (places in the arrays, from 0) and body."""
    parsed = F.from_json("body", "map<string,string>")
    array = F.coalesce(*(F.try_element_at("_m", F.lit(m)) for m in members))
    parts = rows.withColumn("_m", parsed).select(*keep, "path", F.posexplode(F.from_json(array, "array<string>")).alias("_at", "body"))
    return parts.withColumn("path", F.concat("path", F.array("_at"))).drop("_at")


def unify_kind(runs: DataFrame, eval_results: DataFrame, records: DataFrame, metrics: DataFrame, place: str) -> DataFrame:
    """All runs' rows of a place in one consistent table.

    A place is a kind of payload, eval_results, metrics_v1, or one of their arrays of objects, as in
    faithfulness.claims: one row per object, with the keys of its record and its path, the places in
    the arrays. Arrays go by their canonical names. Metrics keep their columns; a state that an old
    writer left null is 'measured'.
    """
    if place == "metrics_v1":
        return metrics.withColumn("state", F.coalesce("state", F.lit("measured")))
    kind, *inner = place.split(".")
    if kind == "eval_results":
        keep = ["result_id", "run_id", "written_at"]
        rows = eval_results.select(*keep, "body")
    else:
        keep = ["id", "run_id", "suite", "payload_schema", "received_at"]
        rows = records.where(F.col("kind") == kind).select(*keep, F.col("payload_json").alias("body"))
    found = checkpoint(profiles(eval_results, records, metrics, kind))
    if inner:
        rows = rows.withColumn("path", F.array().cast("array<int>"))
    at, names = kind, canonical_names(found, changes(found, steps(found, runs), strict=False))
    for field in [*inner, None]:
        fields = canonical_fields(found, names, at)
        # Arrays that were renamed are one place from here on, so that renames inside are followed across.
        arrays = {c: m for c, m, t in fields if t & 8 and (field is None or c == names.get((at, field), field))}
        if field is not None and not arrays:
            arrays = {field: [field]}
        if any(len(m) > 1 or m[0] != c for c, m in arrays.items()):
            for canonical, members in arrays.items():
                old = "^(" + "|".join(re.escape(f"{at}.{m}") for m in members) + r")(?=\.|$)"
                found = found.withColumn("place", F.regexp_replace("place", F.lit(old), F.lit(f"{at}.{canonical}".replace("\\", "\\\\").replace("$", "\\$"))))
            found = checkpoint(layouts(flat(found)))
            names = canonical_names(found, changes(found, steps(found, runs), strict=False))
        if field is not None:
            canonical, members = next(iter(arrays.items()))
            rows = nested(rows, members, keep)
            at = f"{at}.{canonical}"
    nested_fields = {c: canonical_fields(found, names, f"{at}.{c}") for c in arrays}
    return unified(rows, fields, nested_fields, [*keep, "path"] if inner else keep)
