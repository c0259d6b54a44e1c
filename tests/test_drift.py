import itertools
import json
import random

import numpy as np

from gristmill.operators import drift
from gristmill.operators.drift import assignment, compare, drift_report, instant, name_similarity, unify_kind

RUNS = "id string, claimed_by string, started_at string, extra int"
RESULTS = "result_id long, run_id string, written_at timestamp, body string"
RECORDS = "id long, run_id string, suite string, kind string, payload_json string, payload_schema int, received_at timestamp"
METRICS = "run_id string, suite string, name string, variant string, value double, state string, reason string"


def frames(spark, payloads, runs=None, results=(), metrics=()):
    runs = runs or [(f"r{i}", "w", f"2030-01-{i + 1:02d}T00:00:00Z", 0) for i in range(len(payloads))]
    records = [(n, run, "s", "attack", p if isinstance(p, str) or p is None else json.dumps(p), None, None) for n, (run, p) in enumerate(payloads)]
    return [spark.createDataFrame(runs, RUNS), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(records, RECORDS), spark.createDataFrame(list(metrics), METRICS)]


def report(*tables):
    return {(r["run_id"], r["place"], r["field"], r["drift_kind"]) for r in drift_report(*tables).collect()}


def test_all_kinds_of_drift(spark):
    payloads = [("r0", {"a": 1, "old": "x", "gone": True, "list": [{"k": 1}]}), ("r1", {"a": "1", "new": "y", "more": [1], "list": [{"k": 1, "n": None}]})]
    assert report(*frames(spark, payloads)) == {("r1", "attack", "a", "retyped"), ("r1", "attack", "new", "renamed"), ("r1", "attack", "gone", "removed"), ("r1", "attack", "more", "added"), ("r1", "attack.list", "n", "added")}


def test_ambiguous_names_are_not_renamed(spark):
    payloads = [("r0", {"x": "1", "y": "2"}), ("r1", {"u": "1", "v": "2"})]
    assert {d for *_, d in report(*frames(spark, payloads))} == {"removed", "added"}


def test_order_is_by_instant_and_worker(spark):
    runs = [("r0", "w", "2030-01-01T23:00:00-07:00", 0), ("r1", "w", "2030-01-02T05:00:00+00:00", 0), ("r2", "v", "2030-01-02T05:30:00Z", 0), ("r3", None, None, 0)]
    payloads = [("r0", {"a": 1, "b": 1}), ("r1", {"a": 1}), ("r2", {"c": 1}), ("r3", {"d": 1}), ("r9", {"e": 1})]
    assert report(*frames(spark, payloads, runs)) == {("r0", "attack", "b", "added")}


def test_nulls_bad_json_repeats_and_empty(spark):
    payloads = [("r0", '{"a": 1'), ("r0", None), ("r0", "[1]"), ("r0", "NaN"), (None, {"z": 1}), ("r0", {"a": 1}), ("r0", {"a": 1}), ("r1", {"a": None})]
    runs = [("r0", "w", "2030-01-01T00:00:00Z", 0), ("r1", "w", "2030-01-02T00:00:00Z", 0), ("r1", "w", "2030-01-02T00:00:00Z", 0)]
    assert report(*frames(spark, payloads, runs)) == set()
    assert report(*[t.limit(0) for t in frames(spark, payloads, runs)]) == set()


def test_metric_state(spark):
    metrics = [("r0", "s", "n", "", 1.0, None, None), ("r1", "s", "n", "", 1.0, "measured", None)]
    tables = frames(spark, [("r0", {"a": 1}), ("r1", {"a": 1})], metrics=metrics)
    assert report(*tables) == {("r1", "metrics_v1", "state", "added")}


def test_unified_table(spark):
    payloads = [("r0", {"id": 1, "question": "a", "n": 1}), ("r1", {"id": 2, "query": "b", "n": 2}), ("r1", "broken{")]
    rows = unify_kind(*frames(spark, payloads), "attack")
    assert {(r["question"] if "question" in rows.columns else r["query"], r["n"], r["id_field"]) for r in rows.collect()} == {("a", 1.0, 1.0), ("b", 2.0, 2.0)}


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(100):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        score = np.array([[rng.choice([0, rng.random()]) for _ in range(m)] for _ in range(n)])
        best = max(sum(score[i][j] for i, j in zip(rows, columns)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for columns in itertools.permutations(range(m), k))
        assert abs(sum(score[i][j] for i, j in assignment(score)) - best) < 1e-9


def test_names_and_sketches_decide():
    one, two = [1] * 8, [2] * 8
    old, new = {"chunk_id": (4, one), "answer": (4, two)}, {"chunkId": (4, one), "answer_text": (4, two)}
    assert {(e, f) for f, e, kind, *_ in compare(old, new, False) if kind == "renamed"} == {("chunk_id", "chunkId"), ("answer", "answer_text")}
    assert name_similarity("chunk_id", "chunkId") == 1.0


def test_zones(spark):
    texts = ["2030-01-01T12:00:00Z", "2030-01-01T12:00:00+00:00", "2030-01-01T05:00:00-0700", "2030-01-01 14:00:00 +02", "2030-01-01T12:00:00 utc", "2030-01-01T12:00:00", "soon"]
    values = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant("t").cast("string").alias("v")).collect()]
    assert set(values[:-1]) == {"2030-01-01 12:00:00"} and values[-1] is None


def test_unified_tables_of_arrays_follow_renames(spark):
    payloads = [("r0", {"n": 1, "claims": [{"claim": "a", "ok": True}, {"claim": "b", "ok": False}]}), ("r1", {"n": 2, "claimList": [{"claim_text": "c", "ok": True}, 7]}), ("r2", {"n": 3, "claimList": "none"})]
    rows = unify_kind(*frames(spark, payloads), "attack.claims")
    text = "claim" if "claim" in rows.columns else "claim_text"
    assert {(r["id"], tuple(r["path"]), r[text], r["ok"]) for r in rows.collect()} == {(0, (0,), "a", True), (0, (1,), "b", False), (1, (0,), "c", True)}
    assert rows.columns == ["id", "run_id", "suite", "payload_schema", "received_at", "path", text, "ok"]


def test_unified_metrics(spark):
    metrics = [("r0", "s", "n", "", 1.0, None, None), ("r1", "s", "n", "", None, "skipped", "why")]
    rows = unify_kind(*frames(spark, [("r0", {"a": 1})], metrics=metrics), "metrics_v1").collect()
    assert {(r["run_id"], r["value"], r["state"]) for r in rows} == {("r0", 1.0, "measured"), ("r1", None, "skipped")}


def test_every_place_has_a_unified_table():
    from gristmill.plans.queries import QUERIES

    places = "attack results retrieval faithfulness canary_probe clean_defense clean_screen metrics_v1 faithfulness_claims faithfulness_citations attack_matched_markers results_stage_stats"
    assert {f"p1_unified_{p}" for p in places.split()} <= set(QUERIES)


def planted(spark, seed=3, workers=40):
    """Runs whose writers rename several fields of one type at once, one of them with a new type, and their true renames."""
    rng, runs, payloads, truth = random.Random(seed), [], [], set()
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(400)]
    for w in range(workers):
        values = {"question": words[:40], "answer": words[100:140], "chunk": words[200:240], "rank": list(range(30))}
        names = {k: k for k in values}
        for step in range(2):
            run = f"w{w}-{step}"
            runs.append((run, f"w{w}", f"2030-01-0{step + 1}T00:00:00Z", 0))
            if step:
                for field, new in (("question", "query_text"), ("answer", "answer_value"), ("chunk", "passage")):
                    names[field] = new
                    truth.add((run, field, new))
                names["rank"] = "rank_no"
                truth.add((run, "rank", "rank_no"))
            for _ in range(60):
                row = {names[k]: rng.choice(v) for k, v in values.items()}
                if step:
                    row["rank_no"] = str(row["rank_no"])
                payloads.append((run, row))
    return frames(spark, payloads, runs), truth


def renames(tables):
    rows = drift_report(*tables, strict=False).where("drift_kind = 'renamed'").collect()
    return {(r["run_id"], r["earlier"], r["field"]) for r in rows}, {r["field"] for r in rows if r["retyped"]}, rows


def test_planted_renames_are_found_by_sketches_and_names(spark):
    tables, truth = planted(spark)
    found, retyped, rows = renames(tables)
    assert len(found & truth) / len(found) > 0.98 and len(found & truth) / len(truth) > 0.95
    assert retyped == {"rank_no"} and all(0 <= r["runner_up"] < r["score"] <= 1 for r in rows)
    assert {d for *_, d in report(*tables)} == {"added", "removed"}  # by types alone nothing is certain
    assert _pairs_without("SKETCH_WEIGHT") != _pairs_without(None) != _pairs_without("NAME_WEIGHT")


def _pairs_without(weight):
    """The matching of one step, where a weight of the score is 0."""
    old = {"question": (4, [1, 2, 3, 4, 5, 6, 7, 8]), "answer_text": (4, [9] * 8), "note": (4, [7] * 8)}
    new = {"prompt": (4, [1, 2, 3, 4, 5, 6, 7, 0]), "answerText": (4, [8] * 8)}
    saved = {w: getattr(drift, w) for w in ("SKETCH_WEIGHT", "NAME_WEIGHT")}
    if weight:
        setattr(drift, weight, 0.0)
    try:
        return {(e, f) for f, e, kind, *_ in compare(old, new, False) if kind == "renamed"}
    finally:
        for w, v in saved.items():
            setattr(drift, w, v)


def test_arrays_of_objects_are_unified_in_place(spark):
    payloads = [("r0", {"n": 1, "claims": [{"claim": "a", "ok": True}]}), ("r1", {"n": 2, "claimList": [{"claim_text": "c", "ok": False}, 7]}), ("r2", {"n": 3, "claimList": None})]
    rows = {r["n"]: r for r in unify_kind(*frames(spark, payloads), "attack").collect()}
    column = next(c for c in rows[1.0].asDict() if c.startswith("claim"))
    text = next(c for c in rows[1.0][column][0].asDict() if c.startswith("claim"))
    assert [(x[text], x["ok"]) for x in rows[1.0][column]] == [("a", True)] and [(x[text], x["ok"]) for x in rows[2.0][column]] == [("c", False)] and rows[3.0][column] is None


def test_rare_fields_share_a_map(spark, monkeypatch):
    monkeypatch.setattr(drift, "MOST_COLUMNS", 2)
    payloads = [("r0", {"a": 1, "b": "x"}), ("r1", {"a": 2, "b": "y", "key17": "z"}), ("r2", {"a": 3, "b": "y", "key18": "z"})]
    rows = unify_kind(*frames(spark, payloads), "attack").collect()
    values = lambda name: {v for r in rows for v in (r.asDict().get(name), (r["_rest"] or {}).get(name)) if v is not None}
    assert values("a") == {1.0, 2.0, 3.0} and values("key17") | values("key18") == {"z"}
