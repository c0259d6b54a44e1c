import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import analytics as A
from gristmill.operators import evaluation as E
from gristmill.operators.attacks import canaries, foreign_markers, injections, poison, targets
from gristmill.functions.codepoints import Batch
from gristmill.operators.chunking import chunk, chunk_by_specs, spans
from gristmill.operators.components import connected_components
from gristmill.operators.filters import apply_filters, filter_after, guard
from gristmill.operators.retrieval import VectorIndex, exact_top_k, extractive_answers, hashed_embedding, prompts, rerank
from gristmill.operators.store import ResultStore, new_run_id, spec_hash

DOCS = "doc_id long, path string, text string, corpus string"
LONG = "The quick brown fox is on the mat and it was not there for the other one. " * 3


def test_filters_keep_the_first_and_report_the_rest(spark):
    rows = [(1, "b/x", LONG, "c"), (2, "a-b/x", LONG.upper(), "c"), (3, "a/x", " " + LONG, "c"), (4, "d", "le chat noir dort sur le tapis " * 6, "c"), (5, "e", None, "c")]
    left, audit = apply_filters(spark.createDataFrame(rows, DOCS), ["dedup", "language", "boilerplate"])
    assert [r["doc_id"] for r in left.collect()] == [3]
    assert sorted((r["filter"], r["doc_id"]) for r in audit.collect()) == [("boilerplate", 5), ("dedup", 1), ("dedup", 2), ("language", 4)]


def test_second_batch_yields_to_the_corpus(spark):
    corpus, batch = spark.createDataFrame([(9, "z", LONG, "c")], DOCS), spark.createDataFrame([(1, "a", LONG, "c"), (2, "b", "other", "c")], DOCS)
    left, audit = filter_after(corpus, batch, ["dedup"])
    assert [r["doc_id"] for r in left.collect()] == [2]
    assert [r["doc_id"] for r in audit.collect()] == [1]


def test_guard(spark):
    docs = spark.createDataFrame([(i, str(i), LONG, "c") for i in range(4)], DOCS)
    spec = "spec_id int, documents string, filters array<string>, max_filter_drop_rate double"
    guard(docs, spark.createDataFrame([(1, "c", ["dedup"], 0.75), (2, "none", [], None)], spec))
    with pytest.raises(ValueError, match="dedup drops 0.75"):
        guard(docs, spark.createDataFrame([(1, "c", ["dedup"], 0.5)], spec))


def slow_windows(text, size, overlap):
    words, at = [], 0
    for w in text.split():
        at = text.index(w, at)
        words.append((at, at + len(w)))
        at += len(w)
    out, i = [], 0
    while i < len(words):
        j = max([k for k in range(i, len(words)) if k == i or words[k][1] - words[i][0] <= size and all(words[m][1] - words[i][0] <= size for m in range(i + 1, k + 1))])
        out.append((words[i][0], words[j][1]))
        if j + 1 == len(words):
            break
        inside = [k for k in range(i + 1, j + 1) if words[k][0] >= words[j][1] - overlap]
        i = min(inside) if inside else j + 1
    return out


def cut(text, structure, size, overlap):
    _, start, end, section = spans(Batch([text]), [text], structure, size, overlap)
    return list(zip(start.tolist(), end.tolist(), section))


def test_windows_equal_brute_force():
    rng = random.Random(3)
    texts = [" ".join("x" * rng.randint(1, 12) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    owner, start, end, _ = spans(Batch(texts), texts, False, 30, 10)
    for i, text in enumerate(texts):
        assert list(zip(start[owner == i].tolist(), end[owner == i].tolist())) == slow_windows(text, 30, 10)


def test_sections():
    text = "intro\n# A\none\n### B\ntwo\n## C\nthree\n"
    assert [(text[a:b].split("\n")[0], s) for a, b, s in cut(text, True, 100, 10)] == [("intro", None), ("# A", "A"), ("### B", "A › B"), ("## C", "A › C")]
    assert cut("no heading", True, 100, 10) == [(0, 10, None)] and cut(" \n", True, 100, 10) == [] and cut("", False, 100, 10) == []
    assert [s for *_, s in cut("# \n#none\n####### x\n#\tY \r\n\x85###### Z", True, 100, 10)] == [None, "Y", "Y › Z"]


def test_sections_of_all_texts_of_a_batch_are_apart():
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["# a", "## b", "### c", "word " * rng.randint(1, 30), ""]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    owner, start, end, section = spans(Batch(texts), texts, True, 40, 10)
    for i, text in enumerate(texts):
        assert list(zip(start[owner == i].tolist(), end[owner == i].tolist(), [s for o, s in zip(owner, section) if o == i])) == cut(text, True, 40, 10)


def test_chunks_by_the_settings_of_corpora(spark):
    text = "# H\n" + "word " * 60
    docs = spark.createDataFrame([(1, text, "a", 7), (2, text, "b", 8), (3, text, "c", 9), (4, None, "a", 0)], "doc_id long, text string, corpus string, size_tokens int")
    specs = spark.createDataFrame([(1, "a", "fixed", 25, 5), (2, "b", "structure", 200, 10), (0, "b", "structure", 100, 10), (3, "d", "fixed", 20, 1)], "spec_id int, documents string, chunker_type string, size_tokens int, overlap_tokens int")
    got = chunk_by_specs(docs, specs, keep=("corpus",)).collect()
    assert {(r["doc_id"], r["section"]) for r in got} == {(1, None), (2, "H")} and {r["corpus"] for r in got} == {"a", "b"}
    assert [r["end"] - r["start"] for r in got if r["doc_id"] == 2] == [len(text)]
    with pytest.raises(ValueError, match="smaller"):
        chunk(docs, "fixed", 10, 10)
    assert chunk(docs.limit(0)).count() == 0


def test_chunks_are_slices(spark):
    docs = spark.createDataFrame([(1, "# H\n" + "wörd 🎈 " * 100), (2, None), (3, "  ")], "doc_id long, text string")
    text = docs.where("doc_id = 1").first()["text"]
    rows = chunk(docs, "structure", 20, 5).collect()
    assert {r["doc_id"] for r in rows} == {1} and len(rows) > 5
    for r in rows:
        assert r["chunk"] == text[r["start"] : r["end"]] and r["section"] == "H"
        assert r["chunk_id"] == hashlib.sha1(f"1:{r['start']}:{r['end']}".encode()).hexdigest()[:16]


def embed(text):
    import re

    vector = [0.0] * 64
    for token in re.findall("[a-z0-9]+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
        vector[h % 64] += 1.0 if h >> 33 & 1 else -1.0
    norm = math.sqrt(sum(v * v for v in vector))
    return [v / norm for v in vector] if norm else [1.0] + [0.0] * 63


def test_hashed_embedding(spark):
    texts = ["Widget X1 battery life", "", "widget widget"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashed_embedding(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(embed(r["t"]), abs=1e-6)


def test_exact_top_k_equals_brute_force(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    frame = spark.createDataFrame(vectors, "item_id long, vector array<float>")
    asked = frame.where("item_id % 7 = 0").withColumnRenamed("item_id", "qid")
    got = {(r["qid"], r["rank"]): r["item_id"] for r in exact_top_k(asked, frame, 5, block=4, exclude_same=True).collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / max(math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 1e-30), 6)
    for q, v in vectors:
        if q % 7 == 0 and v is not None:
            best = sorted((-cos(v, w), i) for i, w in vectors if i != q and w is not None)[:5]
            assert [got[q, r] for r in range(5)] == [i for _, i in best]
    assert exact_top_k(asked.limit(0), frame, 5).count() == 0


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "battery life of the widget is 72 hours. It is blue."), (2, "returns take 30 days.")], "doc_id long, text string")
    index = VectorIndex.build(chunk(docs, "fixed", 20, 5), "f1")
    index.save(str(tmp_path / "index"))
    again = VectorIndex.load(spark, str(tmp_path / "index"), "f1")
    hits = again.search(spark.createDataFrame([("q1", "battery life of the widget")], "qid string, question string"), 1)
    assert again.rows.join(hits, "chunk_id").first()["doc_id"] == 1
    with pytest.raises(ValueError, match="other documents"):
        VectorIndex.load(spark, str(tmp_path / "index"), "f2")


def test_rerank_prompt_and_answer(spark):
    rows = [("q1", "battery life?", 0, "a.md", None, "Nothing here."), ("q1", "battery life?", 1, "b.md", "S", "The battery life is long. Other."), ("q1", "battery life?", 2, "c.md", "", " ")]
    frame = spark.createDataFrame(rows, "qid string, question string, rank int, source string, section string, text string")
    order = [r["source"] for r in rerank(frame).orderBy("reranked").collect()]
    assert order == ["b.md", "a.md", "c.md"]
    asked = spark.createDataFrame([("q1", "battery life?"), ("q2", "none?")], "qid string, question string")
    context = frame.select("qid", "rank", "source", "section", "text")
    user = {r["qid"]: r["user"] for r in prompts(context, asked).collect()}
    assert user["q1"].startswith("Context:\n\n[1] (source: a.md)\nNothing here.\n\n[2] (source: b.md › S)\nThe")
    answers = {r["qid"]: r["answer"] for r in extractive_answers(context, asked).collect()}
    assert answers == {"q1": "Nothing here. [1] The battery life is long. [2]", "q2": "I don't know."}


def test_rank_metrics_and_percentiles(spark):
    ranks = spark.createDataFrame([("s", 1), ("s", 3), ("s", None), ("s", 12)], "k string, r int")
    got = {r["name"]: r["value"] for r in E.rank_metrics(ranks, ["k"], "r", (1, 10)).collect()}
    assert got == pytest.approx({"recall@1": 0.25, "recall@10": 0.5, "ndcg@1": 0.25, "ndcg@10": 0.375, "mrr": round((1 + 1 / 3 + 1 / 12) / 4, 4)})
    samples = spark.createDataFrame([("a", float(v)) for v in range(1, 6)] + [("b", 5.0), ("b", None)], "stage string, ms double")
    stats = {r["stage"]: (r["count"], r["p50"], r["p95"]) for r in E.stage_statistics(samples, "stage", "ms").collect()}
    assert stats == {"a": (5, 2.0, 5.0), "b": (1, 5.0, 5.0)}


def test_metric_rules(spark):
    schema = "suite string, name string, variant string, value double, state string, reason string"
    rows = [("s", "ok", "", 0.5, None, None), ("s", "bad", "", 0.5, "skipped", "x"), ("s", "mute", "", None, "error", " "), ("s", "odd", "", None, "strange", "x"), ("s", "none", "", None, "inapplicable", "no reranker")]
    frame = spark.createDataFrame(rows, schema)
    assert {r["name"]: r["problem"] for r in E.metric_errors(frame).collect()} == {"bad": "value though not measured", "mute": "no reason", "odd": "unknown state"}
    worst = {r["name"]: (r["state"], r["value"]) for r in A.worst_of(frame, ["name"]).collect()}
    assert worst["ok"] == ("measured", 0.5) and worst["none"] == ("inapplicable", None) and worst["mute"] == ("unknown", None)
    diff = A.run_diff(frame.where("name = 'ok'"), frame.where("name != 'ok'"))
    assert diff.where("delta is not null").count() == 0 and diff.count() == 5


def test_conflicts(spark):
    rows = [("q", "hours", "72", 1, True, 1.0), ("q", "hours", "9", 2, False, 0.2), ("q", "hours", "9", 3, False, 0.2), ("q", "kg", "1", 1, True, 1.0), ("q", "kg", "2", 1, True, 1.0), ("p", "days", "1", 1, True, 1.0), ("p", "days", "2", 2, True, 1.0)]
    frame = spark.createDataFrame(rows, "key string, unit string, value string, doc_id int, verified boolean, trust_score double")
    assert {(r["key"], r["unit"]): r["values"] for r in E.conflicts(frame, "key").collect()} == {("q", "hours"): ["9", "72"], ("p", "days"): ["1", "2"]}
    assert {(r["key"], r["winner"], r["decided"]) for r in E.resolutions(frame, "key").collect()} == {("q", "72", True), ("p", "1", False)}


def test_targets_and_attacks(spark):
    rows = [(f"q{i:02d}", f"What is it {i}? ", None if i % 3 == 0 else f"about 1,2{i} hours", None) for i in range(20)]
    qa = spark.createDataFrame(rows, "qid string, question string, answer string, gold_doc string")
    chosen = targets(qa, 8, 45)
    expected = sorted((r[0] for r in rows), key=lambda q: hashlib.sha256(f"45\0{q}".encode()).digest())[:8]
    assert sorted(r["qid"] for r in chosen.collect()) == sorted(expected)
    bad = {r["qid"]: r for r in poison(chosen).collect()}
    for i, q in enumerate(sorted(expected)):
        n = int(q[1:])
        wanted = f"{900000 + i} (revised)" if n % 3 == 0 else f"about {900000 + i} hours"
        assert f"In response to What is it {n}, the verified value is {wanted}." in bad[q]["doc_text"]
    families = [r["family"] for r in injections(chosen).orderBy("qid").collect()]
    assert families == ["seen", "heldout"] * 4
    made = canaries(spark, {"api_key": ["the vault"], "email": [("Ann", "the clerk")], "phone": ["ops"]}).collect()
    assert len({r["secret"] for r in made}) == 9 and all(r["secret"] in r["doc_text"] for r in made)


def test_foreign_markers_null_is_not_empty(spark):
    schema = "id int, qid string, own_marker string, matched_markers array<struct<marker:string,attack_type:string,qid:string>>"
    rows = [(1, "q1", "m1", None), (2, "q1", "m1", []), (3, "q1", "m1", [("m1", "p", "q1"), ("m2", "i", "q1"), ("m3", "p", "q2")])]
    got = {r["id"]: r for r in foreign_markers(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["foreign"] is None and got[2]["foreign"] == [] and [m["marker"] for m in got[3]["cross_question"]] == ["m3"]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 1)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 161)}
    assert connected_components(links.limit(0)).count() == 0


def test_store(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    schema = "id long, run_id string, suite string"
    store.save("records", spark.createDataFrame([(i, "r1", "s") for i in range(5)], schema))
    store.save("records", spark.createDataFrame([(9, "r2", "s")], schema))
    store.save("records", spark.createDataFrame([(i, "r1", "s") for i in range(3)], schema))
    assert store.read("records").count() == 4
    assert [r["id"] for r in store.page("r1", "s", 2, 1).collect()] == [1, 2]
    assert len(new_run_id()) == 26 and spec_hash({"b": 1, "a": "é"}) == hashlib.sha256(b'{"a":"\\u00e9","b":1}').hexdigest()


def test_markers_of_every_answer(spark, tmp_path):
    import json
    import re

    from gristmill.plans.queries import QUERIES

    answers = ["None.", "One [2].", "Two [3] [1] [3].", "Out [0] [6] [12] [5].", "All [5][4][3][2][1].", "[1234] [ 1]"]
    rows = [(i, "r", "faithfulness", json.dumps({"qid": "q", "answer": a})) for i, a in enumerate(answers)] + [(90, "r", "faithfulness", "{"), (91, "r", "faithfulness", '{"qid": "q"}')]
    spark.createDataFrame(rows, "id long, run_id string, kind string, payload_json string").write.parquet(f"{tmp_path}/records.parquet")
    want = {i: list(dict.fromkeys(m for m in map(int, re.findall(r"\[([0-9]{1,3})\]", a)) if 1 <= m <= 5)) for i, a in enumerate(answers)}
    assert {r["id"]: r["markers"] for r in QUERIES["citation_parse"](spark, str(tmp_path)).collect()} == want
