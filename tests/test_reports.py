import json

import pytest
from pyspark.sql import functions as F

from gristmill import cli
from gristmill.operators import analytics as A
from gristmill.operators.evaluation import stage_statistics
from gristmill.operators.reports import ABSENT, current_payload, difference, escaped, read_results, summary
from gristmill.operators.retrieval import overlap_top_k, prompt_parts, prompts
from gristmill.sources.loaders import load_qa, load_relevance

METRICS = "run_id string, suite string, name string, variant string, value double, state string, reason string"


def test_results_of_all_versions(spark):
    bodies = ['{"schema_version": 6, "run_id": "a"}', "{}", '{"schema_version": 7}', '{"schema_version": "3"}', '{"schema_version": true}', "[1]", "{", None, '{"schema_version": 0}', '{"schema_version": null, "ingestion": {"x": [1]}}', '{"schema_version": 2.5}']
    good, bad = read_results(spark.createDataFrame(list(enumerate(bodies)), "result_id int, body string"))
    rows = {r["result_id"]: (r["version"], json.loads(r["body"])) for r in good.collect()}
    assert {i: v for i, (v, _) in rows.items()} == {0: 6, 1: 1, 9: 1}
    assert rows[0][1] == {"schema_version": 6, "run_id": "a", "ingestion": None, "spec_identity_json": None} and rows[1][1] == {"run_id": None, "ingestion": None, "spec_identity_json": None}
    assert rows[9][1]["ingestion"] == {"x": [1]}
    assert {r["result_id"] for r in bad.collect()} == {2, 3, 4, 5, 6, 7, 8, 10}


def test_derived_keys_of_old_payloads_go(spark):
    rows = [("attack", '{"a": 1, "foreign_markers": [2]}'), ("attack", "{"), ("retrieval", '{"foreign_markers": 1}'), ("attack", '{"a": null}')]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, p string").select(current_payload(F.col("k"), F.col("p"))).collect()]
    assert [json.loads(got[0]), *got[1:]] == [{"a": "1"}, "{", '{"foreign_markers": 1}', '{"a": null}']


def test_summary(spark):
    rows = [("r", "security", "rate", "defense=none", 0.5, None, None), ("r", "security", "rate", "defense=x", None, "skipped", "no *time*\n here"), ("r", "retrieval", "mrr", "", 1.0, "measured", None), ("other", "retrieval", "mrr", "", 0.0, "measured", None)]
    text = summary(spark.createDataFrame(rows, METRICS), "r")
    assert "| rate | 0.5000 | — (skipped) |" in text and "| mrr | 1.0000 |" in text and r"- security/rate/defense=x — skipped: no \*time\* here" in text
    made = spark.createDataFrame([(1.0, 1.5), (None, 1.0)], "a double, b double").select(difference(F.col("a"), F.col("b")).alias("d"), escaped(F.lit("a_b <c>")).alias("e")).collect()
    assert [r["d"] for r in made] == ["+0.5000", ABSENT] and made[0]["e"] == r"a\_b \<c\>"


def test_headline_and_contamination(spark):
    rows = [
        ("r", "retrieval", "ndcg@10", "rerank=on", None, "inapplicable", "x"), ("r", "retrieval", "ndcg@10", "rerank=off", 0.7, None, None), ("r", "security", "knowledge_corruption_rate", "defense=none", 0.2, None, None), ("r", "security", "injection_compliance_rate", "defense=none", 0.4, None, None),
        ("r", "security", A.CONTAMINATION, "defense=none", 0.0, None, None), ("r", "security", A.COMPETITION, "defense=none", 0.1, None, None), ("s", "security", A.CONTAMINATION, "defense=none", 0.3, None, None), ("t", "security", A.CONTAMINATION, "defense=none", None, "error", "x"), ("t", "security", A.COMPETITION, "defense=none", 0.3, None, None),
    ]
    frame = spark.createDataFrame(rows, METRICS)
    assert {(r["run_id"], r["card"]): (r["state"], r["value"]) for r in A.headline(frame).collect()} == {("r", "retrieval"): ("measured", 0.7), ("r", "security"): ("measured", 0.4)}
    assert {r["run_id"]: r["kind"] for r in A.contamination(frame).collect()} == {"r": "contained", "s": "escaping"}


def test_percentiles_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    values = [("a", rng.choice([rng.random(), 0.5, 7.0])) for _ in range(901)] + [("b", 3.0)] * 4 + [("c", None), (None, 1.0), (None, 2.0)]
    got = {r["stage"]: (r["count"], r["p50"], r["p95"]) for r in stage_statistics(spark.createDataFrame(values, "stage string, value double"), "stage", "value", 8).collect()}
    for stage in ("a", "b", None):
        own = sorted(v for s, v in values if s == stage)
        at = lambda p: round(own[max(1, round(len(own) * p)) - 1], 3)  # noqa: E731, B023
        assert got[stage] == (len(own), at(0.5), at(0.95))
    assert "c" not in got


def test_overlap_equals_brute_force(spark):
    import random
    import re

    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(90, None)]
    asked = [(f"q{i}", " ".join(rng.choice(words) for _ in range(4))) for i in range(6)] + [("empty", None)]
    got = {}
    for r in overlap_top_k(spark.createDataFrame(asked, "qid string, question string"), spark.createDataFrame(docs, "item_id long, text string").repartition(3), 5).orderBy("rank").collect():
        got.setdefault(r["qid"], []).append(r["item_id"])
    tokens = lambda t: set(re.findall("[a-z0-9]+", (t or "").lower()))
    for q, text in asked:
        score = {i: len(tokens(text) & tokens(t)) / max(len(tokens(text) | tokens(t)), 1) for i, t in docs}
        assert got[q] == sorted(score, key=lambda i: (-score[i], i))[:5]


def test_prompts_are_read_back(spark):
    rows = [("q", 0, "a.md", None, "One.\n\nTwo [2]."), ("q", 1, "b.md", "S", "Three.")]
    made = prompts(spark.createDataFrame(rows, "qid string, rank int, source string, section string, text string"), spark.createDataFrame([("q", "What?\nReally?")], "qid string, question string"))
    question, blocks = prompt_parts(F.col("user"))
    row = made.select(question.alias("q"), blocks.alias("b")).first()
    assert row["q"] == "What?\nReally?" and [tuple(b) for b in row["b"]] == [(1, "a.md", "One.\n\nTwo [2]."), (2, "b.md › S", "Three.")]


def test_labels_of_questions(spark, tmp_path):
    lines = [{"qid": "a", "question": "?", "answer": "x"}, {"qid": "b", "question": "?", "gold_doc": "d"}, {"qid": "c", "question": "?", "label_source": None, "answer": "x"}, {"qid": "d", "question": "?", "label_source": "human"}]
    (tmp_path / "qa.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    assert {r["qid"]: r["label_source"] for r in load_qa(spark, str(tmp_path / "qa.jsonl")).collect()} == {"a": "legacy", "b": "none", "c": None, "d": "human"}
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no questions"):
        load_qa(spark, str(tmp_path / "none.jsonl"))


def test_relevance_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "7", "title": "T", "text": "body"}\n{"_id": "8", "title": "", "text": "x"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "10", "text": "ten"}\n{"_id": "9", "text": "nine"}\n{"_id": "11", "text": "none"}\n')
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\n10\t8\t1\n10\t7\t1\n9\t7\t1\n11\t7\t0\n")
    docs, asked = load_relevance(spark, str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {"7": "# T\n\nbody", "8": "x"}
    assert [(r["qid"], r["gold_docs"]) for r in asked.collect()] == [("9", ["7.md"]), ("10", ["7.md", "8.md"])]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# Widget\n\nThe battery life of the widget is 72 hours and it is sold in blue. It is the best of all the widgets that we have.\n")
    (tmp_path / "docs/b.md").write_text("# Gadget\n\nThe gadget has a weight of 4 kg and it is made of steel. It is the heaviest of all the gadgets that we have.\n")
    (tmp_path / "qa.jsonl").write_text('{"qid": "q1", "question": "What is the battery life of the widget?", "answer": "72 hours", "gold_fact": "72 hours"}\n')
    spec = {"name": "smoke", "corpus": {"documents": str(tmp_path / "docs"), "qa": str(tmp_path / "qa.jsonl")}, "suites": {"retrieval": {"k_values": [1, 5]}, "faithfulness": {}}}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    call = lambda *args: (cli.main(["--folder", str(tmp_path / "out"), *args]), capsys.readouterr().out.strip())
    assert call("version") == (0, cli.VERSION)
    assert json.loads(call("ingest", str(tmp_path / "spec.json"))[1])["chunks"] == 2
    assert "72 hours" in call("query", str(tmp_path / "spec.json"), "What is the battery life of the widget?")[1]
    run = call("submit", str(tmp_path / "spec.json"))[1]
    assert call("worker", "--most", "1")[1].split("\n")[-1] == f"{run} succeeded"
    assert run in call("runs")[1]
