import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.config import SpecError, parse_spec
from gristmill.operators import judging, providers
from gristmill.operators.ingestion import DropRateExceeded, NothingToIndex, build_index, load_or_build
from gristmill.operators.runs import DuplicateRun, RunQueue, UnknownRun
from gristmill.sources.loaders import load_judgments

SPEC = {"name": "smoke-1", "corpus": {"documents": "/nowhere", "qa": "/nowhere/qa.jsonl"}}


def test_defaults_and_hashes():
    spec = parse_spec(SPEC)
    assert spec.seed == 42 and spec.ingest.chunker.size_tokens == 350 and spec.pipeline.reranker.top_n == 5 and spec.ingest.filters == ("dedup", "language", "boilerplate")
    assert spec.spec_hash() == parse_spec(json.loads(spec.canonical_json())).spec_hash() != parse_spec(SPEC | {"seed": 1}).spec_hash()
    assert spec.ingest_fingerprint() == parse_spec(SPEC | {"seed": 1}).ingest_fingerprint() != parse_spec(SPEC | {"ingest": {"filters": []}}).ingest_fingerprint()


@pytest.mark.parametrize(
    "change,place",
    [
        ({"name": "Bad Name"}, "name"), ({"colour": 1}, "colour"), ({"corpus": {}}, "corpus.documents"), ({"seed": "x"}, "seed"), ({"seed": True}, "seed"),
        ({"ingest": {"filters": ["nonsense"]}}, "ingest.filters"), ({"ingest": {"chunker": {"size_tokens": 10}}}, "size_tokens"), ({"ingest": {"chunker": {"overlap_tokens": 350}}}, "overlap_tokens"),
        ({"ingest": {"max_filter_drop_rate": 0}}, "max_filter_drop_rate"), ({"index": {"store": "x"}}, "index.store"), ({"pipeline": {"retriever": {"k": 3}}}, "top_n"), ({"pipeline": {"generator": {"temperature": 3}}}, "temperature"),
        ({"suites": {"retrieval": {"k_values": []}}}, "k_values"), ({"suites": {"retrieval": {"k_values": [1, 50]}}}, "k_values"), ({"suites": {"retrieval": {}}, "corpus": {"documents": "x"}}, "corpus.qa"),
        ({"suites": {"faithfulness": {"judge": {"type": "llm"}}}}, "provider"), ({"suites": {"faithfulness": {"judge": {"type": "llm", "provider": "p", "model": "m"}}}}, "cache"),
        ({"suites": {"security": {"poisoning": {"enabled": False}, "injection": {"enabled": False}}}}, "suites.security"), ({"suites": {"security": {"defenses": []}}}, "defenses"), ({"suites": {"privacy": {"probes": ["x"]}}}, "probes"),
        ({"suites": {"concurrency": 0}}, "concurrency"), ({"ingest": []}, "ingest"),
    ],
)
def test_what_is_refused(change, place):
    with pytest.raises(SpecError, match=place):
        parse_spec(SPEC | change)


def test_queue(tmp_path):
    queue, spec = RunQueue(str(tmp_path / "runs.db")), parse_spec(SPEC)
    one = queue.submit(spec)
    with pytest.raises(DuplicateRun, match=one):
        queue.submit(spec)
    two, three = queue.submit(spec, force=True), queue.submit(parse_spec(SPEC | {"seed": 7}))
    assert queue.claim("w1")["id"] == one and queue.claim("w2", three)["id"] == three and queue.claim("w3", three) is None
    assert queue.cancel(two) and not queue.cancel(one) and queue.claim("w1") is None
    queue.finish(one)
    queue.finish(three, "broke")
    assert [queue.status(r) for r in (one, two, three)] == ["succeeded", "cancelled", "failed"]
    assert queue.submit(parse_spec(SPEC | {"seed": 7})) != three
    for call in (queue.finish, queue.cancel, queue.status):
        with pytest.raises(UnknownRun):
            call("none")


def test_retries():
    waits, calls = [], []

    def failing(error, times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error("no")
            return "yes"

        calls.clear()
        return call

    retry = lambda call: providers.with_retries(call, sleep=waits.append, rng=random.Random(1))
    assert retry(failing(providers.RateLimited, 3)) == "yes" and len(waits) == 3 and all(0 <= w <= 0.5 * 2**i for i, w in enumerate(waits))
    with pytest.raises(providers.Transient):
        retry(failing(providers.Transient, 9))
    assert len(calls) == 4
    with pytest.raises(providers.Unauthorised):
        retry(failing(providers.Unauthorised, 1))
    assert len(calls) == 1


def test_registry():
    assert providers.make("generator", "fake") is providers.extractive

    def lacking(model):
        import a_package_that_is_not_there

    providers.register("judge", "lacking", lacking)
    for kind, name in (("judge", "lacking"), ("embedder", "other"), ("nothing", "fake")):
        with pytest.raises(providers.Unavailable):
            providers.make(kind, name)
    del providers.REGISTRY["judge"]["lacking"]
    with pytest.raises(providers.ProviderError):
        providers.register("nothing", "x", lacking)


def test_judge_with_cache(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "red door here", "a red door here"), (2, "blue", "a red door"), (3, "blue", "a red door"), (4, "odd one", "odd one"), (5, None, "x")], "id int, claim string, context string")
    ask = lambda prompt: F.when(F.contains(prompt, F.lit("Claim: red")), " yes, it is").when(F.contains(prompt, F.lit("Claim: blue")), "NO").otherwise("perhaps")
    rows, new = judging.judge(pairs, "m", "auto", None, ask)
    assert {r["id"]: (r["supported"], r["parse_ok"], r["cached"]) for r in rows.collect()} == {1: (True, True, False), 2: (False, True, False), 3: (False, True, False), 4: (True, False, False), 5: (True, False, False)}
    assert new.count() == 4
    judging.append(new, str(tmp_path / "cache"))
    cache = load_judgments(spark, str(tmp_path / "cache"))
    again, none = judging.judge(pairs, "m", "cached", cache)
    assert all(r["cached"] for r in again.collect()) and none.count() == 0
    with pytest.raises(judging.CacheMiss, match="new claim"):
        judging.judge(spark.createDataFrame([("new claim", "x")], "claim string, context string"), "m", "cached", cache)
    assert judging.judge(pairs, "other", "live", cache, ask)[1].count() == 4


DOCS = [(f"d{i}", f"a/{i}.md", f"# Title {i}\n" + "the pump of the plant is on and it will stop in the night " * 4) for i in range(6)]


def test_ingestion(spark, tmp_path):
    frame = spark.createDataFrame(DOCS + [("d9", "z/9.md", DOCS[0][2].upper())], "doc_id string, path string, text string")
    spec = parse_spec(SPEC)
    index, audit, reused = load_or_build(spark, spec, str(tmp_path), frame)
    assert not reused and audit["loaded"] == 7 and audit["kept"] == 6 and audit["filters"][0] == {"filter": "dedup", "dropped": 1, "rate": 0.1429}
    again, same, reused = load_or_build(spark, spec, str(tmp_path), frame)
    assert reused and same == audit and again.rows.count() == audit["chunks"] == index.rows.count()
    assert [r["reason"] for r in spark.read.parquet(f"{tmp_path}/{spec.ingest_fingerprint()}/dropped").collect()] == ["exact_duplicate"]
    with pytest.raises(DropRateExceeded, match="'dedup' dropped 1 of 2"):
        build_index(spark, parse_spec(SPEC | {"ingest": {"max_filter_drop_rate": 0.4}}), str(tmp_path), frame.where("doc_id in ('d0', 'd9')"))
    with pytest.raises(NothingToIndex):
        build_index(spark, spec, str(tmp_path), frame.limit(0))


def test_ingestion_of_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text(DOCS[0][2])
    (tmp_path / "docs/b.xyz").write_text("x")
    spec = parse_spec({"name": "files", "corpus": {"documents": str(tmp_path / "docs")}}).with_digests()
    _, audit = build_index(spark, spec, str(tmp_path / "index"))
    assert audit["loaded"] == 1 and audit["skipped_by_suffix"] == {".xyz": 1} and spec.corpus.documents_digest
