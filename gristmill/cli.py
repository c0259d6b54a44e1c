"""python -m gristmill.cli VERB: ingest, query, eval, submit, worker, runs, version."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.config import RunSpec, parse_spec
from gristmill.operators import suites
from gristmill.operators.answering import answer
from gristmill.operators.ingestion import load_or_build
from gristmill.operators.reports import summary
from gristmill.operators.runs import RunQueue
from gristmill.operators.store import ResultStore, new_run_id
from gristmill.session import build_session
from gristmill.sources.loaders import load_corpus, load_qa, load_spec

VERSION = "0.2"


def read_spec(path: str) -> RunSpec:
    with open(path, encoding="utf-8") as file:
        return parse_spec(load_spec(file.read()))


def chunks_of(spark: SparkSession, spec: RunSpec, folder: str) -> DataFrame:
    index, _, _ = load_or_build(spark, spec, folder)
    return index.rows.withColumnRenamed("chunk", "text")


def active(spec: RunSpec) -> str:
    """The one defense that a specification turns on for ordinary questions; the strongest if there are several."""
    on = spec.pipeline.defenses
    return "answer_integrity" if on.answer_integrity else "injection_filter" if on.injection_filter else "prompt_isolation" if on.prompt_isolation else "none"


def evaluate(spark: SparkSession, spec: RunSpec, run_id: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, records) of all suites of a specification; a suite that can't run leaves one metric that says why."""
    documents, _ = load_corpus(spark, spec.corpus.documents)
    documents = documents.withColumnRenamed("source", "path")
    qa = load_qa(spark, spec.corpus.qa) if spec.corpus.qa else None
    own, filters, found = spec.suites, tuple(spec.ingest.filters), []

    def retrieval() -> suites.Suite:
        rows = suites.retrieval_suite(chunks_of(spark, spec, folder), qa, spec.pipeline.retriever.k, own.retrieval.k_values)
        rows = rows if own.retrieval.rerank_lift else rows.where("variant = 'rerank=off'")
        return suites.Suite(rows.select(F.lit("retrieval").alias("suite"), "name", "variant", "value"), None)

    def faithfulness() -> suites.Suite:
        return suites.faithfulness_suite(chunks_of(spark, spec, folder), qa, own.faithfulness.sample_size, spec.seed + suites.SUITE_SEEDS["faithfulness"])

    def security() -> suites.Suite:
        s = own.security
        number = lambda a: a.targets if a.enabled else 0
        return suites.security_suite(documents, qa, number(s.poisoning), number(s.injection), spec.seed + suites.SUITE_SEEDS["security"], s.defenses, s.disjoint_targets, filters, s.clean_control_sample, s.clean_screen_sample)

    def privacy() -> suites.Suite:
        from gristmill.operators.attacks import canaries

        p = own.privacy
        hosts = {k: v for k, v in SUBJECTS.items() if k in p.kinds}
        return suites.privacy_suite(documents, canaries(spark, hosts, p.canaries, spec.seed + suites.SUITE_SEEDS["privacy"]), p.defenses, filters, p.probes)

    records = spark.createDataFrame([], "suite string, kind string, payload_json string")
    for name, run in (("retrieval", retrieval), ("faithfulness", faithfulness), ("security", security), ("privacy", privacy)):
        if getattr(own, name) is None:
            continue
        try:
            done = run()
            found.append(done.metrics.select("suite", "name", "variant", "value", F.lit("measured").alias("state"), F.lit(None).cast("string").alias("reason")))
            records = records if done.records is None else records.unionByName(done.records)
        except ValueError as error:
            state = "skipped" if str(error).startswith("skipped") else "error"
            found.append(spark.createDataFrame([(name, name, "", None, state, str(error))], "suite string, name string, variant string, value double, state string, reason string"))
    metrics = spark.createDataFrame([], "suite string, name string, variant string, value double, state string, reason string")
    for rows in found:
        metrics = metrics.unionByName(rows)
    return metrics.withColumn("run_id", F.lit(run_id)), records.withColumn("run_id", F.lit(run_id))


#: What canaries are about when runs are started from here.
SUBJECTS = {"api_key": ["the billing gateway", "the archive store", "the print server"], "email": [("Ada Quill", "the plant manager"), ("Ben Marsh", "the shift lead"), ("Cleo Hart", "the clerk")], "phone": ["the night desk", "the field team", "the gate"]}


def run_and_store(spark: SparkSession, spec: RunSpec, run_id: str, folder: str) -> str:
    metrics, records = evaluate(spark, spec, run_id, f"{folder}/index")
    store = ResultStore(spark, f"{folder}/results")
    store.save("metrics", metrics)
    store.save("records", records)
    return summary(store.read("metrics"), run_id)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gristmill")
    parser.add_argument("--folder", default=os.environ.get("GRISTMILL_FOLDER", "gristmill-data"), help="where indexes, results and the queue are; shared by all executors")
    parser.add_argument("--master", default=None)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("ingest", "eval", "submit"):
        verbs.add_parser(verb).add_argument("spec")
    verbs.choices["submit"].add_argument("--force", action="store_true")
    query = verbs.add_parser("query")
    query.add_argument("spec")
    query.add_argument("question")
    worker = verbs.add_parser("worker")
    worker.add_argument("--name", default=f"worker-{os.getpid()}")
    worker.add_argument("--most", type=int, default=None, help="stop after so many runs")
    verbs.add_parser("runs")
    verbs.add_parser("version")
    args = parser.parse_args(argv)
    if args.verb == "version":
        print(VERSION)
        return 0
    os.makedirs(args.folder, exist_ok=True)
    queue = RunQueue(f"{args.folder}/runs.db")
    if args.verb == "submit":
        print(queue.submit(read_spec(args.spec), args.force))
        return 0
    if args.verb == "runs":
        with queue.open() as db:
            for row in db.execute("SELECT id, name, status, created_at FROM runs ORDER BY created_at DESC, id DESC LIMIT 50"):
                print(*row, sep="\t")
        return 0
    spark = build_session(master=args.master)
    if args.verb == "ingest":
        _, audit, reused = load_or_build(spark, read_spec(args.spec), f"{args.folder}/index")
        print(json.dumps(audit | {"reused": reused}, sort_keys=True))
    elif args.verb == "query":
        spec = read_spec(args.spec)
        asked = spark.createDataFrame([("q", args.question)], "qid string, question string")
        hits = suites.retrieve(chunks_of(spark, spec, f"{args.folder}/index"), asked, spec.pipeline.retriever.k)
        said = answer(suites.context(hits, spec.pipeline.reranker.top_n, spec.pipeline.reranker.enabled), asked, (active(spec),)).first()
        print(said["answer"])
        for c in said["citations"]:
            if c["parsed"]:
                place = said["context"][c["marker"] - 1]
                print(f"[{c['marker']}] {place['source']}" + (f" › {place['section']}" if place["section"] else ""))
    elif args.verb == "eval":
        print(run_and_store(spark, read_spec(args.spec), new_run_id(), args.folder))
    elif args.verb == "worker":
        done = 0
        while (args.most is None or done < args.most) and (run := queue.claim(args.name)):
            try:
                run_and_store(spark, parse_spec(json.loads(run["spec_json"])), run["id"], args.folder)
                queue.finish(run["id"])
            except Exception as error:  # the run failed, not the worker
                queue.finish(run["id"], f"{type(error).__name__}: {error}")
            print(run["id"], queue.status(run["id"]))
            done += 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
