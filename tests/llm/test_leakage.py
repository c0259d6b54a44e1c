import random
import re

import pytest

from gristmill.llm import leakage
from gristmill.llm.leakage import leak_report, leaks

WORDS = [f"w{i}" for i in range(30)]


def brute(docs, items, n=10):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    wanted = [(i, grams(split(t))) for i, t in items]
    return {(d, i) for d, t in docs for g in [grams(split(t))] for i, w in wanted if g & w}


def data(seed=0):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))) for i in range(40)]
    items += [(50, items[3][1]), (51, None), (52, ""), (53, "nine words are not enough to make a run here"), (54, " ".join(["same"] * 30))]
    docs = []
    for d in range(120):
        text = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        own = rng.choice(items)[1]
        if own and rng.random() < 0.6:
            w = own.split()
            a = rng.randint(0, max(0, len(w) - 12))
            at = rng.randint(0, len(text))
            text[at:at] = w[a : a + rng.randint(8, 14)]
        docs.append((d, ", ".join(x.upper() if rng.random() < 0.3 else x for x in text)))
    return docs + [(500, None), (501, ""), (502, "same " * 10), (503, "same " * 9), (504, items[0][1]), (504, items[0][1])], items


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = data(seed)
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, item_id int, suite string")
    h = spark.createDataFrame([(i, t, None) for i, t in items], "item_id long, text string, suite string")
    got = [tuple(r) for r in leaks(d, h).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = data(3)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 800)
    d, h = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leaks(d, h).collect()} == brute(docs, items)


def test_many_runs_without_a_bitmap(spark, monkeypatch):
    docs, items = data(4)
    d, h = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leakage, "bitmap", lambda runs, amount: None)
    assert {tuple(r) for r in leaks(d, h).collect()} == brute(docs, items)


def test_only_prefixes_are_gathered(spark):
    common, rare = "the same old words again and again in all of", "quite unheard of things"
    docs = spark.createDataFrame([(i, f"{common} the texts number {i}") for i in range(30)] + [(99, f"{common} {rare} here")], "id long, text string")
    items = spark.createDataFrame([(1, f"{common} {rare} here", 0)], "item long, text string, block long")
    runs = leakage.runs_of(items)
    counts = runs.join(leakage.frequencies(docs, leakage.bitmap(runs.select("run"), runs.count())), "run").select("block", "run", "docs")
    chosen = leakage.prefixes(items, counts, 10)
    assert counts.where("docs = 31").count() == 6 and chosen.count() < counts.count() / 2
    assert chosen.join(counts, "run").where("docs = 31").count() == 1  # of the one window that has nothing rarer


def test_bitmap_passes_its_runs(spark):
    import numpy as np

    values = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    frame = spark.createDataFrame([(int(v),) for v in values[:100].view(np.int64)], "run long")
    at = leakage.passes(leakage.bitmap(frame, 100), values)
    assert set(range(100)) <= set(at.tolist()) and len(at) < 200
    assert len(leakage.passes(None, values)) == 5000


def test_empty_tables_and_string_ids(spark):
    docs = spark.createDataFrame([("d", "a b c d e f g h i j")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x a b c d e f g h i j", None)], "item_id string, text string, suite string")
    assert [tuple(r) for r in leaks(docs, items).collect()] == [("d", "i")]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in leak_report(docs, items).collect()] == [("i", 1, "d", None)]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "filler " * 60_000 + "a b c d e f g h i j " + "filler " * 60_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert leaks(docs, items).count() == 1
