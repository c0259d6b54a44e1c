import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions.codepoints import Batch, batches, shingles, word_hashes
from gristmill.llm import neardup
from gristmill.llm.neardup import NearDuplicates, unpack_set

WORDS = [f"w{i}" for i in range(400)]


def brute(docs, width, least, min_words):
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= min_words:
            sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def corpus(seed=0):
    rng, docs = random.Random(seed), []
    for g in range(30):
        base = [rng.choice(WORDS) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            docs.append((len(docs), " ".join(text)))
    docs += [(len(docs) + i, docs[3][1].upper() + "!") for i in range(12)]
    return docs + [(900, None), (901, ""), (902, "too short"), (903, " - ")]


@pytest.mark.parametrize("width,least", [(3, 0.6), (5, 0.8)])
def test_pairs_equal_brute_force(spark, width, least):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, "x", i) for i, t in docs], "doc_id long, text string, id string, n long")
    got = NearDuplicates(frame, similarity=least, width=width)
    assert {tuple(r) for r in got.pairs().collect()} == brute(docs, width, least, 40)
    star = {tuple(r) for r in got.pairs(expand=3).collect()}
    assert star < brute(docs, width, least, 40)


def test_hot_buckets_are_spread_without_loss(spark, monkeypatch):
    docs = corpus(1)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(neardup, "CELL", 1)
    got = NearDuplicates(frame, similarity=0.6, width=3)
    whole = neardup.candidate_pairs(got.classes, 0.6).collect()
    monkeypatch.setattr(neardup, "CELL", 20_000)
    assert {tuple(r) for r in whole} == {tuple(r) for r in neardup.candidate_pairs(got.classes, 0.6).collect()}


def test_one_key_of_a_hundred_times_the_limit(spark):
    rng = np.random.default_rng(5)
    seed = rng.integers(0, 256, size=(20, 16), dtype=np.uint8)
    codes = seed[rng.integers(20, size=1000)] ^ np.packbits(rng.random((1000, 128)) < 0.06, axis=1)
    n = rng.integers(40, 400, size=1000)
    rows = [(i, int(n[i]), bytes(codes[i]), [7, i % 11 + 100, 10_000 + i]) for i in range(1000)]
    reps = spark.createDataFrame(rows, "id long, n int, bits binary, bands array<long>")
    assert neardup.hot_keys(reps.selectExpr("explode(bands) AS key"), 3000, 10).where("key = 7").first()["n"] == 1000
    radius = int(128 * 0.4 / 2 + 4.5 * (128 * 0.4 / 4) ** 0.5 * 1.1)
    apart = np.unpackbits(codes[:, None] ^ codes[None], axis=2).sum(axis=2, dtype=int)
    true = {(a, b) for a, b in zip(*np.nonzero(apart <= radius)) if a < b and min(n[a], n[b]) >= 0.6 * max(n[a], n[b]) - 1e-9}
    assert {tuple(r) for r in neardup.candidate_pairs(reps, 0.6, cell=10).collect()} == true
    assert {tuple(r) for r in neardup.candidate_pairs(reps, 0.6).collect()} == true and neardup.hot_keys(reps.selectExpr("explode(bands) AS key"), 3000, 20_000) is None


def test_tile_pairs_are_skipped_by_population_counts(monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    ones, n = np.repeat([10, 60, 90], 4), np.full(12, 100)
    one, _, two, _ = neardup.tile_pairs(np.array([0, 12]), n, ones, 0.6, 35)
    assert set(zip(one.tolist(), two.tolist())) == {(0, 0), (4, 4), (8, 8), (4, 8)}  # ten and sixty are beyond the radius
    one, rows, two, columns = neardup.tile_pairs(np.array([0, 1, 3, 4, 10]), np.arange(10) + 100, np.full(10, 64), 0.6, 35)
    assert sorted(zip(one.tolist(), rows.tolist(), two.tolist(), columns.tolist())) == [(1, 2, 1, 2), (4, 4, 4, 4), (4, 4, 8, 2), (8, 2, 8, 2)]
    assert len(neardup.tile_pairs(np.array([0]), n[:0], ones[:0], 0.6, 35)[0]) == 0


def test_no_link_between_texts_is_lost_at_any_size_of_groups(spark):
    docs = corpus(4)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = NearDuplicates(frame, similarity=0.6, width=3)
    rep = {r["id"]: r["rep"] for r in got.members().collect()}
    between = {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b in brute(docs, 3, 0.6, 40) if rep[a] != rep[b]}
    assert {(r["a"], r["b"]) for r in got.representative_pairs().collect()} == between
    for expand in (1, 3, 1000):
        assert {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b in map(tuple, got.pairs(expand).collect()) if rep[a] != rep[b]} == between


def test_groups(spark):
    docs = corpus(2)
    got = NearDuplicates(spark.createDataFrame(docs, "doc_id long, text string"), similarity=0.6, width=3)
    links = brute(docs, 3, 0.6, 40)
    rows = {r["id"]: r for r in got.groups().collect()}
    for a, b in links:
        assert rows[a]["group"] == rows[b]["group"]
    assert all(rows[r["group"]]["group"] == r["group"] for r in rows.values())
    assert 900 not in rows and rows[3]["copies"] == 13


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(WORDS[:80])
    rows = [(1, text), (1, text), (2, text), (None, text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in NearDuplicates(frame).pairs().collect()} == {(1, 2)}
    assert NearDuplicates(frame.limit(0)).pairs().count() == 0


def test_string_ids(spark):
    text = " ".join(WORDS[:80])
    frame = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert {tuple(r) for r in NearDuplicates(frame).pairs().collect()} == {("a", "b")}


def test_long_text_is_read_whole():
    text = "start " + "x " * 50_000 + "end"
    assert len(word_hashes(text)) == 50_002
    parts = list(batches([text, "", "a b"], 100))
    assert [(a, b) for a, b, _ in parts] == [(0, 1), (1, 3)]


def test_tokens_hash_alike_anywhere():
    one = Batch(["Éa ǆ 中文 x1", "zz"]).words()[2]
    two = Batch(["", "éA ǅ", "中文 X1 zz"]).words()[2]
    assert one.tolist() == two.tolist()
    assert len(shingles(one, np.array([0, 0, 0, 0, 1]), 5)[0]) == 0


def test_packed_sets_round_trip(spark):
    frame = spark.createDataFrame([(1, " ".join(WORDS[:90]))], "id long, text string")
    blob = neardup.set_table(frame, 3, 3).first()["shingles"]
    values = unpack_set(bytes(blob))
    assert len(values) == 88 and (np.diff(values.astype(np.int64)) > 0).all()


def test_every_document_has_a_group(spark, tmp_path):
    from gristmill.llm.queries import p4_groups

    docs = corpus(3) + [(910, "Too - SHORT!"), (911, " \n"), (912, "too short now"), (913, "--"), (914, "--"), (915, " ".join(WORDS[:12])), (916, " ".join(WORDS[:12]) + "."), (917, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in p4_groups(spark, str(tmp_path)).collect()}
    assert sorted(rows) == sorted(i for i, _ in docs)
    for a, b in brute(docs, 5, 0.8, 5):
        assert rows[a]["group"] == rows[b]["group"]
    assert [rows[i]["group"] for i in (900, 901, 902, 903, 910, 911, 912, 913, 914, 915, 916, 917)] == [900, 901, 902, 903, 902, 911, 912, 913, 913, 915, 915, 917]
    assert rows[910]["copies"] == 2 and rows[917]["copies"] == 1 and rows[916]["links"] == 0
