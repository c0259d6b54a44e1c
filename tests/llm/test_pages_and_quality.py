import random

import numpy as np

from gristmill.functions.codepoints import Batch
from gristmill.llm import boilerplate
from gristmill.llm.boilerplate import Page, furniture
from gristmill.llm.quality import DOCUMENT_LABELLERS, LABELLERS, TYPES, posteriors, quality, type_posteriors, votes

NOUNS = "pump valve motor gauge sensor panel belt filter housing spindle".split()
VERBS = "checks drains warms stops feeds lifts cools turns".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of unit {rng.randint(1, 99)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} when the {rng.choice(NOUNS)} is about to stop after {rng.randint(2, 60)} minutes."


def pages(seed=0, hosts=4, each=30):
    rng, rows, truth = random.Random(seed), [], {}
    for h in range(hosts):
        menu = rng.sample(["Products", "About", "Careers", "Login", "Pricing", "Forum", "Imprint"], 5)
        for p in range(each):
            lines = []
            if rng.random() < 0.8:
                lines.append((" | ".join(menu), True))
            if rng.random() < 0.5:
                lines.append(("This website uses cookies for statistics. Accept all", True))
            lines.append(("", False))
            for _ in range(rng.randint(2, 5)):
                lines.append((" ".join(sentence(rng) for _ in range(rng.randint(1, 3))), False))
            lines.append((f"- {rng.choice(NOUNS)} {rng.choice(NOUNS)}", False))
            if rng.random() < 0.7:
                lines += [("More from this series", True), (f"Video: unpacking the AB-{rng.randint(10, 999)}", True)]
            lines.append((f"Copyright Firm {h} 20{rng.randint(10, 30)}", True))
            i = len(rows)
            rows.append((i, "\n".join(t for t, _ in lines), f"host{h}"))
            truth[i] = {k for k, (t, f) in enumerate(lines, 1) if f}
    return rows, truth


def test_furniture_is_found(spark):
    rows, truth = pages()
    extra = rows + [(900, None, "host0"), (901, "", None), (902, "\n \n", "host0")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in extra], "doc_id long, text string, source string, id int, body string")
    got = {r["doc_id"]: r for r in furniture(frame).collect()}
    assert 900 not in got and got[901]["furniture"] == [] and got[902]["furniture"] == []
    hit = sum(len(truth[i] & set(got[i]["furniture"])) for i in truth)
    said = sum(len(got[i]["furniture"]) for i in truth)
    assert hit / said > 0.97 and hit / sum(map(len, truth.values())) > 0.97
    for i, text, _ in rows:
        gone = set(got[i]["furniture"])
        assert got[i]["body"] == "\n".join(t for k, t in enumerate(text.split("\n"), 1) if k not in gone)


def test_furniture_of_nothing_and_of_repeats(spark):
    rows, _ = pages(1, 1, 20)
    frame = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    assert furniture(frame.limit(0)).count() == 0
    assert furniture(frame).count() == 25


def test_page_lines_segments_and_masks():
    page = Page(Batch(["Home › About › AB-12\nOne, two. Three\n| a | b |", "", "x"]))
    assert page.line_words.tolist() == [3, 3, 2, 0, 1]
    assert page.size.tolist() == [1, 1, 1, 1, 1, 1, 2, 1]
    assert page.model.sum() == 1


PROSE = "The pump of the plant was checked by the crew, and it is not clear why it stopped in the night. "
TABLES = "\n".join(f"2030-01-{i:02d};AB-{i};{i}.5;0" for i in range(1, 25))


def test_types(spark):
    rows = [
        (1, PROSE * 6), (2, TABLES), (3, ("- " + PROSE.lower().strip(". ") + "\n") * 5), (4, "\n".join(f"- {a} {b}" for a in NOUNS for b in NOUNS[:4])), (5, None), (6, " \n\t"),
        (7, "4f" * 900), (8, PROSE * 2 + "\n" + TABLES), (9, PROSE * 30 + "\n" + TABLES), (10, "La pompe de l'usine fut vérifiée par l'équipe et on ne sait pas pourquoi elle a cessé. " * 5), (1, PROSE * 6),
    ] + [(20 + i, PROSE * 3) for i in range(10)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, chars int")
    got = {r["doc_id"]: r for r in quality(frame).collect()}
    kinds = {i: r["text_type"] for i, r in got.items()}
    assert [kinds[i] for i in (1, 3, 9, 10)] == ["prose"] * 4
    assert kinds[2] == kinds[8] == "table" and kinds[4] == "list" and kinds[5] == kinds[6] == "empty" and kinds[7] == "junk"
    sums = {i: sum(r[f"p_{t}"] for t in TYPES) if r["p_prose"] is not None else None for i, r in got.items()}
    assert sums[5] is None and sums[6] is None and all(abs(v - 1) < 1e-9 for v in sums.values() if v is not None)
    assert all(r["text_type"] == max(TYPES, key=lambda t: r[f"p_{t}"]) for r in got.values() if r["p_prose"] is not None)
    assert quality(frame).count() == len(rows) and quality(frame.limit(0)).count() == 0
    assert got[1]["words"] == 21 * 6 and got[2]["lines"] == 24 and abs(got[1]["mean_word_length"] - np.mean([len(w) for w in PROSE.replace(",", "").replace(".", "").split()])) < 1e-9


def test_types_are_learned_from_votes():
    rng = np.random.default_rng(2)
    truth = rng.choice(4, size=6000, p=[0.7, 0.1, 0.12, 0.08])
    named = [[[t in own for t in TYPES] for own in (low, high)] for *_, low, high in DOCUMENT_LABELLERS]
    cast = np.zeros((6000, 8), dtype=int)
    for j, (low, high) in enumerate(named):
        for i, c in enumerate(truth):
            right = 1 if low[c] else 2 if high[c] else rng.integers(1, 3)
            cast[i, j] = 0 if rng.random() < 0.15 else right if rng.random() < (0.97 if j else 0.6) else 3 - right  # the first is worse than thought
    codes, at, weight = np.unique(cast @ 3 ** np.arange(7, -1, -1), return_inverse=True, return_counts=True)
    p, table = type_posteriors(codes, weight.astype(float))
    assert (p[at].argmax(axis=1) == truth).mean() > 0.95
    heard = table[0, 0, 1] / table[0, 0, 1:].sum()
    assert abs(heard - 0.6) < 0.05 and table[0, 1, 1] / table[0, 1, 1:].sum() > 0.93


def test_accuracies_are_learned():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.6, 0.7])
    right = rng.random((4000, 8)) < accuracy
    vote = np.where(right == truth[:, None], 1, 2)
    codes, at, weight = np.unique(vote @ 3 ** np.arange(7, -1, -1), return_inverse=True, return_counts=True)
    p, table = posteriors(codes, weight.astype(float))
    assert ((p[at] > 0.5) == truth).mean() > 0.95
    assert np.abs(table[0, :, 1] - accuracy).max() < 0.06
    assert len(LABELLERS) == 8 and len(posteriors(np.array([], dtype=int), np.array([]))[0]) == 0
    assert votes({name: np.array([1.0]) for _, name, *_ in LABELLERS}).shape == (1,)


def test_rare_features_keep_their_weight_in_a_large_corpus(spark):
    counts = spark.createDataFrame([(0, False, 1, 9_000_000, 1_000_000), (0, False, 2, 5, 0), (1, False, 3, 2, 1), (0, True, 4, 3, 0), (1, True, 4, 2, 0)], "chunk long, pair boolean, feature long, short long, long long")
    assert {r["feature"] for r in boilerplate.weights(counts).collect()} == {1, 2, 4}


SEEN = "chunk long, host long, key long, vector long, pages int, odds float, known float, long boolean"


def test_classes_are_of_one_host_and_vector(spark):
    rows = [(0, 1, 10, 5, 2, 4.0, 2.0, False), (1, 1, 10, 6, 2, 2.0, 1.0, False), (0, 1, 11, 11, 4, 1.0, 2.0, False), (0, 1, 12, 12, 4, 1.0, 1.0, False), (0, 2, 13, 11, 4, 1.0, 1.0, False), (0, 1, 14, 11, 4, 1.0, 1.0, True), (0, 1, 15, 3, 2, 1.0, 1.0, False)]
    got = {r["key"]: r for r in boilerplate.deduce(spark.createDataFrame(rows, SEEN)).collect()}
    assert set(got) == {10, 11, 12, 13, 14}  # fifteen is on too few pages
    assert got[10]["class"] == got[11]["class"] and len({got[k]["class"] for k in (11, 12, 13, 14)}) == 4
    assert got[10]["own"] == 2.0


def test_order_and_nesting_of_classes(spark):
    tokens = spark.createDataFrame([(1, 100, 6.0, 2.0, 9, 3.0), (2, 100, 0.0, 2.0, 9, 0.0), (3, 200, 2.0, 2.0, 5, 1.0), (4, 300, 4.0, 2.0, 5, 2.0)], "key long, class long, odds double, known double, pages long, own double")
    seen = [(100, 0, 9, 7, 7), (200, 100, 4, 8, 8), (200, 0, 1, 8, 8), (300, 100, 2, 1, 2), (300, 0, 3, 1, 1)]
    got = {r["key"]: r["weight"] for r in boilerplate.template(tokens, spark.createDataFrame(seen, "class long, parent long, pages long, low long, high long")).collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 1.0 + boilerplate.NEST * 1.5, 4: 2.0}
    unordered = [(100, 0, 9, 6, 7)]
    got = {r["key"]: r["weight"] for r in boilerplate.template(tokens.where("class = 100"), spark.createDataFrame(unordered, "class long, parent long, pages long, low long, high long")).collect()}
    assert got == {1: 3.0, 2: 0.0}


def test_a_class_that_stands_around_another_is_its_parent(spark):
    rows = [(i, f"Menu alpha\nTeaser number {'one' if i % 2 else 'two'}\nMenu omega", "h") for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").select("doc_id", "text", "source")
    pages = frame.selectExpr("doc_id AS id", "text", "xxhash64(source) AS host", "xxhash64(doc_id) AS page", "0L AS chunk")
    laid = boilerplate.layout(pages, boilerplate.chunk_features(pages), ["id"])
    seen = boilerplate.tokens(laid)
    classed = boilerplate.deduce(seen)
    found = boilerplate.orders(laid, seen.select("chunk", "key").join(classed.select("key", "class"), "key")).collect()
    parents = {r["class"]: (r["parent"], r["pages"], r["low"] == r["high"]) for r in found}
    menu = next(c for c, (p, n, _) in parents.items() if n == 8 and p == 0)
    assert all(ordered for _, _, ordered in parents.values())
    assert sorted((n, p == menu) for p, n, _ in parents.values()) == [(4, True), (4, True), (8, False)]  # the words that all teasers share are in the class of the menu


def test_without_classes_nothing_is_furniture(spark, monkeypatch):
    rows, _ = pages()
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(boilerplate, "template", lambda tokens_of, seen: tokens_of.where("false").selectExpr("key", "0D AS weight"))
    assert furniture(frame).where("size(furniture) > 0").count() == 0


def test_other_hosts_do_not_change_a_host(spark):
    rows, _ = pages(5, 2, 25)
    more, _ = pages(6, 100, 25)
    small = {r["doc_id"]: r["furniture"] for r in furniture(spark.createDataFrame(rows, "doc_id long, text string, source string"), body=False).collect()}
    large = spark.createDataFrame(rows + [(i + 10_000, t, "other" + h) for i, t, h in more], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["furniture"] for r in furniture(large, body=False).where("doc_id < 10000").collect()}
    assert got == small


def test_chunks_do_not_change_the_result(spark, monkeypatch):
    rows, _ = pages(2)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = {tuple(map(str, r)) for r in furniture(frame).collect()}
    monkeypatch.setattr(boilerplate, "CHUNK_CHARS", 4000)
    assert {tuple(map(str, r)) for r in furniture(frame).collect()} == whole and len(whole) == len(rows)
    assert {(str(r["doc_id"]), str(r["furniture"])) for r in furniture(frame, body=False).collect()} == {x[:2] for x in whole}


def test_long_notices_of_a_host_are_found(spark):
    rows, _ = pages(3)
    long = "Ce site garde des données pour retenir vos choix et compter les visites. Refuser / Régler mes choix"
    short = "Ce site garde des données pour retenir vos choix\nCompter les visites\nRefuser / Régler mes choix"
    notice = {i: long if h == "host0" else short if i % 10 == 0 else None for i, _, h in rows}
    frame = spark.createDataFrame([(i, t + ("\n\n" + notice[i] if notice[i] else ""), h) for i, t, h in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["furniture"] for r in furniture(frame).collect()}
    for i, text, host in rows:
        if host == "host0":
            assert text.count("\n") + 3 in got[i]


def test_tokens_are_words_in_context_and_segments_of_long_lines():
    page = Page(Batch([f"About us\n{' '.join(NOUNS[:8])}.\n{' '.join(NOUNS * 2)} About. About\nUs About"]))
    assert len(page.token) == 2 + 8 + 2 + 2 and page.long_unit.tolist() == [2]
    assert len(set(page.token.tolist())) == 14  # neither "About" nor "us" is the same token in another place
