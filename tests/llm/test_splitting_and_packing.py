import random
from collections import defaultdict

import pytest
import regex

from gristmill.functions.codepoints import Batch
from gristmill.llm.packing import PATTERN, TOKENIZER, Bins, encoding, pack, pack_shard, token_counts, word_spans
from gristmill.llm.splitting import cut, headings, oversized, piece_rows, pieces, split

TEXTS = [
    "I'm we'll they've 'tis don't  stop'd it's'", "a  \n\n b\t c   d 'S 've  'll x'", "   ", "\n's end", "'", "''s", "٣٤ ½ x²y", "l'équipe d'usage s'arrête 'r're", "中文,。🎈🎈 x", "x" * 300, "\x1ca b\x85",
]


@pytest.mark.parametrize("text", TEXTS)
def test_words_and_counts_are_the_tokenizers(text):
    batch = Batch([text, "other"])
    start, end = word_spans(batch)
    own = start < len(text)
    assert [text[a:b] for a, b in zip(start[own], end[own])] == regex.findall(PATTERN, text)
    start, _, counts = token_counts(batch, TOKENIZER)
    assert counts[start < len(text)].sum() == len(encoding(TOKENIZER).encode_ordinary(text))


def test_random_text_counts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(" \n'aslvert1.é🎈") for _ in range(rng.randint(1, 40)))
        assert token_counts(Batch([text]), TOKENIZER)[2].sum() == len(encoding(TOKENIZER).encode_ordinary(text)), repr(text)


def slow_best_fit(tokens, sources, copies, capacity):
    bins = []
    for i in sorted(range(len(tokens)), key=lambda i: (-tokens[i], copies[i], str(sources[i]))):
        fits = [b for b in bins if b["room"] >= tokens[i] and copies[i] not in b["copies"]]
        clean = [b for b in fits if sources[i] not in b["sources"]] or fits
        best = min(clean, key=lambda b: b["room"]) if clean else None
        if best is None:
            best = {"room": capacity, "copies": set(), "sources": set()}
            bins.append(best)
        best["room"] -= tokens[i]
        best["copies"].add(copies[i])
        best["sources"].add(sources[i])
    return len(bins)


@pytest.mark.parametrize("seed", range(5))
def test_bins_are_compatible_and_tight(seed):
    rng = random.Random(seed)
    n = 400
    tokens = [rng.randint(1, 100) for _ in range(n)]
    sources = [rng.choice(["hot", "hot", *range(6), None]) for _ in range(n)]
    copies = [rng.choice([i, 7, 7]) if rng.random() < 0.3 else i for i in range(n)]
    for i in range(n):
        tokens[i] = tokens[7] if copies[i] == 7 else tokens[i]
    placed = pack_shard(tokens, sources, copies, 100)
    got = [b for b, _ in placed]
    held = defaultdict(list)
    for i in range(n):
        held[got[i]].append(sources[i])
    assert sum(clash for _, clash in placed) == sum(len(x) - len(set(x)) for x in held.values())
    refused = pack_shard(tokens, sources, copies, 100, refuse=True)
    assert not any(clash for _, clash in refused) and len({(b, sources[i]) for i, (b, _) in enumerate(refused)}) == n
    load, seen = defaultdict(int), defaultdict(set)
    for b, t, c in zip(got, tokens, copies):
        load[b] += t
        assert c not in seen[b]
        seen[b].add(c)
    assert max(load.values()) <= 100
    assert abs(len(load) - slow_best_fit(tokens, sources, copies, 100)) <= max(2, len(load) // 50)


def test_tightest_bin_first():
    bins = Bins(10)
    assert [bins.put(6, 1, 0), bins.put(7, 2, 0), bins.put(3, 4, 0)] == [(0, False), (1, False), (1, False)]
    assert bins.put(4, 1, 0) == (0, True)  # only a bin with its source has room
    assert bins.put(10, 1, 0) == (2, False)
    bins = Bins(10, refuse=True)
    assert [bins.put(6, 1, 0), bins.put(4, 1, 0)] == [(0, False), (1, False)]


def test_pack_whole_table(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1", "é"]) for _ in range(rng.randint(1, 900))), "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", None), (102, " ", None), (103, "long word " * 9000, "t"), (104, "ab" * 20_000, "t"), (105, rows[0][1], "t"), (0, rows[0][1], "s")]
    frame = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, source string, tokens int, shard string")
    got = pack(frame).collect()
    texts = dict((r[0], r[1]) for r in rows)
    load, spans = defaultdict(int), defaultdict(list)
    for r in got:
        load[r["container"]] += r["tokens"]
        spans[r["doc_id"]].append((r["piece"], r["start"], r["end"], r["tokens"]))
        assert len(encoding(TOKENIZER).encode_ordinary(texts[r["doc_id"]][r["start"] : r["end"]])) == r["tokens"]
    assert max(load.values()) <= 2048 and 100 not in spans and 101 not in spans and 102 in spans
    for i in (103, 104):
        parts = sorted(spans[i])
        assert len(parts) > 1 and parts[0][1] == 0 and parts[-1][2] == len(texts[i])
        assert all(a[2] == b[1] for a, b in zip(parts, parts[1:]))
    copies = [r["container"] for r in got if r["doc_id"] in (0, 105)]
    assert len(copies) == len(set(copies)) == 3
    assert pack(frame.limit(0)).count() == 0


def test_clusters_are_kept_apart(spark):
    rows = [(i, "alpha beta gamma " * 20 + f"x{i}", "s") for i in range(12)] + [(50, None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = spark.createDataFrame([(i, i % 3) for i in range(9)] + [(50, 0), (77, 1)], "doc_id long, group long")
    got = {r["doc_id"]: r["container"] for r in pack(frame, clusters=groups).collect()}
    assert sorted(got) == list(range(12))
    assert all(got[a] != got[b] for a in range(9) for b in range(a) if a % 3 == b % 3)
    assert len({got[a] for a in range(9)}) == 3


def straddling(text, spans):
    """Pieces that begin inside a section and go on under a later heading."""
    at, _ = headings(text)
    return [(a, b) for a, b, _ in spans if a not in at and a > 0 and any(a < h < b for h in at)]


def test_no_piece_goes_on_from_inside_a_section_under_a_later_heading():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["A sentence of some words. ", "\n", "\n\n", "\n# Head\n", "\n## Sub\n", "\n- item one\n", "\n  - item two\n", "\n<h3>Title</h3>", "<li>entry</li>"]) for _ in range(rng.randint(20, 120)))
        assert straddling(text, cut(text, 80)) == []


def test_lists_markup_and_fences_are_nodes():
    text = "- one two three\n  - four five\n  - six seven\n- eight nine\n- ten eleven twelve\n"
    assert [text[a:b].split("\n")[0] for a, b, _ in cut(text, 45)] == ["- one two three", "- eight nine"]
    page = "<ul><li>first entry here</li><li>second entry here</li></ul><p>closing words</p>"
    assert all(page[a] == "<" for a, _, _ in cut(page, 40))
    code = "# A\ntext\n```\n# no heading\n```\n# B\n"
    assert [code[a:].split("\n")[0] for a in headings(code)[0]] == ["# A", "# B"]
    assert headings("```\n# open fence")[0] == [4] and headings("<h2 class=x>T</h2>") == ([0], [2])


def test_pieces_tile_the_text_within_the_limit():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "Long sentence ends. ", "\n", "\n\n", "# Head\n", "## Sub\n", "- item\n", "x" * 70, "é🎈 ", "| a | b |\n"]) for _ in range(rng.randint(0, 80)))
        for limit, overlap in ((60, 0), (60, 20), (200, 50)):
            got = pieces(text, limit, overlap)
            assert "".join(text[own:end] for _, own, end, _ in got) == text
            assert all(end - start <= limit for start, _, end, _ in got)
            assert (len(got) > 1) == (len(text) > limit)
            for (_, _, before, _), (start, own, _, _) in zip(got, got[1:]):
                assert own == before and 0 <= own - start <= overlap


def test_cuts_follow_the_structure():
    text = "# A\n" + "one two three. " * 3 + "\n\n# B\n" + "four five six. " * 3
    assert [text[a:b].split("\n")[0] for a, b, _ in cut(text, 60)] == ["# A", "# B"]
    small = "# A\nx\n# B\ny\n# C\n" + "long words here. " * 6
    assert [text for a, b, _ in cut(small, 40) for text in [small[a:b]]][0].startswith("# A\nx\n# B\ny\n")


def test_split_table(spark):
    specs = spark.createDataFrame([(2, "c", 20, 5), (1, "c", 10, 2), (3, None, 5, 1)], "spec_id int, documents string, size_tokens int, overlap_tokens int")
    rows = [(1, "word " * 40, "c"), (2, "short", "c"), (3, None, "c"), (4, "", "c"), (5, "word " * 40, "other"), (6, "word " * 40, None), (1, "word " * 40, "c")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, corpus string, limit int")
    got = sorted((r["doc_id"], r["limit"], len(r["pieces"])) for r in split(docs, specs).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5, 6] and got[2] == (2, 40, 1) and got[3] == (3, 40, 0) and got[5][1:] == (None, 1)
    assert [r["doc_id"] for r in oversized(docs, specs).collect()] == [1, 1]
    assert {r["cut_at"] for r in piece_rows(docs, specs).where("doc_id = 1").collect()} == {"word"}
    assert split(docs.limit(0), specs).count() == 0 and split(docs, specs.limit(0)).where("size(pieces) > 1").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        split(docs, spark.createDataFrame([(1, "c", 10, 10)], "spec_id int, documents string, size_tokens int, overlap_tokens int"))
