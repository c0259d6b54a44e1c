from gristmill.sources.loaders import html_text, load_corpus, load_judgments, load_qa, load_spec, qrels


def test_corpus(spark, tmp_path):
    (tmp_path / "a-b").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "a-b/x.md").write_bytes(b"intro\r\n# Title\r\ntext")
    (tmp_path / "a/x.html").write_text("<title>T</title><script>no()</script><h2>Head</h2><ul><li>one <b>two</b></li></ul><p></p>")
    (tmp_path / "a/y.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "a/z.bin").write_bytes(b"x")
    (tmp_path / "none").write_bytes(b"x")
    (tmp_path / "bad.pdf").write_bytes(b"not a pdf")
    docs, skipped = load_corpus(spark, str(tmp_path))
    got = {r["source"]: (r["title"], r["text"], r["filetype"]) for r in docs.collect()}
    assert got == {"a-b/x.md": ("Title", "intro\n# Title\ntext", "md"), "a/x.html": ("T", "## Head\n\none two", "html"), "a/y.TXT": ("y", "caf�", "txt")}
    assert {(r["source"], r["suffix"], r["reason"]) for r in skipped.collect()} == {("a/z.bin", ".bin", "unsupported_suffix"), ("none", "<none>", "unsupported_suffix"), ("bad.pdf", ".pdf", "loader_error")}


def test_nested_blocks_repeat():
    assert html_text("<blockquote>a<p>b</p></blockquote><br><pre>c</pre>")[0] == "a b\n\nb\n\nc"


def test_qa_judgments_qrels(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text('{"qid":"q1","question":"?","gold_fact":"f"}\n{"qid":"q2","question":"?"}\n')
    assert {r["qid"]: (r["label_source"], r["gold_docs"]) for r in load_qa(spark, str(tmp_path / "qa.jsonl")).collect()} == {"q1": ("legacy", []), "q2": ("none", [])}
    (tmp_path / "j.jsonl").write_text('{"key":"a","supported":true}\n{"key":"a","supported":false}\n')
    assert [tuple(r) for r in load_judgments(spark, str(tmp_path / "j.jsonl")).collect()] == [("a", False)]
    rows = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "c", 0)], "`query-id` string, `corpus-id` string, score int")
    assert [tuple(r) for r in qrels(rows).collect()] == [("q", ["a", "b"])]
    assert load_spec("name: x\nseed: 1") == {"name": "x", "seed": 1}
