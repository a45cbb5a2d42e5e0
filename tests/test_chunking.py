"""Chunker cases from the reference tests plus invariants."""

import random

from ragscope.operators.chunking import chunk, fixed_spans


def test_fixed_digits():
    text = "0123456789" * 5
    assert fixed_spans(text, 20, 5) == [(0, 20), (15, 35), (30, 50)]


def test_fixed_blank_and_space_snap():
    assert fixed_spans("   \n ", 10, 2) == [] == fixed_spans(None, 10, 2)
    spans = fixed_spans("aaaa bbbb cccc dddd", 10, 0)
    assert spans[0] == (0, 10)  # cut just past the last space in [0, 10)
    assert "".join("aaaa bbbb cccc dddd"[a:b] for a, b in spans) == "aaaa bbbb cccc dddd"


def test_fixed_covers_text_without_overlap():
    rnd = random.Random(7)
    for _ in range(50):
        text = "".join(rnd.choice("ab  c\n") for _ in range(rnd.randint(1, 300)))
        spans = fixed_spans(text, 17, 0)
        inside = {i for a, b in spans for i in range(a, b)}
        assert len(inside) == sum(b - a for a, b in spans) and all(0 < b - a <= 17 for a, b in spans)
        assert "".join(c for i, c in enumerate(text) if i not in inside).strip() == ""


def test_char_split_counts_empties(spark):
    df = spark.createDataFrame([("d", "First one. Second one. Third one")], "doc_id string, text string")
    rows = chunk(df, "char_split", sep=". ").collect()
    assert [r["text"] for r in rows] == ["First one", "Second one", "Third one"]
    df2 = spark.createDataFrame([("d", ". . . Something. . . ")], "doc_id string, text string")
    rows = chunk(df2, "char_split", sep=". ").collect()
    assert len(rows) == 1 and rows[0]["chunk_index"] == 3 and rows[0]["text"] == "Something"
    assert rows[0]["chunk_id"] == "d_chunk_3"


def test_fixed_in_spark_matches_python(spark):
    texts = [("a", "word " * 250), ("b", ""), ("c", "x" * 1200), ("d", "é" * 30 + " " + "ü" * 600)]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    rows = chunk(df, "fixed", 500, 64).collect()
    exp = []
    for d, t in texts:
        exp += [(d, i, a, b, t[a:b]) for i, (a, b) in enumerate(fixed_spans(t, 500, 64))]
    got = sorted((r["doc_id"], r["chunk_index"], r["start_char"], r["end_char"], r["text"]) for r in rows)
    assert got == sorted(exp)


def test_none_strategy(spark):
    df = spark.createDataFrame([("a", "hello", "m")], "doc_id string, text string, source string")
    r = chunk(df, None).first()
    assert (r["chunk_id"], r["chunk_index"], r["source"]) == ("a", 0, "m")


def test_chunks_leave_in_batches_of_bounded_size(monkeypatch):
    """However many texts Spark hands over at once."""
    import pyarrow as pa

    from ragscope.operators import chunking

    monkeypatch.setattr(chunking, "ROWS", 3)
    monkeypatch.setattr(chunking, "CHARS", 500)
    texts = ["word " * 300, None, " ", "", "short", "x" * 700, "a b " * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([str(i) for i in range(7)])], names=["_text", "_doc"])
    out = list(chunking.fixed_batches([batch], 100, 10))
    assert all(sum(map(len, b.column("_t").to_pylist())) < 500 + 100 for b in out)
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(str(i), n, a, b, t[a:b]) for i, t in enumerate(texts) for n, (a, b) in enumerate(chunking.fixed_spans(t, 100, 10))]
