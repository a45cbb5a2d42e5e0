"""Chunking documents into passages (strategies ``none``, ``fixed``, ``char_split``).

Output columns: ``doc_id, chunk_index, chunk_id, start_char, end_char, text``
plus any extra corpus columns (document metadata carried to each chunk).

* ``none``: the whole document, ``chunk_id`` = doc id, index 0.
* ``fixed(size, overlap)`` (0-based code points): from ``start``,
  ``end = min(start + size, n)``; when ``end < n`` and the last space in
  ``[start, end)`` lies after ``start`` the cut moves just past it; the
  span is emitted when it holds a non-whitespace character (the index
  counts emitted chunks only); next ``start = end - overlap`` unless that
  does not advance, then ``end``; stop once ``end`` reaches ``n``.  Blank
  documents give no chunks.  Chunks leave Python as rows, in batches of
  bounded size.
* ``char_split(sep)``: literal split, Python-style strip, empties dropped;
  the index is the part's position, so it counts the dropped empties.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscope.functions.text import is_blank, py_strip
from ragscope.llm.memory import after_task
from ragscope.operators.quantiles import quantile_wide
from ragscope.session import scratch_path

#: Texts taken up at once, and characters of chunks in a batch that leaves.
ROWS, CHARS = 256, 4_000_000


def _stop(text: str, at: int, size: int) -> int:
    """Where the span that begins at ``at`` ends: past its last space, if it has one after ``at``."""
    if at + size >= len(text):
        return len(text)
    space = text.rfind(" ", at + 1, at + size)
    return at + size if space < 0 else space + 1


def fixed_spans(text: str | None, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the fixed-size chunks of one text."""
    if not text or text.isspace():
        return []
    spans = [(0, _stop(text, 0, size))]
    while (last := spans[-1])[1] < len(text):
        back = last[1] - overlap
        begin = back if back > last[0] else last[1]
        spans.append((begin, _stop(text, begin, size)))
    return [(a, b) for a, b in spans if not text[a:b].isspace()]


def fixed_batches(batches: Iterable[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The chunks of the texts (first column), a row each, with the other columns of their document.  Texts are taken
    ``ROWS`` at a time and batches end at ``CHARS`` characters of chunks, so memory follows these and the longest text."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part, rows, held = batch.slice(at, ROWS), [], 0
            for i, text in enumerate(part.column(0).to_pylist()):
                for number, (a, b) in enumerate(fixed_spans(text, size, overlap)):
                    rows.append((i, number, a, b, text[a:b]))
                    held += b - a
                    if held >= CHARS:
                        yield _rows(part, rows)
                        rows, held = [], 0
            if rows:
                yield _rows(part, rows)


def _rows(part: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    i, number, a, b, text = zip(*rows, strict=True)
    own = part.select(part.schema.names[1:]).take(pa.array(i, pa.int64()))
    made = [pa.array(number, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays([*own.columns, *made], names=[*own.schema.names, "chunk_index", "_s", "_e", "_t"])


def java_quote(s: str) -> str:
    """Escape a literal for a Java regex (``split`` takes a pattern)."""
    return "".join("\\" + ch if ch in r"\.[]{}()<>*+-=!?^$|&" else ch for ch in s)


def chunk(corpus: DataFrame, strategy: str | None = None, size: int = 500, overlap: int = 0,
          sep: str = ". ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    meta = [c for c in corpus.columns if c not in (id_col, text_col)]
    doc = F.col(id_col).cast("string")
    if strategy in (None, "none"):
        return corpus.select(
            doc.alias("doc_id"), F.lit(0).alias("chunk_index"), doc.alias("chunk_id"),
            F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"),
            F.col(text_col).alias("text"), *meta)
    if strategy == "fixed":
        if size <= 0:
            raise ValueError("chunk_size must be > 0")
        # the chunks leave with their own text; the document's is not copied to their rows
        texts = corpus.select(F.col(text_col).alias("_text"), doc.alias("_doc"), *meta)
        out = T.StructType([*texts.schema.fields[1:], T.StructField("chunk_index", T.IntegerType()), T.StructField("_s", T.IntegerType()),
                            T.StructField("_e", T.IntegerType()), T.StructField("_t", T.StringType())])
        ex = texts.mapInArrow(after_task(lambda batches: fixed_batches(batches, int(size), int(overlap))), out)
        return ex.select(
            F.col("_doc").alias("doc_id"), "chunk_index",
            F.concat("_doc", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            F.col("_s").alias("start_char"), F.col("_e").alias("end_char"), F.col("_t").alias("text"), *meta)
    if strategy == "char_split":
        if not sep:
            raise ValueError("split_sequence must not be empty")
        parts = corpus.select("*", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), java_quote(sep), -1))
                              .alias("chunk_index", "_part"))
        parts = parts.where(~is_blank("_part"))
        return parts.select(
            doc.alias("doc_id"), "chunk_index",
            F.concat(doc, F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
            F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"),
            py_strip("_part").alias("text"), *meta)
    raise ValueError(f"unknown chunking strategy {strategy!r}")


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """Total chunks, documents split into more than one chunk, chunks that
    start mid-document, and chunk-length summary with quartiles (one row).

    The lengths are written once and read by every pass, so chunks are made once."""
    spark = chunks.sparkSession
    path = scratch_path(spark, "chunk-lengths")
    chunks.select("doc_id", "chunk_index", F.char_length("text").cast("double").alias("len")).write.parquet(path)
    lengths, ln = spark.read.parquet(path), F.col("len")
    quartiles = quantile_wide(lengths.select("len"), ["len"], [0.25, 0.5, 0.75]).first()
    return lengths.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        # fixed chunking numbers emitted chunks only: index > 0 <=> split
        F.count_distinct(F.when(F.col("chunk_index") > 0, F.col("doc_id"))).alias("split_docs"),
        F.count_if(F.col("chunk_index") > 0).alias("non_first_chunks"),
        F.avg(ln).alias("len_mean"), F.stddev_samp(ln).alias("len_std"),
        F.min(ln).alias("len_min"), *[F.lit(quartiles[f"len__q{q}"]).cast("double").alias(f"len_p{q}") for q in (25, 50, 75)],
        F.max(ln).alias("len_max"),
    )


def split_report(corpus: DataFrame, chunks: DataFrame, size: int = 500, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Documents longer than ``size`` with each chunk's span and text."""
    long_docs = corpus.where(F.char_length(text_col) > size).select(
        F.col(id_col).cast("string").alias("doc_id"), F.char_length(text_col).alias("doc_len"))
    return chunks.join(long_docs, "doc_id", "inner").select(
        "doc_id", "doc_len", "chunk_index", "start_char", "end_char", "text")
