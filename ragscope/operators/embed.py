"""Embedding chunks with a pluggable batch embedder (``mapInPandas``).

The embedder is any callable ``list[str] -> array (n, d)``; it runs inside
tasks on Arrow batches cut into sub-batches of ``batch_size`` (the request
size of a remote embedding service), rows keep their order, and every
vector must have the collection's dimension (learned from the first batch
when not given, then checked).  A deterministic feature-hashing embedder is
included for tests and for corpora without a model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\w+", re.UNICODE)


class HashingEmbedder:
    """Signed feature hashing of lower-cased word tokens, L2-normalised."""

    def __init__(self, dims: int = 64):
        if dims <= 0:
            raise ValueError("dims must be > 0")
        self.dims = dims

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for i, t in enumerate(texts):
            for tok in _TOKEN.findall((t or "").lower()):
                h = zlib.crc32(tok.encode("utf-8"))
                out[i, h % self.dims] += 1.0 if (h >> 31) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def embed(chunks: DataFrame, embedder: Callable[[Sequence[str]], np.ndarray], text_col: str = "text",
          batch_size: int = 32, dims: int | None = None, out_col: str = "embedding") -> DataFrame:
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    schema = T.StructType([*chunks.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])
    want = dims

    def run(batches):
        d = want
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vecs = []
            for lo in range(0, len(texts), batch_size):
                v = np.asarray(embedder(texts[lo:lo + batch_size]), dtype=np.float32)
                if v.ndim != 2 or v.shape[0] != len(texts[lo:lo + batch_size]):
                    raise ValueError("embedder must return one vector per text")
                if d is None:
                    d = v.shape[1]
                elif v.shape[1] != d:
                    raise ValueError(f"embedding dimension {v.shape[1]} != collection dimension {d}")
                vecs.append(v)
            out = pdf.copy()
            out[out_col] = list(np.vstack(vecs)) if vecs else []
            yield out

    return chunks.mapInPandas(run, schema)


def with_progress(df: DataFrame, name: str = "embedded") -> tuple[DataFrame, Observation]:
    """Count rows as they pass (read ``obs.get`` after the action)."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
