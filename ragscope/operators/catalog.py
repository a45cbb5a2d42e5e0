"""Index catalog: one vector collection per retrieval configuration.

* ``config_fingerprint`` - sha256 of the configuration as compact JSON with
  sorted keys and nulls left out (``k`` included, as in the reference, so a
  new k builds a new index; pass ``exclude=("k",)`` to key on the index only).
* ``resolve_collections`` - configurations joined to the existing catalog by
  fingerprint; unmatched fingerprints get ``<base>_<max existing + n>``.
* ``build_plan`` - per configuration: exists / populated / chunk count and
  whether the build can be skipped.
The configuration and catalog tables are one row per configuration or
collection; nothing is hinted, the optimiser decides by their size.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragscope.functions.text import collection_name


def config_fingerprint(cols: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    keep = sorted(c for c in cols if c not in set(exclude))
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in keep])), 256)


def chunk_signature(strategy: Column, size: Column | None = None, overlap: Column | None = None, sequence: Column | None = None) -> Column:
    """What of the chunking a collection depends on, as text: ``none`` without chunking."""
    null = F.lit(None).cast("string")
    size, overlap, sequence = (null if c is None else c.cast("string") for c in (size, overlap, sequence))
    return (F.when(strategy == "fixed", F.concat(F.lit("chunk_size="), size, F.lit(";chunk_overlap="), overlap))
            .when(strategy == "char_split", F.concat(F.lit("split_sequence="), sequence)).otherwise(F.lit("none")))


def resolve_collections(configs: DataFrame, catalog: DataFrame, model: str = "model", quant: str = "quantization",
                        dims: str = "dimensions", fingerprint: str = "fingerprint") -> DataFrame:
    """``configs + collection, is_new``; ``catalog`` has ``collection, fingerprint``."""
    base = collection_name(model, quant, dims)
    cfg = configs.withColumn("_base", base)
    cat = catalog.select(F.col("collection"), F.col(fingerprint).alias("_fp"))
    j = cfg.join(cat, cfg[fingerprint] == cat["_fp"], "left").drop("_fp")
    idx = F.regexp_extract(F.col("collection"), r"_(\d+)$", 1)
    existing = (catalog.select(F.col("collection"))
                .select(F.regexp_replace("collection", r"_\d+$", "").alias("_base"),
                        F.when(idx != "", idx.cast("int")).alias("_i"))
                .groupBy("_base").agg(F.max("_i").alias("_max")))
    new = (j.where(F.col("collection").isNull()).select("_base", fingerprint).distinct()
           .join(existing, "_base", "left")
           .withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(fingerprint)))
           .select("_base", fingerprint,
                   F.concat(F.col("_base"), F.lit("_"), (F.coalesce("_max", F.lit(0)) + F.col("_n")).cast("string"))
                   .alias("_new")))
    out = j.join(new, ["_base", fingerprint], "left")
    return out.select(*configs.columns, F.coalesce("collection", "_new").alias("collection"),
                      F.col("collection").isNull().alias("is_new"))


def build_plan(resolved: DataFrame, index_counts: DataFrame) -> DataFrame:
    """``index_counts``: ``collection, chunk_count`` of collections that exist."""
    j = resolved.join(index_counts, "collection", "left")
    exists = F.col("chunk_count").isNotNull()
    return j.select("*", exists.alias("exists"), (exists & (F.col("chunk_count") > 0)).alias("populated"),
                    (exists & (F.col("chunk_count") > 0)).alias("skip_build"))


def scrape_counters(texts: DataFrame, text_col: str, names: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Metric scrape texts (``name value`` lines) -> one typed column per
    counter, 0 when absent or unparsable.  A mapping gives the types (counters of things
    are ``bigint``, of seconds ``double``); names alone are doubles."""
    kinds = names if isinstance(names, Mapping) else dict.fromkeys(names, "double")
    cols = []
    for n, kind in kinds.items():
        v = F.regexp_extract(F.col(text_col), rf"(?m)^{re.escape(n)}(?:\{{[^}}]*\}})?\s+([-+0-9.eE]+)\s*$", 1)
        cols.append(F.coalesce(v.try_cast(kind), F.lit(0).cast(kind)).alias(n.replace(":", "_")))
    return texts.select("*", *cols)
