"""Reading the input tables and the derived views the analytics run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register every input table as a temp view (lazy: nothing is read)."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas skips NaN in every aggregate; Spark treats NaN as a value
    (largest in max, poisons avg).  Normalise once at load."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# The wide metric table derived from lineitem (FIXTURES.md part C).  The
# same text runs in Spark SQL and DuckDB, so it is stated once here.
EVALS_SQL = """
select 'run_'||lpad(cast(l_suppkey % 16 as string),2,'0')                                        as run_id,
       'run_'||lpad(cast(l_suppkey % 16 as string),2,'0')||'_s'||cast(l_orderkey % 3 as string)  as session_id,
       'claim_'||cast(l_partkey % 61 as string)              as claim_id,
       l_extendedprice/10                                    as latency_e2e_latency_ms,
       l_extendedprice/50                                    as latency_ttft_ms,
       20+l_quantity                                         as generation_tokens_per_second,
       cast(l_quantity*5 as bigint)                          as generation_completion_tokens,
       cast(l_quantity*20 as bigint)                         as generation_prompt_tokens,
       cast(l_partkey % 7 as double)/6                       as metrics_recall_at_k,
       case when l_linenumber=7 then null else l_discount*10 end as score_correctness,
       case when l_linenumber=6 then null else l_tax/0.08 end    as score_hallucination
from lineitem
"""

EVALS_COLUMNS = [
    "run_id", "session_id", "claim_id", "latency_e2e_latency_ms", "latency_ttft_ms",
    "generation_tokens_per_second", "generation_completion_tokens", "generation_prompt_tokens",
    "metrics_recall_at_k", "score_correctness", "score_hallucination",
]


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide evaluation table (one row per evaluation)."""
    return nan_to_null(spark.sql(EVALS_SQL.replace("from lineitem", "from {lineitem}"), lineitem=read_table(spark, sf_dir, "lineitem")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nan_to_null(read_table(spark, sf_dir, "events"))
