"""RAG prompt per query from its ranked hits.

The context block is ``[i] text`` per hit in rank order, joined by a blank
line; the hits of one query are bounded by k, so collecting them per query
is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The two prompt templates (byte-exact, including the
# 16-space indents and the 16-space line before "Answer").
_INDENT = " " * 16
PROMPT_WITH_CONTEXT = (
    "<s>[INST] Use the following pieces of context to answer the question.\n"
    f"{_INDENT}Context:\n"
    f"{_INDENT}{{context}}\n"
    "\n"
    f"{_INDENT}Question: {{query}}\n"
    f"{_INDENT}\n"
    f"{_INDENT}Answer: [/INST]"
)
PROMPT_NO_CONTEXT = (
    "<s>[INST] Use the following pieces of context to answer the question.\n"
    f"{_INDENT}Context:\n"
    f"{_INDENT}<No context available>\n"
    "\n"
    f"{_INDENT}Question: {{query}}\n"
    f"{_INDENT}\n"
    f"{_INDENT}Answer: [/INST]"
)


def _fill(template: str, **cols: Column) -> Column:
    """Substitute ``{name}`` placeholders with columns (no format-string parsing
    of the data, so braces or percent signs in texts are safe)."""
    parts: list[Column] = []
    rest = template
    while True:
        idx = [(rest.find("{" + n + "}"), n) for n in cols if rest.find("{" + n + "}") >= 0]
        if not idx:
            parts.append(F.lit(rest))
            break
        pos, name = min(idx)
        parts += [F.lit(rest[:pos]), F.coalesce(cols[name], F.lit(""))]
        rest = rest[pos + len(name) + 2:]
    return F.concat(*parts)


def context_block(hits: DataFrame, key: str = "query_id", rank: str = "rank", text: str = "text") -> DataFrame:
    """``key, n_context, context`` from ranked hit texts."""
    return hits.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_context"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"),
                                                                      F.coalesce(F.col(text), F.lit("")).alias("t")))),
                                 lambda s: F.concat(F.lit("["), s["r"].cast("string"), F.lit("] "), s["t"])),
                     "\n\n").alias("context"),
    )


def rag_prompt(queries: DataFrame, hits: DataFrame, key: str = "query_id", query_text: str = "query",
               rank: str = "rank", text: str = "text") -> DataFrame:
    """``key, n_context, prompt`` for every query (no hits -> no-context template)."""
    ctx = context_block(hits, key, rank, text)
    j = queries.select(key, query_text).join(ctx, key, "left")
    with_ctx = _fill(PROMPT_WITH_CONTEXT, context=F.col("context"), query=F.col(query_text))
    no_ctx = _fill(PROMPT_NO_CONTEXT, query=F.col(query_text))
    return j.select(key, F.coalesce(F.col("n_context"), F.lit(0)).alias("n_context"),
                    F.when(F.col("context").isNull(), no_ctx).otherwise(with_ctx).alias("prompt"))
