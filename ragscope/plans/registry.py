"""All registered queries and their DuckDB oracles."""

from __future__ import annotations


def all_queries() -> dict:
    from ragscope.plans import analytics, analytics2, corpus_q, eval_q, index_q, io_q, more_q, retrieval_q, shapes_q, spans_q, stream_q

    out = {}
    for mod in (analytics, analytics2, retrieval_q, corpus_q, spans_q, eval_q, stream_q, io_q, index_q, shapes_q, more_q):
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict:
    from ragscope.plans import analytics2, corpus_q, eval_q, index_q, io_q, more_q, oracle_analytics, retrieval_q, shapes_q, spans_q, stream_q

    out = {}
    for mod in (oracle_analytics, analytics2, retrieval_q, corpus_q, spans_q, eval_q, stream_q, io_q, index_q, shapes_q, more_q):
        out.update(mod.ORACLES)
    return out
