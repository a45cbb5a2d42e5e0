"""DuckDB oracle SQL for the analytics queries (independent formulation:
plain aggregates, ``quantile_cont`` and UNPIVOT, no shared Spark code)."""

from __future__ import annotations

from ragscope.plans.analytics import (
    BAND_COLS, BAND_ORDER, SUMMARY_MEANS, SUMMARY_MEDIANS, SUMMARY_P90, TREND_COLS,
)
from ragscope.plans.common import EVALS_METRICS, EVENT_IDS, EVENT_METRICS, RUN_ORDER
from ragscope.sources.tables import EVALS_COLUMNS, EVALS_SQL

EVALS_CTE = f"evals as ({EVALS_SQL})"
EVENTS_CTE = (
    "ev as (select event_id, user_id, event_type, ts, value as event_value, "
    "try_cast(json_extract_string(props, '$.k') as double) as props_k from events)"
)


def values_list(name: str, items) -> str:
    rows = ", ".join(f"('{v}', {i})" for i, v in enumerate(items))
    return f"{name}(val, _ord) as (select * from (values {rows}))"


def r6(cols) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


def iqr_bounds(table: str, cols, t: float = 3.0) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"quantile_cont({c}, 0.25) as q1_{i}, quantile_cont({c}, 0.75) as q3_{i}")
    return f"select {', '.join(parts)} from {table}"


def iqr_flag(c: str, i: int, t: float = 3.0) -> str:
    iqr = f"(q3_{i} - q1_{i})"
    return (f"coalesce({iqr} <> 0 and ({c} < q1_{i} - {t} * {iqr} or {c} > q3_{i} + {t} * {iqr}), false)")


def unpivot_long(table: str, by: list[str], cols) -> str:
    casts = ", ".join(f"cast({c} as double) as {c}" for c in cols)
    return (f"select {', '.join(by)}, metric, v from (unpivot (select {', '.join(by)}, {casts} from {table}) "
            f"on {', '.join(cols)} into name metric value v)")


def run_summary() -> str:
    flags = " or ".join(iqr_flag(c, i) for i, c in enumerate(EVALS_METRICS))
    means = ", ".join(f"avg({c}) as {a}" for c, a in SUMMARY_MEANS.items())
    meds = ", ".join(f"quantile_cont({c}, 0.5) as {a}" for c, a in SUMMARY_MEDIANS.items())
    p90 = ", ".join(f"cast(round_even(quantile_cont({c}, 0.9), 0) as bigint) as {a}" for c, a in SUMMARY_P90.items())
    outs = list(SUMMARY_MEANS.values()) + list(SUMMARY_MEDIANS.values())
    return f"""
with {EVALS_CTE}, b as ({iqr_bounds('evals', EVALS_METRICS)}),
kept as (select evals.* from evals, b where not ({flags})),
{values_list('o', RUN_ORDER)},
agg as (select run_id, count(*) as n_rows, {means}, {meds}, {p90} from kept group by run_id)
select agg.* replace ({r6(outs)}), o._ord from agg join o on agg.run_id = o.val
"""


def group_describe() -> str:
    return f"""
with {EVALS_CTE}, long as ({unpivot_long('evals', ['session_id'], EVALS_METRICS)})
select session_id, metric, count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
       round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50,
       round(quantile_cont(v, 0.75), 6) as p75, round(max(v), 6) as max
from long where session_id is not null group by session_id, metric
"""


def group_band() -> str:
    ms = ", ".join(f"('{c}')" for c in BAND_COLS)
    return f"""
with {EVALS_CTE}, long as ({unpivot_long('evals', ['run_id'], BAND_COLS)}),
{values_list('o', BAND_ORDER)}, m(metric) as (select * from (values {ms})),
agg as (select run_id, metric, quantile_cont(v, 0.9) as value, stddev_samp(v) as std,
               quantile_cont(v, 0.1) as band_lo, quantile_cont(v, 0.9) as band_hi
        from long where run_id in (select val from o) group by run_id, metric)
select o.val as run_id, o._ord, m.metric, {r6(['value', 'std', 'band_lo', 'band_hi'])}
from o cross join m left join agg on agg.run_id = o.val and agg.metric = m.metric
"""


def normalised_trend() -> str:
    return f"""
with {EVALS_CTE}, long as ({unpivot_long('evals', ['session_id'], TREND_COLS)}),
agg as (select session_id, metric, avg(v) as value, stddev_samp(v) as std,
               quantile_cont(v, 0.25) as band_lo, quantile_cont(v, 0.75) as band_hi
        from long where session_id is not null group by session_id, metric),
s as (select *, min(value) over (partition by metric) as lo,
             case when max(value) over (partition by metric) - min(value) over (partition by metric) = 0 then 1.0
                  else max(value) over (partition by metric) - min(value) over (partition by metric) end as sc
      from agg)
select session_id, metric, round((value - lo) / sc, 6) as value, round(std / sc, 6) as std,
       round((band_lo - lo) / sc, 6) as band_lo, round((band_hi - lo) / sc, 6) as band_hi
from s
"""


def dataset_info() -> str:
    kinds = {"run_id": "string", "session_id": "string", "claim_id": "string", "generation_completion_tokens": "bigint",
             "generation_prompt_tokens": "bigint"}
    return f"with {EVALS_CTE} " + " union all ".join(
        f"select {i} as position, '{c}' as \"column\", '{kinds.get(c, 'double')}' as type, count({c}) as non_null, count(*) as n_rows from evals"
        for i, c in enumerate(EVALS_COLUMNS))


def null_profile() -> str:
    parts = " union all ".join(
        f"select '{c}' as metric, count_if({c} is null) as null_count, "
        f"round(count_if({c} is null) / count(*) * 100, 6) as null_pct from evals" for c in EVALS_METRICS)
    return f"with {EVALS_CTE} select * from ({parts}) where null_count > 0"


def _event_outliers(flag_fn, bounds_sql) -> str:
    parts = []
    cols = EVENT_METRICS
    for i, c in enumerate(cols):
        lo, hi = flag_fn(c, i)
        parts.append(
            f"select '{c}' as outlier_col, round({c}, 6) as value, round(round({lo}, 4), 6) as lower, "
            f"round(round({hi}, 4), 6) as upper, {', '.join(EVENT_IDS)}, "
            f"{', '.join(f'round({x}, 6) as {x}' for x in cols)} "
            f"from ev, b where {c} < {lo} or {c} > {hi}")
    return f"with {EVENTS_CTE}, b as ({bounds_sql}) " + " union all ".join(parts)


def find_outliers() -> str:
    def fl(c, i):
        iqr = f"case when q3_{i} - q1_{i} <> 0 then q3_{i} - q1_{i} end"
        return f"(q1_{i} - 3.0 * ({iqr}))", f"(q3_{i} + 3.0 * ({iqr}))"
    return _event_outliers(fl, iqr_bounds("ev", EVENT_METRICS))


def find_outliers_z() -> str:
    def fl(c, i):
        sd = f"case when sd_{i} <> 0 then sd_{i} end"
        return f"(mu_{i} - 3.0 * ({sd}))", f"(mu_{i} + 3.0 * ({sd}))"
    b = "select " + ", ".join(f"avg({c}) as mu_{i}, stddev_samp({c}) as sd_{i}" for i, c in enumerate(EVENT_METRICS)) + " from ev"
    return _event_outliers(fl, b)


def exclude_outliers() -> str:
    flags = " or ".join(iqr_flag(c, i) for i, c in enumerate(EVENT_METRICS))
    return f"""
with {EVENTS_CTE}, b as ({iqr_bounds('ev', EVENT_METRICS)})
select event_id, user_id, event_type, {r6(EVENT_METRICS)} from ev, b where not ({flags})
"""


def outlier_summary() -> str:
    parts = " union all ".join(
        f"select '{c}' as metric, count_if({iqr_flag(c, i)}) as n_outliers, count({c}) as n_non_null, "
        f"round(case when count({c}) > 0 then count_if({iqr_flag(c, i)}) / count({c}) * 100 end, 6) as pct from ev, b"
        for i, c in enumerate(EVENT_METRICS))
    return f"with {EVENTS_CTE}, b as ({iqr_bounds('ev', EVENT_METRICS)}) {parts}"


ORACLES = {
    "run_summary": run_summary(),
    "group_describe": group_describe(),
    "group_band": group_band(),
    "normalised_trend": normalised_trend(),
    "null_profile": null_profile(),
    "dataset_info": dataset_info(),
    "find_outliers": find_outliers(),
    "find_outliers_z": find_outliers_z(),
    "exclude_outliers": exclude_outliers(),
    "outlier_summary": outlier_summary(),
}
