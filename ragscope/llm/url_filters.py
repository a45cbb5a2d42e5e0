"""URL filters against dated lists: a temporal list join.

List entries are dated events (domain pattern, action, day): ``block``,
``allow`` or ``remove``.  Per pattern, each event is valid from its day to the
next event's day (``intervals``).  A capture is judged by the entries that were
active on the day of its fetch: an as-of join on every domain suffix of its
host.  The longest active pattern decides.

Interval rows are laid out by month, so the as-of join is an equi-join on
(pattern, month) with a range condition that few rows have to pass.  Captures
are reduced to distinct (host, day) pairs before they meet the list, so a host
with a third of all captures is a few rows there; the verdicts join back on
(host, day).

Edge cases: hosts are compared in lower case, without a trailing dot; a url
without a host, or a null fetch day, meets no entry and is not blocked; events
of one pattern on one day count as one, block before allow before remove;
events with a null pattern, action or day, or another action, are ignored;
repeated captures get a row each; an empty list blocks nothing.  Dates make the
events of a pattern no more than the days that the list spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Actions by priority on the same day.
ACTIONS = ["remove", "allow", "block"]


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, null without one."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of each block or allow entry; valid_to
    is exclusive, null while the entry stands.  ``events``: pattern, action, listed_on."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    pattern = F.regexp_replace(F.lower("pattern"), r"^\.|\.$", "")
    daily = (
        events.select(pattern.alias("pattern"), rank.alias("rank"), F.col("listed_on").cast("date").alias("day"))
        .where((F.col("rank") > 0) & (F.col("pattern") != "") & F.col("day").isNotNull())
        .groupBy("pattern", "day").agg(F.max("rank").alias("rank"))
    )
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return daily.select("pattern", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("rank").cast("int")).alias("action"),
                        F.col("day").alias("valid_from"), until.alias("valid_to")).where(F.col("action") != "remove")


def judge_hosts(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """(host, day, n_active, decided_by, action) of distinct (host, day) pairs that meet an active entry."""
    asked = pairs.withColumn("pattern", F.explode(suffixes(F.col("host")))).withColumn("month", F.trunc("day", "month"))
    last = pairs.agg(F.max("day").alias("d")).first()["d"]  # one value
    end = F.coalesce(F.date_sub("valid_to", 1), F.greatest(F.lit(last), F.col("valid_from")))
    by_month = spans.withColumn("month", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(end, "month"), F.expr("interval 1 month"))))
    hit = asked.join(by_month, ["pattern", "month"]).where(
        (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    best = F.max(F.struct(F.length("pattern").alias("size"), "pattern", "action"))
    return hit.groupBy("host", "day").agg(F.count(F.lit(1)).alias("n_active"), best.alias("best")).select(
        "host", "day", "n_active", F.col("best.pattern").alias("decided_by"), F.col("best.action").alias("action"))


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with ``_u_host``, ``_u_active`` (active entries met), ``_u_decided_by`` and ``_u_blocked``."""
    own = captures.withColumn("_u_host", host_of(F.col(url))).withColumn("_u_day", F.col(fetched).cast("date"))
    pairs = own.where(F.col("_u_host").isNotNull() & F.col("_u_day").isNotNull()).select(F.col("_u_host").alias("host"), F.col("_u_day").alias("day")).distinct()
    v = judge_hosts(pairs, intervals(events))
    v = v.toDF(*[f"_v_{c}" for c in v.columns])
    out = own.join(v, (F.col("_u_host") == F.col("_v_host")) & (F.col("_u_day") == F.col("_v_day")), "left")
    return out.select(*[F.col(f"`{c}`") for c in captures.columns], "_u_host",
                      F.coalesce("_v_n_active", F.lit(0)).alias("_u_active"), F.col("_v_decided_by").alias("_u_decided_by"),
                      F.coalesce(F.col("_v_action") == "block", F.lit(False)).alias("_u_blocked"))
