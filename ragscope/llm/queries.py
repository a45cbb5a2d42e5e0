"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscope.llm import chat, decontaminate, hamming_join, hard_negatives, hmm, line_dedup, ngram_join, packing, periodic, quality_rules, secret_scan, substring_dedup, url_filters
from ragscope.llm.jobs import read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeated chunks take from every document, and what is left."""
    p = line_dedup.P
    return line_dedup.remove_repeats(_docs(spark, sf_dir)).select(
        "doc_id", F.col(p + "lines").alias("n_lines"), F.col(p + "removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from ``labels``."""
    docs = _docs(spark, sf_dir)
    rules = quality_rules.learn(docs, read(spark, sf_dir, "labels"))
    p = quality_rules.P
    return quality_rules.judge(docs, rules).select(
        "doc_id", *[F.col(p + c).alias(c) for c in [*quality_rules.BASE, "n_lines", "n_listed", "base_failed", "rule", "kept"]])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a 13-word window of an earlier document covers."""
    p = substring_dedup.P
    return substring_dedup.parse(_docs(spark, sf_dir)).select(
        "doc_id", F.col(p + "words").alias("n_words"), F.col(p + "removed").alias("n_removed"),
        F.sha2(F.col(p + "kept").cast("binary"), 256).alias("kept_sha256"), F.size(F.filter(p + "factors", lambda f: ~f["boundary"])).cast("long").alias("n_factors"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a window of a benchmark item covers."""
    found = decontaminate.find(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    words, items = F.col(decontaminate.P + "words"), F.col(decontaminate.P + "items")
    return found.select(
        "doc_id", words.alias("n_words"), decontaminate.n_hit().alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (decontaminate.n_hit() > 0).alias("contaminated"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credentials in every document: the base kinds and further known formats."""
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_scan.scan(_docs(spark, sf_dir)).select(
        "doc_id", *[count(k) for k in base],
        F.sha2(secret_scan.spans_text(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.collapse_and_render(read(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
upto AS (
  SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(role || chr(1) || text, chr(2)) OVER w AS whole,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS rendered
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
uniq AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n, whole, min(rendered) AS rendered FROM upto WHERE pos = n GROUP BY n, whole)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM uniq
WHERE NOT EXISTS (SELECT 1 FROM upto u WHERE u.pos = uniq.n AND u.pos < u.n AND u.whole = uniq.whole)
"""


def _word_bpe() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(_docs(spark, sf_dir), _word_bpe())


# The tables hold no list and no fetch times: both are derived from `pages` by
# these expressions, which read the same in Spark and DuckDB.
_HOST_SQL = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:@]+)', 1)"
_LISTED = [("block", 3, 0, 0, 700), ("remove", 3, 0, 701, 300), ("block", 6, 0, 1002, 200), ("allow", 5, 1, 0, 900)]
_DAY_0 = "DATE '2020-01-01'"


def _list_events(hosts: DataFrame) -> DataFrame:
    """Dated entries for hosts and their parent domains: an md5 of the pattern gives actions and days."""
    patterns = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]*\.", ""))).alias("pattern")).distinct()
    k = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    parts = [F.when(k % mod == rest, F.struct(F.lit(action).alias("action"), F.date_add(F.expr(_DAY_0), (first + k % days).cast("int")).alias("listed_on")))
             for action, mod, rest, first, days in _LISTED]
    return patterns.select("pattern", F.explode(F.array_compact(F.array(*parts))).alias("e")).select("pattern", "e.action", "e.listed_on")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page capture against the list entries active on its fetch day."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.expr(_DAY_0), F.pmod(F.col("page_id") * 37, F.lit(1461)).cast("int")))
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    return url_filters.filter_captures(captures, _list_events(hosts)).select(
        "page_id", F.col("_u_host").alias("host"), "fetched_on", F.col("_u_active").alias("n_active"),
        F.col("_u_decided_by").alias("decided_by"), F.col("_u_blocked").alias("blocked"))


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document, learned from nine tenths of them."""
    return hmm.score(_docs(spark, sf_dir))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.85 on four-word shingles."""
    return ngram_join.join(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of Jaccard similarity 0.85 on five-word shingles, by b-bit signatures."""
    return hamming_join.join(_docs(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score just below each anchor's nearest rows of its own label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, the strongest one, and the text with runs cut to one period."""
    p = periodic.P
    found = periodic.find_runs(_docs(spark, sf_dir), rewrite=periodic.rewrite_rule)
    runs = F.col(p + "runs")
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate(runs, none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), p + "kept", p + "words").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(p + "kept").cast("binary"), 256).alias("collapsed_sha256"), F.col(p + "words").alias("n_words"))


OP8_SQL = f"""
WITH captures AS (
  SELECT page_id, nullif({_HOST_SQL}, '') AS host, {_DAY_0} + CAST((page_id * 37) % 1461 AS INTEGER) AS fetched_on FROM pages),
patterns AS (
  SELECT DISTINCT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS k FROM (
    SELECT host AS pattern FROM captures WHERE host IS NOT NULL
    UNION ALL SELECT regexp_replace(host, '^[^.]*[.]', '') FROM captures WHERE host IS NOT NULL)),
events AS ({" UNION ALL ".join(
    f"SELECT pattern, '{a}' AS action, {i} AS rank, {_DAY_0} + CAST({f} + k % {d} AS INTEGER) AS day FROM patterns WHERE k % {m} = {r}"
    for (a, m, r, f, d), i in zip(_LISTED, (3, 1, 3, 2), strict=True))}),
daily AS (SELECT pattern, day, max(rank) AS rank FROM events GROUP BY pattern, day),
spans AS (SELECT pattern, rank, day AS a, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS b FROM daily),
asked AS (SELECT page_id, fetched_on, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
    lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS pattern FROM captures WHERE host IS NOT NULL),
hits AS (SELECT page_id, s.pattern, s.rank, row_number() OVER (PARTITION BY page_id ORDER BY length(s.pattern) DESC) AS place,
    count(*) OVER (PARTITION BY page_id) AS n
  FROM asked JOIN spans s ON asked.pattern = s.pattern AND s.rank > 1 AND fetched_on >= a AND (b IS NULL OR fetched_on < b))
SELECT c.page_id, c.host, c.fetched_on, coalesce(h.n, 0) AS n_active, h.pattern AS decided_by, coalesce(h.rank = 3, false) AS blocked
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.place = 1
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_packing": op7_packing,
    "op8_url_filters": op8_url_filters,
    "op9_hmm_scoring": op9_hmm_scoring,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hamming_join": op11_hamming_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op6_chat_formatting": OP6_SQL, "op8_url_filters": OP8_SQL, "op12_hard_negatives": OP12_SQL}
