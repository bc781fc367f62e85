"""Every operator as a query over the given tables, with its SQL counterpart.

Results are flat: lists are joined to text and maps written as ``key=value``.
Every query reads whole tables.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql as q
from checks.derived import derived_keys, derived_requests, derived_usage
from checks.folders import shared_folder
from checks.sample_logs import sample_logs
from faultlore import catalogue as cat
from faultlore.catalogue import BUILTIN_RULES
from faultlore.functions import metadata as md
from faultlore.functions import severity as sv
from faultlore.functions.text import trimmed, utf16_length
from faultlore.operators import explaining as ex
from faultlore.operators import incidents as inc
from faultlore.operators import matching as mt
from faultlore.operators import parsing as ps
from faultlore.operators import rule_tables
from faultlore.operators import usage as us
from faultlore.plans import jobs
from faultlore.sources import tables, usage_store
from faultlore.streaming import incident_store
from faultlore.streaming import operators as st
from faultlore.streaming.runs import partial_sessions, read_stream_table, run_available


class Check(NamedTuple):
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Check] = {}


def check(sql: str | None = None, name: str | None = None):
    def register(query):
        REGISTRY[name or query.__name__] = Check(query, sql)
        return query
    return register


# ── inputs ──────────────────────────────────────────────────────────


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs_of(spark, sf_dir) -> DataFrame:
    return sample_logs(table(spark, sf_dir, "events"))


def busy_logs(spark, sf_dir) -> DataFrame:
    """Log lines for the costly operators, on all cores: a line costs more to explain than to move."""
    return sample_logs(table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism))


def scanned(spark, sf_dir) -> DataFrame:
    """Lines with ``line``, ``timestamp`` and ``scan`` for the single-field queries."""
    return (busy_logs(spark, sf_dir)
            .withColumn("line", trimmed(F.col("raw_log")))
            .withColumn("timestamp", md.extract_timestamp(F.col("line")))
            .withColumn("scan", md.strip_timestamp(F.col("line"), F.col("timestamp"))))


def assessed_of(spark, sf_dir) -> DataFrame:
    return ex.assess_logs(busy_logs(spark, sf_dir))


def usage_of(spark, sf_dir) -> DataFrame:
    return derived_usage(table(spark, sf_dir, "events"))


def keys_of(spark, sf_dir) -> DataFrame:
    return derived_keys(table(spark, sf_dir, "events"))


def as_of() -> Column:
    return F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark) -> Callable[[DataFrame], DataFrame]:
    """Stores a table in the shared folder and reads it back."""
    def store(df: DataFrame) -> DataFrame:
        path = folder(spark, "stored")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def listed(column) -> Column:
    return F.array_join(column, " > ")


def written(map_column: str) -> Column:
    pairs = F.array_sort(F.map_entries(map_column))
    return F.array_join(F.transform(pairs, lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")


def stamp(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# ── sources and sinks ───────────────────────────────────────────────


@check(q.sql(q.LOGS, "SELECT log_id, seq, incident_id, raw_log, coalesce(source, '') AS source FROM logs"))
def read_raw_logs(spark, sf_dir):
    """Lines written to a Parquet table and read back through the reader."""
    path = folder(spark, "raw-logs")
    logs_of(spark, sf_dir).write.parquet(path)
    logs = tables.read_raw_logs(spark, path, fmt="parquet")
    return logs.select("log_id", "seq", "incident_id", "raw_log", F.coalesce("source", F.lit("")).alias("source"))


@check("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_log,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)
SELECT doc_id, seq::INT AS seq, length(raw_log) AS chars, coalesce(nullif(regexp_extract(raw_log,
    '\\b(\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})\\b', 1), ''), '') AS ip_address FROM lines""")
def read_raw_logs_lines(spark, sf_dir):
    """Documents as line-oriented logs, with the first address of each line."""
    lines = tables.split_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return lines.select("doc_id", "seq", F.length("raw_log").alias("chars"),
                        F.coalesce(md.extract_ip(F.col("raw_log")), F.lit("")).alias("ip_address"))


@check(q.sql(q.ASSESSED, """SELECT r.rank, r.rule_id, r.category, r.rule_severity AS severity, count(a.log_id) AS logs
FROM rules r LEFT JOIN assessed a ON a.rank = r.rank GROUP BY ALL"""))
def read_rules(spark, sf_dir):
    """The catalogue with the number of lines each rule explains."""
    won = ex.best_match(busy_logs(spark, sf_dir)).groupBy("rank").agg(F.count("*").alias("logs"))
    return (cat.read_rules(spark).join(won, "rank", "left")
            .select("rank", "rule_id", "category", "severity", F.coalesce("logs", F.lit(0)).alias("logs")))


@check(q.sql(q.ASSESSED, "SELECT log_id, rule_id, confidence FROM assessed WHERE rule_id = 'SYS_OOM'"))
def rule_by_id(spark, sf_dir):
    """Lines explained by one rule of the catalogue."""
    rule = cat.rule_by_id(cat.read_rules(spark), "SYS_OOM").select("rule_id")
    best = ex.best_match(busy_logs(spark, sf_dir)).withColumnRenamed("pattern_id", "rule_id")
    return best.join(F.broadcast(rule), "rule_id", "left_semi").select("log_id", "rule_id", "confidence")


@check(q.sql(q.ASSESSED, """SELECT (SELECT count(*) FROM rules) AS total_patterns,
  (SELECT string_agg(category, ' > ' ORDER BY first_rank) FROM (SELECT category, min(rank) AS first_rank FROM rules GROUP BY 1)) AS categories,
  count(DISTINCT rule_id) AS patterns_seen, count(rule_id) AS known_logs, count(*) AS logs FROM assessed"""))
def kb_stats(spark, sf_dir):
    """Size of the catalogue and how much of the logs it covers."""
    size = cat.kb_stats(cat.read_rules(spark)).withColumn("categories", listed("categories"))
    won = ex.best_match(busy_logs(spark, sf_dir)).groupBy("rank").agg(F.count("*").alias("n"))
    known = F.col("rank") > 0
    cover = won.agg(F.count_if(known).alias("patterns_seen"),
                    F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known_logs"), F.sum("n").alias("logs"))
    # one row each, laid on top of each other
    columns = [*size.columns, *cover.columns]
    return size.unionByName(cover, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in columns])


@check(q.sql(q.USAGE, "SELECT id, api_key_id, endpoint, status_code, response_time_ms, "
             "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM usage"))
def read_usage(spark, sf_dir):
    path = folder(spark, "usage")
    usage_of(spark, sf_dir).write.parquet(path)
    return tables.read_usage(spark, path).withColumn("created_at", stamp("created_at"))


KEYS_SQL = ("SELECT id, user_id, key_prefix, name, is_active, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, "
            "strftime(last_used_at, '%Y-%m-%d %H:%M:%S') AS last_used_at, "
            "coalesce(strftime(expires_at, '%Y-%m-%d %H:%M:%S'), '') AS expires_at FROM keys")


def keys_flat(keys: DataFrame) -> DataFrame:
    return keys.select("id", "user_id", "key_prefix", "name", "is_active", stamp("created_at").alias("created_at"),
                       stamp("last_used_at").alias("last_used_at"),
                       F.coalesce(stamp("expires_at"), F.lit("")).alias("expires_at"))


@check(q.sql(q.USAGE, KEYS_SQL))
def read_keys(spark, sf_dir):
    path = folder(spark, "keys")
    keys_of(spark, sf_dir).write.parquet(path)
    return keys_flat(tables.read_keys(spark, path))


@check(q.sql(q.USAGE, "SELECT endpoint, strftime(created_at, '%Y-%m-%d') AS day, 2 * count(*) AS requests FROM usage GROUP BY ALL"))
def append_usage(spark, sf_dir):
    """Facts appended twice, then counted from the table."""
    path = folder(spark, "appended")
    for _ in range(2):
        tables.append_usage(usage_of(spark, sf_dir), path)
    return (spark.read.parquet(path).groupBy("endpoint", F.date_format("day", "yyyy-MM-dd").alias("day"))
            .agg(F.count("*").alias("requests")))


EXPLAINED_FLAT = """SELECT log_id, raw_log, pattern_id, summary, category, severity, severity_score, root_cause,
  array_to_string(possible_causes, ' > ') AS possible_causes, array_to_string(recommended_fixes, ' > ') AS recommended_fixes,
  metadata, coalesce(timestamp, '') AS timestamp, coalesce(final_source, '') AS source, confidence, 'rule-based' AS engine
FROM explained"""


def metadata_text(column: str = "metadata") -> Column:
    """Present keys in the fixed order of the map."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def explained_flat(df: DataFrame) -> DataFrame:
    return df.select(
        "log_id", "raw_log", "pattern_id", "summary", "category", "severity", "severity_score", "root_cause",
        listed("possible_causes").alias("possible_causes"), listed("recommended_fixes").alias("recommended_fixes"),
        metadata_text().alias("metadata"), F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("source", F.lit("")).alias("source"), "confidence", "engine")


@check(q.sql(q.EXPLAINED, EXPLAINED_FLAT))
def write_explanations(spark, sf_dir):
    path = folder(spark, "explanations")
    explained = ex.explain_logs(busy_logs(spark, sf_dir))
    tables.write_explanations(explained, path, fmt="json")
    return explained_flat(spark.read.schema(explained.schema).json(path))


# ── filters ─────────────────────────────────────────────────────────


@check("SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE text <> ''")
def reject_empty_logs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("text", "raw_log")
    return ps.reject_empty_logs(rows).select("conv_id", "turn", F.length("raw_log").alias("chars"))


def _rule(rule_id: str):
    return next(r for r in BUILTIN_RULES if r.rule_id == rule_id)


@check(q.sql(q.LOGS, "SELECT log_id FROM logs WHERE " + " OR ".join(
    f"regexp_matches(raw_log, {q.q(rx)}, 'i')" for rx in _rule("SYS_PROCESS_CRASH").patterns)))
def rule_regex_predicate(spark, sf_dir):
    return busy_logs(spark, sf_dir).filter(mt.rule_regex_predicate(_rule("SYS_PROCESS_CRASH"))).select("log_id")


def _keyword_sql() -> str:
    index: dict[str, list[str]] = {}
    for r in BUILTIN_RULES:
        for k in r.keywords:
            index.setdefault(k.lower(), []).append(r.rule_id)
    rows = [(f"{i * 100 + j}", k, rid) for i, (k, ids) in enumerate(index.items()) for j, rid in enumerate(ids)]
    values = ", ".join(f"({at}, {q.q(k)}, {q.q(rid)})" for at, k, rid in rows)
    return q.sql(q.LOGS, f"""SELECT log_id, rule_id, row_number() OVER (PARTITION BY log_id ORDER BY first_at)::INT AS place FROM (
      SELECT log_id, rule_id, min(nth) AS first_at FROM logs JOIN (VALUES {values}) k(nth, keyword, rule_id)
      ON contains(lower(raw_log), keyword) GROUP BY ALL)""")


@check(_keyword_sql())
def keyword_candidates(spark, sf_dir):
    return mt.keyword_candidates(busy_logs(spark, sf_dir).select("log_id", "raw_log")).select("log_id", "rule_id", "place")


@check(q.sql(q.USAGE, "SELECT id, user_id FROM keys WHERE is_active AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-31')"))
def active_key_filter(spark, sf_dir):
    return us.active_key_filter(keys_of(spark, sf_dir), as_of()).select("id", "user_id")


@check(q.sql(q.USAGE, "SELECT id, api_key_id FROM usage WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS"))
def usage_recent_filter(spark, sf_dir):
    return us.usage_recent_filter(usage_of(spark, sf_dir), as_of(), 7).select("id", "api_key_id")


@check(q.sql(q.USAGE, "SELECT count(*) AS requests, 30 AS days FROM usage WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS"))
def days_limit(spark, sf_dir):
    days = us.days_limit("soon")
    return us.usage_recent_filter(usage_of(spark, sf_dir), as_of(), days).agg(
        F.count("*").alias("requests")).withColumn("days", F.lit(days))


@check(q.sql(q.ASSESSED, "SELECT log_id, pattern_id FROM assessed WHERE rank IS NOT NULL"))
def known_only(spark, sf_dir):
    return ex.known_only(ex.explain_logs(busy_logs(spark, sf_dir))).select("log_id", "pattern_id")


@check(q.sql(q.USAGE, "SELECT id, status_code, status_code >= 200 AND status_code < 400 AS successful FROM usage"))
def status_class(spark, sf_dir):
    return usage_of(spark, sf_dir).select("id", "status_code", us.status_class(F.col("status_code")).alias("successful"))


# ── metadata ────────────────────────────────────────────────────────


def _field(name: str, sql_expr: str, column: Callable[[], Column]):
    def query(spark, sf_dir):
        df = scanned(spark, sf_dir).withColumn("ip_address", md.extract_ip(F.col("scan")))
        return df.select("log_id", F.coalesce(column(), F.lit("")).alias("value"))
    REGISTRY[name] = Check(query, q.sql(
        q.SCANNED, f"SELECT log_id, coalesce({sql_expr}, '') AS value FROM addressed"))


def _of_scan(extract: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: extract(F.col("scan"))


def register_fields() -> None:
    _field("extract_timestamp", "stamp", lambda: F.col("timestamp"))
    _field("strip_timestamp", "scan", lambda: F.col("scan"))
    _field("extract_ip", "ip_address", lambda: F.col("ip_address"))
    for name, field, column in (
            ("extract_log_level", "log_level", _of_scan(md.extract_log_level)),
            ("extract_pid", "pid", _of_scan(md.extract_pid)),
            ("extract_port", "port", lambda: md.extract_port(F.col("scan"), F.col("ip_address"))),
            ("extract_error_code", "error_code", _of_scan(md.extract_error_code)),
            ("extract_http_status", "http_status", _of_scan(md.extract_http_status)),
            ("extract_http_method", "http_method", _of_scan(md.extract_http_method)),
            ("extract_url", "url", _of_scan(md.extract_url)),
            ("extract_username", "username", _of_scan(md.extract_username)),
            ("extract_file_path", "file_path", _of_scan(md.extract_file_path)),
            ("extract_source", "extracted_source", _of_scan(md.extract_source)),
            ("message_body", "message_body", lambda: md.message_body(F.col("line"), F.col("timestamp")))):
        _field(name, q.FIELDS[field], column)
    _field("override_source", f"coalesce(nullif(source, ''), {q.FIELDS['extracted_source']})",
           lambda: md.override_source(md.extract_source(F.col("scan")), F.col("source")))


URL_SQL = q.FIELDS["url"].replace("scan", "url")


@check(f"SELECT page_id, coalesce({URL_SQL}, '') AS url FROM pages")
def extract_url_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.coalesce(md.extract_url(F.col("url")), F.lit("")).alias("url"))


@check(q.sql(q.PARSED, "SELECT log_id, " + ", ".join(
    f"coalesce({c}, '') AS {c}" for c in ps.METADATA_COLUMNS) + " FROM parsed"))
def parse_log_line(spark, sf_dir):
    return ps.parse_log_line(busy_logs(spark, sf_dir)).select(
        "log_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ps.METADATA_COLUMNS])


@check("""SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_log, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS seq
FROM documents""")
def explode_batch(spark, sf_dir):
    """Documents as batches of lines."""
    batches = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("logs"))
    return tables.explode_batch(batches, "logs", "doc_id")


@check(q.sql(q.EXPLAINED, "SELECT log_id, metadata FROM explained"))
def metadata_map(spark, sf_dir):
    df = ex.best_match(ps.parse_log_line(busy_logs(spark, sf_dir)))
    return df.withColumn("metadata", ps.metadata_map(F.col("rank") > 0)).select(
        "log_id", metadata_text().alias("metadata"))


@check(q.sql(q.PARSED, f"SELECT log_id, coalesce({q.SEVERITY_OF_LEVEL}, '') AS value FROM parsed"))
def level_to_severity(spark, sf_dir):
    return ps.parse_log_line(busy_logs(spark, sf_dir)).select(
        "log_id", F.coalesce(sv.level_to_severity(F.col("log_level")), F.lit("")).alias("value"))


@check(q.sql(q.PARSED, f"SELECT log_id, {q.DEFAULT_SEVERITY} AS value FROM parsed"))
def level_to_severity_default(spark, sf_dir):
    return ps.parse_log_line(busy_logs(spark, sf_dir)).select(
        "log_id", sv.level_to_severity_default(F.col("log_level")).alias("value"))


# ── matching ────────────────────────────────────────────────────────


def ranked_of(spark, sf_dir) -> DataFrame:
    return mt.rank_candidates(busy_logs(spark, sf_dir).select("log_id", "raw_log"))


def _stage(name: str, column: str, stage: Callable[[Column, Column, Column, Column], Column]):
    """One step of the confidence formula for every matching rule of every line."""
    def query(spark, sf_dir):
        value = stage(F.col("match_length").cast("double"), utf16_length(F.col("raw_log")),
                      F.col("keyword_hits"), F.col("code_hit"))
        return ranked_of(spark, sf_dir).select("log_id", "rule_id", value.alias("value"))
    REGISTRY[name] = Check(query, q.sql(
        q.LOGS + ",\n" + q.HITS, f"SELECT log_id, rule_id, {column} AS value FROM scored"))


def register_stages() -> None:
    def by_regex(length, line, kw, code):
        return mt.regex_confidence(length, line)

    def by_keyword(length, line, kw, code):
        return mt.keyword_boost(mt.regex_confidence(length, line), kw)

    def by_code(length, line, kw, code):
        return mt.error_code_boost(by_keyword(length, line, kw, code), code)

    _stage("regex_confidence", "by_regex", by_regex)
    _stage("keyword_boost", "by_keyword", by_keyword)
    _stage("error_code_boost", "by_code", by_code)
    _stage("confidence_round", "confidence", lambda *a: mt.confidence_round(by_code(*a)))


@check(q.sql(q.LOGS + ",\n" + q.HITS, """SELECT log_id, rule_id, rank, match_length::INT AS match_length,
  keyword_hits::INT AS keyword_hits, code_hit FROM hits"""))
def match_rules(spark, sf_dir):
    """Every line with every rule that matches it."""
    return ranked_of(spark, sf_dir).select("log_id", "rule_id", "rank", "match_length", "keyword_hits", "code_hit")


@check(q.sql(q.LOGS + ",\n" + q.HITS, "SELECT log_id, rule_id, confidence, place::INT AS place FROM ranked"))
def rank_candidates(spark, sf_dir):
    return ranked_of(spark, sf_dir).select("log_id", "rule_id", "confidence", "place")


@check(q.sql(q.LOGS + ",\n" + q.HITS, """SELECT h.log_id, h.rule_id, h.rank, r.confidence, r.place::INT AS place, h.match_length::INT AS match_length,
  h.keyword_hits::INT AS keyword_hits, h.code_hit FROM hits h JOIN ranked r USING (log_id, rule_id)"""))
def match_rule_table(spark, sf_dir):
    """The same from rules that are a table, through the index of their literals."""
    index = rule_tables.rule_index(cat.read_rules(spark), stored(spark))
    return rule_tables.match_rule_table(busy_logs(spark, sf_dir).select("log_id", "raw_log"), index)


@check(q.sql(q.ASSESSED, "SELECT log_id, pattern_id, category, confidence FROM assessed"))
def best_match(spark, sf_dir):
    return ex.best_match(busy_logs(spark, sf_dir)).select("log_id", "pattern_id", "category", "confidence")


@check(q.sql(q.EXPLAINED, """SELECT log_id, pattern_id, summary, root_cause, array_to_string(possible_causes, ' > ') AS possible_causes,
  array_to_string(recommended_fixes, ' > ') AS recommended_fixes FROM explained"""))
def attach_explanation(spark, sf_dir):
    return ex.attach_explanation(ex.best_match(ps.parse_log_line(busy_logs(spark, sf_dir)))).select(
        "log_id", "pattern_id", "summary", "root_cause", listed("possible_causes").alias("possible_causes"),
        listed("recommended_fixes").alias("recommended_fixes"))


# ── severity ────────────────────────────────────────────────────────


def steps_of(spark, sf_dir) -> DataFrame:
    """Lines a rule explains, with the steps of their score."""
    matched = ex.best_match(ps.parse_log_line(busy_logs(spark, sf_dir)))
    return ex.severity_steps(matched).filter(F.col("rank") > 0)


def _score(name: str, sql_expr: str, value: Callable[[], Column]):
    def query(spark, sf_dir):
        return steps_of(spark, sf_dir).select("log_id", value().cast("int").alias("value"))
    REGISTRY[name] = Check(query, q.sql(
        q.ASSESSED, f"SELECT log_id, ({sql_expr})::INT AS value FROM assessed WHERE rank IS NOT NULL"))


def register_scores() -> None:
    _score("base_score", "base", lambda: F.col("rule_score"))
    _score("level_blend", "blended", lambda: F.col("blended"))
    _score("context_boost", "in_context", lambda: F.col("in_context"))
    _score("repetition_boost", "repeated", lambda: F.col("repeated"))
    _score("severity_clamp", "severity_score", lambda: sv.severity_clamp(F.col("repeated")))


@check(q.sql(q.ASSESSED, "SELECT log_id, modified::INT AS score, modifier_reason AS reason FROM assessed WHERE rank IS NOT NULL"))
def apply_modifiers(spark, sf_dir):
    return steps_of(spark, sf_dir).select(
        "log_id", F.col("modified").alias("score"), F.coalesce("modifier.reason", F.lit("")).alias("reason"))


@check(q.sql(q.PARSED, f"SELECT log_id, ({q.score_of(q.DEFAULT_SEVERITY)})::INT AS value FROM parsed"))
def unknown_score(spark, sf_dir):
    return ps.parse_log_line(busy_logs(spark, sf_dir)).select(
        "log_id", sv.unknown_score(F.col("log_level")).alias("value"))


@check(f"SELECT event_id, {q.level_of('value')} AS severity FROM events")
def score_to_level(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sv.score_to_level(F.col("value")).alias("severity"))


@check(q.sql(q.ASSESSED, "SELECT log_id, severity_reason FROM assessed"))
def severity_reason(spark, sf_dir):
    return assessed_of(spark, sf_dir).select("log_id", "severity_reason")


@check(q.sql(q.ASSESSED, "SELECT log_id, pattern_id, severity, severity_score FROM assessed"))
def calculate_severity(spark, sf_dir):
    return assessed_of(spark, sf_dir).select("log_id", "pattern_id", "severity", "severity_score")


@check(q.sql(q.EXPLAINED, EXPLAINED_FLAT + " WHERE rank IS NULL"))
def unknown_explanation(spark, sf_dir):
    explained = ex.explain_logs(busy_logs(spark, sf_dir))
    return explained_flat(explained.filter(F.col("pattern_id") == ex.UNKNOWN))


@check(q.sql(q.EXPLAINED, EXPLAINED_FLAT))
def explain_logs(spark, sf_dir):
    return explained_flat(ex.explain_logs(busy_logs(spark, sf_dir)))


@check(q.sql(q.EXPLAINED, EXPLAINED_FLAT))
def job_explain_table(spark, sf_dir):
    return explained_flat(jobs.explain_table(busy_logs(spark, sf_dir), folder(spark, "explain-table")))


# ── incidents ───────────────────────────────────────────────────────


@check(q.sql(q.INCIDENTS, """SELECT incident_id, severity, severity_score, 'Aggregate of ' || total_logs || ' logs. Max score: ' || max_score
  || '. High-severity count: ' || high_scores || '. Critical count: ' || critical_scores || '.' AS severity_reason FROM incidents_seen"""))
def aggregate_severity(spark, sf_dir):
    return inc.aggregate_severity(assessed_of(spark, sf_dir), "incident_id").select(
        "incident_id", "severity", "severity_score", "severity_reason")


@check(q.sql(q.INCIDENTS, "SELECT incident_id, category, logs, first_seq FROM breakdown"))
def category_breakdown(spark, sf_dir):
    return inc.category_breakdown(assessed_of(spark, sf_dir), "incident_id")


@check(q.sql(q.INCIDENTS, "SELECT incident_id, critical_logs, high_logs FROM incidents_seen"))
def severity_counts(spark, sf_dir):
    return assessed_of(spark, sf_dir).groupBy("incident_id").agg(*inc.severity_counts()).select(
        "incident_id", "critical_logs", "high_logs")


@check(q.sql(q.INCIDENTS, "SELECT incident_id, patterns FROM incidents_seen"))
def distinct_patterns(spark, sf_dir):
    facts = inc.incident_facts(busy_logs(spark, sf_dir))
    return facts.select("incident_id", F.size("known").cast("bigint").alias("patterns"))


@check(q.sql(q.LOGS, "SELECT incident_id, count(*) AS total_logs FROM logs GROUP BY ALL"))
def total_logs(spark, sf_dir):
    return inc.incident_facts(busy_logs(spark, sf_dir)).select("incident_id", "total_logs")


INCIDENT_FIELDS = {
    "affected_systems": ("coalesce(affected_systems, '')", lambda: F.array_join("affected_systems", ",")),
    "root_cause_chain": ("root_cause_chain", lambda: listed("root_cause_chain")),
    "recommended_actions": ("recommended_actions", lambda: listed("recommended_actions")),
    "incident_title": ("title", lambda: F.col("title")),
    "incident_summary_text": ("summary", lambda: F.col("summary")),
    "detect_correlations": ("correlations", lambda: F.array_join("correlations", "; ")),
}


def _incident_field(name: str, expr: str, column: Callable[[], Column]):
    def query(spark, sf_dir):
        return inc.incident_summary(busy_logs(spark, sf_dir)).select("incident_id", column().alias("value"))
    REGISTRY[name] = Check(query, q.sql(q.INCIDENTS, f"SELECT incident_id, {expr} AS value FROM incidents_seen"))


CORRELATION_NAMES = ("corr_db_timeout", "corr_memory_process", "corr_auth_security", "corr_dns_network",
                     "corr_disk_database", "corr_config_application")


def _correlation(name: str, correlation: inc.Correlation, condition: str):
    def query(spark, sf_dir):
        summary = inc.incident_summary(busy_logs(spark, sf_dir), correlations=[correlation])
        return summary.select("incident_id", (F.size("correlations") == 1).alias("holds"))
    REGISTRY[name] = Check(query, q.sql(
        q.INCIDENTS, f"SELECT incident_id, coalesce({condition}, false) AS holds FROM i1"))


@check(q.sql(q.INCIDENTS, """SELECT incident_id, nth::INT AS nth, fix FROM fixes_placed WHERE nth <= 10"""))
def top_fixes(spark, sf_dir):
    return inc.incident_summary(busy_logs(spark, sf_dir)).select(
        "incident_id", F.posexplode("recommended_actions").alias("nth", "fix")).withColumn("nth", F.col("nth") + 1)


@check(q.sql(q.INCIDENTS, "SELECT incident_id, top_category FROM tops"))
def top_category(spark, sf_dir):
    """Highest count of lines, ties by first seen."""
    return inc.incident_facts(busy_logs(spark, sf_dir)).select("incident_id", "top_category")


@check(q.sql(q.INCIDENTS, """SELECT category, array_to_string(list_transform(string_split(category, '_'),
  lambda w: upper(w[1]) || w[2:]), ' ') AS label, sum(logs)::BIGINT AS logs FROM breakdown GROUP BY ALL"""))
def category_label(spark, sf_dir):
    return assessed_of(spark, sf_dir).groupBy("category").agg(F.count("*").alias("logs")).withColumn(
        "label", inc.category_label(F.col("category")))


# Every incident on record: those with lines and, per user, one without any.
ON_RECORD_SQL = """on_record AS (SELECT DISTINCT 'INC-' || user_id || '-' || strftime(ts, '%d') AS incident_id,
    CASE WHEN user_id % 3 = 0 THEN 'reported by user ' || user_id WHEN user_id % 3 = 1 THEN '' END AS context FROM events
  UNION ALL SELECT DISTINCT 'INC-' || user_id || '-none', CASE WHEN user_id % 2 = 0 THEN 'no lines' END FROM events)"""


def on_record(spark, sf_dir) -> DataFrame:
    uid = F.col("user_id")
    users = table(spark, sf_dir, "events")
    with_lines = users.select(
        F.concat(F.lit("INC-"), uid.cast("string"), F.lit("-"), F.date_format("ts", "dd")).alias("incident_id"),
        F.when(uid % 3 == 0, F.concat(F.lit("reported by user "), uid.cast("string")))
        .when(uid % 3 == 1, F.lit("")).alias("context")).distinct()
    without = users.select(
        F.concat(F.lit("INC-"), uid.cast("string"), F.lit("-none")).alias("incident_id"),
        F.when(uid % 2 == 0, F.lit("no lines")).alias("context")).distinct()
    return with_lines.unionByName(without)


RECORDED = q.INCIDENTS + ",\n" + ON_RECORD_SQL + """,
recorded AS (SELECT o.incident_id, coalesce(i.title, 'No Logs Provided') || CASE WHEN o.context <> '' THEN ' — ' || o.context ELSE '' END AS title,
    coalesce(i.summary, 'No log entries were provided for incident analysis.') AS summary,
    coalesce(i.severity, 'LOW') AS severity, coalesce(i.severity_score, 0) AS severity_score,
    coalesce(i.root_cause_chain, '') AS root_cause_chain, coalesce(i.affected_systems, '') AS affected_systems,
    coalesce(i.recommended_actions, '') AS recommended_actions, coalesce(i.total_logs, 0) AS total_logs_analyzed,
    coalesce(i.category_breakdown, '') AS category_breakdown, coalesce(i.correlations, '') AS correlations
  FROM on_record o LEFT JOIN incidents_seen i USING (incident_id))"""


def recorded(spark, sf_dir) -> DataFrame:
    return summary_flat(inc.incident_summary(busy_logs(spark, sf_dir), on_record(spark, sf_dir)))


def summary_flat(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        "incident_id", "title", "summary", "severity", "severity_score",
        listed("root_cause_chain").alias("root_cause_chain"),
        F.array_join("affected_systems", ",").alias("affected_systems"),
        listed("recommended_actions").alias("recommended_actions"), "total_logs_analyzed",
        written("category_breakdown").alias("category_breakdown"),
        F.array_join("correlations", "; ").alias("correlations"))


@check(q.sql(RECORDED, "SELECT * FROM recorded"))
def incident_summary(spark, sf_dir):
    return recorded(spark, sf_dir)


@check(q.sql(RECORDED, "SELECT incident_id, title FROM recorded"))
def append_context(spark, sf_dir):
    return recorded(spark, sf_dir).select("incident_id", "title")


@check(q.sql(RECORDED, "SELECT * FROM recorded WHERE total_logs_analyzed = 0"))
def empty_incident(spark, sf_dir):
    return recorded(spark, sf_dir).filter(F.col("total_logs_analyzed") == 0)


TIMELINE_SQL = """timeline AS (SELECT incident_id, seq, coalesce(timestamp, '') AS timestamp, substr(summary, 1, 150) AS summary, severity, category,
  row_number() OVER (PARTITION BY incident_id ORDER BY timestamp IS NULL, timestamp, seq) AS position FROM explained)"""


@check(q.sql(q.EXPLAINED + ",\n" + TIMELINE_SQL, "SELECT * FROM timeline"))
def incident_timeline(spark, sf_dir):
    return inc.incident_timeline(busy_logs(spark, sf_dir)).withColumn("timestamp", F.coalesce("timestamp", F.lit("")))


@check(q.sql(q.EXPLAINED + ",\n" + TIMELINE_SQL, """SELECT incident_id, ((position - 1) // 2)::BIGINT AS page,
  string_agg(position::VARCHAR || '|' || timestamp || '|' || category, ';' ORDER BY position) AS entries
FROM timeline GROUP BY 1, 2"""))
def incident_timeline_pages(spark, sf_dir):
    """Pages of two lines, so that most incidents have several."""
    pages = inc.incident_timeline_pages(inc.incident_timeline(busy_logs(spark, sf_dir)), page_size=2)
    entries = F.transform("timeline", lambda e: F.concat_ws(
        "|", e["position"].cast("string"), F.coalesce(e["timestamp"], F.lit("")), e["category"]))
    return pages.select("incident_id", "page", F.array_join(entries, ";").alias("entries"))


@check("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_log,
    generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
kept AS (SELECT * FROM lines)
SELECT row_number() OVER (ORDER BY doc_id, line) - 1 AS log_id, row_number() OVER (ORDER BY doc_id, line) - 1 AS seq, raw_log,
    'docs' AS source FROM kept""")
def read_raw_logs_text(spark, sf_dir):
    """Lines of documents as text files in order of ids, read back with ids in file order."""
    path = folder(spark, "raw-text")
    lines = tables.split_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    (lines.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id", "seq").select("raw_log").write.text(path))
    return tables.read_raw_logs(spark, path, source="docs", line_sep="\n")


# ── usage ───────────────────────────────────────────────────────────


@check(q.sql(q.USAGE, "SELECT u.id, u.api_key_id FROM usage u WHERE u.api_key_id IN (SELECT id FROM keys WHERE user_id = 7)"))
def usage_for_user(spark, sf_dir):
    return us.usage_for_user(usage_of(spark, sf_dir), keys_of(spark, sf_dir), 7).select("id", "api_key_id")


@check(q.sql(q.USAGE, """SELECT event_id AS request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS requested_at,
  coalesce(good, false) AS authorized, CASE WHEN good THEN id END AS api_key_id, CASE WHEN good THEN user_id END AS user_id
FROM (SELECT e.event_id, e.ts, k.id, k.user_id, k.is_active AND (k.expires_at IS NULL OR k.expires_at >= e.ts) AS good
  FROM events e LEFT JOIN keys k ON k.key_hash = sha256(CASE WHEN event_id % 13 = 0 THEN 'key-none' ELSE 'key-' || e.user_id END))"""))
def attribute_requests(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return us.attribute_requests(derived_requests(events), derived_keys(events), F.col("requested_at")).withColumn(
        "requested_at", stamp("requested_at"))


@check(q.sql(q.USAGE, "SELECT api_key_id, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_used_at FROM usage GROUP BY 1"))
def last_used_per_key(spark, sf_dir):
    return us.last_used_per_key(usage_of(spark, sf_dir)).withColumn("last_used_at", stamp("last_used_at"))


def rollup_of(spark, sf_dir) -> DataFrame:
    return us.usage_rollup(us.usage_recent_filter(usage_of(spark, sf_dir), as_of()), keys_of(spark, sf_dir))


TOTALS_SQL = """SELECT user_id, count(*) AS total_requests, count(*) FILTER (status_code BETWEEN 200 AND 399) AS successful_requests,
  count(*) - count(*) FILTER (status_code BETWEEN 200 AND 399) AS failed_requests,
  floor(sum(coalesce(response_time_ms, 0))::DOUBLE / count(*) + 0.5)::BIGINT AS avg_response_time_ms FROM owned GROUP BY 1"""


@check(q.sql(q.USAGE, TOTALS_SQL))
def usage_totals(spark, sf_dir):
    return us.usage_totals(rollup_of(spark, sf_dir))


@check(q.sql(q.USAGE, "SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS requests FROM owned GROUP BY ALL"))
def usage_by_day(spark, sf_dir):
    return us.usage_by_day(rollup_of(spark, sf_dir))


@check(q.sql(q.USAGE, """SELECT user_id, endpoint, count(*) AS requests, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_used
FROM owned GROUP BY 1, 2"""))
def usage_by_endpoint(spark, sf_dir):
    return us.usage_by_endpoint(rollup_of(spark, sf_dir)).withColumn("last_used", stamp("last_used"))


@check(q.sql(q.USAGE + f""",
totals AS ({TOTALS_SQL}),
days AS (SELECT user_id, strftime(created_at, '%Y-%m-%d') AS item, count(*) AS value FROM owned GROUP BY ALL),
ends AS (SELECT user_id, endpoint AS item, count(*) AS value, max(created_at) AS used FROM owned GROUP BY 1, 2)""",
"""SELECT user_id, part, 1 AS position, '' AS item, value FROM totals UNPIVOT (value FOR part IN (
  total_requests, successful_requests, failed_requests, avg_response_time_ms))
UNION ALL SELECT user_id, 'requests_by_day', row_number() OVER (PARTITION BY user_id ORDER BY item)::INT, item, value FROM days
UNION ALL SELECT user_id, 'requests_by_endpoint', row_number() OVER (PARTITION BY user_id ORDER BY value DESC, used DESC, item)::INT, item, value FROM ends"""))
def usage_stats(spark, sf_dir):
    return us.usage_stats(usage_of(spark, sf_dir), keys_of(spark, sf_dir), as_of()).withColumn(
        "item", F.coalesce("item", F.lit("")))


@check(q.sql(q.USAGE, "SELECT user_id, count(*) AS keys, count(*) >= 10 AS at_limit FROM keys GROUP BY 1"))
def keys_per_user(spark, sf_dir):
    return us.keys_per_user(keys_of(spark, sf_dir))


@check(q.sql(q.USAGE, KEYS_SQL))
def keys_by_created(spark, sf_dir):
    return keys_flat(us.keys_by_created(keys_of(spark, sf_dir)))


@check("""SELECT event_type AS client, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests
FROM events GROUP BY ALL HAVING count(*) > 3""")
def rate_limit_breaches(spark, sf_dir):
    """Event types as clients, with an hourly limit the test data can break."""
    requests = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("client"), F.col("ts").alias("created_at"))
    return us.rate_limit_breaches(requests, limit=3, window="1 hour", aligned=True).withColumn("window_start", stamp("window_start"))


# Requests packed so closely that clients break the default limit of 60 in 60 seconds; one client has half of all.
DENSE_SQL = """requests AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'busy' WHEN event_id % 4 = 1 THEN event_type ELSE 'user-' || user_id % 40 END AS client,
  make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // (64000000 // (SELECT count(*) FROM events))) AS t FROM events)"""


def dense_requests(spark, sf_dir, events: DataFrame | None = None) -> DataFrame:
    closer = 64_000_000 // table(spark, sf_dir, "events").count()
    events = table(spark, sf_dir, "events") if events is None else events
    start = F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    at = F.timestamp_micros(start + F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")) - start, F.lit(closer)))
    user = F.concat(F.lit("user-"), (F.col("user_id") % 40).cast("string"))
    client = F.when(F.col("event_id") % 2 == 0, F.lit("busy")).when(F.col("event_id") % 4 == 1, F.col("event_type")).otherwise(user)
    return events.select(client.alias("client"), at.alias("created_at"))


THROTTLE_SQL = "WITH RECURSIVE " + DENSE_SQL + """,
opened AS (SELECT client, min(t) AS start FROM requests GROUP BY client
  UNION ALL SELECT o.client, (SELECT min(t) FROM requests r WHERE r.client = o.client AND r.t >= o.start + INTERVAL 60 SECONDS) AS start
  FROM opened o WHERE o.start IS NOT NULL)
SELECT o.client, strftime(o.start, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS requests
FROM opened o JOIN requests r ON r.client = o.client AND r.t >= o.start AND r.t < o.start + INTERVAL 60 SECONDS GROUP BY ALL"""


def micros(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@check(THROTTLE_SQL)
def throttle_windows(spark, sf_dir):
    return us.throttle_windows(dense_requests(spark, sf_dir), store=stored(spark)).withColumn("window_start", micros("window_start"))


@check(THROTTLE_SQL + " HAVING count(*) > 60")
def rate_limit_default(spark, sf_dir):
    """The default limit, 60 in the 60 seconds that a client's first request opens."""
    breaches = us.rate_limit_breaches(dense_requests(spark, sf_dir), store=stored(spark))
    return breaches.withColumn("window_start", micros("window_start"))


# ── streams ─────────────────────────────────────────────────────────


def stream_logs(spark, sf_dir) -> DataFrame:
    events = read_stream_table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
    return sample_logs(events.withColumn("event_time", F.col("ts").cast("timestamp")), "event_time")


@check(q.sql(q.EXPLAINED, EXPLAINED_FLAT))
def stream_explain(spark, sf_dir):
    explained = st.stream_explain(stream_logs(spark, sf_dir))
    return explained_flat(run_available(explained, folder(spark, "explained")))


# Append mode emits the windows that end by the watermark.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"
WINDOW_COUNTS = ", ".join([
    "count(*) AS total_logs", "max(severity_score) AS max_score", "count(*) FILTER (severity_score >= 55) AS hi",
    "count(*) FILTER (severity_score >= 80) AS cr", "count(*) FILTER (severity = 'CRITICAL') AS critical_logs",
    "count(*) FILTER (severity = 'HIGH') AS high_logs",
    "list(category) AS cats"])


def _window_sql(ctes: str, group: str) -> str:
    total = ("least(least(least(max_score + CASE WHEN hi >= 3 THEN 5 ELSE 0 END, 100) + CASE WHEN hi >= 5 THEN 5 ELSE 0 END, 100)"
             " + CASE WHEN cr >= 2 THEN 10 ELSE 0 END, 100)")
    return q.sql(q.EXPLAINED + ", timed AS (SELECT x.*, ts, coalesce(final_source, '') AS src FROM explained x JOIN events e ON e.event_id = x.log_id)" + ctes, f"""
SELECT source, window_start, window_end, total_logs, {q.level_of("severity_score")} AS severity, severity_score, critical_logs, high_logs, category_breakdown
FROM (SELECT src AS source, strftime(w_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w_end, '%Y-%m-%d %H:%M:%S') AS window_end,
  total_logs, {total} AS severity_score, critical_logs, high_logs,
  array_to_string(list_transform(list_sort(list_distinct(cats)), lambda c: c || '=' || len(list_filter(cats, lambda d: d = c))), ',') AS category_breakdown
FROM ({group}) WHERE w_end <= {CLOSED})""")


def windows_flat(df: DataFrame) -> DataFrame:
    return df.select(
        "source", stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "total_logs",
        "severity", "severity_score", "critical_logs", "high_logs", written("category_breakdown").alias("category_breakdown"))


@check(_window_sql("", f"""SELECT src, time_bucket(INTERVAL 1 HOUR, ts) AS w_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS w_end,
  {WINDOW_COUNTS} FROM timed GROUP BY ALL"""))
def stream_incident_windows(spark, sf_dir):
    return windows_flat(run_available(st.stream_incident_windows(stream_logs(spark, sf_dir)), folder(spark, "windows")))


SESSIONS_SQL = """, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY src ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM timed),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM gaps)"""


@check(_window_sql(SESSIONS_SQL, f"""SELECT src, min(ts) AS w_start, max(ts) + INTERVAL 30 MINUTES AS w_end, {WINDOW_COUNTS}
  FROM numbered GROUP BY src, session"""))
def stream_incident_sessions(spark, sf_dir):
    with partial_sessions(spark):
        return windows_flat(run_available(st.stream_incident_sessions(stream_logs(spark, sf_dir)), folder(spark, "sessions")))


@check(_window_sql(SESSIONS_SQL, f"""SELECT src, min(ts) AS w_start, max(ts) + INTERVAL 30 MINUTES AS w_end, {WINDOW_COUNTS}
  FROM numbered GROUP BY src, session""").replace(f"WHERE w_end <= {CLOSED}", ""))
def incident_sessions(spark, sf_dir):
    """The sessions of a table, sources cut into many ranges of time."""
    events = table(spark, sf_dir, "events").repartition(spark.sparkContext.defaultParallelism)
    logs = sample_logs(events.withColumn("event_time", F.col("ts").cast("timestamp")), "event_time")
    return windows_flat(st.stream_incident_sessions(logs, late=None, slices=40))


@check("""SELECT endpoint, window_start, count(*) AS total_requests, count(*) FILTER (endpoint <> 'error') AS successful_requests,
  count(*) FILTER (endpoint = 'error') AS failed_requests, floor(sum(ms)::DOUBLE / count(*) + 0.5)::BIGINT AS avg_response_time_ms
FROM (SELECT event_type AS endpoint, strftime(time_bucket(INTERVAL 1 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    CASE WHEN event_id % 11 <> 0 THEN floor(value)::BIGINT ELSE 0 END AS ms FROM events
  WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= """ + CLOSED + ") GROUP BY ALL")
def stream_usage_by_minute(spark, sf_dir):
    events = read_stream_table(spark, sf_dir, "events")
    usage = derived_usage(events).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return run_available(st.stream_usage_by_minute(usage), folder(spark, "usage")).withColumn("window_start", stamp("window_start"))


@check("""SELECT event_type AS client, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests
FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= """ + CLOSED + " GROUP BY ALL HAVING count(*) > 3")
def stream_rate_limit_breaches(spark, sf_dir):
    requests = read_stream_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("client"), F.col("ts").cast("timestamp").alias("created_at"))
    return run_available(st.stream_rate_limit_breaches(requests, limit=3, window="1 hour"), folder(spark, "breaches")).withColumn(
        "window_start", stamp("window_start"))


@check(q.sql(RECORDED, """SELECT incident_id, title, summary, severity, severity_score, root_cause_chain, affected_systems, recommended_actions,
  total_logs_analyzed, category_breakdown, correlations FROM recorded"""))
def job_incident_report(spark, sf_dir):
    """The summaries of the whole job, incidents without lines included."""
    summary, _ = jobs.incident_report(busy_logs(spark, sf_dir), folder(spark, "report"), on_record(spark, sf_dir))
    return summary_flat(summary)


@check(q.sql(q.EXPLAINED + ",\n" + TIMELINE_SQL, "SELECT * FROM timeline"))
def job_incident_timeline(spark, sf_dir):
    """The time line of the whole job, from the table of assessed lines."""
    _, timeline = jobs.incident_report(busy_logs(spark, sf_dir), folder(spark, "report"))
    return timeline.withColumn("timestamp", F.coalesce("timestamp", F.lit("")))


@check(REGISTRY["usage_stats"].sql)
def job_usage_report(spark, sf_dir):
    """The usage report of the whole job."""
    report = jobs.usage_report(usage_of(spark, sf_dir), keys_of(spark, sf_dir), folder(spark, "usage-report"), as_of())
    return report.withColumn("item", F.coalesce("item", F.lit("")))


# Lines of one month around New Year, most of them without a year in their stamps.
@check("""SELECT event_id AS log_id, strftime(ts - INTERVAL 15 DAYS, '%Y-%m-%d %H:%M:%S') AS event_time FROM events""")
def event_time(spark, sf_dir):
    """Five hosts, each with a sequence of its own; stamps in four forms."""
    eid, at = F.col("event_id"), F.expr("ts - INTERVAL 15 DAYS")
    forms = (F.when(eid % 7 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(eid % 7 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
             .when(eid % 7 == 2, F.unix_timestamp(at.cast("timestamp")).cast("string")).otherwise(F.date_format(at, "MMM d HH:mm:ss")))
    lines = table(spark, sf_dir, "events").select(
        eid.alias("log_id"), F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("host"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), forms.alias("timestamp"))
    timed = ps.with_event_time(lines, 2023, key="host", slices=40)
    return timed.select("log_id", stamp("event_time").alias("event_time"))


# Lines of an incident by time, ids breaking ties.
BY_TIME = RECORDED.replace("event_id AS seq", "row_number() OVER (ORDER BY ts, event_id) AS seq")


@check(q.sql(BY_TIME, """SELECT incident_id, title, summary, severity, severity_score, coalesce(root_cause_chain, '') AS root_cause_chain,
  coalesce(affected_systems, '') AS affected_systems, coalesce(recommended_actions, '') AS recommended_actions, total_logs AS total_logs_analyzed,
  category_breakdown, coalesce(correlations, '') AS correlations FROM incidents_seen"""))
def stream_incident_summary(spark, sf_dir):
    """Summaries kept up to date by micro-batches."""
    path = folder(spark, "incidents")
    logs = stream_logs(spark, sf_dir)
    incident_store.stream_incident_summary(logs, path, f"{path}-checkpoint").awaitTermination()
    return summary_flat(incident_store.read_summaries(spark, path))


def recorded_usage(spark, sf_dir) -> str:
    """Usage recorded as a stream of batches; returns the folder."""
    path = folder(spark, "usage-store")
    usage = derived_usage(read_stream_table(spark, sf_dir, "events"))
    usage_store.record_usage(usage, path, f"{path}-checkpoint").awaitTermination()
    return path


def recorded_facts(spark, sf_dir, path: str) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usage_of(spark, sf_dir).schema)
    return usage_store.read_facts(spark, path, schema)


@check(q.sql(q.USAGE, """SELECT id, api_key_id, endpoint, status_code, coalesce(response_time_ms, -1) AS response_time_ms,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(created_at, '%Y-%m-%d') AS day FROM usage"""))
def stream_append_usage(spark, sf_dir):
    """Facts recorded from a stream, read back with the days they are stored by."""
    facts = recorded_facts(spark, sf_dir, recorded_usage(spark, sf_dir))
    return facts.select("id", "api_key_id", "endpoint", "status_code", F.coalesce("response_time_ms", F.lit(-1)).alias("response_time_ms"),
                        stamp("created_at").alias("created_at"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@check(REGISTRY["usage_stats"].sql)
def usage_stats_stored(spark, sf_dir):
    """The report from stored day partials."""
    path = recorded_usage(spark, sf_dir)
    stats = usage_store.usage_stats_stored(spark, path, recorded_facts(spark, sf_dir, path), keys_of(spark, sf_dir), dt.datetime(2024, 1, 31))
    return stats.withColumn("item", F.coalesce("item", F.lit("")))


@check(REGISTRY["last_used_per_key"].sql)
def last_used_stored(spark, sf_dir):
    """The stored last use of each key."""
    path = recorded_usage(spark, sf_dir)
    return usage_store.read_last_used(spark, path, usage_of(spark, sf_dir)).withColumn("last_used_at", stamp("last_used_at"))


@check(THROTTLE_SQL.replace("GROUP BY ALL", """WHERE o.start + INTERVAL 60 SECONDS <=
  (SELECT date_trunc('millisecond', max(t)) - INTERVAL 10 SECONDS FROM requests) GROUP BY ALL"""))
def stream_throttle_windows(spark, sf_dir):
    """Windows that clients' first requests open, as far as the stream has closed them."""
    requests = dense_requests(spark, sf_dir, read_stream_table(spark, sf_dir, "events"))
    windows = st.stream_throttle_windows(requests, late="10 seconds")
    return run_available(windows, folder(spark, "throttled")).withColumn("window_start", micros("window_start"))


register_fields()
register_stages()
register_scores()
for _name, (_expr, _column) in INCIDENT_FIELDS.items():
    _incident_field(_name, _expr, _column)
for _name, _corr, _condition in zip(CORRELATION_NAMES, inc.CORRELATIONS, q.CORRELATION_CONDITIONS, strict=True):
    _correlation(_name, _corr, _condition)
