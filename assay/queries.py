"""Queries over the tables, judged by a loopback server whose rules SQL can restate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.engine import Engine
from assay.functions.columns import register_helpers, register_json_functions
from assay.functions.requests import PARAMETERS
from assay.operators.metrics import Collector
from assay.sources.loopback import MODEL, Loopback
from assay.sources.provider import Provider
from assay.streaming.judged import run_to_end, stream_table

_server: list[Loopback] = []
_collector: list[Collector] = []


def server() -> Loopback:
    if not _server:
        _server.append(Loopback(keep=False))
    return _server[0]


def engine(spark: SparkSession, **settings: object) -> Engine:
    """An engine on the loopback server, its functions in the session."""
    if not _collector:
        _collector.append(Collector(spark.conf.get("spark.driver.host", "127.0.0.1")))
    made = Engine(spark, Provider.direct("loopback", server().url, MODEL), collector=_collector[0], **settings)
    if not spark.catalog.functionExists(next(iter(PARAMETERS))):
        made.register()
    register_helpers(spark)
    return made


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _sql(tables: str, text: str, **settings: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, *tables.split())
        return engine(spark, **settings).sql(text).dataframe()

    return run


def judge_in_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = engine(spark)
    stream = stream_table(spark, sf_dir, "events").select("event_id", judge.noul(F.col("event_type"), "even").alias("p"))
    return run_to_end(stream)


def judge_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged events counted in one-hour windows under a watermark."""
    judge = engine(spark)
    stream = stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("p", judge.noul(F.col("event_type"), "even")).withWatermark("ts", "1 hour")
    totals = run_to_end(stream.groupBy(F.window("ts", "1 hour").alias("w"), "p").count(), "complete")
    return totals.groupBy("p").agg(F.sum("count").alias("n"), F.count("*").alias("windows"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    judge = engine(spark)
    events = stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withColumn("p", judge.noul(F.col("event_type"), "even")).withWatermark("ts", "1 hour")


def judge_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged events counted in windows of two hours that begin each hour."""
    totals = run_to_end(_stream(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "p").count(), "complete")
    return totals.groupBy("p").agg(F.sum("count").alias("n"), F.count("*").alias("windows"))


def judge_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions of judged events, which end with an hour and half a second without any."""
    sessions = run_to_end(_stream(spark, sf_dir).groupBy("user_id", F.session_window("ts", "3600500 milliseconds")).agg(F.count("*").alias("n"), F.max("p").alias("p")), "complete")
    return sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.max("p").alias("p"))


def judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a reply and of a list in it, by keys and places."""
    _views(spark, sf_dir, "events")
    judge = engine(spark)
    register_json_functions(spark)
    text = """SELECT event_id, json_get_float(r, 'answers', 'a\\'s', 'noul') AS a, json_get_int(r, 'usage', 'input_tokens') AS tokens, json_get(l, 1, 'k') AS k, json_get_bool(l, 5) AS none
        FROM (SELECT event_id, concat('[0,{"k":"', event_type, '"}]') AS l, ask(event_type, '{"a\\'s":{"type":"noul","instructions":"even"}}') AS r FROM events)"""
    return judge.sql(text).dataframe()


def judge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query over a single partition pays: one request for each distinct state of a batch."""
    _views(spark, sf_dir, "events")
    result = engine(spark).sql("SELECT /*+ COALESCE(1) */ noul(event_type, 'even') AS p FROM events")
    result.dataframe().write.format("noop").mode("overwrite").save()
    got = result.metrics()
    return spark.createDataFrame([(got["requests"], got["cache_hits"], got["failures"], got["estimated_cost_nano_usd"])], "requests long, cache_hits long, failures long, cost long")


def judge_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The DataFrame form."""
    judge = engine(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = events.where("value > 10").select("event_id", judge.noul(F.col("event_type"), "even").alias("p"))
    return judge.query(df.where("p > 0.5")).dataframe()


_CHOICE = """'{"a":"first","b":null,"c":"third"}'"""
_EVEN = "CASE WHEN length({0}) % 2 = 0 THEN 0.9 ELSE 0.1 END"
_WEIGHTS = "[1 + (length({0}) + i) % 4 for i in range(0, 3)]"

#: name: tables, Spark SQL, DuckDB SQL, settings.
_JUDGED: dict[str, tuple] = {
    "judge_noul": ("events", "SELECT event_id, noul(event_type, 'Is this a purchase?') AS p FROM events WHERE value > 10", "SELECT event_id, CAST(0.9 AS DOUBLE) AS p FROM events WHERE value > 10", {}),
    "judge_filter_reuse": ("documents", "SELECT doc_id, noul(text, 'even') AS p FROM documents WHERE noul(text, 'even') > 0.5 AND lang = 'en'", f"SELECT doc_id, CAST(0.9 AS DOUBLE) AS p FROM documents WHERE lang = 'en' AND {_EVEN.format('text')} > 0.5", {}),
    "judge_choice": ("conversations", f"SELECT conv_id, turn, j.label, round(j.confidence, 6) AS confidence, round(j.probabilities['c'], 6) AS c FROM (SELECT conv_id, turn, choice(text, 'which', {_CHOICE}) AS j FROM conversations)", f"WITH w AS (SELECT conv_id, turn, {_WEIGHTS.format('text')} AS w FROM conversations) SELECT conv_id, turn, ['a', 'b', 'c'][list_position(w, list_max(w))] AS label, round(list_max(w) / list_sum(w), 6) AS confidence, round(w[3] / list_sum(w), 6) AS c FROM w", {}),
    "judge_score": ("conversations", """SELECT conv_id, turn, score(text, 'how much', '["none","some","much"]').score AS level FROM conversations""", "SELECT conv_id, turn, CAST(length(text) % 3 AS DOUBLE) AS level FROM conversations", {}),
    "judge_ask": ("events", """SELECT event_id, CAST(get_json_object(r, '$.answers.a.noul') AS DOUBLE) AS a, CAST(get_json_object(r, '$.answers.b.score') AS DOUBLE) AS b FROM (SELECT event_id, ask(event_type, '{"a":{"type":"noul","instructions":"even"},"b":{"type":"score","instructions":"x","criteria":["l","h"]}}') AS r FROM events)""", f"SELECT event_id, CAST({_EVEN.format('event_type')} AS DOUBLE) AS a, CAST(length(event_type) % 2 AS DOUBLE) AS b FROM events", {}),
    "judge_named_arguments": ("events", """SELECT event_id, noul(instructions => 'even', state => event_type, model => 'other') AS p FROM events""", f"SELECT event_id, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p FROM events", {}),
    "judge_criteria_column": ("events", """SELECT event_id, noul(event_type, 'even', concat('{"true":"above ', CAST(event_id % 7 AS STRING), '"}')) AS p FROM events""", f"SELECT event_id, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p FROM events", {}),
    "judge_null_state": ("events", "SELECT event_id, noul(nullif(event_type, 'error'), 'even') AS p FROM events", f"SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST({_EVEN.format('event_type')} AS DOUBLE) END AS p FROM events", {}),
    "judge_errors_as_null": ("events", """SELECT event_id, noul(event_type, 'even', CASE WHEN event_id % 3 = 0 THEN '{broken' END) AS p FROM events""", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST({_EVEN.format('event_type')} AS DOUBLE) END AS p FROM events", {"on_error": "null"}),
    "judge_lossy_states_as_null": ("events", "SELECT event_id, noul(named_struct('ts', ts), 'x') AS a, noul(array(if(event_id % 2 = 0, CAST('NaN' AS DOUBLE), value)), 'x') AS b FROM events", "SELECT event_id, CAST(NULL AS DOUBLE) AS a, CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(0.9 AS DOUBLE) END AS b FROM events", {"on_error": "null"}),
    "judge_inner_join": ("nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND noul(named_struct('n', n_name, 'r', r_name), 'even') > 0.5", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE (length(n_name) + length(r_name) + 15) % 2 = 0", {}),
    "judge_left_join": ("customer nation", "SELECT c_custkey, noul(n_name, 'even') AS p FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3", f"SELECT c_custkey, CASE WHEN n_name IS NULL THEN NULL ELSE CAST({_EVEN.format('n_name')} AS DOUBLE) END AS p FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3", {}),
    "judge_group_by": ("events", "SELECT event_type, count(*) AS n, max(p) AS p FROM (SELECT event_type, noul(event_type, 'even') AS p FROM events) GROUP BY event_type HAVING max(p) > 0.5", f"SELECT event_type, count(*) AS n, CAST(0.9 AS DOUBLE) AS p FROM events WHERE {_EVEN.format('event_type')} > 0.5 GROUP BY event_type", {}),
    "judge_window": ("conversations", "SELECT conv_id, turn, sum(p) OVER (PARTITION BY conv_id ORDER BY turn) > 1.05 AS busy FROM (SELECT conv_id, turn, noul(text, 'even') AS p FROM conversations)", f"SELECT conv_id, turn, sum({_EVEN.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) > 1.05 AS busy FROM conversations", {}),
    "judge_top_k": ("documents", "SELECT doc_id, noul(text, 'even') AS p FROM documents ORDER BY p DESC, doc_id LIMIT 25", f"SELECT doc_id, CAST({_EVEN.format('text')} AS DOUBLE) AS p FROM documents ORDER BY p DESC, doc_id LIMIT 25", {}),
    "judge_union": ("events", "SELECT event_id, noul(event_type, 'even') AS p FROM events WHERE value > 20 UNION ALL SELECT event_id, noul(event_type, 'x') AS p FROM events WHERE value < 5", f"SELECT event_id, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p FROM events WHERE value > 20 UNION ALL SELECT event_id, CAST(0.9 AS DOUBLE) FROM events WHERE value < 5", {}),
    "judge_semi_join": ("documents labels", "SELECT doc_id FROM documents LEFT SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE noul(text, 'even') > 0.5", f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND {_EVEN.format('text')} > 0.5", {}),
    "judge_outer_cheap_filter": ("events", "SELECT event_id, p FROM (SELECT event_id, value, noul(event_type, 'even') AS p FROM events) WHERE p > 0.5 AND value > 30", f"SELECT event_id, CAST(0.9 AS DOUBLE) AS p FROM events WHERE {_EVEN.format('event_type')} > 0.5 AND value > 30", {}),
    "judge_paid_or": ("events", "SELECT event_id FROM events WHERE value > 50 OR noul(event_type, 'even') > 0.5", f"SELECT event_id FROM events WHERE value > 50 OR {_EVEN.format('event_type')} > 0.5", {}),
    "judge_rollup": ("events", "SELECT event_type, p, count(*) AS n FROM (SELECT event_type, noul(event_type, 'even') AS p FROM events) GROUP BY ROLLUP (event_type, p)", f"SELECT event_type, p, count(*) AS n FROM (SELECT event_type, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p FROM events) GROUP BY ROLLUP (event_type, p)", {}),
    "judge_except": ("events", "SELECT user_id, event_type FROM events WHERE noul(event_type, 'even') > 0.5 EXCEPT SELECT user_id, event_type FROM events WHERE value > 50", f"SELECT user_id, event_type FROM events WHERE {_EVEN.format('event_type')} > 0.5 EXCEPT SELECT user_id, event_type FROM events WHERE value > 50", {}),
    "judge_intersect": ("events", "SELECT user_id FROM events WHERE noul(event_type, 'even') > 0.5 INTERSECT SELECT user_id FROM events WHERE noul(event_type, 'even') < 0.5", f"SELECT user_id FROM events WHERE {_EVEN.format('event_type')} > 0.5 INTERSECT SELECT user_id FROM events WHERE {_EVEN.format('event_type')} < 0.5", {}),
    "judge_anti_join": ("documents labels", "SELECT doc_id FROM documents d LEFT ANTI JOIN labels USING (doc_id) WHERE noul(lang, 'even') > 0.5", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND length(lang) % 2 = 0", {}),
    "judge_full_join": ("customer nation", "SELECT c_custkey, n_name, noul(coalesce(n_name, 'none'), 'even') AS p FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 2) n ON c_nationkey = n_nationkey", f"SELECT c_custkey, n_name, CAST({_EVEN.format("coalesce(n_name, 'none')")} AS DOUBLE) AS p FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 2) n ON c_nationkey = n_nationkey", {}),
    "judge_right_join": ("customer nation", "SELECT c_custkey, n_name, noul(n_name, 'even') AS p FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 5000", f"SELECT c_custkey, n_name, CAST({_EVEN.format('n_name')} AS DOUBLE) AS p FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 5000", {}),
    "judge_cross_join": ("nation region", "SELECT n_name, r_name, noul(concat(n_name, r_name), 'even') AS p FROM nation CROSS JOIN region WHERE noul(r_name, 'even') > 0.5", f"SELECT n_name, r_name, CAST({_EVEN.format('(n_name || r_name)')} AS DOUBLE) AS p FROM nation CROSS JOIN region WHERE {_EVEN.format('r_name')} > 0.5", {}),
    "judge_cube": ("events", "SELECT event_type, p, count(*) AS n FROM (SELECT event_type, noul(event_type, 'even') AS p FROM events) GROUP BY CUBE (event_type, p)", f"SELECT event_type, p, count(*) AS n FROM (SELECT event_type, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p FROM events) GROUP BY CUBE (event_type, p)", {}),
    "judge_grouping_sets": ("events", "SELECT user_id % 10 AS u, p, count(*) AS n FROM (SELECT user_id, noul(event_type, 'even') AS p FROM events) GROUP BY GROUPING SETS ((user_id % 10), (p), ())", f"SELECT u, p, count(*) AS n FROM (SELECT user_id % 10 AS u, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p FROM events) GROUP BY GROUPING SETS ((u), (p), ())", {}),
    "judge_repartition_reuse": ("events", "SELECT event_id, noul(event_type, 'even') AS p FROM (SELECT /*+ REPARTITION(3) */ event_id, event_type FROM events WHERE noul(event_type, 'even') > 0.5) WHERE event_id % 2 = 1", f"SELECT event_id, CAST(0.9 AS DOUBLE) AS p FROM events WHERE {_EVEN.format('event_type')} > 0.5 AND event_id % 2 = 1", {}),
    "judge_limit_rejected": ("events", "SELECT DISTINCT p FROM (SELECT noul(event_type, 'even') AS p FROM events WHERE noul(event_type, 'even') > 0.95 LIMIT 5)", "SELECT CAST(0.9 AS DOUBLE) AS p FROM range(0)", {}),
    "judge_exists": ("customer nation", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AND noul(n_name, 'even') > 0.5", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 5000) AND length(n_name) % 2 = 0", {}),
    "judge_cte": ("events", "WITH judged AS (SELECT event_id, event_type, noul(event_type, 'even') AS p FROM events) SELECT a.event_id, a.p + b.p AS s FROM judged a JOIN judged b ON a.event_id = b.event_id WHERE a.event_type = 'signup'", "SELECT event_id, CAST(1.8 AS DOUBLE) AS s FROM events WHERE event_type = 'signup'", {}),
    "judge_built_state": ("events", "SELECT event_id, noul(concat(upper(event_type), date_format(ts, '-yyyy'), '-', CAST(user_id % 100 AS STRING)), 'even') AS p FROM events", f"SELECT event_id, CAST(CASE WHEN length(event_type || '-0000-' || CAST(user_id % 100 AS VARCHAR)) % 2 = 0 THEN 0.9 ELSE 0.1 END AS DOUBLE) AS p FROM events", {}),
    "judge_limit": ("events", "SELECT noul(event_type, 'even') AS p FROM events WHERE noul(event_type, 'even') > 0.5 LIMIT 10 OFFSET 3", "SELECT CAST(0.9 AS DOUBLE) AS p FROM range(10)", {}),
    "judge_limit_zero": ("events", "SELECT noul(event_type, 'even') AS p FROM events LIMIT 0", "SELECT CAST(0.9 AS DOUBLE) AS p FROM range(0)", {}),
    "judge_states_alike": ("events", "SELECT event_id, noul(named_struct('k', event_type), 'even') AS a, noul(map('k', event_type), 'even') AS b, noul(concat('{\"k\":\"', event_type, '\"}'), 'even') AS c, noul(parse_json(concat('{\"k\":\"', event_type, '\"}')), 'even') AS d FROM events", f"SELECT event_id, CAST(p AS DOUBLE) AS a, CAST(p AS DOUBLE) AS b, CAST(p AS DOUBLE) AS c, CAST(p AS DOUBLE) AS d FROM (SELECT event_id, {_EVEN.format('event_type')} AS p FROM events)", {}),
    "state_canonical": ("events", "SELECT event_id, canonical_state(named_struct('type', event_type, 'id', event_id, 'n', CAST(event_id AS DECIMAL(12,2)) / 4)) AS j FROM events", "SELECT event_id, '{\"id\":' || event_id || ',\"n\":' || event_id // 4 || ['', '.25', '.5', '.75'][event_id % 4 + 1] || ',\"type\":\"' || event_type || '\"}' AS j FROM events", {}),
    "state_hash": ("events", "SELECT event_id, state_fingerprint(array(event_type, NULL)) AS h FROM events", "SELECT event_id, sha256('[\"' || event_type || '\",null]') AS h FROM events", {}),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sql(tables, text, **settings) for name, (tables, text, _, settings) in _JUDGED.items()}
QUERIES |= {f.__name__: f for f in (judge_in_stream, judge_stream_totals, judge_stream_sliding, judge_stream_sessions, judge_json, judge_counters, judge_columns)}

SQL = {name: oracle for name, (_, _, oracle, _) in _JUDGED.items()}
SQL |= {
    "judge_in_stream": f"SELECT event_id, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p FROM events",
    "judge_stream_totals": f"SELECT p, CAST(sum(n) AS BIGINT) AS n, count(*) AS windows FROM (SELECT CAST({_EVEN.format('event_type')} AS DOUBLE) AS p, date_trunc('hour', ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY p",
    "judge_stream_sliding": f"SELECT p, CAST(sum(n) AS BIGINT) AS n, count(*) AS windows FROM (SELECT CAST({_EVEN.format('event_type')} AS DOUBLE) AS p, w, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL) GROUP BY p",
    "judge_stream_sessions": f"""WITH marked AS (SELECT user_id, ts, CAST({_EVEN.format('event_type')} AS DOUBLE) AS p, coalesce(CAST(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 3600500 AS INT), 1) AS fresh FROM events),
        numbered AS (SELECT user_id, p, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM marked)
        SELECT user_id, count(*) AS sessions, max(n) AS longest, max(p) AS p FROM (SELECT user_id, k, count(*) AS n, max(p) AS p FROM numbered GROUP BY user_id, k) GROUP BY user_id""",
    "judge_json": f"SELECT event_id, CAST({_EVEN.format('event_type')} AS DOUBLE) AS a, CAST(10 AS BIGINT) AS tokens, event_type AS k, CAST(NULL AS BOOLEAN) AS none FROM events",
    "judge_counters": "SELECT requests, total - requests AS cache_hits, CAST(0 AS BIGINT) AS failures, 420 * requests AS cost FROM (SELECT CAST(count(DISTINCT event_type) * ceil(count(*) / 10000) AS BIGINT) AS requests, count(*) AS total FROM events)",
    "judge_columns": f"SELECT event_id, CAST(0.9 AS DOUBLE) AS p FROM events WHERE value > 10 AND {_EVEN.format('event_type')} > 0.5",
}
