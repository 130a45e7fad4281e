"""How many requests queries make, and what stays when rows fail."""

import json

import pytest

from assay.engine import Engine
from assay.errors import PlanError
from assay.functions.requests import PARAMETERS
from assay.sources.loopback import MODEL, Loopback, respond
from assay.sources.provider import Provider


@pytest.fixture
def make(spark):
    for name in PARAMETERS:
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
    open_ = []

    def make(script=None, delay=0.0, provider=None, **settings):
        server = Loopback(script, delay)
        engine = Engine(spark, (provider or (lambda u: Provider.direct("key", u, MODEL)))(server.url), **settings).register()
        open_.append((server, engine))
        return server, engine

    yield make
    for server, engine in open_:
        engine.close()
        server.__exit__()


def table(spark, n=20, parts=1, distinct=None, name="t", reject=lambda i: i % 5 == 0, tenant=lambda i: 42 if i % 2 else 41):
    rows = [(tenant(i), f"{'reject' if reject(i) else 'record'}-{i % (distinct or n)}") for i in range(n)]
    spark.createDataFrame(rows, "tenant_id int, body string").repartitionByRange(parts, "body").createOrReplaceTempView(name)


M = "SELECT body, noul(body, 'x') AS p FROM t WHERE tenant_id = 42 AND noul(body, 'x') > 0.8"


def test_cheap_first_and_reuse(spark, make):
    server, engine = make()
    table(spark)
    assert len(engine.sql(M).collect()) == 8 and server.requests == 10
    server.reset()
    text = "SELECT noul(body, 'x') AS a, noul(body, instructions => 'x', criteria => NULL) AS b FROM t WHERE noul(body, 'x') > 0.8 AND tenant_id = 42"
    assert len(engine.sql(text).collect()) == 8 and server.requests == 10
    server.reset()
    engine.sql("SELECT * FROM (SELECT tenant_id, noul(body, 'x') AS p FROM t) WHERE tenant_id = 42").collect()
    assert server.requests == 10
    server.reset()
    assert len(engine.sql("SELECT body FROM t WHERE tenant_id = 42 OR noul(body, 'x') > 0.8").collect()) == 18 and server.requests == 20


@pytest.mark.parametrize(("distinct", "requests"), [(100, 100), (50, 50), (10, 10)])
def test_duplicates_of_a_batch_are_free(spark, make, distinct, requests):
    server, engine = make()
    table(spark, 100, distinct=distinct, reject=lambda i: False, tenant=lambda i: 42)
    result = engine.sql(M)
    assert len(result.collect()) == 100 and server.requests == requests
    got = result.metrics()
    assert (got["requests"], got["cache_hits"], got["input_tokens"], got["estimated_cost_nano_usd"]) == (requests, 100 - requests, 10 * requests, 420 * requests)
    result.collect()  # running again pays again
    assert server.requests == 2 * requests


def test_batches_do_not_share_replies(spark, make):
    server, engine = make()
    table(spark, 40, distinct=10, reject=lambda i: False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        spark.createDataFrame([(1, f"record-{i % 10}") for i in range(40)], "tenant_id int, body string").coalesce(1).createOrReplaceTempView("t")
        engine.sql("SELECT noul(body, 'x') FROM t").collect()
        assert server.requests == 20
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_questions_and_models_are_part_of_a_request(spark, make):
    server, engine = make()
    table(spark, 1, reject=lambda i: False)
    engine.sql("SELECT noul(body, 'x'), noul(body, 'y'), noul(body, 'x', model => 'm'), noul(body, 'x', '{\"true\":\"z\"}') FROM t").collect()
    assert server.requests == 4
    assert server.bodies.count(b'{"model":"m","questions":{"q0":{"instructions":"x","type":"noul"}},"state":"record-0"}') == 1


@pytest.mark.parametrize("parts", [1, 4])
def test_limit_pays_for_rows_consumed(spark, make, parts):
    server, engine = make()
    table(spark, 64, parts, tenant=lambda i: 42, reject=lambda i: False)
    for limit in (1, 10, 40):
        server.reset()
        assert len(engine.sql(f"{M} LIMIT {limit}").collect()) == limit and server.requests == limit
    server.reset()
    assert len(engine.sql("SELECT noul(body, 'x') FROM t LIMIT 3").collect()) == 3 and server.requests == 3
    server.reset()
    assert engine.sql(f"{M} LIMIT 0").collect() == [] and server.requests == 0
    server.reset()
    assert len(engine.sql(f"{M} LIMIT 2 OFFSET 3").collect()) == 2 and server.requests == 5
    server.reset()
    rows = engine.sql("SELECT body, noul(body, 'x') AS p FROM t ORDER BY p, body LIMIT 3").collect()
    assert [r.body for r in rows] == ["record-0", "record-1", "record-10"] and server.requests == 64


def test_limit_over_rejections(spark, make):
    server, engine = make()
    spark.createDataFrame([(42, f"{'reject' if i < 7 else 'record'}-{i:02}") for i in range(30)], "tenant_id int, body string").coalesce(1).createOrReplaceTempView("t")
    assert [r.body for r in engine.sql(f"{M} LIMIT 3 OFFSET 1").collect()] == ["record-08", "record-09", "record-10"]
    assert server.requests == 11
    server.reset()
    assert len(engine.sql(f"{M} LIMIT 100").collect()) == 23 and server.requests == 30
    spark.createDataFrame([], "tenant_id int, body string").createOrReplaceTempView("t")
    assert engine.sql(f"{M} LIMIT 3").collect() == []


def test_rejections_cost_no_jobs(spark, make):
    server, engine = make()

    def jobs(n, text):
        spark.createDataFrame([(42, f"reject-{i % 50}" if i < n else f"record-{i}") for i in range(n + 3)], "tenant_id int, body string").coalesce(1).createOrReplaceTempView("t")
        server.reset()
        group = f"limit-{n}-{len(text)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            rows = engine.sql(text).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return [r.body for r in rows], len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    for text in (f"{M} LIMIT 1", "SELECT body, j.label FROM (SELECT body, tenant_id, choice(body, 'x', '{\"a\":1,\"b\":2}') AS j, noul(body, 'x') AS p FROM t) WHERE p BETWEEN 0.8 AND tenant_id AND coalesce(j.label, '') <> 'c' AND j.probabilities['a'] > 0 LIMIT 1"):
        few, many = jobs(10, text), jobs(2000, text)
        assert few[0] == ["record-10"] and many[0] == ["record-2000"] and many[1] <= few[1] + 1 < 5


def test_changes_of_partitioning_are_no_barrier(spark, make):
    server, engine = make()
    table(spark, 100, reject=lambda i: i < 10, tenant=lambda i: 42)
    for dealt in ("REPARTITION(3)", "COALESCE(1)", "REPARTITION(3, body)", "REBALANCE"):
        server.reset()
        rows = engine.sql(f"SELECT body, noul(body, 'x') AS p FROM (SELECT /*+ {dealt} */ body FROM t WHERE noul(body, 'x') > 0.8)").collect()
        assert len(rows) == 90 and server.requests == 100, dealt
        server.reset()
        rows = engine.sql(f"SELECT * FROM (SELECT /*+ {dealt} */ body, noul(body, 'x') AS p FROM t) WHERE body LIKE 'record-1%'").collect()
        assert len(rows) == 10 and server.requests == 10, dealt
    server.reset()
    from pyspark.sql import functions as F

    df = spark.table("t")
    judged = df.where(engine.noul(df.body, "x") > 0.8).repartition(3, engine.noul(F.col("body"), "x"))
    assert engine.query(judged.select("body", engine.noul(F.col("body"), "x").alias("p"))).dataframe().count() == 90 and server.requests == 100


def test_several_statements(spark, make):
    server, engine = make()
    rows = engine.sql("SET assay.model = 'later'; -- a comment; here\nSELECT noul('a;b', 'x;') AS p /* ; */;").collect()
    assert len(rows) == 1 and json.loads(server.bodies[0]) == {"model": "later", "state": "a;b", "questions": {"q0": {"type": "noul", "instructions": "x;"}}}
    assert engine.sql("SET assay.model = 'x'; SET assay.on_error = 'null'") is None


def test_late_reports_are_sent_with_the_next(monkeypatch):
    from collections import Counter

    from assay.operators import metrics

    collector = metrics.Collector()
    monkeypatch.setattr(metrics, "WAIT", 0.01)
    connect = metrics.socket.create_connection
    monkeypatch.setattr(metrics.socket, "create_connection", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
    metrics.report(collector.address, "q", "s", Counter(requests=3))
    assert not collector.counts
    monkeypatch.setattr(metrics.socket, "create_connection", connect)
    metrics.report(collector.address, "q", "s", Counter(requests=4))
    assert collector.total("q")["requests"] == 7 and collector.late == 1
    metrics.report((*collector.address[:2], "wrong"), "q", "s", Counter(requests=4))
    assert collector.total("q")["requests"] == 7
    collector.close()


def test_work_kept_besides_replies_has_a_bound(spark, make):
    from assay.operators.judge import Cache

    cache = Cache(4096)
    assert cache.spares(500) and not cache.spares(500) and cache.left == 4096
    server, engine = make(cache_bytes=20_000)
    spark.createDataFrame([(("x" * 3000) + str(i % 4),) for i in range(40)], "body string").coalesce(1).createOrReplaceTempView("long")
    assert len(engine.sql("SELECT noul(body, 'x') FROM long").collect()) == 40 and server.requests == 4


def test_late_data_in_a_stream_is_left_out(spark, make, tmp_path):
    from pyspark.sql import functions as F

    from assay.streaming.judged import run_to_end

    server, engine = make()
    for k, rows in enumerate((["2024-01-01 10:00:00", "2024-01-01 10:20:00"], ["2024-01-01 15:00:00"], ["2024-01-01 15:10:00"], ["2024-01-01 10:30:00", "2024-01-01 14:30:00"], ["2024-01-01 20:00:00"])):
        spark.createDataFrame([(r, f"record-{r}") for r in rows], "ts string, body string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "body").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time

        time.sleep(1.1)  # files are taken by age
    stream = spark.readStream.schema("ts timestamp, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    judged = stream.withColumn("p", engine.noul(F.col("body"), "x")).withWatermark("ts", "1 hour")
    got = run_to_end(judged.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("p").alias("p"))).selectExpr("hour(w.start) AS h", "n", "p").collect()
    assert sorted(tuple(r) for r in got) == [(10, 2, 0.9), (14, 1, 0.9), (15, 2, 0.9)]


def test_a_stream_leaves_its_rows_to_files(spark, make, tmp_path):
    from pyspark.sql import functions as F

    from assay.streaming.judged import run_to_end

    server, engine = make()
    for k in range(3):
        spark.createDataFrame([(k, f"record-{k}"), (k, f"reject-{k}")], "k int, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_end(stream.withColumn("p", engine.noul(F.col("body"), "x")))
    assert len(got.inputFiles()) >= 3 and server.requests == 6  # a table in the driver's memory has none
    assert sorted((r.k, r.p) for r in got.collect()) == [(k, p) for k in range(3) for p in (0.1, 0.9)]
    assert server.requests == 6


def test_the_last_of_complete_results_is_the_table(spark, make, tmp_path):
    from pyspark.sql import functions as F

    from assay.streaming.judged import run_to_end

    server, engine = make()
    for k in range(3):
        spark.createDataFrame([(k, f"record-{k}"), (0, f"reject-{k}")], "k int, body string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema("k int, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_end(stream.withColumn("p", engine.noul(F.col("body"), "x")).groupBy("p").count(), "complete")
    assert sorted(tuple(r) for r in got.collect()) == [(0.1, 3), (0.9, 3)] and server.requests == 6
    assert len({f.rpartition("/")[0] for f in got.inputFiles()}) == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_inner_joins_match_first(spark, make):
    server, engine = make()
    spark.createDataFrame([(i, f"a{i}") for i in range(6)], "k int, a string").createOrReplaceTempView("l")
    spark.createDataFrame([(i % 3, f"b{i}", i) for i in range(6)], "k int, b string, n int").createOrReplaceTempView("r")
    text = "SELECT a, b FROM l JOIN r ON l.k = r.k AND l.k < r.n AND noul(named_struct('source', a, 'candidate', b), 'same?') > 0.5"
    assert len(engine.sql(text).collect()) == 3 and server.requests == 3
    assert json.loads(server.bodies[0])["state"].keys() == {"source", "candidate"}
    server.reset()
    rows = engine.sql("SELECT a, noul(b, 'x') AS p FROM l LEFT JOIN r ON l.k = r.k AND r.n < 2").collect()
    assert len(rows) == 6 and sum(r.p is None for r in rows) == 4 and server.requests == 2


def test_equal_states_have_equal_bytes(spark, make):
    server, engine = make()
    engine.sql("""SELECT noul(named_struct('b', 1.50BD, 'a', 'x'), 'i'), noul('{"a":"x", "b":1.5}', 'i'), noul(parse_json('{"b":1.50,"a":"x"}'), 'i'), noul(map('a', 'x', 'b', 'y'), 'i')""").collect()
    assert server.requests == 2 and b'"state":{"a":"x","b":1.5}}' in min(server.bodies, key=len) + max(server.bodies, key=len)


def test_a_reply_serves_several_functions(spark, make):
    server, engine = make(lambda n, b: (200, {}, b'{ "answers": {"q0": {"noul": 7}} , "future": 1 }'), on_error="null")
    row = engine.sql("""SELECT noul('s', 'i') AS p, ask('s', '{"q0":{"type":"noul","instructions":"i"}}') AS r""").collect()[0]
    assert row.p is None and row.r == '{ "answers": {"q0": {"noul": 7}} , "future": 1 }' and server.requests == 1


def test_settings_are_snapshots(spark, make):
    server, engine = make()
    before = engine.sql("SELECT noul('a', 'x')")
    assert engine.sql("SET assay.model = 'later'") is None
    engine.sql("SELECT noul('a', 'x'), noul('a', 'x', model => 'own')").collect()
    before.collect()
    assert [json.loads(b)["model"] for b in server.bodies] == ["later", "own", MODEL]
    for text, says in (("SET assay.on_error = 'maybe'", "on_error must be fail or null"), ("SET assay.model = ' '", "model cannot be empty"), ("SET assay.other = 1", "unknown setting")):
        with pytest.raises(PlanError, match=says):
            engine.sql(text)
    assert {k: v for k, v, _ in engine.settings()} == {"assay.on_error": "fail", "assay.model": "later", "assay.cache_bytes": 256 << 20}
    with pytest.raises(PlanError, match="already registered"):
        engine.register()


def failing(n, body):
    request = json.loads(body)
    return (500, {}, b"") if request["state"].startswith("bad") else (200, {}, json.dumps(respond(request)).encode())


def test_error_policies(spark, make):
    server, engine = make(failing)
    spark.createDataFrame([("good",), ("bad",), ("bad",), (None,)], "s string").coalesce(1).createOrReplaceTempView("e")
    with pytest.raises(Exception, match="HTTP 500 for noul"):
        engine.sql("SELECT noul(s, 'x') FROM e").collect()
    engine.set("on_error", "null")
    server.reset()
    result = engine.sql("SELECT noul(s, 'x') AS p FROM e")
    assert [r.p for r in result.collect()] == [0.9, None, None, None] and server.requests == 2
    got = result.metrics()
    assert (got["failures"], got["cache_hits"]) == (2, 1)


def test_fatal_statuses_stay_fatal(spark, make):
    server, engine = make(lambda n, b: (401, {}, b"secret"), on_error="null")
    with pytest.raises(Exception, match="HTTP 401 for noul") as e:
        engine.sql("SELECT noul('private words', 'x')").collect()
    assert "secret" not in str(e.value) and server.requests == 1


def test_cache_budget_is_fatal(spark, make):
    server, engine = make(on_error="null", cache_bytes=0)
    with pytest.raises(Exception, match="byte budget"):
        engine.sql("SELECT noul('a', 'x')").collect()
    assert server.requests == 0


@pytest.mark.parametrize(
    ("call", "says"),
    [
        ("noul('a', 'x', '{bad')", "criteria must be valid JSON"), ("choice('a', 'x', '{}')", "nonempty"), ("score('a', 'x', '[1]')", "two ordered levels"), ("choice('a', 'x', NULL)", "nonempty"),
        ("ask('a', '{}')", "cannot be empty"), ("ask('a', '{\"a\":1,\"a\":2}')", "valid JSON"), ("noul('a', NULL)", "instructions cannot be NULL"), ("noul('a', 'x', model => ' ')", "model cannot be empty"),
        ("noul('a', 1)", "argument 2 must be UTF-8 text"), ("noul(1, 'x')", "state must be text"), ("noul('a', 'x', other => 'y')", "no argument other"), ("noul('a')", "expects 4 arguments"), ("noul(named_struct('a', 1, 'a', 2), 'x')", "duplicate field names"), ("noul('{\"a\":1,\"a\":2}', 'x')", "duplicate object keys"),
    ],
)
def test_errors_found_at_planning(make, call, says):
    server, engine = make(on_error="null")
    with pytest.raises(PlanError, match=says):
        engine.sql(f"SELECT {call}")
    assert server.requests == 0


def test_missing_key(make):
    server, engine = make(provider=lambda u: Provider.direct(" ", u, MODEL))
    with pytest.raises(PlanError, match="noul requires JUDGMENT_API_KEY before planning"):
        engine.sql("SELECT noul('a', 'x')")


def test_row_errors_spend_nothing(spark, make):
    server, engine = make(on_error="null")
    rows = engine.sql("SELECT noul(x, 'i') AS p FROM VALUES (array(1D)), (array(CAST('NaN' AS DOUBLE))), (NULL) AS t(x)").collect()
    assert [r.p for r in rows] == [0.9, None, None] and server.requests == 1
    rows = engine.sql("SELECT noul('s', i, model => m) AS p FROM VALUES ('a', 'm'), (NULL, 'm'), ('a', ' ') AS t(i, m)").collect()
    assert [r.p for r in rows] == [0.9, None, None] and server.requests == 2
    rows = engine.sql("SELECT ask('s', q) AS r FROM VALUES ('{broken'), ('{\"a\":{\"type\":\"noul\",\"instructions\":\"i\"}}') AS t(q)").collect()
    assert [r.r is None for r in rows] == [True, False] and server.requests == 3


def test_partitions_overlap_within_the_cap(spark, make):
    server, engine = make(delay=0.05)
    table(spark, 16, 4, reject=lambda i: False)
    engine.sql("SELECT noul(body, 'x') FROM t").collect()
    assert server.requests == 16 and 1 < server.peak <= 8


def test_explain_analyze_and_sites(spark, make):
    server, engine = make()
    table(spark, 3)
    text = engine.sql("SELECT noul(body, 'x'), choice(body, 'y', '{\"a\":1}') FROM t WHERE tenant_id = 42").explain_analyze()
    assert "Judge project#1 noul: demand_driven=false, requests=1" in text and "Judge project#1 choice" in text
    assert "requests=1" in engine.sql("EXPLAIN ANALYZE SELECT noul(body, 'x') FROM t WHERE tenant_id = 42").collect()[0].plan
    limited = engine.sql("SELECT noul(body, 'x') FROM t LIMIT 2")
    assert "demand_driven=true, requests=2" in limited.explain_analyze()
    assert limited.sites()["demand noul"]["elapsed_compute_nanos"] > 0


def test_large_taxonomies(spark, make):
    server, engine = make()
    options = json.dumps({f"option-{i}": "x" * 50 for i in range(1024)})
    spark.createDataFrame([(f"record-{i % 16}", options) for i in range(64)], "body string, criteria string").coalesce(1).createOrReplaceTempView("wide")
    rows = engine.sql("SELECT choice(body, 'x', criteria) AS c FROM wide").collect()
    assert len(rows) == 64 and all(len(r.c.probabilities) == 1024 for r in rows) and server.requests == 16


def test_counters_belong_to_their_place(spark, make):
    server, engine = make()
    spark.createDataFrame([(42, "reject-a"), (42, "record-b"), (42, "record-c"), (41, "d")], "tenant_id int, body string").coalesce(1).createOrReplaceTempView("t")
    result = engine.sql("SELECT choice(body, 'y', '{\"a\":1}') FROM t WHERE tenant_id = 42 AND noul(body, 'x') > 0.8")
    assert len(result.collect()) == 2
    assert {k: v["requests"] for k, v in result.sites().items()} == {"filter#1 noul": 3, "project#2 choice": 2}


def test_sorting_by_a_judgment_judges_once(spark, make):
    server, engine = make()
    table(spark)
    rows = engine.sql("SELECT body, noul(body, 'x') AS p FROM t ORDER BY noul(body, 'x'), body").collect()
    assert [r.p for r in rows] == [0.1] * 4 + [0.9] * 16 and server.requests == 20
    server.reset()
    assert len(engine.sql("SELECT body FROM t ORDER BY noul(body, 'x') DESC LIMIT 4").collect()) == 4 and server.requests == 20


def test_json_functions_share_one_reply(spark, make):
    from assay.functions.columns import register_json_functions

    server, engine = make()
    register_json_functions(spark)
    q = """'{"a":{"type":"noul","instructions":"i"},"b":{"type":"choice","instructions":"i","criteria":{"x":1}}}'"""
    rows = engine.sql(f"SELECT json_get_float(r, 'answers', 'a', 'noul') AS a, json_get_str(r, 'answers', 'b', 'choice') AS b, json_get_int(r, 'nothing') AS c FROM (SELECT ask('s', {q}) AS r)").collect()
    assert [tuple(r) for r in rows] == [(0.9, "x", None)] and server.requests == 1


def test_cancelling_stops_spending(spark, make):
    import threading
    import time

    server, engine = make(delay=0.2)
    table(spark, 400, 1, reject=lambda i: False)
    result = engine.sql("SELECT noul(body, 'x') FROM t")
    failed = []

    def run():
        spark.sparkContext.setJobGroup("cancelled", "x", True)
        try:
            result.collect()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    thread = threading.Thread(target=run)
    thread.start()
    while server.requests < 3:
        time.sleep(0.05)
    spark.sparkContext.cancelJobGroup("cancelled")
    thread.join()
    time.sleep(5)  # Spark looks every other second, and lets a worker end for two
    seen = server.requests
    time.sleep(1)
    assert failed and server.requests == seen < 60


def test_limit_keeps_all_types(spark, make):
    server, engine = make()
    spark.sql("""SELECT id, CAST(id AS DECIMAL(20,3)) / 7 AS d, map('a', id) AS m, named_struct('x', array(id, NULL)) AS s, timestamp_ntz '2024-01-02 03:04:05' AS n, timestamp '2024-01-02 03:04:05' AS t, date '2024-01-02' AS day,
        unhex('00ff') AS b, parse_json(concat('{"k":', id, '.50}')) AS v, interval '1' day AS i FROM range(0, 8, 1, 2)""").createOrReplaceTempView("typed")
    want = spark.sql("SELECT id, d, m, s, n, t, day, b, CAST(v AS STRING) AS v, i FROM typed WHERE id < 3").collect()
    got = engine.sql("SELECT id, d, m, s, n, t, day, b, CAST(v AS STRING) AS v, i FROM typed WHERE noul(v, 'x') > 0.5 AND noul(s, 'y') > 0.5 AND noul(named_struct('d', d, 'm', m), 'z') > 0.5 LIMIT 3").collect()
    assert got == want and server.requests == 9
    assert b'"state":{"k":1.5}' in b"".join(server.bodies)


def test_aggregates_read_what_filters_paid_for(spark, make):
    server, engine = make()
    table(spark)
    rows = engine.sql("SELECT tenant_id, max(noul(body, 'x')) AS m, sum(noul(body, 'x') + 1) AS s, count(*) AS n FROM t WHERE noul(body, 'x') > 0.05 GROUP BY tenant_id ORDER BY tenant_id").collect()
    assert [(r.tenant_id, r.m, round(r.s, 6), r.n) for r in rows] == [(41, 0.9, 17.4, 10), (42, 0.9, 17.4, 10)] and server.requests == 20
    server.reset()
    rows = engine.sql("SELECT noul(body, 'x') AS p, count(*) AS n FROM t GROUP BY noul(body, 'x') HAVING count(*) > 5").collect()
    assert [(r.p, r.n) for r in rows] == [(0.9, 16)] and server.requests == 20
    server.reset()
    rows = engine.sql("SELECT tenant_id, noul(max(body), 'x') AS p FROM t GROUP BY tenant_id HAVING noul(max(body), 'x') < 0.5").collect()
    assert len(rows) == 2 and server.requests in (2, 4)


def test_limit_shares_replies_across_rounds(spark, make):
    server, engine = make()
    spark.createDataFrame([(42, f"{'reject' if i % 4 == 0 else 'record'}-{i % 20}") for i in range(60)], "tenant_id int, body string").coalesce(1).createOrReplaceTempView("t")
    assert len(engine.sql(f"{M} LIMIT 45").collect()) == 45 and server.requests == 20


def test_large_rubrics(spark, make):
    server, engine = make()
    spark.createDataFrame([("s", json.dumps({"true": "x" * 65536 + str(i % 16)})) for i in range(32)], "body string, criteria string").coalesce(1).createOrReplaceTempView("rubrics")
    result = engine.sql("SELECT noul(body, 'x', criteria) AS p FROM rubrics")
    assert len(result.collect()) == 32 and server.requests == 16 and result.metrics()["cache_hits"] == 16


def test_choices_can_be_stored_with_and_without_their_probabilities(spark, make, tmp_path):
    server, engine = make()
    options = json.dumps({f"option-{i:02}": None for i in range(75)})
    df = engine.sql(f"SELECT id, choice(concat('s', id), 'x', '{options}') AS j FROM range(50)").dataframe()
    df.write.parquet(str(tmp_path / "full"))
    spark.read.parquet(str(tmp_path / "full")).selectExpr("id", "j.label", "j.confidence").write.parquet(str(tmp_path / "short"))
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert server.requests == 50 and size("full") > 2 * size("short")


@pytest.mark.parametrize("query", ["SELECT /*+ COALESCE(1) */ noul(body, 'x') AS p FROM parts", "SELECT /*+ COALESCE(1) */ body FROM parts WHERE noul(body, 'x') > 0.8 AND noul(body, 'even') > 0"])
def test_a_coalesce_makes_batches_whole(spark, make, tmp_path, query):
    server, engine = make()
    for i in range(5):  # as many files, and partitions, of 7 rows
        spark.createDataFrame([(f"record-{k}",) for k in range(7)], "body string").coalesce(1).write.parquet(f"{tmp_path}/{i}")
    paths = [f"{tmp_path}/{i}" for i in range(5)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        spark.read.parquet(*paths).createOrReplaceTempView("parts")
        assert spark.table("parts").rdd.getNumPartitions() >= 5
        assert len(engine.sql(query).collect()) == 35
        assert server.requests == 7 * (2 if "even" in query else 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
