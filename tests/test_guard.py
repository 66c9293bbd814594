"""What free SQL may and may not do."""

from __future__ import annotations

import pytest

from spinlog.errors import QueryTimeoutError, SqlGuardError
from spinlog.operators.guard import GuardedSql, describe
from spinlog.plans.views import VIEWS, publish_views
from spinlog.schema import PLAYS
from spinlog.sources.testtables import plays_from_lineitem


@pytest.fixture(scope="module")
def door(spark, sf):
    spark.sql("select 1 as secret").createOrReplaceTempView("private_view")
    spark.sql("select 1 as secret").createOrReplaceGlobalTempView("private_global")
    return GuardedSql(spark, lambda session: publish_views(plays_from_lineitem(session, sf)))


REFUSED = [
    "SELECT * FROM plays; DROP TABLE plays;", "SELECT 1; SELECT 2", "DROP TABLE plays", "INSERT INTO plays VALUES (1)",
    "DELETE FROM plays", "UPDATE plays SET ms_played = 0", "CREATE TABLE t (x INT)", "CREATE TABLE t AS SELECT * FROM plays",
    "CREATE VIEW v AS SELECT 1", "ALTER TABLE plays ADD COLUMN x INT", "ATTACH 'x.db' AS x", "DETACH x", "PRAGMA database_list",
    "SET spark.sql.ansi.enabled=false", "RESET", "COPY plays TO 'x.csv'", "INSTALL httpfs", "LOAD httpfs",
    "SELECT * FROM read_csv('x')", "SELECT * FROM read_csv_auto('x')", "SELECT * FROM read_json('x')",
    "SELECT * FROM read_parquet('x')", "SELECT glob('*')", "SELECT some_weird_auto(1)", "WITH x AS (SELECT 1) INSTALL httpfs",
    "-- looks fine\nDROP TABLE plays", "", "  \n\t ", "this is not sql", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE plays",
    "CACHE TABLE plays", "REFRESH TABLE plays", "USE other", "VALUES (1)", "ADD JAR 'x.jar'", "CALL x()",
    "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'", "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT * FROM plays",
    "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM plays INSERT INTO t SELECT *",
    "SELECT TRANSFORM(track_uri) USING 'cat' FROM plays", "SELECT * FROM parquet.`/root/x`", "SELECT * FROM text.`/etc/passwd`",
    "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a", "SELECT (SELECT max(value) FROM text.`/etc/passwd`)",
    "SELECT * FROM plays WHERE EXISTS (SELECT 1 FROM text.`/etc/passwd`)", "SELECT java_method('java.lang.System', 'exit', 1)",
    "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT try_reflect('java.util.UUID', 'randomUUID') FROM plays",
    "WITH a AS (SELECT java_method('java.lang.System', 'exit', 1) AS x) SELECT x FROM a",
    "SELECT * FROM plays ORDER BY reflect('java.util.UUID', 'randomUUID')", "SELECT * FROM IDENTIFIER('private_' || 'view')",
    "SELECT * FROM private_view", "SELECT * FROM global_temp.private_global", "SELECT * FROM spark_catalog.default.t",
    "SELECT system.builtin.java_method('java.lang.System', 'exit', 1)", "FROM text.`/etc/passwd` |> WHERE true",
    "SELECT * FROM plays |> UNION ALL (SELECT * FROM private_view)", "SELECT nowhere FROM plays", "SELECT current_user()", "SELECT version()", "SELECT input_file_name() FROM plays",
    "SELECT current_catalog() FROM plays", "SELECT spark_partition_id() FROM plays",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(door, sql):
    with pytest.raises(SqlGuardError):
        door.frame(sql)


ALLOWED = [
    "SELECT * FROM plays", "SELECT * FROM plays LIMIT 10", "SELECT artist_name, COUNT(*) FROM plays GROUP BY artist_name",
    "WITH recent AS (SELECT * FROM plays WHERE played_date > '1996-01-01') SELECT * FROM recent",
    "SELECT track_uri FROM plays UNION SELECT track_uri FROM dim_track",
    "SELECT * FROM plays -- a comment that mentions DROP TABLE plays", "SELECT * FROM plays -- ; DROP TABLE plays; --",
    "SELECT * FROM dim_artist ORDER BY play_count DESC;", "select 'DROP TABLE plays; --' as text from V_HOURLY",
    "SELECT a.played_hour FROM v_hourly a JOIN v_hourly b USING (played_hour, played_dow)",
    "SELECT played_month, artist_name, SUM(plays) FROM v_monthly_artist GROUP BY ROLLUP (played_month, artist_name)",
    "FROM plays |> AGGREGATE COUNT(*) AS n GROUP BY artist_name", "SELECT x FROM range(3) AS t(x)",
    "SELECT *, row_number() OVER (ORDER BY plays DESC, track_uri) FROM v_skip WHERE plays IN (SELECT max(plays) FROM v_skip)",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(door, sql):
    door.frame(sql)


def test_cap_and_flag(door):
    cut = door.run("SELECT * FROM plays ORDER BY ts_utc", max_rows=7, timeout_s=120)
    assert cut.truncated and cut.row_count == len(cut.rows) == 7 and "track_uri" in cut.columns
    whole = door.run("SELECT played_hour, played_dow, plays FROM v_hourly WHERE played_dow = 1", max_rows=24, timeout_s=120)
    assert not whole.truncated and whole.row_count == 24 and set(whole.rows[0]) == {"played_hour", "played_dow", "plays"}


def test_time_limit_cancels_and_the_session_lives_on(door):
    slow = "SELECT count(*) FROM plays a, plays b, plays c WHERE a.ms_played + b.ms_played > c.ms_played + 1"
    with pytest.raises(QueryTimeoutError, match="2 s"):
        door.run(slow, timeout_s=2)
    assert door.run("SELECT count(*) AS n FROM v_hourly", timeout_s=120).rows[0]["n"] > 0


def test_description(spark, sf):
    plays = spark.createDataFrame([], PLAYS)
    views = {"plays": plays, **{name: view(plays) for name, view in VIEWS.items()}}
    rows = {(r.view, r.column): r for r in describe(spark, views).collect()}
    assert "heuristic" in rows["plays", "is_skip"].meaning and rows["v_hourly", "plays"].type == "bigint"
    assert len([k for k in rows if k[0] == "plays"]) == 28


def test_inner_name_does_not_open_a_saved_table(spark):
    spark.sql("create or replace temp view one as select 1 as a")
    spark.range(3).write.mode("overwrite").saveAsTable("secret")
    try:
        guarded = GuardedSql(spark, lambda s: s.sql("select 1 as a").createOrReplaceTempView("v") or ["v"])
        with pytest.raises(SqlGuardError):
            guarded.run("select s.* from secret s, (with secret as (select 1 as a) select * from secret) t")
        assert guarded.run("with v2 as (select a from v) select * from v2").rows == [{"a": 1}]
    finally:
        spark.sql("drop table secret")
