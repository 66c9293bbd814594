"""Free SQL over the published views, and its rules, run over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from registry import Area
from registry.plays import PLAYS_CTE
from spinlog.operators.guard import GuardedSql
from spinlog.plans.views import publish_views
from spinlog.sources.testtables import plays_from_lineitem

AREA = Area()


def guarded(spark: SparkSession, sf_dir: str) -> GuardedSql:
    return GuardedSql(spark, lambda session: publish_views(plays_from_lineitem(session, sf_dir)))


def ask(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    AREA.add(name, lambda s, d: guarded(s, d).frame(spark_sql), PLAYS_CTE + (duck_sql or spark_sql))


ask("sql_guarded",
    "with loud as (select artist_name, play_count from dim_artist where play_count >= 20) "
    "select m.played_month, count(*) as artists, sum(m.plays) as plays from v_monthly_artist m "
    "join loud on loud.artist_name = m.artist_name where m.plays > (select min(plays) from v_skip) "
    "group by m.played_month",
    ", loud as (select artist_name, play_count from dim_artist where play_count >= 20) "
    "select m.played_month, count(*) as artists, cast(sum(m.plays) as bigint) as plays from v_monthly_artist m "
    "join loud on loud.artist_name = m.artist_name where m.plays > (select min(plays) from v_skip) group by m.played_month")
ask("set_union_sql",
    "select artist_name from v_skip where plays > 3 union select artist_name from dim_artist where play_count < 25")
ask("sql_validate",
    "select s.artist_name, s.plays, cast(rank() over (partition by s.artist_name order by s.plays desc, s.track_uri) as int) as place "
    "from v_skip s where exists (select 1 from dim_track t where t.track_uri = s.track_uri and t.play_count > 4)")


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a full listing fits under the cap, next to its true size."""
    door = guarded(spark, sf_dir)
    result = door.run("select artist_name, played_month, plays from v_monthly_artist", max_rows=1000, timeout_s=600)
    total = door.frame("select count(*) as total from v_monthly_artist")
    return total.selectExpr("total", f"{result.row_count} as row_count", f"{str(result.truncated).lower()} as truncated")


AREA.add("cap_rows_truncated", capped, PLAYS_CTE +
         "select count(*) as total, least(count(*), 1000) as row_count, count(*) > 1000 as truncated from v_monthly_artist")
