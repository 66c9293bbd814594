"""Edits of ordered lists of 150 events, and the audit rows they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import Area
from spinlog.operators import audit
from spinlog.operators import lists as L
from spinlog.session import work_dir
from spinlog.sources.testtables import list_items, table

AREA = Area()

ITEMS_CTE = """
with items as (
  select event_id // 150 as list_id, event_id % 150 as position,
    case when event_type = 'error' then 'app:episode:' else 'app:track:' end || user_id as uri, event_id
  from events
)
"""


def over(edit):
    return lambda spark, sf_dir: edit(spark, list_items(spark, sf_dir))


def ask(name, edit, sql):
    AREA.add(name, over(edit), ITEMS_CTE + sql)


def listed(events: DataFrame) -> DataFrame:
    """Event values as URIs, one in six of a wrong kind."""
    return events.select(
        "event_id",
        F.concat(F.when(F.col("event_id") % 6 == 0, "app:album:").otherwise("app:track:"), F.col("user_id")).alias("uri"))


AREA.add("list_validate_uris", lambda s, d: L.bad_uri_summary(listed(table(s, d, "events")), order=["event_id"])
         .select("bad", F.array_join("shown", ",").alias("shown"), "more"), """
with u as (select event_id, case when event_id % 6 = 0 then 'app:album:' else 'app:track:' end || user_id as uri from events)
select count(*) as bad, (select string_agg(uri, ',' order by event_id) from (select * from u where uri like 'app:album:%' order by event_id limit 5)) as shown,
  greatest(count(*) - 5, 0) as more from u where uri like 'app:album:%'""")

ask("list_chunk", lambda s, items: L.chunked(items),
    "select list_id, position, uri, position // 100 as chunk from items")


def additions(items: DataFrame) -> DataFrame:
    """The first 130 items of every third list, for the list after it; every second one in front of item 40."""
    return items.where("list_id % 3 = 0 and position < 130").selectExpr(
        "list_id + 1 as list_id", "position as n", "uri", "if(list_id % 2 = 0, cast(40 as bigint), null) as at")


ADDITIONS = """
, adds as (select list_id + 1 as list_id, position as n, uri, case when list_id % 2 = 0 then 40 end as spot
   from items where list_id % 3 = 0 and position < 130)
, sizes as (select list_id, count(*) as size from items group by list_id)
, edits as (select list_id, count(*) as added, min(spot) as spot from adds group by list_id)
"""
ask("list_append_at", lambda s, items: L.append_at(items, additions(items)), ADDITIONS + """
, ordered as (
  select i.list_id, i.uri, case when e.spot is not null and i.position >= e.spot then 2 else 0 end as grp, i.position as p
    from items i left join edits e using (list_id)
  union all select list_id, uri, case when spot is not null and n < 100 then 1 else 3 end, n from adds
)
select list_id, uri, row_number() over (partition by list_id order by grp, p) - 1 as position from ordered""")
ask("list_append_preview", lambda s, items: L.append_preview(items, additions(items)), ADDITIONS + """
select list_id, added as adding, coalesce(size, 0) + added as resulting_size, cast(ceil(added / 100.0) as bigint) as requests
from edits left join sizes using (list_id)""")


def content(items: DataFrame) -> DataFrame:
    return items.where("list_id % 4 = 0 and position % 2 = 0").selectExpr("list_id", "position div 2 as position", "uri")


def cleared(items: DataFrame) -> DataFrame:
    return items.where("list_id % 4 = 1").select("list_id").distinct()


ask("list_replace", lambda s, items: L.replace(items, content(items), cleared(items)), """
select list_id, position, uri from items where list_id % 4 > 1 union all
select list_id, position // 2, uri from items where list_id % 4 = 0 and position % 2 = 0""")
ask("list_replace_preview", lambda s, items: L.replace_preview(items, content(items), cleared(items)), """
, new as (select list_id, position // 2 as position, uri as new_uri from items where list_id % 4 = 0 and position % 2 = 0)
select list_id, position, i.uri as old_uri, new_uri from (select * from items where list_id % 4 < 2) i
full outer join new using (list_id, position)""")
ask("list_replace_counts", lambda s, items: L.replace_counts(items, content(items), cleared(items)), """
select list_id, count(*) as removing, count(*) filter (list_id % 4 = 0 and position % 2 = 0) as adding
from items where list_id % 4 < 2 group by list_id""")


def moves(items: DataFrame) -> DataFrame:
    """One move per list: forward, backward, onto itself or past the end, by list number."""
    return items.where("position = 0").selectExpr(
        "list_id", "list_id % 37 as range_start", "list_id % 11 + 1 as range_length",
        "cast(element_at(array(0, 20, 140, 500), cast(list_id % 4 as int) + 1) as bigint) as insert_before")


def versions(items: DataFrame) -> DataFrame:
    """The present version of each list: here its number and size."""
    return L.list_sizes(items).select("list_id", F.concat_ws("-", "list_id", "size").alias("version"))


def on_version(edits: DataFrame, items: DataFrame) -> DataFrame:
    return edits.join(versions(items), "list_id")


def half_stale(items: DataFrame) -> DataFrame:
    """Edits of every list, those of every third one made on an older version, of every fifth one on none."""
    now = versions(items)
    version = F.when(F.col("list_id") % 5 == 0, None).when(F.col("list_id") % 3 == 0, F.concat("version", F.lit("-old")))
    return now.select("list_id", version.otherwise(F.col("version")).alias("version"))


ask("list_stale_edits", lambda s, items: L.stale_edits(half_stale(items), versions(items)), """
, now as (select list_id, list_id || '-' || count(*) as current from items group by list_id)
select list_id, case when list_id % 5 > 0 then current || '-old' end as version, current
from now where list_id % 5 = 0 or list_id % 3 = 0""")
ask("list_reorder", lambda s, items: L.reorder(items, on_version(moves(items), items), versions(items)), """
, m as (select list_id, list_id % 37 as s, list_id % 11 + 1 as n,
    case list_id % 4 when 0 then 0 when 1 then 20 when 2 then 140 else 500 end as t from items where position = 0)
, placed as (select i.list_id, i.uri, i.position,
    case when i.position >= s and i.position < s + n then t else i.position end as k1,
    case when i.position >= s and i.position < s + n then 0 else 1 end as k2
  from items i join m using (list_id))
select list_id, uri, row_number() over (partition by list_id order by k1, k2, position) - 1 as position from placed""")
ask("list_reorder_preview", lambda s, items: L.moved_items(items, moves(items)), """
select list_id, position as from_position, uri,
  cast(case list_id % 4 when 0 then 0 when 1 then 20 when 2 then 140 else 500 end as bigint) as to_position
from items where position >= list_id % 37 and position < list_id % 37 + list_id % 11 + 1""")


def removals(items: DataFrame) -> DataFrame:
    return items.where("list_id % 2 = 0 and position % 5 = 0").select("list_id", "uri").distinct()


REMOVALS = ", gone as (select distinct list_id, uri from items where list_id % 2 = 0 and position % 5 = 0)"
ask("list_remove", lambda s, items: L.remove(items, on_version(removals(items), items), versions(items), allowed=True), REMOVALS + """
select list_id, uri, row_number() over (partition by list_id order by position) - 1 as position
from items i where not exists (select 1 from gone g where g.list_id = i.list_id and g.uri = i.uri)""")
ask("list_remove_preview", lambda s, items: L.remove_preview(items, removals(items)), REMOVALS + """
select list_id, removing, greatest(size - removing, 0) as resulting_size from
 (select list_id, count(*) as removing from gone group by list_id) join (select list_id, count(*) as size from items group by list_id) using (list_id)""")


def details_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lists: some asked to change name, description or visibility."""
    c = table(spark, sf_dir, "customer")
    current = c.selectExpr("c_custkey as list_id", "c_name as name", "c_mktsegment as description", "c_acctbal > 0 as public")
    wanted = c.selectExpr(
        "c_custkey as list_id", "case c_custkey % 3 when 0 then c_name when 1 then concat(c_name, '!') end as name",
        "if(c_custkey % 2 = 0, 'BUILDING', null) as description", "if(c_custkey % 5 = 0, true, null) as public")
    diff = L.details_diff(current, wanted)
    text = F.array_join(F.transform("changes", lambda x: F.concat_ws(":", x["field"], x["from"], x["to"])), ";")
    return diff.select("list_id", text.alias("changes"), "changed")


AREA.add("list_details_diff", details_diff, """
with d as (select c_custkey as list_id, concat_ws(';',
  case when c_custkey % 3 = 1 then 'name:' || c_name || ':' || c_name || '!' end,
  case when c_custkey % 2 = 0 and c_mktsegment <> 'BUILDING' then 'description:' || c_mktsegment || ':BUILDING' end,
  case when c_custkey % 5 = 0 and not c_acctbal > 0 then 'public:false:true' end) as changes from customer)
select list_id, changes, changes <> '' as changed from d""")


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lists to create, some fields left open."""
    return L.create_lists(table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as list_id", "c_name as name", "if(c_custkey % 2 = 0, c_mktsegment, null) as description",
        "case c_custkey % 3 when 0 then true when 1 then false end as public", "if(c_custkey % 3 = 1, true, null) as collaborative"))


AREA.add("list_create", created, """
select c_custkey as list_id, c_name as name, case when c_custkey % 2 = 0 then c_mktsegment else '' end as description,
  c_custkey % 3 = 0 as public, c_custkey % 3 = 1 as collaborative from customer""")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edits, appended to a JSON-lines log by two jobs, one of which runs twice, and read back."""
    edits = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as list_id", "o_orderpriority as name", "o_orderdate as edited_at",
        "if(o_orderstatus = 'P', 'dry_run', 'executed') as outcome")
    path = work_dir(spark, "audit")
    for action in ("rename", "replace", "rename"):
        audit.append_batch(audit.audit_rows(edits, action, ["name", "list_id"]), path, f"{action} of a day")
    return audit.read_batches(spark, path).drop("batch")


AREA.add("sink_audit_append", audited, """
select strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as ts, action,
  sha256('{"list_id":"' || o_orderkey || '","name":"' || o_orderpriority || '"}') as payload_hash,
  cast(null as varchar) as token, case when o_orderstatus = 'P' then 'dry_run' else 'executed' end as outcome,
  cast(null as varchar) as snapshot_id
from orders, (values ('rename'), ('replace')) as t(action)""")
