"""Ingest of very many small files: what may not grow with their number, and what is done once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from registry.ingest import BATCH, write_export
from spinlog.operators.plays import extract_fields
from spinlog.schema import RAW_PLAYS, ExportFormat
from spinlog.sources import export, ranges
from spinlog.sources.testtables import export_files


def test_names_of_many_files_stand_in_no_plan(spark, tmp_path, monkeypatch):
    """The names of all new files were spelled out in a filter, and so in every plan and message about it."""
    for i in range(40):
        (tmp_path / f"name {i:02d}.json").write_text(f'[{{"ts":"x","ms_played":{i}}}]')
    (tmp_path / "large.json").write_text("[" + ",".join(f'{{"ts":"x","ms_played":{i}}}' for i in range(2000)) + "]")
    monkeypatch.setattr(ranges, "FEW", 10, raising=False)
    plans = []
    for name in ("_whole_files", "_texts"):
        def seen(*args, made=getattr(ranges, name), **kw):
            df = made(*args, **kw)
            plans.append(df._jdf.queryExecution().toString())
            return df
        monkeypatch.setattr(ranges, name, seen)
    wanted = [f"name {i:02d}.json" for i in range(0, 40, 2)] + ["large.json"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = export.scan_export(spark, str(tmp_path), only=spark.createDataFrame([(n,) for n in wanted], "source_file string"))
        got = {(r.source_file, r.source_index) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(n, 0) for n in wanted} | {("large.json", i) for i in range(2000)}
    assert len(plans) == 2 and not [n for n in wanted for plan in plans if "FileScan" in plan and n in plan]


def test_export_files_are_whole_and_alone_in_their_folder(spark, tmp_path):
    """Hadoop's writer put a checksum file beside each, and started a process for either."""
    days = "timestamp_ntz'1997-03-01' + make_dt_interval(cast(id % 1500 as int))"
    orders = spark.range(0, 3000, 2).selectExpr("id as o_orderkey", "id % 17 as o_custkey", "if(id % 3 = 0, null, 'F') as o_orderstatus",
                                                "id * 1.5D as o_totalprice", f"if(id % 50 = 0, null, {days}) as o_orderdate", "'\"2, HIGH\"' as o_orderpriority")
    twice = orders.where("o_orderkey % 40 = 0").withColumn("o_totalprice", F.lit(7.0))
    orders.unionByName(twice).write.parquet(str(tmp_path / "orders.parquet"))
    target = str(tmp_path / "a folder")
    for batch in (1, 2, 3):
        write_export(spark, str(tmp_path), f"{BATCH} = {batch}", target, f"batch{batch}")
    made = sorted(r["content"] + b"\n" for batch in (1, 2, 3) for r in export_files(spark, str(tmp_path), f"{BATCH} = {batch}").collect())
    written = os.listdir(target)
    assert len(written) == len(made) and all(n.endswith(".txt") for n in written)
    assert sorted(open(f"{target}/{n}", "rb").read() for n in written) == made
    assert spark.read.text(f"{target}/*-batch2.txt").count() > 0


def test_a_record_is_parsed_once(spark):
    """The filter on `ts` parsed each record again, and a time was read twice."""
    rows = [(1, "f", i, p) for i, p in enumerate(['{"ts":"2020-01-01T00:00:00Z","ms_played":"5"}', '{"ts":null}', "{}", None])]
    fields = extract_fields(spark.createDataFrame(rows, RAW_PLAYS), ExportFormat())
    assert [(r.source_index, str(r.ts_utc), r.ms_played) for r in fields.collect()] == [(0, "2020-01-01 00:00:00", 5)]
    plan = fields._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert plan.count("try_cast(r") and plan.count("as timestamp_ntz) END") == 1
