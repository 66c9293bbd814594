"""Steps whose tasks or rows must grow no faster than the data."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from spinlog.functions import fuzzy
from spinlog.operators import match
from spinlog.sources import ranges


def test_small_files_are_hashed_by_few_tasks(spark, tmp_path):
    """A long file stays in one piece beside many small ones, which share tasks."""
    texts = {f"f{i:03d}.json": f'[{{"ts":"x","ms_played":{i}}}]' for i in range(200)}
    texts["long.json"] = "[" + ",".join(f'{{"ts":"x","ms_played":{i}}}' for i in range(20_000)) + "]"
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    hashes = ranges.file_hashes(session, str(tmp_path))
    assert {r["source_file"]: r["file_hash"] for r in hashes.collect()} == {
        name: hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}
    assert len(hashes.inputFiles()) <= 40  # one written part per task: there were 201


def test_costly_rows_of_one_small_file_are_dealt_to_many_tasks(spark):
    """Text forms and signatures took one task each, whatever the rows, where a scan or a shuffle had few bytes."""
    one = spark.range(0, 2_000, 1, 1)
    tracks = one.selectExpr(
        "cast(id as string) as id", "concat('song number ', id) as name", "concat('u', id) as uri",
        "array(named_struct('id', 'a', 'name', 'The Same', 'uri', 'a')) as artists",
        "named_struct('id', 'b', 'name', 'Album', 'uri', 'b', 'release_date', '2001') as album", "named_struct('isrc', 'i') as external_ids")
    asked = one.selectExpr("id as input_idx", "'same' as artist", "concat('song numbr ', id) as title",
                           "cast(null as string) as album", "cast(null as string) as year")
    index, wanted = match.catalog_index(tracks), match.wanted_keys(asked)
    cores = spark.sparkContext.defaultParallelism
    assert index.rdd.getNumPartitions() >= cores and wanted.rdd.getNumPartitions() >= cores
    assert index.count() == wanted.count() == 2_000
    signed = match.signed(wanted.coalesce(1), "title_norm", "probes")
    assert len(signed.inputFiles()) >= cores
    brute = sum(len(r["s"]) for r in wanted.select(fuzzy.signatures(F.col("title_norm")).alias("s")).collect())
    assert signed.count() == brute


def test_similar_titles_meet_in_as_many_tasks_as_a_shuffle_has(spark):
    """Adaptive execution joined all partitions of well compressed copies into one task's memory."""
    keys = spark.range(500).selectExpr(
        "concat('artist ', id) as artist_norm", "concat('some old sng ', id % 7) as title_norm", "0 as excused_album", "'' as want_year",
        "0 as excused_title", "concat('artist ', id) as artist_key")
    index = spark.range(500).selectExpr(
        "cast(id as string) as track_id", "'u' as uri", "'n' as name", "'i' as isrc", "'2001' as release", "'2001' as year",
        "'x' as title_norm", "concat('some old song ', id % 7) as stripped_norm", "0 as title_mask", "0 as album_mask", "0 as artist_pos",
        "concat('a', id) as artist_id", "'A' as artist_name", "concat('artist ', id) as artist_norm")
    pairs = match.weak_pairs(keys, index, "artist_norm")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert pairs.select("artist_norm").distinct().count() == pairs.count() == 500
