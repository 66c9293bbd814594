"""The resolution cache as a stored table: hash buckets, rewritten one by one, made visible by a commit.

    rows/slot=V-B/     rows of bucket B as version V wrote them
    commits/           per commit one file with the live slot of every bucket

The bucket of a row is that of Spark's own bucketed tables, so a lookup reads every bucket in a task of its own and
moves the wanted keys to it; the cache is never shuffled.  An upsert reads and writes the buckets its keys
fall into.  Nothing is overwritten: a failed upsert leaves slots that no commit names.  One writer at a time.

A commit is read through a table of the session's catalog with one partition per live slot; `forget` drops those tables.
"""

from __future__ import annotations

import datetime as dt
import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinlog.operators.cache import CACHE, lookup

COMMITS = "commit long, bucket int, slot string"
NAMES = CACHE.names


class CacheStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        """`buckets` holds for the store's whole life: some hundred MB of rows each is a good size."""
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], COMMITS)

    def last(self) -> tuple[int, dict[int, str]]:
        """Number of the last commit (0: none) and the live slot of each bucket that has one."""
        commits = self._commits()
        rows = commits.join(F.broadcast(commits.agg(F.max("commit").alias("commit"))), "commit").collect()
        return (rows[0]["commit"] if rows else 0), {r["bucket"]: r["slot"] for r in rows}

    def _table(self, name: str, slots: list[str]) -> str:
        """A bucketed table over the store's folder that sees the given slots only."""
        base = self._table_name(name)
        if not self.spark.catalog.tableExists(base):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CACHE)
            self.spark.sql(
                f"create table {base} ({columns}, slot string) using parquet partitioned by (slot) "
                f"clustered by (norm_key) sorted by (norm_key) into {self.buckets} buckets location '{self.root}/rows'")
            if slots:
                named = " ".join(f"partition (slot = '{s}')" for s in slots)
                self.spark.sql(f"alter table {base} add if not exists {named}")
        return base

    def read(self) -> DataFrame:
        """All rows as of the last commit, expired ones included."""
        commit, live = self.last()
        if not live:
            return self.spark.createDataFrame([], CACHE)
        return self.spark.table(self._table(f"c{commit}", sorted(live.values()))).select(*NAMES)

    def lookup(self, wanted: DataFrame, as_of: dt.datetime) -> DataFrame:
        return lookup(wanted, self.read(), as_of)

    def upsert(self, new: DataFrame) -> list[int]:
        """`new` replaces rows of equal key; of several with one key the last resolved stays.  Returns the buckets rewritten.

        Rows without a key can never be looked up and are not stored.
        """
        commit, live = self.last()
        rest = [n for n in NAMES if n not in ("norm_key", "resolved_at")]
        latest = new.where("norm_key is not null").groupBy("norm_key").agg(F.max(F.struct("resolved_at", *rest)).alias("r"))
        latest = latest.select("norm_key", "r.*").select(*[F.col(f.name).cast(f.dataType) for f in CACHE])
        bucket = F.pmod(F.hash("norm_key"), F.lit(self.buckets))
        touched = sorted(r[0] for r in latest.select(bucket).distinct().collect())
        if not touched:
            return []
        version = uuid.uuid4().hex
        old = [live[b] for b in touched if b in live]
        merged = latest
        if old:
            stored = self.spark.table(self._table(f"u{version}", old)).select(*NAMES)
            merged = stored.join(latest.select("norm_key"), "norm_key", "left_anti").select(*NAMES).unionByName(latest)
        target = self._table(f"w{version}", [])
        slot = F.concat_ws("-", F.lit(version), bucket)
        merged.repartition(self.buckets, "norm_key").withColumn("slot", slot).write.insertInto(target)
        live = {**live, **{b: f"{version}-{b}" for b in touched}}
        rows = self.spark.createDataFrame([(commit + 1, b, s) for b, s in sorted(live.items())], COMMITS)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        for name in ("u", "w"):
            self.spark.sql(f"drop table if exists {self._table_name(name + version)}")
        return touched

    def _table_name(self, name: str) -> str:
        return f"spinlog_cache_{zlib.crc32(self.root.encode()):08x}_{name}"

    def forget(self) -> None:
        """Drops this store's tables from the catalog; the data stay, frames made by `read` before can't be used any more."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith(self._table_name("")):
                self.spark.sql(f"drop table if exists {t.name}")
