"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SHARED = "/tmp/spinlog-shared"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one that the session names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_SHARED
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: the lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a, b): rows (node, root), root the smallest node reachable.

    Each round gives every node the smallest label among itself and its
    neighbours, then follows that label once (a label is itself a node).  Both
    steps are joins with pre-aggregated minima, so a hub's edges are never
    gathered.  Stops when no label changed; each round is written out.
    """
    both = save(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                  .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        step = save(step, "step")
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        labels = save(step.join(jump, "mid", "left")
                      .select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old"), "labels")
        if labels.filter("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
