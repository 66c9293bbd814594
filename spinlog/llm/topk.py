"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers and grouped by length (Euclidean norm) into
buckets of at most `BUCKET_ROWS` rows, longest first; queries into blocks of
`QUERY_ROWS`.  Each query first meets the bucket of the longest vectors, which
gives it a lower bound for its k-th best product.  For every other bucket that
bound turns into a cosine threshold of its own, bound / (|q| * longest of the
bucket).  A bucket whose threshold exceeds 1 is left out for the query.  Otherwise
it is searched by the cheaper of two prunings: by length (vectors long enough to
reach the bound) or by coordinate (vectors whose normalised value at the query's
largest coordinate lies in the range that the threshold allows).  What is left
is verified by exact integer products.  Bounds admit equal scores, so ties are not lost.

Defined cases: a vector that is null, empty or holds a null or a non-finite component takes no part;
shorter vectors count as ending in zeros; a query with fewer candidates gets
all of them; rows with a null id take no part; rows repeating an id are candidates each,
and repeated queries are answered once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinlog.llm.common import save

BUCKET_ROWS = 8192
QUERY_ROWS = 2048
EPS = 1e-9


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>, norm) of the rows that take part."""
    v = F.col("embedding")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return (vectors.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & (F.size(v) > 0) & whole)
            .select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))))


def blocks(rows: DataFrame, name: str, size: int, *key: Column) -> DataFrame:
    """Packs rows into blocks of about `size` by ranges of `key`: (name, ids, dims, data), long vectors first in each.

    Ranges come from the sort shuffle's own sampling, rows are packed where they
    land; blocks are numbered by partition and place, so none holds more than `size` rows.
    """
    from pyspark import TaskContext

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held = TaskContext.get().partitionId(), 0, []

        def block(rows: list) -> pd.DataFrame:
            nonlocal n
            dims = max(len(v) for _, v in rows)
            data = np.zeros((len(rows), dims), "<i8")
            for i, (_, v) in enumerate(rows):
                data[i, :len(v)] = v
            n += 1
            return pd.DataFrame({name: [part * (1 << 20) + n - 1], "ids": [np.array([i for i, _ in rows], "<i8").tobytes()],
                                 "dims": [dims], "data": [data.tobytes()]})

        for frame in batches:
            held += list(zip(frame["vec_id"], frame["v"], strict=True))
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:]
        if held:
            yield block(held)

    n_rows = rows.count()
    parts = max(1, -(-n_rows // size))
    return (rows.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("vec_id", "v")
            .mapInPandas(packed, f"{name} long, ids binary, dims int, data binary"))


def matrix(ids: bytes, dims: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(-1, dims)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products.  Floating point is used where every partial sum is a whole number below 2**53."""
    dims = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :dims], vectors[:, :dims]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * dims
    if bound < 2.0 ** 53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    if bound >= 2.0 ** 63:
        raise ValueError("inner products do not fit 64 bits: use a smaller scale")
    return queries @ vectors.T


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[int]:
    """Places of the k best, ties to the smaller id, without the query's own id."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        cut = np.partition(scores[places], len(places) - k)[len(places) - k]
        places = places[scores[places] >= cut]
    return places[np.lexsort((ids[places], -scores[places]))][:k].tolist()


def search(q_ids, q, v_ids, v, bounds, k: int) -> tuple[list, list, list]:
    """Best k of one bucket for each query; `bounds` (or None) are lower bounds of the k-th best products."""
    order = np.argsort(-np.einsum("ij,ij->i", v.astype(float), v.astype(float)), kind="stable")
    v, v_ids = v[order], v_ids[order]
    lengths = np.sqrt(np.einsum("ij,ij->i", v.astype(float), v.astype(float)))
    q_lengths = np.sqrt(np.einsum("ij,ij->i", q.astype(float), q.astype(float)))
    out: tuple[list, list, list] = ([], [], [])
    dims = min(q.shape[1], v.shape[1])
    unit = v[:, :dims] / np.maximum(lengths, EPS)[:, None]
    columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    everyone: list[int] = []
    for i in range(len(q)):
        bound = -np.inf if bounds is None else bounds[i]
        if bound <= 0 or q_lengths[i] == 0:
            everyone.append(i)
            continue
        local = bound / (q_lengths[i] * max(lengths[0], EPS))  # the bucket's cosine threshold for this query
        if local > 1 + EPS:
            continue
        n_long = int(np.searchsorted(-lengths, -(bound / q_lengths[i]) * (1 - EPS), "right"))
        focus = int(np.argmax(np.abs(q[i, :dims])))
        if focus not in columns:
            by = np.argsort(unit[:, focus], kind="stable")
            columns[focus] = by, unit[by, focus]
        by, values = columns[focus]
        at = q[i, focus] / q_lengths[i]
        threshold = min(1.0, local)
        slack = np.sqrt(max(0.0, (1 - threshold ** 2) * (1 - at ** 2))) + 1e-7
        lo, hi = np.searchsorted(values, [at * threshold - slack, at * threshold + slack])
        if at * 1 > threshold:  # the allowed range reaches to the end of the axis
            hi = len(values)
        if -at > threshold:
            lo = 0
        if min(n_long, hi - lo) > len(v) // 2:
            everyone.append(i)
            continue
        picked = np.arange(n_long) if n_long <= hi - lo else np.sort(by[lo:hi])
        scores = products(q[i:i + 1], v[picked])[0]
        keep = scores >= bound
        _take(out, q_ids[i], scores[keep], v_ids[picked][keep], k)
    for begin in range(0, len(everyone), 256):  # little to prune: products of whole blocks
        some = everyone[begin:begin + 256]
        for i, scores in zip(some, products(q[some], v), strict=True):
            bound = -np.inf if bounds is None else bounds[i]
            keep = scores >= bound
            _take(out, q_ids[i], scores[keep], v_ids[keep], k)
    return out


def _take(out: tuple[list, list, list], own: int, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
    for j in best(scores, ids, own, k):
        out[0].append(own)
        out[1].append(int(ids[j]))
        out[2].append(int(scores[j]))


FOUND = "query_id long, vec_id long, score long"


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row for each query row, its own id left out."""
    rows = save(quantised(vectors, scale), "vectors")
    buckets = save(blocks(rows, "bucket", BUCKET_ROWS, F.desc("norm"), F.col("vec_id")), "buckets")
    queries = rows.filter(is_query).dropDuplicates(["vec_id"])
    queries = save(blocks(queries, "block", QUERY_ROWS, F.col("vec_id")), "queries")
    first = buckets.agg(F.min("bucket")).first()[0]
    q = queries.select("block", F.struct("ids", "dims", "data").alias("q"))

    def seek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                q_ids, q_rows = matrix(row.q["ids"], row.q["dims"], row.q["data"])
                v_ids, v_rows = matrix(row.v["ids"], row.v["dims"], row.v["data"])
                bounds = None if row.bounds is None else np.frombuffer(row.bounds, float)
                found = search(q_ids, q_rows, v_ids, v_rows, bounds, k)
                yield pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]}, dtype="int64")

    def pairs(buckets: DataFrame, q: DataFrame) -> DataFrame:
        # Every block of the stated query set meets every bucket: packed blocks, not rows, are paired.
        v = buckets.select("bucket", F.struct("ids", "dims", "data").alias("v"))
        blocks_of = q.select("block").agg(F.collect_set("block").alias("all"))
        # one number per QUERY_ROWS queries
        n = F.lit(blocks_of.first()["all"])
        v = v.withColumn("block", F.explode(n)) if blocks_of.first()["all"] else v.withColumn("block", F.lit(0).cast("long")).limit(0)
        return v.join(q, "block").repartition("block", "bucket").select("q", "v", "bounds")

    head = buckets.filter(F.col("bucket") == F.lit(first))
    seeds = save(pairs(head, q.withColumn("bounds", F.lit(None).cast("binary"))).mapInPandas(seek, FOUND), "seeds")
    least = seeds.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # The bound of each query, in the order of its block.
    spread = queries.select("block", "ids").mapInPandas(_unpacked, "block long, place int, query_id long")
    bounds = (spread.join(least, "query_id", "left")
              .groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("n") >= k, F.col("least")).alias("b")))).alias("b"))
              .select("block", F.transform("b", lambda x: F.coalesce(x["b"].cast("double"), F.lit(float("-inf")))).alias("b"))
              .mapInPandas(_packed, "block long, bounds binary"))
    rest = pairs(buckets.filter(F.col("bucket") != F.lit(first)), q.join(bounds, "block"))
    found = save(rest.mapInPandas(seek, FOUND), "found").unionByName(seeds)
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for block, ids in zip(frame["block"], frame["ids"], strict=True):
            ids = np.frombuffer(ids, "<i8")
            yield pd.DataFrame({"block": block, "place": np.arange(len(ids), dtype="int32"), "query_id": ids})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield pd.DataFrame({"block": frame["block"], "bounds": [np.array(b, float).tobytes() for b in frame["b"]]})
