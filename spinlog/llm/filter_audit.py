"""Filter interaction audit: what five filters remove in each of their 120 orders, per part of a corpus.

Every document is reduced to a mask of the filters it fails.  A part then has at
most 32 mask cells, each with its number of documents, good ones and toxic ones.
The array of all orders is a constant that goes out with the plan.  Each cell folds
across it: `transform` walks the orders, `aggregate` the steps of one, and the
600 structs made so are weighted with the cell's numbers.  The structs of a part's
cells are added element by element.  The folds run on cells, so their cost grows with parts, not documents.

Filters (words are maximal runs without ASCII blanks, case-sensitive):
A fewer than 50 words; B distinct words below 65 % of all; C capitals A-Z above
5 % of the code points; D any of #$%&*|; E the same text as a document of smaller id.

Copies are found by SHA-256.  The smallest id of each text is joined back by text and id,
so a text that a third of all rows share meets no join as one key.

Defined cases: null texts are empty; a null source is the part ''; a row without id
never fails E, has no label, and no row fails E because of it; rows that repeat an id and its text do not fail E
because of each other.  A document with several labels counts as good (toxic) if one says so.
Other columns are not read.  An empty table gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import save

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MIN_WORDS, DISTINCT_PCT, CAPITALS_PCT = 50, 65, 5
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_BLANKS = " \t\n\x0b\f\r"
_ROW = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def _bit(letter: str) -> int:
    return 1 << LETTERS.index(letter)


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the mask of the filters A to D it fails."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    cut = read.select("*", F.split(F.btrim("text", F.lit(_BLANKS)), r"[\x20\x09-\x0D]+").alias("words"))
    sized = cut.select(
        "doc_id", "part", "text",
        F.when(F.col("words")[0] == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.when(F.col("words")[0] == "", 0).otherwise(F.size(F.array_distinct("words"))).cast("long").alias("n_distinct"))
    fails = {
        "A": F.col("n_words") < MIN_WORDS,
        "B": 100 * F.col("n_distinct") < DISTINCT_PCT * F.col("n_words"),
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > CAPITALS_PCT * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    mask = sum((F.when(c, _bit(k)).otherwise(0) for k, c in fails.items()), F.lit(0))
    return sized.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows per part."""
    rows = save(slim(docs), "filter-masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    joined = rows.join(firsts, ["digest", "doc_id"], "left").join(said, "doc_id", "left")
    return joined.select(
        "part", F.when(copy, F.col("mask") + _bit("E")).otherwise(F.col("mask")).alias("mask"), "good", "toxic",
    ).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")])


def _steps(cell: Column, orders: Column) -> Column:
    """The 600 structs of one cell: per order and step, the cell's numbers where they count, else zero."""

    def step(before: Column, bit: Column) -> Column:
        failed, reached = cell.mask.bitwiseAND(bit) != 0, cell.mask.bitwiseAND(before) == 0
        here = {
            "kept": (reached & ~failed, cell.n), "removed": (reached & failed, cell.n), "redundant": (~reached & failed, cell.n),
            "unique_fails": (cell.mask == bit, cell.n), "good_lost": (reached & failed, cell.good), "toxic_lost": (reached & failed, cell.toxic),
        }
        return F.struct(*[F.when(here[c][0], here[c][1]).otherwise(F.lit(0).cast("long")).alias(c) for c in COUNTS])

    start = F.struct(F.lit(0).alias("before"), F.array().cast(f"array<{_ROW}>").alias("rows"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(
        order, start,
        lambda acc, bit: F.struct(acc.before.bitwiseOR(bit).alias("before"),
                                  F.concat(acc.rows, F.array(step(acc.before, bit))).alias("rows")),
        lambda acc: acc.rows)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts: 600 rows per part of `docs`."""
    orders = F.array(*[F.array(*[F.lit(_bit(c)) for c in o]) for o in ORDERS])
    names = F.array(*[F.lit(o) for o in ORDERS])
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), len(ORDERS) * len(LETTERS))
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    added = parts.select("part", F.aggregate(
        "cells", zero, lambda acc, cell: F.zip_with(
            acc, _steps(cell, orders), lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS]))).alias("rows"))

    def removed_by(bit: int) -> Column:
        own = F.zip_with("rows", F.flatten(orders), lambda r, at: F.when(at == bit, r.removed).otherwise(F.lit(0).cast("long")))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    bits = [_bit(c) for c in LETTERS]
    by_filter = F.map_from_arrays(F.array(*map(F.lit, bits)), F.array(*map(removed_by, bits)))
    rows = added.select("part", by_filter.alias("shapley_of"), F.posexplode("rows").alias("at", "row"))
    order, step = (F.col("at") / len(LETTERS)).cast("int"), F.col("at") % len(LETTERS)
    return rows.select(
        "part", names[order].alias("filter_order"), (step + 1).cast("int").alias("step"),
        *[F.col(f"row.{c}").alias(c) for c in COUNTS], F.col("shapley_of")[orders[order][step]].alias("shapley"))


ORACLE = r"""
WITH docs AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marked AS (
    SELECT doc_id, part,
           CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM docs),
said AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM marked LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
    FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
    JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (
    SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
folded AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM folded
"""
