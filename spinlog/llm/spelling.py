"""Spelling variants: words one edit apart, found by a relational trie frontier, and the form each one leads to.

All words of the corpus stand in two tries, one over the words and one over the
reversed words.  A node is the hash of its prefix; the edge table has a row for each child of a node, with
the letters that follow the child and whether a word ends there, and is stored by level.
The frontier holds states (word, position, node, edits).  One level joins it with
its edges on the node, so each edge is read once: a state without an edit goes on by the word's own letter, and spawns
a state with one edit for each child that replaces that letter or stands before it; a state
with one edit goes on by the word's own letter only, or ends.  States whose next letter does not
follow their node are dropped before the next shuffle.  A one-edit state at the end of its word, on a node where a
word ends, is a pair of neighbours.

The edit lies in the word's first half or in its second, and the half without it is a
known prefix of one of the two tries, so states start there: near the root, where
nearly every letter follows, nothing is spawned.  Each pair is found once: from the shorter word, or from the one with
the smaller letter; a letter put into a run of itself stands behind the run.

Words of more than `LONG` letters start in the forward trie at every `LONG`/2-th letter, each start
walks to the next one, and their states with an edit look the whole new word up at once.
So the number of levels is bounded, and no word is left out.

Defined cases: null texts have no words; a null doc_id hashes as an empty string; repeated rows count as often as they stand;
an empty table, or one without words of three occurrences, gives no row.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import save, scratch

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
LONG = 64
FOLD_AT = 500_000  # distinct words a task holds before it sends them on


def torn(run: str, h: int) -> str:
    """The run, without one letter if its hash says so."""
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words that are long and frequent enough."""

    def counted(batches):
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = crc(f"{'' if doc_id is None else doc_id}:".encode())
                small = (text or b"").lower().decode()  # of bytes: A-Z only
                for run, n in Counter(RUNS.findall(small)).items():
                    word = torn(run, crc(run.encode(), start))
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= FOLD_AT:
                    yield out()
                    held.clear()
        if held:
            yield out()

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return read.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _node(back: Column, prefix: Column) -> Column:
    return F.xxhash64(back, prefix)


def _level(depth: Column) -> Column:
    """Depths beyond `LONG` share levels: only starts of long words stand there, each of which walks less than `LONG`/2 levels."""
    return F.when(depth <= LONG, depth).otherwise(LONG + 1 + depth % (LONG // 2)).cast("int")


def _by_level(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.partitionBy("level").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trie(vocabulary: DataFrame) -> DataFrame:
    """The edges of both tries, by level: node, sym, child, next (the letters that follow the child), ends (whether a word ends there).

    A word's edges above the half where states of its own length, or of one letter less, start are left out.
    The reversed trie holds what a word of `LONG` letters can reach.
    """
    shorter = F.length("word") - 1
    first = F.when(F.length("word") > LONG, 0).otherwise(F.expr("(length(word) - 1) div 2"))
    both = vocabulary.select(F.lit(False).alias("back"), F.col("word").alias("w"), first.alias("first")).union(
        vocabulary.filter(F.length("word") <= LONG + 1).select(F.lit(True), F.reverse("word"), shorter - F.expr("(length(word) - 1) div 2")))
    steps = both.select("back", "w", F.explode(F.sequence("first", F.length("w") - 1)).alias("d"))
    edges = steps.select(
        _node(F.col("back"), F.expr("substring(w, 1, d)")).alias("node"), F.expr("substring(w, d + 1, 1)").alias("sym"),
        _node(F.col("back"), F.expr("substring(w, 1, d + 1)")).alias("child"), _level(F.col("d")).alias("level"),
        (F.col("d") + 1 == F.length("w")).alias("ends"),
    ).groupBy("node", "sym", "child", "level").agg(F.max("ends").alias("ends"))
    edges = save(edges, "edges")
    following = edges.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_set("sym")).alias("next"))
    return edges.join(following, "child", "left").select("node", "sym", "child", F.coalesce("next", F.lit("")).alias("next"), "ends", "level")


def _starts(vocabulary: DataFrame) -> DataFrame:
    """States without an edit, by level: w, n, back, pos, stop (a start walks up to here), node."""
    half = F.expr("length(word) div 2")
    short, long = vocabulary.filter(F.length("word") <= LONG), vocabulary.filter(F.length("word") > LONG)
    forth = short.select(F.col("word").alias("w"), "n", F.lit(False).alias("back"), half.alias("pos"), F.length("word").alias("stop"))
    back = short.select(F.reverse("word"), "n", F.lit(True), F.length("word") - half, F.length("word"))
    at = F.explode(F.sequence(F.lit(0), F.length("word"), F.lit(LONG // 2)))
    cut = long.select(F.col("word").alias("w"), "n", F.lit(False).alias("back"), at.alias("pos"))
    cut = cut.withColumn("stop", F.least(F.col("pos") + LONG // 2 - 1, F.length("w")))
    every = forth.union(back).union(cut)
    return every.select("w", "n", "back", F.col("pos").cast("int"), F.col("stop").cast("int"),
                        _node(F.col("back"), F.expr("substring(w, 1, pos)")).alias("node"), F.lit(0).alias("edits"), _level(F.col("pos")).alias("level"))


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge further, ended ones included; `whole` is the new word of a long one."""
    size, own = F.length("w"), F.expr("substring(w, pos + 1, 1)")
    long, clean, inside = size > LONG, F.col("edits") == 0, F.col("pos") < size
    # A letter is not put in before itself, and the place between the halves belongs to the forward trie.
    before = F.when(F.col("back"), F.expr("if(pos > 0, substring(w, pos, 1), '')")).otherwise(own)
    open_place = ~F.col("back") | (F.col("pos") > F.expr("length(w) - length(w) div 2"))

    def goes_on(pos: Column) -> Column:
        return long | F.when(pos == size, F.col("ends")).otherwise(F.contains(F.col("next"), F.substring("w", pos + 1, F.lit(1))))

    kept = clean & inside & (F.col("sym") == own) & (F.col("pos") < F.col("stop")) & (F.col("next") != "")
    replaced = clean & inside & (F.col("sym") > own) & goes_on(F.col("pos") + 1)
    followed = ~clean & inside & (F.col("sym") == own) & goes_on(F.col("pos") + 1)
    put_in = clean & open_place & (F.col("sym") != before) & goes_on(F.col("pos"))
    moved = (frontier.join(edges.drop("level"), "node").filter(kept | replaced | followed | put_in)
             .select("*", F.explode(F.array(F.when(kept | replaced | followed, F.col("pos") + 1), F.when(put_in, F.col("pos")))).alias("to"))
             .filter("to is not null"))
    edited = ~clean | (F.col("to") == F.col("pos")) | (F.col("sym") != own)
    head, tail = F.expr("substring(w, 1, pos)"), F.substring("w", F.col("to") + 1, size)
    return moved.select(
        "w", "n", "back", F.col("to").alias("pos"), "stop", F.col("child").alias("node"), edited.cast("int").alias("edits"),
        F.when(long & edited, F.concat(head, "sym", tail)).alias("whole"), (edited & (long | (F.col("to") == size))).alias("done"))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: both directions of every pair of words one edit apart."""
    edges, starts = _by_level(trie(vocabulary), "trie"), _by_level(_starts(vocabulary), "starts")
    begun = {r["level"] for r in starts.select("level").distinct().collect()}  # at most 1.5 `LONG` levels
    ended, waiting = [], None
    for level in range(LONG + 1 + LONG // 2):
        frontier = starts.filter(F.col("level") == level).drop("level") if level in begun else None
        # What walks on from depth `LONG` passes over the level where later starts begin.
        if waiting is not None and level != LONG + 1:
            frontier, waiting = waiting if frontier is None else frontier.unionByName(waiting), None
        if frontier is not None:
            moved = save(_step(frontier, edges.filter(F.col("level") == level)), "frontier")
            ended.append(moved.filter("done"))
            on = moved.filter("not done").drop("done", "whole")
            if not on.isEmpty():
                waiting = on if waiting is None else waiting.unionByName(on)
    if not ended:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    states = ended[0]
    for more in ended[1:]:
        states = states.unionByName(more)
    states = states.withColumn("word", F.when(F.col("back"), F.reverse("w")).otherwise(F.col("w")))
    ends = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    nodes = ends.select(F.explode(F.array(
        F.struct(_node(F.lit(False), F.col("near")).alias("node")), F.struct(_node(F.lit(True), F.reverse("near")).alias("node")),
    )).alias("at"), "near", "near_n").select("at.node", "near", "near_n")
    pairs = (states.filter("whole is null").join(nodes, "node").select("word", "n", "near", "near_n")
             .union(states.filter("whole is not null").join(ends, F.col("whole") == F.col("near")).select("word", "n", "near", "near_n")))
    pairs = pairs.filter(F.levenshtein("word", "near", 1) == 1)  # two prefixes may share a hash
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of `docs` that is long and frequent enough."""
    vocabulary = save(words(docs), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = (neighbours(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.min("n").alias("own"))
            .select("word", "n_near", F.when(-F.col("best.less") >= RATIO * F.col("own"), F.col("best.near")).alias("form"),
                    (-F.col("best.less")).alias("near_n")))
    near = save(near, "near")
    # Counts at least double from a word to its form, so a chain has at most 63 links and halves each round.
    links = near.filter("form is not null").select("word", F.col("form").alias("root"))
    while not links.isEmpty():
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        jumped = save(links.join(ahead, "root", "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        links = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return (vocabulary.join(near, "word", "left").join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n")))
