"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Texts become tokens: runs of letters, and numbers.  A number is replaced by <num>, a unit
by <unit>, and a capitalised word that does not begin a sentence by <name>; all
other tokens are lower-cased.  Windows of `size` canonical tokens of documents and
benchmark items are joined by their hash.  Per document, item and offset, slot
consistency is checked: each value that the item has in a slot must stand for one
and the same value of the document throughout.  Windows of consistent offsets
count; an item is found in a document if at least `least` of its windows are there.

`kind` is "exact" if all slots hold the item's own values, else "changed".
Windows with fewer than `literal` tokens that are no placeholders say too little and are left out.
Null and empty texts, and items without a window, are never found.  Rows with equal doc_id count as one document.

`find` follows this rule, which its SQL states as well.  `find_any`, for cleaning, also takes
windows of lower-cased tokens in which only numbers and units are placeholders (copies in another case
share those), and leaves out no more than the windows whose own names conflict.

Only the windows of the benchmark are broadcast, and only below `BROADCAST_ROWS`;
beyond it the join shuffles, with document windows without a partner left out by
the join itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import save

SIZE = 8
LITERAL = 4
LEAST = 0.25
BROADCAST_ROWS = 1_000_000

# Fixed values.
UNITS = ["km", "kilometers", "kilometres", "m", "meters", "metres", "cm", "mm", "miles", "mile", "feet", "foot", "inches", "inch",
         "kg", "kilograms", "grams", "g", "pounds", "lb", "tons", "liters", "litres", "ml", "gallons", "seconds", "minutes",
         "hours", "hour", "days", "day", "weeks", "months", "years", "dollars", "euros", "cents", "usd", "eur", "percent",
         "degrees", "mph", "kmh"]
TOKEN = r"(?:^[ \t\r\n]*|[.!?:][ \t\r\n]+|\n[ \t\r\n]*)?\p{L}+|[0-9]+(?:[.,][0-9]+)*"
LEADING = " \t\r\n.!?:"


def canonical(token: Column, place: Column) -> Column:
    """A token that begins a sentence still has its mark, or place 0."""
    code = F.ascii(token)
    first = F.substring(token, 1, 1)
    bare = F.lower(F.ltrim(token, F.lit(LEADING)))
    capital = code.between(65, 90) | ((code > 127) & (first != F.lower(first)))
    small = code.between(97, 122)  # most tokens: neither a mark to take off nor a capital
    return (F.when(small & token.isin(UNITS), F.lit("<unit>")).when(small, F.lower(token))
            .when(code.between(48, 57), F.lit("<num>"))
            .when(capital & (place > 0), F.lit("<name>"))
            .when(bare.isin(UNITS), F.lit("<unit>")).otherwise(bare))


def windows(rows: DataFrame, id_column: str, size: int) -> DataFrame:
    """id, place, h, raw: one row per window; `raw` are its tokens as they stand."""
    tokens = rows.select(id_column, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("raw")).filter(F.size("raw") >= size)
    hashed = tokens.select(id_column, "raw", F.transform("raw", lambda t, i: F.xxhash64(canonical(t, i))).alias("codes"))
    places = F.sequence(F.lit(0), F.size("raw") - size)
    each = F.transform(places, lambda i: F.struct(
        i.alias("place"), F.xxhash64(F.slice("codes", i + 1, size)).alias("h"), F.slice("raw", i + 1, size).alias("raw")))
    return hashed.select(id_column, F.inline(each).alias("place", "h", "raw"))


def slots(raw: Column, place: Column) -> Column:
    """For each token of a window: is it a placeholder?"""
    return F.transform(raw, lambda t, j: canonical(t, place + j).isin("<num>", "<name>", "<unit>"))


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, literal: int = LITERAL, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, kind: one row per document and item found in it."""
    items = windows(benchmark.select("item_id", "text").filter(F.col("text").isNotNull()), "item_id", size)
    items = items.withColumn("slots", slots(F.col("raw"), F.col("place")))
    items = items.filter(F.size(F.filter("slots", lambda s: ~s)) >= literal).select(
        "item_id", F.col("place").alias("item_place"), "h", F.col("raw").alias("item_raw"), "slots")
    totals = items.groupBy("item_id").agg(F.countDistinct("item_place").alias("total"))
    small = items.count() <= BROADCAST_ROWS
    found = (windows(docs.select("doc_id", "text"), "doc_id", size).join(F.broadcast(items) if small else items, "h")
             .select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("offset"), "item_place",
                     F.filter(F.arrays_zip(F.col("slots").alias("slot"), F.col("item_raw").alias("item"), F.col("raw").alias("doc")),
                              lambda x: x["slot"]).alias("filled")))
    # Few rows are left, windows that documents share with the benchmark; they are used twice.
    found = save(found, "shared")
    trim = lambda c: F.ltrim(c, F.lit(LEADING))
    filled = (found.select("doc_id", "item_id", "offset", F.inline("filled").alias("slot", "item", "doc"))
              .groupBy("doc_id", "item_id", "offset", trim(F.col("item")).alias("item"))
              .agg(F.min(trim(F.col("doc"))).alias("low"), F.max(trim(F.col("doc"))).alias("high"))
              .groupBy("doc_id", "item_id", "offset")
              .agg(F.max(F.col("low") != F.col("high")).alias("torn"), F.max(F.col("low") != F.col("item")).alias("changed")))
    places = found.groupBy("doc_id", "item_id", "offset").agg(F.collect_set("item_place").alias("places"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("doc_id", "item_id", "offset")]
    sound = (places.alias("p").join(filled.alias("f"), same, "left").filter(~F.coalesce("f.torn", F.lit(False)))
             .select("p.doc_id", "p.item_id", "p.places", F.coalesce("f.changed", F.lit(False)).alias("changed")))
    return (sound.select("doc_id", "item_id", "changed", F.explode("places").alias("place"))
            .groupBy("doc_id", "item_id").agg(F.countDistinct("place").alias("n_windows"), F.max("changed").alias("changed"))
            .join(F.broadcast(totals) if small else totals, "item_id").withColumn("coverage", F.col("n_windows") / F.col("total"))
            .filter(F.col("coverage") >= least)
            .select("doc_id", "item_id", "n_windows", "coverage",
                    F.when(F.col("changed"), F.lit("changed")).otherwise(F.lit("exact")).alias("kind")))


def literal_form(token: Column) -> Column:
    """The token in lower case, whatever its place; names are no placeholders."""
    bare = F.lower(F.ltrim(token, F.lit(LEADING)))
    return F.when(bare.isin(UNITS), F.lit("<unit>")).when(F.ascii(bare).between(48, 57), F.lit("<num>")).otherwise(bare)


def windows_both(rows: DataFrame, id_column: str, size: int, literal: int = 0) -> DataFrame:
    """id, place, raw, named, h: a row per window and form, one if both forms are equal; at least `literal` tokens are no placeholders."""
    tokens = rows.select(id_column, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("raw")).filter(F.size("raw") >= size)
    forms = tokens.select(id_column, "raw", F.transform("raw", lambda t, i: canonical(t, i)).alias("a"), F.transform("raw", literal_form).alias("b"))
    if literal:
        said = lambda c, i: F.size(F.filter(F.slice(c, i + 1, size), lambda t: ~t.isin("<num>", "<name>", "<unit>"))) >= literal
    else:
        said = lambda c, i: F.lit(True)
    coded = forms.select(id_column, "raw", "a", "b", *[F.transform(c, lambda t: F.xxhash64(t)).alias(f"{c}_codes") for c in "ab"])
    places = F.sequence(F.lit(0), F.size("raw") - size)
    each = F.transform(places, lambda i: F.struct(
        i.alias("place"), F.slice("raw", i + 1, size).alias("raw"), said("a", i).alias("named"),
        F.array_distinct(F.array_compact(F.array(*[F.when(said(c, i), F.xxhash64(F.slice(f"{c}_codes", i + 1, size))) for c in "ab"]))).alias("hs")))
    return coded.select(id_column, F.inline(each).alias("place", "raw", "named", "hs")).select(id_column, "place", "raw", "named", F.explode("hs").alias("h"))


def find_any(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, literal: int = LITERAL, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, kind: all that `find` has, copies in another case, and items only some of whose values changed.

    Numbers and units that are equal in the item may differ in the document (kind "mixed").  A name that stands for
    several others at an offset takes only those windows out in which it is changed.  Coverage is the larger of that over all
    windows and that over the windows `find` counts.
    """
    items = windows_both(benchmark.select("item_id", "text").filter(F.col("text").isNotNull()), "item_id", size, literal)
    items = items.withColumn("names", F.transform("raw", lambda t, j: canonical(t, F.col("place") + j) == "<name>"))
    items = items.select("item_id", F.col("place").alias("item_place"), "h", "named", F.col("raw").alias("item_raw"), "names")
    of_named = F.when(F.col("named"), F.col("item_place"))
    totals = items.groupBy("item_id").agg(F.countDistinct("item_place").alias("total"), F.countDistinct(of_named).alias("total_named"))
    small = items.count() <= BROADCAST_ROWS
    trim = lambda c: F.lower(F.ltrim(c, F.lit(LEADING)))
    filled = F.transform(F.arrays_zip(F.col("names").alias("name"), F.col("item_raw").alias("item"), F.col("raw").alias("doc")),
                         lambda x: F.struct(x["name"].alias("name"), trim(x["item"]).alias("item"), trim(x["doc"]).alias("doc")))
    found = (windows_both(docs.select("doc_id", "text"), "doc_id", size).drop("named").join(F.broadcast(items) if small else items, "h")
             .select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("offset"), "item_place", "named", filled.alias("filled")))
    found = save(found, "shared_any")
    keys = ["doc_id", "item_id", "offset"]
    values = (found.select(*keys, F.inline("filled")).groupBy(*keys, "item")
              .agg(F.max("name").alias("name"), F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high")
              .groupBy(*keys).agg(F.collect_set(F.when(F.col("name"), F.col("item"))).alias("torn")))
    joined = found.alias("l").join(values.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys], "left").select(
        "l.*", F.coalesce("r.torn", F.array().cast("array<string>")).alias("torn"), F.col("r.torn").isNotNull().alias("mixed"))
    sound = joined.filter(~F.exists("filled", lambda x: x["name"] & (x["item"] != x["doc"]) & F.array_contains("torn", x["item"])))
    changed = F.exists("filled", lambda x: x["item"] != x["doc"])
    return (sound.groupBy("doc_id", "item_id").agg(
                F.countDistinct("item_place").alias("n_windows"), F.countDistinct(of_named).alias("n_named"),
                F.max("mixed").alias("mixed"), F.max(changed).alias("changed"))
            .join(F.broadcast(totals) if small else totals, "item_id")
            .withColumn("coverage", F.greatest(F.col("n_windows") / F.col("total"), F.when(F.col("total_named") > 0, F.col("n_named") / F.col("total_named"))))
            .filter(F.col("coverage") >= least)
            .select("doc_id", "item_id", "n_windows", "coverage",
                    F.when(F.col("mixed"), F.lit("mixed")).when(F.col("changed"), F.lit("changed")).otherwise(F.lit("exact")).alias("kind")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item is found by `find_any`; rows without an id stay."""
    return docs.join(find_any(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def _sql_canonical(token: str, place: str) -> str:
    bare = f"lower(ltrim({token}, E' \\t\\r\\n.!?:'))"
    units = ", ".join(f"'{u}'" for u in UNITS)
    return (f"CASE WHEN unicode({token}) BETWEEN 97 AND 122 THEN CASE WHEN {token} IN ({units}) THEN '<unit>' ELSE lower({token}) END "
            f"WHEN unicode({token}) BETWEEN 48 AND 57 THEN '<num>' "
            f"WHEN {place} > 0 AND (unicode({token}) BETWEEN 65 AND 90 OR (unicode({token}) > 127 "
            f"AND substr({token}, 1, 1) <> lower(substr({token}, 1, 1)))) THEN '<name>' "
            f"WHEN {bare} IN ({units}) THEN '<unit>' ELSE {bare} END")


def _sql_windows(table: str, key: str, size: int) -> str:
    token = TOKEN.replace("'", "''")
    return f"""
    SELECT {key}, unnest(list_transform(range(len(raw) - {size - 1}), lambda p: {{
               'place': p, 'raw': raw[p + 1:p + {size}], 'canon': canon[p + 1:p + {size}]}}), recursive := true) FROM (
        SELECT {key}, raw, list_transform(raw, lambda t, i: {_sql_canonical('t', '(i - 1)')}) AS canon
        FROM (SELECT {key}, regexp_extract_all(text, '{token}') AS raw FROM {table}) WHERE len(raw) >= {size})"""


ORACLE = f"""
WITH items AS (SELECT * FROM ({_sql_windows('benchmark', 'item_id', SIZE)})
               WHERE len(list_filter(canon, lambda c: c NOT IN ('<num>', '<name>', '<unit>'))) >= {LITERAL}),
totals AS (SELECT item_id, count(DISTINCT place) AS total FROM items GROUP BY 1),
found AS (SELECT d.doc_id, i.item_id, d.place - i.place AS offset_, i.place, i.canon, i.raw AS item_raw, d.raw AS doc_raw
          FROM ({_sql_windows('documents', 'doc_id', SIZE)}) d JOIN items i ON d.canon = i.canon),
slots AS (SELECT doc_id, item_id, offset_, ltrim(item_raw[j], E' \\t\\r\\n.!?:') AS item, ltrim(doc_raw[j], E' \\t\\r\\n.!?:') AS doc
          FROM (SELECT *, unnest(range(1, {SIZE + 1})) AS j FROM found) WHERE canon[j] IN ('<num>', '<name>', '<unit>')),
values_ AS (SELECT doc_id, item_id, offset_, item, min(doc) AS low, max(doc) AS high FROM slots GROUP BY ALL),
torn AS (SELECT doc_id, item_id, offset_, bool_or(low <> high) AS torn, bool_or(low <> item) AS changed FROM values_ GROUP BY ALL),
sound AS (SELECT f.doc_id, f.item_id, f.place, coalesce(t.changed, false) AS changed
          FROM found f LEFT JOIN torn t ON f.doc_id IS NOT DISTINCT FROM t.doc_id AND f.item_id = t.item_id AND f.offset_ = t.offset_
          WHERE NOT coalesce(t.torn, false)),
counted AS (SELECT doc_id, item_id, count(DISTINCT place) AS n_windows, bool_or(changed) AS changed FROM sound GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_windows / total AS coverage, CASE WHEN changed THEN 'changed' ELSE 'exact' END AS kind
FROM counted JOIN totals USING (item_id) WHERE n_windows / total >= {LEAST}
"""
