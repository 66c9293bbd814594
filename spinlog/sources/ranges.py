"""Export files of any size, read in byte ranges by many tasks.

Spark's text source cuts a file into ranges and puts their borders where a `}` ends;
so a row is the text up to the next `}`, whatever the file's line breaks.  To cut
records, a range must know whether it begins inside a string, and how deep.  Both follow from
the ranges before it: a first pass counts quotes and, for either answer to the first question, brackets;
running sums over a file's ranges give each its beginning.  The second pass cuts elements at
the commas of the outer array.  An element that lies in several ranges is put together by its
index; all others never leave their task.  Each element is then checked by Spark's JSON parser.

A file that is small, and that Spark would not cut, needs no first pass: it begins outside of everything.
It is read as one row, cut in one go, and its elements are parsed before they are stored.

The SHA-256 of a file has no parallel form: one task streams each large file, and holds one batch of rows;
that of a small file is taken from its one row.

A folder may hold very many files.  It is listed once (`listing`) for all that is asked of it, and many
names are joined, as a filter that spells them out would stand in every plan and every message about one.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spinlog.session import materialize, work_dir

END = b"}"
PER_TASK, PER_FILE = 128 << 20, 4 << 20  # bytes a task hashes, if no file is longer, and what a file counts beside its own
WHOLE, PER_BATCH, PER_OPEN = 4 << 20, 16, 256 << 10  # bytes of a file cut in one go, such files to a batch, and what one counts beside its bytes
FEW = 1000  # names that a plan may spell out
_BLANK = b" \t\r\n"
_HASHES = "source_file string, file_hash string"
_TEXTS = "source_file string, start long, size long, text binary"
_SUMMARY = "source_file string, start long, size long, bytes long, quotes long, deeper0 long, deeper1 long, begin string"
_PIECES = "source_file string, start long, at long, head boolean, tail boolean, outside boolean, text binary"
_CUT = "source_file string, source_index long, text binary, array boolean, balanced boolean, around string"


def _file_name() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def listing(spark: SparkSession, directory: str, pattern: str = "*.json") -> DataFrame:
    """The files as Spark's binary source has them, listed once; small files share a task."""
    session = spark.newSession()
    session.conf.set("spark.sql.files.openCostInBytes", str(PER_OPEN))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PER_BATCH))
    return session.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)


def _wanted(files: DataFrame, only: DataFrame | list[str] | None) -> DataFrame:
    """The files that `only` names: few names choose the files before any is read, many are joined."""
    if only is None:
        return files
    if isinstance(only, DataFrame):
        only = only.select("source_file").distinct()
        names = [r["source_file"] for r in only.limit(FEW + 1).collect()]
        if len(names) > FEW:
            # As many names as the listing holds on the driver, at most.
            return files.withColumn("source_file", _file_name()).join(F.broadcast(only), "source_file", "left_semi")
        only = names
    return files.withColumn("source_file", _file_name()).where(_file_name().isin(only))


def _texts(spark: SparkSession, directory: str, pattern: str, only: DataFrame | list[str] | None = None, above: int = 0) -> DataFrame:
    """The texts between one `}` and the next, with the range they begin in; in order within a range.

    `only` names files, of more than `above` bytes.
    """
    lines = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", pattern).text(directory)
    lines = lines.where(F.col("_metadata.file_size") > above)
    return _wanted(lines.select("value", "_metadata"), only).select(
        _file_name().alias("source_file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("text"))


def _by_range(batches):
    """(range and what else stands in front of the text, texts of a batch that begin in it), in order."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True)
        for key, group in groupby(rows, key=lambda r: r[:-1]):
            yield key, [r[-1] for r in group]


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [(c.split()[0], types[c.split()[1]]) for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _large(files: DataFrame, above: int) -> Row:
    """How many files are larger, their bytes and the longest; the others are not opened."""
    sizes = files.where(F.col("_metadata.file_size") > above).select(F.col("length").alias("size"))
    return sizes.agg(F.count("size").alias("files"), F.sum("size").alias("total"), F.max("size").alias("longest")).first()


def _unsplit(spark: SparkSession, large: Row) -> SparkSession:
    """A session that cuts no file, and deals several to one task."""
    share = (large["total"] + large["files"] * PER_FILE) // spark.sparkContext.defaultParallelism
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(max(large["longest"], min(PER_TASK, share))))
    session.conf.set("spark.sql.files.openCostInBytes", str(PER_FILE))
    session.conf.set("spark.sql.files.minPartitionNum", "1")  # more would make splits smaller than the longest file
    return session


def file_hashes(spark: SparkSession, directory: str, pattern: str = "*.json", files: DataFrame | None = None) -> DataFrame:
    """source_file, file_hash: the SHA-256 of each file's bytes (files without a byte have no row).

    `files` is the folder's `listing`, if it was made before.
    """
    files = listing(spark, directory, pattern) if files is None else files
    limit = _whole_limit(spark)
    small = files.where(F.col("_metadata.file_size").between(1, limit))
    path = work_dir(spark, "hashes")
    small.select(_file_name().alias("source_file"), F.sha2("content", 256).alias("file_hash")).write.parquet(path)
    large = _large(files, limit)
    if large["files"]:
        _streamed_hashes(_texts(_unsplit(spark, large), directory, pattern, above=limit)).write.mode("append").parquet(path)
    return spark.read.schema(_HASHES).parquet(path)


def _streamed_hashes(texts: DataFrame) -> DataFrame:
    """The hash of each file from its texts in order, of which a task holds one batch."""

    def hashed(batches):
        digest = last = None
        done = 0

        def out():
            if done < last[2]:  # the file ends with a `}`
                digest.update(END)
            return _batch([(last[0], digest.hexdigest())], _HASHES)

        for key, texts in _by_range(batches):
            if key != last:
                if last is not None:
                    yield out()
                digest, last, done = hashlib.sha256(), key, 0
            else:
                digest.update(END)
                done += 1
            joined = END.join(texts)
            digest.update(joined)
            done += len(joined)
        if last is not None:
            yield out()

    return texts.mapInArrow(hashed, _HASHES)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where quotes stand that begin or end a string: not after an odd number of backslashes."""
    quotes, slash = data == ord('"'), data == ord("\\")
    if slash.any():
        place = np.arange(len(data))
        other = np.maximum.accumulate(np.where(slash, -1, place))
        run = place - 1 - np.concatenate([[-1], other[:-1]])  # backslashes right before
        quotes &= run % 2 == 0
    return quotes


def _deeper(data: np.ndarray, string: np.ndarray) -> np.ndarray:
    opens, closes = (data == ord("{")) | (data == ord("[")), (data == ord("}")) | (data == ord("]"))
    return np.where(string, 0, opens.astype(np.int64) - closes)


def _summaries(texts: DataFrame) -> DataFrame:
    """One row per range: its quotes, and the brackets it leaves open if it begins outside and inside a string."""

    def counted(batches):
        sums: dict[tuple, list] = {}
        for key, rows in _by_range(batches):
            joined = END.join(rows) + END  # no escape reaches beyond a text
            data = np.frombuffer(joined, np.uint8)
            quotes = _quotes(data)
            string = (np.cumsum(quotes) & 1).astype(bool)
            n, outer, inner = int(quotes.sum()), int(_deeper(data, string).sum()), int(_deeper(data, ~string).sum())
            have = sums.setdefault(key, [0, 0, 0, 0, ""])
            if have[1] % 2:
                outer, inner = inner, outer
            sums[key] = [have[0] + len(joined), have[1] + n, have[2] + outer, have[3] + inner,
                         have[4] or joined.lstrip(_BLANK)[:1].decode("latin-1")]
        yield _batch([(*k, *v) for k, v in sums.items()], _SUMMARY)

    return texts.mapInArrow(counted, _SUMMARY)


def _beginnings(summaries: DataFrame) -> DataFrame:
    """Per range: does it begin inside a string, how deep, is it the last of its file, and what the whole file shows."""
    file = Window.partitionBy("source_file")  # ranges of one file: its size by that of a range
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("begin") != "", F.struct("start", "begin"))).over(file)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    known = summaries.select(
        "*", inside.alias("inside"), (F.col("start") == F.max("start").over(file)).alias("last"),
        # A `}` was counted behind each text, but a file need not end with one.
        (F.sum("bytes").over(file) > F.col("size")).alias("unended"),
        F.coalesce(first["begin"] == "[", F.lit(False)).alias("array"), (F.sum("quotes").over(file) % 2).alias("odd"))
    deeper = F.when(F.col("inside") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
    known = known.withColumn("deeper", deeper)
    total = F.sum("deeper").over(file) + F.when(F.col("unended"), 1).otherwise(0)
    return known.select(
        "source_file", "start", "inside", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"), "last", "unended", "array",
        ((F.col("odd") == 0) & (total == 0)).alias("balanced"))


class _Cutter:
    """Cuts one range into pieces of elements; `outer` is what stands outside of the file's array."""

    def __init__(self, key: tuple) -> None:
        self.file, self.start, self.inside, self.depth, self.last, self.unended, self.array = key
        self.at, self.head, self.parts, self.outer = 0, self.start == 0, [], b""
        self.within = self.start == 0 or self.depth > 0  # does an element begin or go on at the border?
        self.held = b""  # the last `}` may not be there

    def feed(self, texts: list[bytes]):
        joined = self.held + END.join(texts)
        self.held = END
        if not self.array:
            self.parts.append(joined)
            return
        data = np.frombuffer(joined, np.uint8)
        string = ((np.cumsum(_quotes(data)) + self.inside) & 1).astype(bool)
        deeper = _deeper(data, string)
        after = self.depth + np.cumsum(deeper)
        if len(data):
            self.inside, self.depth = int(string[-1]), int(after[-1])
        body = (after - deeper >= 1) & (after >= 1)
        self.outer = (self.outer + joined.translate(None, _BLANK) if not body.any()
                      else self.outer + data[~body].tobytes().translate(None, _BLANK))[:3]
        last = 0
        for cut in np.flatnonzero((data == ord(",")) & ~string & (after == 1) & body).tolist():
            self.parts.append(data[last:cut][body[last:cut]].tobytes())
            yield self.piece(True)
            self.at, self.head, self.parts, last = self.at + 1, True, [], cut + 1
        self.parts.append(data[last:][body[last:]].tobytes())

    def piece(self, tail: bool) -> tuple:
        return self.file, self.start, self.at, self.head, tail, False, b"".join(self.parts)

    def finish(self):
        if not (self.last and self.unended):
            yield from self.feed([b""])
        closed = self.last if not self.array else self.depth < 1
        if self.within or self.at or any(self.parts) or self.outer.startswith(b"["):
            yield self.piece(closed)
        yield self.file, self.start, self.at, True, True, True, self.outer


def _pieces(texts: DataFrame, beginnings: DataFrame) -> DataFrame:
    """Elements, or what a range has of them, numbered within the range; and one row `outside` per range."""
    known = beginnings.select("source_file", "start", "inside", "depth", "last", "unended", "array")
    # One small row per range, and a range is as large as a task's input.
    rows = texts.join(F.broadcast(known), ["source_file", "start"]).select(
        "source_file", "start", "inside", "depth", "last", "unended", "array", "text")

    def cut(batches):
        cutter = last = None
        for key, group in _by_range(batches):
            out = []
            if key != last:
                out += list(cutter.finish()) if cutter else []
                cutter, last = _Cutter(key), key
                out += list(cutter.feed(group) or ())
            else:
                out += list(cutter.feed(group) or ())
            yield _batch(out, _PIECES)
        if cutter:
            yield _batch(list(cutter.finish()), _PIECES)

    return rows.mapInArrow(cut, _PIECES)


def _whole_limit(spark: SparkSession) -> int:
    """Up to how many bytes a file is cut in one go: never more than Spark gives a task of a file."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    return min(WHOLE, int(number) << 10 * " kmgtp".index(unit or " "))


_MARKS, _DEPTHS = np.zeros(256, bool), np.zeros(256, np.int8)
_MARKS[list(b'"{}[],')] = True
_DEPTHS[list(b"{[")], _DEPTHS[list(b"}]")] = 1, -1


def _cut_whole(content: bytes) -> tuple[list[bytes], bool, bool, str]:
    """The elements of a whole file, is it an array, is it balanced, and what stands around the elements."""
    # Pairs of backslashes first: what then stands before a quote escapes it.
    plain = content.replace(b"\\\\", b"..").replace(b'\\"', b"..") if b"\\" in content else content
    data = np.frombuffer(plain, np.uint8)
    marks = np.flatnonzero(_MARKS[data])
    kinds = data[marks]
    string = (np.cumsum(kinds == ord('"')) & 1).astype(bool)
    after = np.cumsum(np.where(string, 0, _DEPTHS[kinds]), dtype=np.int64)
    array = content.lstrip(_BLANK)[:1] == b"["
    balanced = not len(marks) or bool(not string[-1] and after[-1] == 0)
    if array and balanced and (after[:-1] >= 1).all():  # one array, and blanks or plain text behind it
        first, end = int(marks[0]), int(marks[-1])
        cuts = [first, *marks[(kinds == ord(",")) & ~string & (after == 1)].tolist(), end]
        around = content[first:first + 1] + content[end:].translate(None, _BLANK)
        return [content[a + 1:b] for a, b in zip(cuts, cuts[1:])], array, balanced, around[:3].decode("latin-1")
    cutter = _Cutter(("", 0, 0, 0, True, True, array))
    *pieces, outside = [*cutter.feed([content]), *cutter.finish()]
    return [p[-1] for p in pieces], array, balanced, outside[-1].decode("latin-1")


def _whole_files(files: DataFrame, only: DataFrame | list[str] | None, limit: int) -> DataFrame:
    """The elements of the files of up to `limit` bytes, and per file one row without index of what the file shows."""
    files = _wanted(files.where(F.col("_metadata.file_size").between(1, limit)).select("content", "_metadata"), only)

    names, kinds = [c.split()[0] for c in _CUT.split(", ")], (pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.string())

    def cut(batches):
        for batch in batches:
            elements, places, counts, shown = [], [], [], []
            for name, content in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                found, *seen = _cut_whole(content)
                elements += found
                places += range(len(found))
                counts.append(len(found))
                shown.append((name, None, None, *seen))
            files = pa.array([row[0] for row in shown], kinds[0]).take(pa.array(np.repeat(np.arange(len(counts)), counts), kinds[1]))
            columns = [files, pa.array(places, kinds[1]), pa.array(elements, kinds[2]), *(pa.nulls(len(elements), t) for t in kinds[3:])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            yield _batch(shown, _CUT)

    return files.select(_file_name().alias("source_file"), F.col("content").alias("text")).mapInArrow(cut, _CUT)


# A text that could pass for an object once its quotes are gone.
_BRACED = r'^\s*"\s*(?:\{|\\u007[bB])'
_SPACES = " \t\n\x0b\f\r"  # what \s is


def _checked(elements: DataFrame) -> DataFrame:
    """What Spark's JSON parser makes of each element's bytes, beside the columns that stand with them; parsed once.

    A blank text has no element, so it is one of the broken, and a braced one begins with a quote: only these meet a pattern.
    """
    text = F.decode("text", "UTF-8")
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    others = [c for c in elements.columns if c != "text"]
    broken = F.col("parsed").isNull() | (F.size("parsed") != 1)
    quoted = F.ltrim("text", F.lit(_SPACES)).startswith('"')
    return elements.select(*others, text.alias("text"), parsed.alias("parsed")).select(
        *others, F.get("parsed", F.lit(0)).alias("payload"),
        F.when(F.col("text").isNotNull(), F.when(broken, F.col("text").rlike(r"^\s*$")).otherwise(False)).alias("blank"), broken.alias("broken"),
        F.when(F.col("text").isNotNull(), F.when(quoted, F.col("text").rlike(_BRACED)).otherwise(False)).alias("braced"))


def records(
    spark: SparkSession, directory: str, pattern: str = "*.json", only: DataFrame | list[str] | None = None, files: DataFrame | None = None
) -> DataFrame:
    """source_file, source_index, payload, problem: one row per element of the files' arrays, or one row per broken file.

    `only` names the files to read (a `source_file` column or a list); `files` is the folder's `listing`, if it was made before.
    """
    files = listing(spark, directory, pattern) if files is None else files
    limit = _whole_limit(spark)
    small = _checked(_whole_files(files, only, limit))
    path = work_dir(spark, "elements")
    small.write.parquet(path)
    small = spark.read.schema(small.schema).parquet(path)

    # Without large files there is nothing to list again for the reader that cuts them.
    texts = _texts(spark, directory, pattern, only, limit) if _large(files, limit)["files"] else spark.createDataFrame([], _TEXTS)
    beginnings = materialize(_beginnings(_summaries(texts)), "ranges")
    pieces = materialize(_pieces(texts, beginnings), "pieces")

    earlier = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.where("outside").select(
        "source_file", "start", F.coalesce(F.sum("at").over(earlier), F.lit(0)).alias("before"), F.decode("text", "ISO-8859-1").alias("around"))
    placed = pieces.where("not outside").join(F.broadcast(ranges.drop("around")), ["source_file", "start"]).withColumn(
        "source_index", F.col("before") + F.col("at"))
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("start", "text"))), F.lit(b""), lambda a, x: F.concat(a, x.text))
    across = placed.where("not (head and tail)").groupBy("source_file", "source_index").agg(joined.alias("text"))
    large = _checked(placed.where("head and tail").select("source_file", "source_index", "text").unionByName(across))

    elements = small.where("source_index is not null").select(*large.columns).unionByName(large)
    inner = elements.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("blank"), 1)).alias("blanks"),
        F.count(F.when(F.col("broken") & ~F.col("blank"), 1)).alias("broken"), F.coalesce(F.max("braced"), F.lit(False)).alias("braced"))
    outer = ranges.groupBy("source_file").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("start", "around")))["around"], "").alias("around"))
    whole = beginnings.groupBy("source_file").agg(F.max("array").alias("array"), F.min("balanced").alias("balanced")).join(outer, "source_file")
    whole = whole.unionByName(small.where("source_index is null").select("source_file", "array", "balanced", "around"))
    fine = F.col("balanced") & (F.col("broken") == 0) & ((F.col("blanks") == 0) | (F.col("array") & (F.col("n") == 1)))
    files = whole.join(inner, "source_file", "left").select(
        "source_file",
        F.when(~F.col("array") & fine, "the file is JSON, but no array of records")
        .when(~F.col("array") | ~fine | (F.col("around") != "[]"), "no JSON in it")
        .when(F.col("braced"), "a text stands where a record should").alias("problem"))
    bad = materialize(files.where("problem is not null"), "broken")
    payload = F.col("payload")
    good = elements.where("not blank").join(bad, "source_file", "left_anti").select(
        "source_file", "source_index", "payload",
        F.when(payload.isNull() | ~payload.startswith("{"), "this entry is no record").alias("problem"))
    return good.unionByName(bad.select(
        "source_file", F.lit(None).cast("bigint").alias("source_index"), F.lit(None).cast("string").alias("payload"), "problem"))
