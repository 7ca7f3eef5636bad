"""Parallel reading of CSV files whose quoted cells hold line ends (A1-A4, T13-T16), one large merged
file as well as trees of small ones.

A record boundary cannot be told from a line end alone: inside quotes it is data. Spark's
``multiLine`` reader therefore takes a whole file in one task. Here a file is read in ranges:

1. **Scan.** Spark's text source splits files at line ends, whatever their size. Each task packs its
   lines to chunks of about ``chunk_bytes`` and notes for each, *for both starting states* (outside
   and inside quotes), the state after it, how many records begin in it, where the first and the
   last record boundary are, and whether the quoting is broken; besides, which encodings decode it.
   Chunks and notes are written once, so every later step sees the same ranges.
2. **Compose.** A range's notes are a function of two states. A prefix scan over the ranges of a file
   gives the state before each, the number of its first record, the file's encoding (the first one
   that decodes all of it) and whether the file is rejected.
3. **Parse.** Every chunk parses the records that lie whole in it, with Arrow's CSV reader (Python's
   where records are ragged). The pieces of records that cross chunks are put together by their
   record number and parsed the same way.

Line ends are ``\\n`` or ``\\r\\n``. The encodings must have ASCII as a part in which quote, comma and
line ends stand for themselves and for nothing else (UTF-8, CP949, EUC-KR, Latin-1 do).

Defined results: cells are strings, bound by header name; a repeated name is numbered from its second
place on (``a``, ``a.1``), cells beyond the header are ``_cell<place>``, missing ones null; blank lines are skipped;
a byte order mark is dropped. Files that no encoding decodes, whose quoting is broken (text behind
a closing quote, an end inside quotes, a bare carriage return outside) or that hold no record give
one reject row and no other.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from pressroom.operators.joins import bounded_broadcast
from pressroom.session import scratch_path

BOM = b"\xef\xbb\xbf"
CHUNK_BYTES = 1 << 20

CHUNKS = ("path string, range long, chunk long, data binary, decodes long, "
          # of the chunk, begun outside (o) or inside (i) quotes
          "end_o boolean, end_i boolean, starts_o long, starts_i long, head_i long, tail_o long, tail_i long, error_o string, error_i string, "
          # of the chunks before it in its range
          "before_o boolean, before_i boolean, count_o long, count_i long, "
          # the first record of a file, if it is whole in the first chunk
          "header binary")


# ---------------------------------------------------------------- one line, one chunk
def after_line(line: bytes, inside: bool) -> tuple[bool, str | None]:
    """Whether the end of a line (without its ``\\n``) lies inside quotes, and what is wrong in it."""
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1: at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at < 0:
                return True, None
            at += 1
            if at == n or at == n - 1 and line[at] == 13:
                return False, None
            if line[at] != 44:
                return False, "parse error: text after a closing quote"
            at += 1
            inside = False
        elif line[at: at + 1] == b'"':
            inside, at = True, at + 1
        else:
            comma = line.find(b",", at)
            bare = line.find(b"\r", at, n - 1 if comma < 0 else comma)
            if bare >= 0:
                return False, "parse error: bare carriage return outside quotes"
            if comma < 0:
                return False, None
            at = comma + 1


def note(lines: list[bytes], inside: bool) -> tuple[bool, int, int, int, str | None]:
    """State after the lines, records that begin in them, bytes up to the first record boundary
    (0 if begun at one) and up to the last record that is left open, first error."""
    starts, at, head, tail = 0, 0, None if inside else 0, -1
    for line in lines:
        if not inside:
            head = at if head is None else head
            if line and line != b"\r":
                starts += 1
                tail = at
        if inside or b'"' in line or b"\r" in line[:-1]:
            inside, error = after_line(line, inside)
            if error:
                return False, starts, at if head is None else head, at, error
        at += len(line) + 1
    if head is None:
        head = at
    # what begins in the chunk and is not closed in it, nothing if the last record is whole
    return inside, starts, head, tail if inside and tail >= 0 else at, None


def first_record(lines: list[bytes]) -> bytes | None:
    """The bytes of the first record that begins in lines begun outside quotes, if it ends in them."""
    out, inside = [], False
    for line in lines:
        if out or line and line != b"\r":
            out.append(line + b"\n")
            inside, error = after_line(line, inside)
            if not inside:
                return None if error else b"".join(out)
    return None


def _scan(encodings: Sequence[str], chunk_bytes: int):
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def decodes(data: bytes) -> int:
        bits = 0
        for i, encoding in enumerate(encodings):
            try:
                data.decode(encoding)
                bits |= 1 << i
            except (UnicodeDecodeError, LookupError):
                pass
        return bits

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, lines, size, before = None, 0, [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal chunk, lines, size, before
            data = b"\n".join(lines) + b"\n"
            out, inn = note(lines, False), note(lines, True)
            row = [now[0], now[1], chunk, data, decodes(data), out[0], inn[0], out[1], inn[1], inn[2], out[3], inn[3], out[4], inn[4], *before, first_record(lines) if now[1] == 0 and chunk == 0 else None]
            end = {False: out, True: inn}
            before = (end[before[0]][0], end[before[1]][0], before[2] + end[before[0]][1], before[3] + end[before[1]][1])
            chunk, lines, size = chunk + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5, pa.string(), pa.string(),
                 pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, start, line in zip(batch.column("path").to_pylist(), batch.column("range").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if (path, start) != now:
                    if lines:
                        yield close()
                    now, chunk, before = (path, start), 0, (False, True, 0, 0)
                    if start == 0 and line.startswith(BOM):
                        line = line[len(BOM):]
                lines.append(line)
                size += len(line) + 1
                if size >= chunk_bytes:
                    yield close()
        if lines:
            yield close()

    return scan


def load_files(spark: SparkSession, fmt: str, paths: str | list[str], **options) -> DataFrame:
    """The files that the globs match, listed by their folders where all globs name the same ones: a file
    that is a path of its own costs Spark a listing call, and with the others a task of a listing job."""
    reader = spark.read.format(fmt).options(**options)
    split = [p.rsplit("/", 1) for p in ([paths] if isinstance(paths, str) else paths)]
    folders, names = {p[0] for p in split}, [p[-1] for p in split]
    # folders and names that are plain globs; all else is Spark's to read
    if any(len(p) < 2 for p in split) or len(folders) > 1 or not all("*" in n for n in names) or any(c in p for p in (*folders, *names) for c in "{},\\"):
        return reader.load(paths)
    folder = folders.pop()
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    depth = len(fs.makeQualified(glob).toUri().getPath().split("/")) + 1
    found = reader.options(pathGlobFilter=names[0] if len(names) == 1 else "{" + ",".join(names) + "}", recursiveFileLookup=True)
    if not all(fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}")) for n in names):
        return reader.load(paths)  # says that there is no such path
    # files that lie in these folders, not deeper or beside them
    place = F.split(F.regexp_replace("_metadata.file_path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/")
    return found.load(folder).filter(F.size(place) == depth)


def scan_chunks(spark: SparkSession, paths: str | list[str], encodings: Sequence[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The written chunks of all files, see the module's first step."""
    text = load_files(spark, "text", paths, lineSep="\n")
    # the path of the metadata is a URI, that of a listing is not
    listed = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = text.select(listed.alias("path"), F.col("_metadata.file_block_start").alias("range"),
                        F.col("value").cast("binary").alias("line"))
    path = scratch_path(spark, "csv-chunks")
    lines.mapInArrow(_scan(list(encodings), chunk_bytes), CHUNKS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(CHUNKS).parquet(path)


# ---------------------------------------------------------------- the prefix scan
def compose(chunks: DataFrame, encodings: Sequence[str]) -> DataFrame:
    """(path, range, inside, first_record) -- state and number of records before each range -- and of
    its file: encoding, n_records, reason (it is rejected for) and header (bytes)."""
    # a range's function is its last chunk's, after what stands before that
    last = F.struct("chunk", "before_o", "before_i", "count_o", "count_i", "end_o", "end_i", "starts_o", "starts_i")
    wrong = {s: F.when(F.col(f"before_{s}"), F.col("error_i")).otherwise(F.col("error_o")) for s in "oi"}
    ends = chunks.groupBy("path", "range").agg(
        F.max(last).alias("l"), F.bit_and("decodes").alias("decodes"), F.max("header").alias("header"),
        *[F.min(F.when(e.isNotNull(), F.struct("chunk", e.alias("error"))))["error"].alias(f"error_{s}") for s, e in wrong.items()])
    of = lambda state, o, i: F.when(state, F.col(f"l.{i}")).otherwise(F.col(f"l.{o}"))
    ranges = ends.select("path", "range", "decodes", "header", "error_o", "error_i", *[
        e for s in "oi" for e in (of(F.col(f"l.before_{s}"), "end_o", "end_i").alias(f"to_{s}"),
                                  (F.col(f"l.count_{s}") + of(F.col(f"l.before_{s}"), "starts_o", "starts_i")).alias(f"n_{s}"))])
    # Functions of two states are constant, the identity or a swap: the state before a range is that
    # of the last constant one, swapped as often as swaps came after it.
    w = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("to_o") == F.col("to_i")
    ranges = ranges.withColumn("_swaps", F.coalesce(F.sum(F.when(~constant & F.col("to_o"), 1).otherwise(0)).over(w), F.lit(0)))
    fixed = F.last(F.when(constant, F.struct(F.col("to_o").alias("state"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(w)
    ranges = ranges.withColumn("_f", fixed)
    odd = ((F.col("_swaps") - F.coalesce(F.col("_f.swaps"), F.lit(0))) % 2) == 1
    ranges = ranges.withColumn("inside", F.coalesce(F.col("_f.state"), F.lit(False)) != odd)
    actual = lambda c: F.when(F.col("inside"), F.col(f"{c}_i")).otherwise(F.col(f"{c}_o"))
    ranges = ranges.select("path", "range", "decodes", "header", "inside", actual("n").alias("n"), actual("to").alias("to"), actual("error").alias("error"))
    ranges = ranges.withColumn("first_record", F.coalesce(F.sum("n").over(w), F.lit(0)))
    # what holds for the file
    file = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("path", "range", "inside", "first_record", F.bit_and("decodes").over(file).alias("decodes"), F.sum("n").over(file).alias("n_records"),
                           F.last("to").over(file).alias("open"), F.first("error", ignorenulls=True).over(file).alias("error"), F.first("header").over(file).alias("header"))
    encoding = F.coalesce(*[F.when(F.col("decodes").bitwiseAND(F.lit(1 << i)) != 0, F.lit(e)) for i, e in enumerate(encodings)])
    reason = (F.when(F.col("decodes") == 0, "undecodable").when(F.col("error").isNotNull(), F.col("error"))
               .when(F.col("open"), "parse error: the file ends inside quotes").when(F.col("n_records") == 0, "empty file"))
    return ranges.select("path", "range", "inside", "first_record", encoding.alias("encoding"), "n_records", reason.alias("reason"), "header")


def cell_names(header: list[str], widest: int) -> list[str]:
    """Names of all cells up to the widest record."""
    names: list[str] = []
    for i in range(max(widest, len(header))):
        name = header[i] if i < len(header) else f"_cell{i}"
        n, unique = 0, name
        while unique in names:
            n += 1
            unique = f"{name}.{n}"
        names.append(unique)
    return names


def records_of(data: bytes, encoding: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(data.decode(encoding), newline=""), strict=True) if r]


def table_of(data: bytes, encoding: str, header: list[str]) -> tuple[list[str], list[pa.Array]]:
    """Names and string columns of whole records."""
    if encoding.lower().replace("_", "-") not in ("utf-8", "utf8"):
        data = data.decode(encoding).encode()
    # Arrow reads records that are as wide as the header; a lone column would lose its empty cells
    if len(header) > 1 and len(data) < 1 << 30:
        names = cell_names(header, 0)
        try:
            table = pacsv.read_csv(
                pa.py_buffer(data), read_options=pacsv.ReadOptions(column_names=names, block_size=max(len(data), 1 << 16), use_threads=False),
                parse_options=pacsv.ParseOptions(newlines_in_values=True),
                convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False))
            return names, [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
        except pa.ArrowInvalid:
            pass  # ragged
    csv.field_size_limit(2**31 - 1)  # cells of any length
    records = records_of(data, "utf-8")
    names = cell_names(header, max((len(r) for r in records), default=0))
    return names, [pa.array([r[i] if i < len(r) else None for r in records], pa.string()) for i in range(len(names))]


# ---------------------------------------------------------------- parsing
def locate(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunks of the files that are not rejected as they are, now that the state before their range is
    known: ``inside`` quotes or not, ``first`` (records of the file that began before), ``n`` (that begin
    here), ``head`` and ``tail`` (bytes between which whole records lie), encoding and header."""
    where = ranges.filter("reason IS NULL").select("path", "range", F.col("inside").alias("_in"), "first_record", "encoding", F.col("header").alias("_header"))
    # one row per range: broadcast within the session's limit, else a shuffle join
    rows = chunks.join(bounded_broadcast(where, materialize=False)[0], ["path", "range"])
    inside = F.when(F.col("_in"), F.col("before_i")).otherwise(F.col("before_o"))
    pick = lambda o, i: F.when(inside, i).otherwise(o)
    return rows.select(
        "path", "range", "chunk", "data", "encoding", F.col("_header").alias("header"), inside.alias("inside"),
        (F.col("first_record") + F.when(F.col("_in"), F.col("count_i")).otherwise(F.col("count_o"))).alias("first"),
        *[pick(F.col(f"{c}_o"), F.col(f"{c}_i")).alias(n) for c, n in (("starts", "n"), ("tail", "tail"))],
        pick(F.lit(0).cast("long"), F.col("head_i")).alias("head"))


def pieces(located: DataFrame) -> DataFrame:
    """(path, record, range, chunk, side, piece): the parts of records that cross chunks. What leads a
    chunk belongs to the record begun last before it."""
    cut = lambda start, size: F.substring("data", start.cast("int"), size.cast("int"))
    size = F.octet_length("data")
    leading = F.struct((F.col("first") - 1).alias("record"), F.lit(1).alias("side"), F.when(F.col("inside"), cut(F.lit(1), F.col("head"))).alias("piece"))
    trailing = F.struct((F.col("first") + F.col("n") - 1).alias("record"), F.lit(2).alias("side"),
                        F.when(F.col("tail") < size, cut(F.col("tail") + 1, size - F.col("tail"))).alias("piece"))
    crossing = located.filter(F.col("inside") | (F.col("tail") < size))
    parts = crossing.select("path", "range", "chunk", "encoding", "header", F.explode(F.array(leading, trailing)).alias("_p"))
    return parts.select("path", "range", "chunk", "encoding", "header", "_p.*").filter("octet_length(piece) > 0")


def _joined(parts: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[tuple]:
    """(path, record, bytes, the other fields) of pieces sorted by path, record and place."""
    now, data = None, []
    for part in parts:
        for r in part.to_pylist():
            key = (r["path"], r["record"])
            if now and key != now[0]:
                yield (*now[0], b"".join(data), *now[1])
                data = []
            now = key, [r[f] for f in fields]
            data.append(r["piece"])
    if now:
        yield (*now[0], b"".join(data), *now[1])


ORDER = ["path", "record", "range", "chunk", "side"]


def long_headers(located: DataFrame) -> DataFrame:
    """(path, header) of the files whose header is not whole in their first chunk."""
    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, _, data in _joined(batches, []):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data])], names=["path", "header"])

    cut = pieces(located).filter("record = 0 AND header IS NULL")
    return cut.repartition("path").sortWithinPartitions(*ORDER).mapInArrow(crossing, "path string, header binary")


def header_of(header: bytes, encoding: str) -> list[str]:
    csv.field_size_limit(2**31 - 1)  # cells of any length
    return records_of(header, encoding)[0]


def _map_of(names: list[str], values: list[pa.Array], n: int) -> pa.Array:
    """A map for each of n rows of the cells that are there."""
    width = len(names)
    if not width:
        return pa.array([[]] * n, pa.map_(pa.string(), pa.string()))
    at = (np.arange(width)[None, :] * n + np.arange(n)[:, None]).ravel()
    flat = pa.concat_arrays(values).take(pa.array(at))
    keys = pa.array(names, pa.string()).take(pa.array(np.tile(np.arange(width), n)))
    there = flat.is_valid()
    sizes = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False).reshape(n, width).sum(1)))
    return pa.MapArray.from_arrays(pa.array(sizes.astype(np.int32)), keys.filter(there), flat.filter(there))


def parse(located: DataFrame, columns: Sequence[str] = (), rest: str | None = None) -> DataFrame:
    """(path, encoding, record, the named columns) of all records but the headers; a column that a file
    has not is null. ``rest``: name of a map column with all other cells. ``record`` counts the records
    of a file from 0, the header."""
    columns = list(columns)
    own = [StructField(c, StringType()) for c in columns] + ([StructField(rest, MapType(StringType(), StringType()))] if rest else [])
    schema = StructType([StructField("path", StringType()), StructField("encoding", StringType()), StructField("record", LongType()), *own])

    def rows(path: str, first: int, data: bytes, encoding: str, header: bytes) -> Iterator[pa.RecordBatch]:
        if not data.strip(b"\r\n"):
            return
        names, values = table_of(data, encoding, header_of(header, encoding))
        if first == 0:  # the header itself
            values, first = [v[1:] for v in values], 1
        n = len(values[0])
        if n:
            known = dict(zip(names, values, strict=True))
            cells = [known.pop(c) if c in known else pa.nulls(n, pa.string()) for c in columns]
            if rest:
                cells.append(_map_of(list(known), list(known.values()), n))
            lead = [pa.array([path] * n, pa.string()), pa.array([encoding] * n, pa.string()), pa.array(np.arange(first, first + n))]
            yield pa.RecordBatch.from_arrays([*lead, *cells], names=schema.names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from rows(r["path"], r["first"], r["data"][r["head"]: r["tail"]], r["encoding"], r["header"])

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, record, data, encoding, header in _joined(batches, ["encoding", "header"]):
            yield from rows(path, record, data, encoding, header)

    cut = pieces(located).repartition("path", "record").sortWithinPartitions(*ORDER)
    return located.filter("head < tail").mapInArrow(whole, schema).unionByName(cut.mapInArrow(crossing, schema))


class CsvFiles:
    """CSV files scanned and composed, ready to be parsed; ``paths``: a path, a glob, or a list."""

    def __init__(self, spark: SparkSession, paths: str | list[str], encodings: Sequence[str] = ("utf-8",), chunk_bytes: int = CHUNK_BYTES):
        chunks = scan_chunks(spark, paths, encodings, chunk_bytes)
        ranges = _kept(compose(chunks.drop("data"), encodings), "csv-ranges")
        self.located = locate(chunks, ranges)
        if not ranges.filter("range = 0 AND reason IS NULL AND header IS NULL").isEmpty():
            long = long_headers(self.located).withColumnRenamed("header", "_long")
            found = ranges.join(long, "path", "left").withColumn("header", F.coalesce("header", "_long")).select(*ranges.columns)
            ranges = _kept(found, "csv-headers")
            self.located = locate(chunks, ranges)
        #: (path, encoding, reason, n_records, header) of every file with a line in it
        self.files = ranges.filter("range = 0").select("path", "encoding", "reason", "n_records", "header")

    def names(self, condition: str = "true") -> list[str]:
        """All header names of the files that meet the condition, in the order of the first file (by
        path) that has them. One row per distinct header comes to the driver, as many as layouts."""
        some = self.files.filter("reason IS NULL").filter(condition)
        layouts = some.groupBy("header", "encoding").agg(F.min("path").alias("path")).orderBy("path").collect()
        return list(dict.fromkeys(c for r in layouts for c in cell_names(header_of(bytes(r["header"]), r["encoding"]), 0)))

    def records(self, columns: Sequence[str] = (), rest: str | None = None) -> DataFrame:
        return parse(self.located, columns, rest)

    def rejects(self) -> DataFrame:
        return self.files.filter("reason IS NOT NULL").select("path", "reason")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """One row per range, written so that it is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
