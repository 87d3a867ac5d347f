"""Elements of JSON arrays in files of any size, read in byte ranges.

An export is one JSON array. Spark's text reader cuts files at ``}`` and deals byte ranges to
tasks, so a file is split like a file of lines. Whether a range starts inside a string, how deep, and
in which element follows from the ranges before it:

1. Each range counts its quotes and, for both answers to "does it start in a string?", its brackets and
   its commas by depth. That is one small row.
2. Running sums over the ranges of a file give the start of each: quotes say whether it is in a string,
   brackets how deep it is, and commas at depth one how many elements came before.
3. Each range cuts its bytes at the commas of depth one. Elements that cross ranges are joined from their parts.

A member of a zip archive can't be split. It is decoded piece by piece, and its elements leave one by one.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.session import cut_lineage
from snipmill.sources.stores import locate

#: Byte ranges whose starts are broadcast (some 20 MB); beyond that the pieces are shuffled to them.
BROADCAST = 200_000
#: Bytes of a member that are decoded at once.
PIECE = 1 << 20

_QUOTE, _SLASH, _OPEN, _CLOSE, _COMMA = range(1, 6)
_KINDS = np.zeros(256, np.int8)
for _kind, _bytes in ((_QUOTE, b'"'), (_SLASH, b"\\"), (_OPEN, b"{["), (_CLOSE, b"}]"), (_COMMA, b",")):
    _KINDS[list(_bytes)] = _kind


def structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and kinds of brackets and commas, and how many quotes stand before each; the last entry is the end.

    ``data`` must not begin behind a backslash that escapes. Backslashes are found by runs: the first of a run
    escapes the second, the third the fourth, and the last one of an odd run the next character.
    """
    line = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_KINDS[line])
    kind = _KINDS[line[at]]
    quote = kind == _QUOTE
    slash = kind == _SLASH
    if slash.any():
        beside = np.diff(at, prepend=-2) == 1
        first = slash & ~(beside & np.concatenate([[False], slash[:-1]]))
        number = np.arange(len(at))
        escapes = slash & ((number - np.maximum.accumulate(np.where(first, number, 0))) % 2 == 0)
        quote &= ~(beside & np.concatenate([[False], escapes[:-1]]))
    before = np.cumsum(quote) - quote
    keep = kind >= _OPEN
    return (np.append(at[keep], len(data)), np.append(kind[keep], 0), np.append(before[keep], quote.sum()))


def _steps(kind: np.ndarray) -> np.ndarray:
    return (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)


class Range:
    """What one byte range says about the ones behind it, for a start outside and inside a string."""

    def __init__(self) -> None:
        self.quotes = 0
        self.depth = [0, 0]
        self.opened = [False, False]
        self.commas: list[dict[int, int]] = [{}, {}]

    def read(self, data: bytes) -> None:
        _, kind, quotes = structure(data)
        for start in (0, 1):
            outside = kind[:-1][(quotes[:-1] + self.quotes + start) % 2 == 0]
            depth = self.depth[start] + np.cumsum(_steps(outside))
            found, times = np.unique(depth[outside == _COMMA], return_counts=True)
            self.opened[start] |= bool((outside == _OPEN).any())
            counts = self.commas[start]
            for d, n in zip(found.tolist(), times.tolist(), strict=True):
                counts[d] = counts.get(d, 0) + n
            self.depth[start] = int(depth[-1]) if len(depth) else self.depth[start]
        self.quotes = (self.quotes + int(quotes[-1])) % 2


NO_ARRAY, NO_JSON = "top level is not an array", "not valid JSON"


class Elements:
    """Cuts what follows a known start into elements.

    ``position`` counts the elements before the start, ``began`` says that the array was open there. The first
    fault of the whole (no array, text behind its end, an end of the wrong kind) is kept in ``fault``; what is
    wrong inside an element shows when it is parsed.
    """

    def __init__(self, quotes: int = 0, depth: int = 0, position: int = 0, began: bool = False) -> None:
        self.quotes, self.depth, self.position, self.began = quotes, depth, position, began
        self.whole = not began  # whether the current element started here
        self.held: list[bytes] = []
        self.fault: str | None = None

    def read(self, data: bytes) -> Iterator[tuple[int, bytes, bool]]:
        """(position, text, whether it is the whole element) of the elements that end in ``data``."""
        at, kind, quotes = structure(data)
        keep = (quotes + self.quotes) % 2 == 0
        keep[-1] = False
        at, kind = at[keep], kind[keep]
        depth = self.depth + np.cumsum(_steps(kind))
        begin = 0
        for i in np.flatnonzero((depth == 1) & ((kind == _COMMA) | (kind == _OPEN)) | (depth <= 0)).tolist():
            place, now = int(at[i]), int(depth[i])
            if kind[i] == _OPEN and now == 1:
                if self.began or data[begin:place].strip(_WHITE) or data[place] != 0x5B:
                    self.fault = self.fault or (NO_JSON if self.began else NO_ARRAY)
                self.began, begin = True, place + 1
            elif now == 1 or now == 0 and kind[i] == _CLOSE:
                yield self.position, b"".join([*self.held, data[begin:place]]), self.whole
                self.held, self.whole, begin = [], True, place + 1
                self.position += now
                if not now and data[place] != 0x5D:
                    self.fault = self.fault or NO_JSON
            else:  # a comma or bracket outside of the array
                self.fault = self.fault or (NO_JSON if self.began else NO_ARRAY)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.quotes = (self.quotes + int(quotes[-1])) % 2
        if self.depth > 0:
            self.held.append(data[begin:])
        elif data[begin:].strip(_WHITE):
            self.fault = self.fault or (NO_JSON if self.began else NO_ARRAY)

    def rest(self) -> Iterator[tuple[int, bytes, bool]]:
        """The part of an element that goes on behind what was read."""
        if self.held:
            yield self.position, b"".join(self.held), False

    def end(self) -> None:
        """Nothing follows."""
        if self.depth or self.quotes or not self.began:
            self.fault = self.fault or NO_JSON


_WHITE = b" \t\r\n"
#: An element or, if it is not ``whole``, the part of it in one range; rows without a position tell of a fault.
_PARTS = "path string, position long, range long, part binary, whole boolean, fault string"
_PARTS_ARROW = pa.schema([("path", pa.string()), ("position", pa.int64()), ("range", pa.int64()), ("part", pa.binary()),
                          ("whole", pa.bool_()), ("fault", pa.string())])


def _parts(path: str, start: int, listed: Iterator[tuple[int, bytes, bool]]) -> pa.RecordBatch:
    found = list(listed)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()),
         pa.array([start] * len(found), pa.int64()), pa.array([f[1] for f in found], pa.binary()),
         pa.array([f[2] for f in found], pa.bool_()), pa.nulls(len(found), pa.string())], schema=_PARTS_ARROW)


def _fault(path: str, message: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"path": path, "fault": message}], schema=_PARTS_ARROW)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, range, size, piece) of JSON files: the text between two ``}``, in order within a range."""
    read = (spark.read.option("lineSep", "}").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{json,JSON}").text(path))
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("piece"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int, bytes]]:
    """((path, range), first row, bytes) of rows of the same range; each piece gets its ``}`` back."""
    names = list(zip(batch.column("path").to_pylist(), batch.column("range").to_pylist(), strict=True))
    found, begin = batch.column("piece").to_pylist(), 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[begin]:
            yield names[begin], begin, b"}".join([*found[begin:i], b""])
            begin = i


def ranges(read: DataFrame) -> DataFrame:
    """(path, range, size, length, quotes, depth, opened, commas): one row for each byte range."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, size, length = None, Range(), 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "path": [key[0]], "range": [key[1]], "size": [size], "length": [length], "quotes": [found.quotes],
                "depth": [found.depth], "opened": [found.opened], "commas": [[list(c.items()) for c in found.commas]]}, schema=_RANGES_ARROW)

        for batch in batches:
            for name, first, data in _runs(batch):
                if name != key:
                    if key is not None:
                        yield row()
                    key, found, length = name, Range(), 0
                    size = batch.column("size")[first].as_py()
                length += len(data)
                found.read(data)
        if key is not None:
            yield row()

    return read.mapInArrow(of, "path string, range long, size long, length long, quotes int, depth array<long>, "
                               "opened array<boolean>, commas array<map<long,long>>")


_RANGES_ARROW = pa.schema([
    ("path", pa.string()), ("range", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("quotes", pa.int32()),
    ("depth", pa.list_(pa.int64())), ("opened", pa.list_(pa.bool_())), ("commas", pa.list_(pa.map_(pa.int64(), pa.int64())))])


def starts(found: DataFrame) -> DataFrame:
    """(path, range, quotes, depth, began, position, last, extra): the start of each range, by running sums over its file.

    ``last`` marks the last range of a file, and ``extra`` that its last ``}`` is not in the file: the text reader
    does not say whether the last piece had one, the sizes do.
    """
    order = Window.partitionBy("path").orderBy("range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = found.withColumn("_in", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int"))
    deep = inside.withColumn("_deep", F.coalesce(F.sum(F.get("depth", F.col("_in"))).over(before), F.lit(0)))
    own = F.coalesce(F.element_at(F.get("commas", F.col("_in")), F.lit(1) - F.col("_deep")), F.lit(0))
    whole = Window.partitionBy("path")
    return deep.withColumn("_commas", own).select(
        "path", "range", F.col("_in").alias("quotes"), F.col("_deep").alias("depth"),
        F.coalesce(F.max(F.get("opened", F.col("_in"))).over(before), F.lit(False)).alias("began"),
        F.coalesce(F.sum("_commas").over(before), F.lit(0)).alias("position"),
        (F.col("range") == F.max("range").over(whole)).alias("last"),
        (F.sum("length").over(whole) > F.col("size")).alias("extra"),
    )


def file_parts(read: DataFrame, inputs: DataFrame) -> DataFrame:
    """Parts of the elements of those files of ``pieces`` that are ``inputs``, and their faults."""
    placed = cut_lineage(starts(ranges(read)).join(inputs, "path", "left_semi"))
    keys = ["path", "range"]
    if placed.count() <= BROADCAST:
        joined = read.join(F.broadcast(placed), keys)
    else:
        joined = read.withColumn("_seq", F.monotonically_increasing_id()).join(placed.hint("shuffle_merge"), keys)
        joined = joined.repartition(*keys).sortWithinPartitions(*keys, "_seq").drop("_seq")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, held, start = None, None, b"", None

        def finish() -> Iterator[pa.RecordBatch]:
            if key is None:
                return
            yield _parts(*key, found.read(held[:-1] if start["last"] and start["extra"] else held))
            yield _parts(*key, found.rest())
            if start["last"]:
                found.end()
            if found.fault:
                yield _fault(key[0], found.fault)

        for batch in batches:
            for name, first, data in _runs(batch):
                if name != key:
                    yield from finish()
                    start = batch.slice(first, 1).select(["quotes", "depth", "began", "position", "last", "extra"]).to_pylist()[0]
                    key, found = name, Elements(start["quotes"], start["depth"], start["position"], start["began"])
                elif held:
                    yield _parts(*key, found.read(held))
                held = data
        yield from finish()

    return joined.mapInArrow(of, _PARTS)


# ---- archives --------------------------------------------------------------------------------
def member_parts(archives: DataFrame) -> DataFrame:
    """Elements of the first member of each archive whose name ends with the export's file name, and faults."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _member(path)

    return archives.select("path").mapInArrow(of, _PARTS)


def _member(path: str) -> Iterator[pa.RecordBatch]:
    found, rest = Elements(), b""
    try:
        fs, place = locate(path)
        with fs.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
            names = [n for n in archive.namelist() if n.endswith(fixed.EXPORT_FILE)]
            if not names:
                yield _fault(path, f"no {fixed.EXPORT_FILE} in the archive")
                return
            with archive.open(names[0]) as member:
                while data := member.read(PIECE):
                    data = rest + data
                    kept = len(data.rstrip(b"\\"))  # a run of backslashes stays together
                    rest = data[kept:]
                    yield _parts(path, 0, found.read(data[:kept]))
        found.end()
        if found.fault or rest:
            yield _fault(path, found.fault or NO_JSON)
    except (zipfile.BadZipFile, zlib.error, EOFError, pa.ArrowInvalid):  # the last from files shorter than an archive can be
        yield _fault(path, "not a valid zip archive")


# ---- inputs ----------------------------------------------------------------------------------
def export_files(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the inputs below ``path``: archives and JSON files.

    Where a folder holds a file of the export's own name, that one is the input and its neighbours
    are not. Contents are not read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,JSON,zip,ZIP}")
             .load(path).select(F.col("_metadata.file_path").alias("path")))
    named = F.regexp_extract("path", r"([^/]*)$", 1) == fixed.EXPORT_FILE
    folder = Window.partitionBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    return files.withColumn("_named", named).withColumn("_has", F.max("_named").over(folder)).where(
        "_named OR NOT _has").select("path")


def scan_export_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(entries, errors)`` of all exports below ``path``, whatever their size.

    ``entries`` has a row for each element: ``export_key`` (the file), ``position``, ``entry`` (a variant) and
    ``conv_key``. A file with a fault anywhere gives no entry and one row in ``errors`` (path, error). An empty
    array gives neither, nor does a file without a byte, which Spark's readers pass over. Archives are opened where Arrow reaches their store.
    """
    inputs = cut_lineage(export_files(spark, path))
    is_zip = F.lower("path").endswith(".zip")
    parts = cut_lineage(file_parts(pieces(spark, path), inputs.where(~is_zip)).unionByName(
        member_parts(inputs.where(is_zip).repartition("path"))))
    # Only elements that cross a seam are brought together.
    seams = parts.where("position IS NOT NULL AND NOT whole").groupBy("path", "position").agg(
        F.array_sort(F.collect_list(F.struct("range", "part"))).alias("p"))
    elements = parts.where("whole").select("path", "position", "part").unionByName(seams.select(
        "path", "position", F.array_join(F.transform("p.part", lambda x: x.cast("string")), "").cast("binary").alias("part")))
    text = F.col("part").cast("string")
    read = elements.select("path", "position", F.is_valid_utf8(text).alias("utf8"), text.alias("text")).select(
        "path", "position", "utf8", (F.btrim("text", F.lit(" \t\r\n")) == "").alias("blank"),
        F.when(F.col("utf8"), F.try_parse_json("text")).alias("entry"))
    parsed = cut_lineage(read.select("path", "position", "blank", "entry", F.when(~F.col("utf8"), "not valid UTF-8").when(
        F.col("entry").isNull() & ~F.col("blank"), NO_JSON).alias("fault")))
    # A blank element is the empty array if it is alone, else a comma too many.
    verdict = parsed.select("path", "position", "blank", "fault").unionByName(
        parts.where("fault IS NOT NULL").select("path", "fault"), allowMissingColumns=True).groupBy("path").agg(
        F.min("fault").alias("fault"), (F.coalesce(F.max("blank"), F.lit(False)) & (F.max("position") > 0)).alias("gap"))
    bad = cut_lineage(verdict.where(F.col("fault").isNotNull() | F.col("gap")).select(
        "path", F.coalesce("fault", F.lit(NO_JSON)).alias("error")))
    entries = parsed.where(~F.col("blank")).join(bad.select("path"), "path", "left_anti").select(
        F.col("path").alias("export_key"), F.col("position").cast("int").alias("position"), "entry",
        F.concat_ws("#", "path", "position").alias("conv_key"))
    return entries, bad
