"""Readers for exports, Markdown, registries, records, library files and patterns.

Every reader names its schema; none infers one. Files that cannot be read as
what they should be become rows with an ``error``.
"""

from __future__ import annotations

import io
import tomllib
import zipfile
from collections.abc import Iterator, Mapping

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import secrets as S
from snipmill.functions import text as T

COLLECTION_DOC = (
    "schema string, name string, title string, description string, "
    "members array<struct<ref string, compiled string>>"
)
TAG_DOC = "schema string, artifacts map<string, struct<compiled: string, tags: array<string>>>"


def _binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def _utf8(content: Column) -> Column:
    """The text of valid UTF-8 bytes, else NULL."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def scan_markdown(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(docs, errors)``: one row per Markdown file below ``path``."""
    return markdown_rows(_binary(spark, path, "*.{md,markdown,MD}"))


def markdown_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(docs, errors)`` of ``(path, content)``; bytes that are no UTF-8 are errors."""
    name = F.regexp_extract("path", r"([^/]+)\z", 1)
    rows = files.select(
        F.col("path").alias("doc_key"), F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem"),
        _utf8(F.col("content")).alias("text"))
    good = rows.where(F.col("text").isNotNull())
    return good, rows.where(F.col("text").isNull()).select(
        F.col("doc_key").alias("path"), F.lit("not valid UTF-8").alias("error"))


# ---- chat exports ----------------------------------------------------------------
def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First member of each archive whose name ends with the export file name."""
    for batch in batches:
        contents, errors = [], []
        for raw in batch.column("content").to_pylist():
            try:
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    names = [n for n in archive.namelist() if n.endswith(fixed.EXPORT_FILE)]
                    contents.append(archive.read(names[0]) if names else None)
                    errors.append(None if names else f"no {fixed.EXPORT_FILE} in the archive")
            except zipfile.BadZipFile:
                contents.append(None)
                errors.append("not a valid zip archive")
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), pa.array(contents, pa.binary()), pa.array(errors, pa.string())],
            names=["path", "content", "error"],
        )


def scan_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Every input below ``path`` as ``(path, text, error)``; archives are opened."""
    return input_rows(_binary(spark, path))


def input_rows(files: DataFrame) -> DataFrame:
    """``(path, text, error)`` of ``(path, content)`` rows."""
    is_zip = F.lower("path").endswith(".zip")
    plain = files.where(~is_zip).withColumn("error", F.lit(None).cast("string"))
    unzipped = files.where(is_zip).mapInArrow(_unzip, "path string, content binary, error string")
    rows = plain.unionByName(unzipped).withColumn("text", _utf8(F.col("content")))
    bad = F.col("text").isNull() & F.col("error").isNull()
    return rows.select("path", "text", F.when(bad, "not valid UTF-8").otherwise(F.col("error")).alias("error"))


def _array(text: Column) -> Column:
    """Elements of a top-level JSON array; NULL when the text is no such array."""
    return F.when(text.rlike(r"\A\s*\["), F.from_json(text, "array<variant>"))


def importer_scores(inputs: DataFrame, importers: Mapping[str, tuple] = fixed.ADAPTER_KEYS) -> DataFrame:
    """Long table ``(path, adapter, score)``: how well each importer fits an input.

    JSON importers look at the keys of the first element only.
    """
    low = F.lower("path")
    suffix = low.endswith(".json") | low.endswith(".zip")
    first = F.get(_array(F.col("text")), F.lit(0))
    keys = F.map_keys(F.try_variant_get(first, "$", "map<string,variant>"))
    markdown = F.lit(False)
    for ending in fixed.MARKDOWN_SUFFIXES:
        markdown = markdown | low.endswith(ending)
    scores = [F.struct(F.lit(fixed.MARKDOWN_ADAPTER).alias("adapter"),
                       F.when(markdown, 1.0).otherwise(0.0).alias("score"))]
    for adapter, needed in importers.items():
        fits = suffix & F.size(F.array_intersect("keys", F.array(*[F.lit(k) for k in needed]))).eqNullSafe(
            F.lit(len(needed)))
        scores.append(F.struct(F.lit(adapter).alias("adapter"), F.when(fits, 1.0).otherwise(0.0).alias("score")))
    return inputs.select("path", "text", F.when(suffix, keys).alias("keys")).select(
        "path", F.inline(F.array(*scores)))


def detect_format(inputs: DataFrame, adapter: str | None = None, scores: DataFrame | None = None,
                  keys: Mapping[str, tuple] = fixed.ADAPTER_KEYS) -> DataFrame:
    """``(path, adapter, error)``; no fit is unsupported, a tie at the top ambiguous."""
    known = [fixed.MARKDOWN_ADAPTER, *keys]
    if adapter is not None:
        if adapter not in known:
            raise ValueError(f"unknown adapter {adapter!r}; known are {known}")
        return inputs.select("path", F.lit(adapter).alias("adapter"), F.lit(None).cast("string").alias("error"))
    scored = importer_scores(inputs, keys) if scores is None else scores
    best = scored.groupBy("path").agg(
        F.max("score").alias("top"),
        F.max_by("adapter", "score").alias("adapter"),
        F.array_sort(F.collect_list(F.struct("score", "adapter"))).alias("all"),
    )
    ties = F.size(F.filter("all", lambda s: s["score"] == F.col("top")))
    error = F.when(F.col("top") <= 0, "unsupported").when(ties > 1, "ambiguous")
    return best.withColumn("error", error).select(
        "path", F.when(F.col("error").isNull(), F.col("adapter")).alias("adapter"), "error")


def scan_chat_export(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries, errors)`` of export files: one row per conversation."""
    rows = inputs.select("path", "error", _array(F.col("text")).alias("items"), "text")
    errors = rows.where(F.col("items").isNull()).select("path", F.coalesce(
        "error", F.when(F.try_parse_json("text").isNotNull(), "top level is not an array")
        .otherwise("not valid JSON")).alias("error"))
    entries = rows.where(F.col("items").isNotNull()).select(
        F.col("path").alias("export_key"), F.posexplode("items").alias("position", "entry"))
    return entries.withColumn("conv_key", F.concat_ws("#", "export_key", "position")), errors


# ---- library and registries ----------------------------------------------------------
def compiled_stamp(text: Column) -> Column:
    """The ``compiled`` value of a header or front matter; body lines never count."""
    lines = F.split(text, "\n", -1)

    def before(l: Column, stop) -> Column:
        at = F.array_position(F.transform(l, stop), True)
        return F.when(at == 0, l).otherwise(F.slice(l, F.lit(1), (at - 1).cast("int")))

    def find(l: Column) -> Column:
        header = F.filter(before(l, lambda x: ~(x.startswith("#") | x.startswith("--"))),
                          lambda x: x.rlike(fixed.HEADER_STAMP))
        inner = F.slice(l, F.lit(2), F.greatest(F.size(l) - 1, F.lit(0)))
        matter = F.filter(before(inner, lambda x: x.isin("---", "...")),
                          lambda x: x.rlike(fixed.FRONT_STAMP))
        raw = F.regexp_extract(F.get(matter, F.lit(0)), fixed.FRONT_STAMP, 1)
        value = F.try_parse_json(raw)
        quoted = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
        return F.when(
            l[0] == "---", F.nullif(F.when(value.isNull(), raw).otherwise(quoted), F.lit(""))
        ).otherwise(F.regexp_extract(F.get(header, F.lit(0)), fixed.HEADER_STAMP, 1))

    return F.nullif(T.let(lines, find), F.lit(""))


def scan_library(spark: SparkSession, root: str) -> DataFrame:
    """Draft and approved files of a library folder."""
    return library_rows(_binary(spark, f"{root}/artifacts"))


def library_rows(files: DataFrame) -> DataFrame:
    """``(ref, state, compiled, text, sha256)`` of ``(path, content)`` rows."""
    place = r"/artifacts/(drafts|approved)/((?:scripts|prompts|runbooks)/[^/]+)\z"
    return files.select(
        F.regexp_extract("path", place, 2).alias("ref"),
        F.when(F.regexp_extract("path", place, 1) == "drafts", "draft").otherwise("approved").alias("state"),
        _utf8(F.col("content")).alias("text"), F.sha2("content", 256).alias("sha256"),
    ).where(F.col("ref").rlike(fixed.REF_RULE)).withColumn("compiled", compiled_stamp(F.col("text")))


def _checked(rows: DataFrame, faults: list[tuple[Column, str]]) -> DataFrame:
    """Fail the job on the first corrupt registry row; it is never read as empty."""
    fault = T.first_of(faults)
    return rows.withColumn("_ok", F.when(fault.isNotNull(), F.raise_error(
        F.concat(F.col("path"), F.lit(": "), fault)).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")


def scan_tags(spark: SparkSession, path: str, schema: str = "tags/1") -> DataFrame:
    """Tag registry documents below ``path``."""
    return tag_rows(_binary(spark, path), schema)


def tag_rows(files: DataFrame, schema: str = "tags/1") -> DataFrame:
    """``(ref, compiled, tag)`` of tag registry documents ``(path, content)``."""
    docs = files.select("path", F.from_json(_utf8(F.col("content")), TAG_DOC).alias("d"))
    whole = _checked(docs, [
        (~F.col("d.schema").eqNullSafe(F.lit(schema)), "wrong schema or not JSON"),
        (F.col("d.artifacts").isNull(), "`artifacts` must be an object"),
    ])
    entries = whole.select("path", F.explode("d.artifacts").alias("ref", "e"))
    checked = _checked(entries, [
        (~F.col("ref").rlike(fixed.REF_RULE), "malformed reference"),
        (F.coalesce("e.compiled", F.lit("")) == "", "no `compiled` stamp"),
        (F.coalesce(F.size("e.tags"), F.lit(0)) <= 0, "empty `tags` list"),
        (F.exists("e.tags", lambda t: t.isNull() | ~t.rlike(fixed.NAME_RULE)), "invalid tag name"),
    ])
    return checked.select("ref", F.col("e.compiled").alias("compiled"),
                          F.explode(F.array_distinct("e.tags")).alias("tag"))


def scan_collections(spark: SparkSession, path: str, schema: str = "collection/1"
                     ) -> tuple[DataFrame, DataFrame]:
    """Collection documents below ``path``."""
    return collection_rows(_binary(spark, path, "*.json"), schema)


def collection_rows(files: DataFrame, schema: str = "collection/1") -> tuple[DataFrame, DataFrame]:
    """``(collections, members)`` of ``(path, content)``; other file names are ignored."""
    stem = F.regexp_extract("path", r"([^/]+)\.json\z", 1)
    docs = files.select(
        "path", stem.alias("stem"), F.from_json(_utf8(F.col("content")), COLLECTION_DOC).alias("d")
    ).where(F.col("stem").rlike(fixed.NAME_RULE))
    refs = F.col("d.members.ref")
    checked = _checked(docs, [
        (~F.col("d.schema").eqNullSafe(F.lit(schema)), "wrong schema or not JSON"),
        (~F.col("d.name").eqNullSafe(F.col("stem")), "`name` is not the file name"),
        (F.col("d.title").isNull() | F.col("d.description").isNull(), "`title` and `description` must be strings"),
        (F.col("d.members").isNull(), "`members` must be a list"),
        (F.exists("d.members", lambda m: m.isNull() | m["ref"].isNull() | ~m["ref"].rlike(fixed.REF_RULE)
                  | (F.coalesce(m["compiled"], F.lit("")) == "")), "malformed member"),
        (F.size(F.array_distinct(refs)) != F.size(refs), "a member is listed twice"),
    ])
    members = checked.select(F.col("d.name").alias("name"), F.posexplode("d.members").alias("at", "m")).select(
        "name", (F.col("at") + 1).alias("pos"), "m.ref", "m.compiled")
    return checked.select("d.name", "d.title", "d.description"), members


def scan_record_files(spark: SparkSession, path: str) -> DataFrame:
    """Record documents as ``(path, text)`` for ``records.scan_records``."""
    return _binary(spark, path, "*.json").select("path", _utf8(F.col("content")).alias("text"))


# ---- pattern tables ---------------------------------------------------------------------
def _compiles(pattern: str) -> bool:
    """Whether the JVM, which runs the scans, takes the pattern."""
    SparkContext._ensure_initialized()
    try:
        SparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def scan_pattern_table(text: str | None, defaults: S.Patterns, flags: str = "") -> S.Patterns:
    """Patterns of a TOML text ``[patterns] label = "regex"``; a table replaces the defaults.

    Runs on the driver: a pattern table is a few lines of settings. A pattern
    that does not compile is dropped; an empty or broken table gives the
    defaults. ``flags`` are JVM flags put before each pattern, ``(?is)`` for
    secrets.
    """
    try:
        rows = tomllib.loads(text or "").get("patterns") or {}
    except tomllib.TOMLDecodeError:
        rows = {}
    kept = []
    for label, pattern in rows.items():
        full = f"{flags}(?U)(?d){pattern}"
        if isinstance(pattern, str) and _compiles(full):
            kept.append((label, full))
    return kept or list(defaults)
