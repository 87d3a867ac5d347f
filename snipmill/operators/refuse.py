"""Refuse or redact what carries a secret.

A hit anywhere refuses the whole document before anything else reads it, so
callers take ``accepted`` as the only input of later stages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from snipmill import fixed
from snipmill.functions import secrets as S
from snipmill.functions import text as T

KEY_BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
KEY_END = r"-----END [A-Z ]*PRIVATE KEY-----"


@T.built_once
def _hit(patterns: tuple) -> Column:
    return S.find_secret(F.col("text"), list(patterns))


@T.built_once
def _any_hit(patterns: tuple) -> Column:
    return S.has_secret(F.col("text"), list(patterns))


@T.built_once
def _redacted(patterns: tuple) -> Column:
    return S.redact(F.col("text"), list(patterns))


def secret_scan(docs: DataFrame, patterns: S.Patterns | None = None) -> DataFrame:
    """``(doc_key, label, line)`` of each document that holds a secret."""
    hits = docs.select("doc_key", _hit(T.table(patterns or fixed.SECRET_PATTERNS)).alias("hit"))
    return hits.where(F.col("hit").isNotNull()).select("doc_key", "hit.label", "hit.line")


def kv_literals(docs: DataFrame) -> DataFrame:
    """Every key=value match of a document and whether its value is a literal."""
    pattern = dict(fixed.SECRET_PATTERNS)[fixed.KV_LABEL]
    values = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(3))
    return (
        docs.where(F.col("text").contains("=") | F.col("text").contains(":"))
        .select("doc_key", F.posexplode(values).alias("match_no", "value"))
        .withColumn("is_literal", S.is_literal_value(F.col("value")))
    )


def refuse_documents(docs: DataFrame, patterns: S.Patterns | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``; a document is one row, so this is a plain filter."""
    hit = F.coalesce(_any_hit(T.table(patterns or fixed.SECRET_PATTERNS)), F.lit(False))
    return docs.where(~hit), secret_scan(docs, patterns)


def segment_secrets(segments: DataFrame, patterns: S.Patterns | None = None) -> DataFrame:
    """First secret of documents that come as segments, as ``(doc_key, label, line)``.

    The first hit goes by pattern order, then by place. Only a private key can
    span segments: it does when some BEGIN stands before the last END.
    """
    table = patterns or fixed.SECRET_PATTERNS
    rank = F.array_position(F.array(*[F.lit(label) for label, _ in table]), F.col("hit.label"))
    found = segments.select(
        "doc_key", "line_base", _hit(T.table(table)).alias("hit")
    ).where(F.col("hit").isNotNull())
    hits = found.select(
        "doc_key", F.struct(rank.alias("rank"), (F.col("line_base") + F.col("hit.line")).alias("line"),
                            F.col("hit.label").alias("label")).alias("first"))
    if ("private-key", dict(fixed.SECRET_PATTERNS)["private-key"]) in table:
        text = F.col("text")
        ends = segments.where(text.contains("PRIVATE KEY-----")).select(
            "doc_key",
            F.when(text.rlike(KEY_BEGIN), F.struct(
                "seg_no", (F.col("line_base") + T.line_of_match(text, KEY_BEGIN, 0)).alias("line")
            )).alias("begin"),
            F.when(text.rlike(KEY_END), F.col("seg_no")).alias("end"),
        )
        spans = ends.groupBy("doc_key").agg(
            F.min("begin").alias("begin"), F.max("end").alias("end")
        ).where(F.col("begin.seg_no") < F.col("end"))
        place = [label for label, _ in table].index("private-key") + 1
        hits = hits.unionByName(spans.select(
            "doc_key", F.struct(F.lit(place).cast("long").alias("rank"), F.col("begin.line").alias("line"),
                                F.lit("private-key").alias("label")).alias("first")))
    return hits.groupBy("doc_key").agg(F.min("first").alias("first")).select(
        "doc_key", "first.label", F.col("first.line").cast("int").alias("line")
    )


def refuse_segments(segments: DataFrame, patterns: S.Patterns | None = None,
                    also: Sequence[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)`` for documents in segments: any hit drops all segments.

    ``also`` are further texts ``(doc_key, text)`` of the same documents that become part
    of results: whole files with their header, titles, source labels. A hit there refuses as well,
    and comes first, as these stand at the head of a document.
    """
    refused = segment_secrets(segments, patterns)
    if also:
        heads = reduce(DataFrame.unionByName, [secret_scan(a.select("doc_key", "text"), patterns) for a in also])
        every = heads.withColumn("place", F.lit(0)).unionByName(refused.withColumn("place", F.lit(1)))
        refused = every.groupBy("doc_key").agg(F.min(F.struct("place", "line", "label")).alias("first")).select(
            "doc_key", "first.label", "first.line")
    return segments.join(refused.select("doc_key"), "doc_key", "left_anti"), refused


def redact_text(docs: DataFrame, patterns: S.Patterns | None = None) -> DataFrame:
    return docs.withColumn("text", _redacted(T.table(patterns or fixed.SECRET_PATTERNS)))


def _redact_value(value: Column, dtype: DataType, patterns: S.Patterns | None) -> Column:
    if isinstance(dtype, StringType):
        return S.redact(value, patterns)
    if isinstance(dtype, ArrayType):
        return F.transform(value, lambda v: _redact_value(v, dtype.elementType, patterns))
    if isinstance(dtype, MapType):
        return F.transform_values(value, lambda _, v: _redact_value(v, dtype.valueType, patterns))
    if isinstance(dtype, StructType):
        fields = [
            _redact_value(value[f.name], f.dataType, patterns).alias(f.name) for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_nested(frame: DataFrame, column: str, patterns: S.Patterns | None = None) -> DataFrame:
    """Redact every string inside a nested column; map keys and field names stay."""
    dtype = frame.schema[column].dataType
    return frame.withColumn(column, _redact_value(F.col(column), dtype, patterns))
