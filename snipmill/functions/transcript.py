"""Column builders for the canonical transcript: header, markers, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import text as T


def iso_millis(seconds: Column) -> Column:
    """Epoch seconds as ISO-8601 with milliseconds and ``+00:00``, in any session zone."""
    whole = F.floor(seconds)
    micros = F.bround((seconds - whole) * 1e6)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = epoch + F.make_dt_interval(
        secs=(whole + micros / 1e6).cast("decimal(18,6)"))
    return T.let(moment.cast("string"), lambda s: F.concat(
        F.replace(F.substring(s, 1, 19), F.lit(" "), F.lit("T")), F.lit("."),
        F.rpad(F.substring(s, 21, 3), 3, "0"), F.lit("+00:00")))


def yaml_scalar(value: Column) -> Column:
    def scalar(v: Column) -> Column:
        quoted = (
            (v == "") | (v != T.strip(v)) | F.lower(v).isin(*fixed.RESERVED_SCALARS)
            | v.rlike(r'[:#"\n]') | F.lit(fixed.UNSAFE_LEADING).contains(F.substring(v, 1, 1))
        )
        return F.when(v.isNull(), F.lit("null")).when(quoted, T.json_string(v)).otherwise(v)

    return T.let(value, scalar)


@T.built_once
def front_matter() -> Column:
    """First part of a transcript, from the header columns and ``turn_count``."""
    rows = [
        ("source", yaml_scalar(F.col("source"))),
        ("adapter", yaml_scalar(F.col("adapter"))),
        ("conversation_id", yaml_scalar(F.col("conversation_id"))),
        ("title", yaml_scalar(F.col("title"))),
        ("exported_at", yaml_scalar(F.col("exported_at"))),
        ("turns", F.col("turn_count").cast("string")),
    ]
    head = f"---\nkind: transcript\nschema: {fixed.TRANSCRIPT_SCHEMA}\n"
    return F.concat(
        F.lit(head),
        F.concat_ws("\n", *[F.concat(F.lit(f"{key}: "), value) for key, value in rows]),
        F.lit("\n---"),
    )


def turns_of(body: Column) -> Column:
    """array<struct(idx, role, content_md, ts)> of the text below the front matter."""
    rx = fixed.TURN_MARKER_LINE

    def build(text: Column) -> Column:
        contents = F.slice(F.split(text, rx, -1), F.lit(2), F.length(text) + 1)
        parts = F.arrays_zip(
            F.regexp_extract_all(text, F.lit(rx), F.lit(1)).alias("idx"),
            F.regexp_extract_all(text, F.lit(rx), F.lit(2)).alias("role"),
            F.regexp_extract_all(text, F.lit(rx), F.lit(3)).alias("ts"),
            contents.alias("content"),
        )
        empty = F.array().cast("array<struct<idx:int,role:string,content_md:string,ts:string>>")
        return F.when(text.rlike(rx), F.transform(parts, lambda p: F.struct(
            p["idx"].cast("int").alias("idx"),
            F.when(F.lower(p["role"]).isin(*fixed.KNOWN_ROLES), F.lower(p["role"]))
            .otherwise("unknown").alias("role"),
            T.strip_newlines(p["content"]).alias("content_md"),
            F.nullif(p["ts"], F.lit("")).alias("ts"),
        ))).otherwise(empty)

    return T.let(body, build)


def _bad_quoted(raw: Column) -> Column:
    return raw.startswith('"') & raw.endswith('"') & F.coalesce(
        F.schema_of_variant(F.try_parse_json(raw)) != "STRING", F.lit(True)
    )


def _scalar(raw: Column) -> Column:
    return F.when(raw == "null", F.lit(None).cast("string")).when(
        raw.startswith('"') & raw.endswith('"'),
        F.try_variant_get(F.try_parse_json(raw), "$", "string"),
    ).otherwise(raw)


def parsed(text: Column) -> Column:
    """struct(error, source, adapter, title, conversation_id, exported_at, turns).

    ``error`` is the first rule a text breaks; NULL for a canonical transcript.
    """
    def build(t: Column) -> Column:
        matter = F.regexp_extract(t, fixed.TRANSCRIPT_FRONT_MATTER, 0)
        inside = F.regexp_extract(t, fixed.TRANSCRIPT_FRONT_MATTER, 1)
        lines = F.filter(F.split(inside, "\n", -1), lambda l: ~T.is_blank(l))
        entries = F.transform(lines, lambda l: F.struct(
            T.strip(F.split(l, ":", 2)[0]).alias("key"),
            T.strip(F.get(F.split(l, ":", 2), F.lit(1))).alias("raw"), l.alias("line"),
        ))
        body = F.substring(t, F.length(matter) + 1, F.length(t))
        return T.let(F.struct(
            (matter != "").alias("has"), entries.alias("entries"), turns_of(body).alias("turns"),
        ), read)

    def read(p: Column) -> Column:
        def field(key: str) -> Column:
            hits = F.filter(p["entries"], lambda e: e["key"] == key)
            return F.get(hits, F.size(hits) - 1)["raw"]

        return T.let(
            F.struct(p["has"].alias("has"), p["entries"].alias("entries"), p["turns"].alias("turns"),
                     *[field(k).alias(k) for k in fixed.TRANSCRIPT_KEYS if k != "turns"],
                     field("turns").alias("declared")),
            judge,
        )

    def judge(p: Column) -> Column:
        loose = F.filter(p["entries"], lambda e: e["raw"].isNull())
        missing = F.array_compact(F.array(*[
            F.when(p["declared" if k == "turns" else k].isNull(), F.lit(k))
            for k in sorted(fixed.TRANSCRIPT_KEYS)
        ]))
        whole = r"^[+-]?[0-9]+\z"
        count = F.size(p["turns"])
        quoted = F.filter(
            F.array(*[p[k] for k in ("source", "adapter", "title", "conversation_id", "exported_at")]),
            _bad_quoted,
        )
        text = F.lit
        error = (
            F.when(~p["has"], text("missing or malformed front matter"))
            .when(F.size(loose) > 0, F.concat(text("malformed front matter line: "), loose[0]["line"]))
            .when(F.size(missing) > 0, F.concat(text("missing fields: "), F.array_join(missing, ", ")))
            .when(p["kind"] != "transcript", F.concat(text("unexpected kind: "), p["kind"]))
            .when(~p["schema"].rlike(whole), F.concat(text("schema is not an integer: "), p["schema"]))
            .when(p["schema"].cast("int") != fixed.TRANSCRIPT_SCHEMA,
                  F.concat(text("unsupported schema: "), p["schema"]))
            .when(~p["declared"].rlike(whole), F.concat(text("turns is not an integer: "), p["declared"]))
            .when(p["declared"].cast("int") != count, F.concat(
                text("declares "), p["declared"], text(" turns but has "), count.cast("string")))
            .when(F.size(quoted) > 0, F.concat(text("malformed quoted value: "), F.get(quoted, F.lit(0))))
        )
        return F.struct(
            error.alias("error"),
            F.coalesce(_scalar(p["source"]), text("")).alias("source"),
            F.coalesce(_scalar(p["adapter"]), text("")).alias("adapter"),
            F.coalesce(_scalar(p["title"]), text("")).alias("title"),
            _scalar(p["conversation_id"]).alias("conversation_id"),
            _scalar(p["exported_at"]).alias("exported_at"),
            p["turns"].alias("turns"),
        )

    return T.let(text, build)


@T.built_once
def parsed_text() -> Column:
    return parsed(F.col("text"))
