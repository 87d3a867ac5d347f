"""Checks over artifact texts, verdicts over check results.

Artifacts are ``(ref, text)`` with ``ref`` = ``<kind>/<file name>``. Results of
tools that run outside (linters, parsers) arrive as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import markdown as M
from snipmill.functions import text as T
from snipmill.functions.sqllex import sql_scan
from snipmill.operators import emit


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _until(lines: Column, stop) -> Column:
    """Leading lines before the first one for which ``stop`` holds."""
    def cut(l: Column) -> Column:
        at = F.array_position(F.transform(l, stop), True)
        return F.when(at == 0, l).otherwise(F.slice(l, F.lit(1), (at - 1).cast("int")))

    return T.let(lines, cut)


# ---- headers and plans ----------------------------------------------------------
def _first_group(lines: Column, pattern: str) -> Column:
    hits = F.filter(lines, lambda l: l.rlike(pattern))
    return F.regexp_extract(F.get(hits, F.lit(0)), pattern, 1)


def header_dialect(text: Column) -> Column:
    header = _until(_lines(text), lambda l: ~l.startswith("--"))
    return F.nullif(_first_group(header, fixed.HEADER_DIALECT), F.lit("unspecified"))


def header_flags(text: Column) -> Column:
    """Flags of a script header; an array, empty for ``none`` or no header."""
    header = _until(
        F.filter(_lines(text), lambda l: ~l.startswith("#!")),
        lambda l: ~(l.startswith("#") | l.startswith("--")),
    )
    value = _first_group(header, fixed.HEADER_FLAGS)
    return T.let(value, lambda v: F.when(v.isNull() | (v == "none"), F.array().cast("array<string>"))
                 .otherwise(F.transform(F.split(v, ",", -1), T.strip)))


def split_ref(artifacts: DataFrame) -> DataFrame:
    return artifacts.withColumns({
        "kind": F.split_part("ref", F.lit("/"), F.lit(1)),
        "filename": F.split_part("ref", F.lit("/"), F.lit(2)),
    })


def emitter_of(kind: Column, filename: Column, rules: Sequence[tuple] = fixed.EMITTERS) -> Column:
    """The first rule that makes files of this kind and extension."""
    chain = None
    for name, _, _, extension, _, folder in rules:
        chain = (F if chain is None else chain).when(
            (kind == folder) & (F.regexp_extract(filename, r"[^.](\.[^.]*)\z", 1) == extension),
            F.lit(name),
        )
    return chain


def header_fields(artifacts: DataFrame, rules: Sequence[tuple] = fixed.EMITTERS) -> DataFrame:
    """Emitter, dialect and risk flags as recovered from the file itself."""
    matter = F.col("_fm")
    raw = F.element_at(matter["fields"], F.lit("risk-flags"))
    listed = F.when(_is_string_list(raw), F.from_json(raw, "array<string>"))
    is_md = F.col("filename").endswith(".md")
    named = split_ref(artifacts).withColumn("emitter", emitter_of(F.col("kind"), F.col("filename"), rules))
    return named.withColumn(
        "_fm", F.when(is_md, _front_matter())
    ).withColumns({
        "dialect": F.when(F.col("emitter") == "sql", header_dialect(F.col("text"))),
        "flags": F.when(is_md, F.coalesce(listed, F.array().cast("array<string>")))
        .otherwise(header_flags(F.col("text"))),
    }).drop("_fm")


def rebuild_plan(artifacts: DataFrame, rules: Sequence[tuple] = fixed.EMITTERS, checks: Sequence[tuple] = fixed.CHECKS,
                 incomplete: tuple[str, ...] = fixed.INCOMPLETE_PLANS) -> DataFrame:
    """The check plan of a file, from its name and header alone."""
    fields = header_fields(artifacts, rules).withColumn("body", F.col("text"))
    return emit.plan_checks(fields.where(F.col("emitter").isNotNull()), checks=checks, incomplete=incomplete)


# ---- front matter ------------------------------------------------------------------
def _is_string(raw: Column) -> Column:
    return F.schema_of_variant(F.try_parse_json(raw)) == "STRING"


def _is_string_list(raw: Column) -> Column:
    shape = F.schema_of_variant(F.try_parse_json(raw))
    nulls = F.exists(F.from_json(raw, "array<string>"), lambda v: v.isNull())
    return F.coalesce(shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~nulls, F.lit(False))


def parse_front_matter(text: Column) -> Column:
    """struct(present, closed, fields, problems, body, body_line) of an artifact.

    ``fields`` maps a key to the JSON text of its first valid value.
    """
    line_type = "struct<line:int,key:string,raw:string,fault:string>"

    def read(line: Column, i: Column) -> Column:
        key = F.regexp_extract(line, fixed.FRONT_MATTER_FIELD, 1)
        raw = F.regexp_extract(line, fixed.FRONT_MATTER_FIELD, 2)
        fault = F.when(key == "", F.lit("is not a `key: value` field")).when(
            F.try_parse_json(raw).isNull(), F.lit("value is not a JSON string or list")
        )
        skipped = T.is_blank(line) | T.strip(line).startswith("#")
        return F.when(
            ~skipped,
            F.struct((i + 2).alias("line"), key.alias("key"), raw.alias("raw"), fault.alias("fault")),
        ).otherwise(F.lit(None).cast(line_type))

    def first_seen(e: Column) -> Column:
        """Entries with valid JSON whose key has not come before."""
        good = F.filter(e["entries"], lambda x: x["fault"].isNull())
        keys = F.transform(good, lambda x: x["key"])
        lines = F.transform(good, lambda x: x["line"])
        return F.struct(
            e["entries"].alias("entries"), e["rest"].alias("rest"), e["at"].alias("at"),
            e["head"].alias("head"),
            T.let(
                F.struct(good.alias("good"), keys.alias("keys"), lines.alias("lines")),
                lambda g: F.filter(g["good"], lambda x: F.get(
                    g["lines"], (F.array_position(g["keys"], x["key"]) - 1).cast("int")) == x["line"]),
            ).alias("first"),
        )

    def result(p: Column) -> Column:
        present, at = p["head"] == "---", p["at"]
        first_lines = F.transform(p["first"], lambda f: f["line"])
        faults = T.let(first_lines, lambda known: F.filter(
            p["entries"],
            lambda x: x["fault"].isNotNull() | ~F.array_contains(known, x["line"])))
        problems = F.transform(faults, lambda x: F.concat(
            F.lit("line "), x["line"].cast("string"), F.lit(": "),
            F.coalesce(x["fault"], F.concat(F.lit("key '"), x["key"], F.lit("' appears more than once"))),
        ))
        fields = F.map_from_entries(F.transform(p["first"], lambda x: F.struct(x["key"], x["raw"])))
        rest = p["rest"]
        body = F.array_join(F.slice(rest, at + 1, F.greatest(F.size(rest) - at, F.lit(0))), "\n")
        return F.struct(
            present.alias("present"), (present & (at > 0)).alias("closed"),
            F.when(present, fields).otherwise(F.create_map().cast("map<string,string>")).alias("fields"),
            F.when(present, problems).otherwise(F.array().cast("array<string>")).alias("problems"),
            F.when(~present, text).when(at > 0, body).alias("body"),
            F.when(~present, 1).otherwise(at + 2).alias("body_line"),
        )

    def split(p: Column) -> Column:
        matter = F.when(p["head"] != "---", F.array().cast("array<string>")).when(
            p["at"] > 0, F.slice(p["rest"], F.lit(1), p["at"] - 1)).otherwise(p["rest"])
        entries = F.array_compact(F.transform(matter, read))
        bound = F.struct(entries.alias("entries"), p["rest"].alias("rest"), p["at"].alias("at"),
                         p["head"].alias("head"))
        return T.let(T.let(bound, first_seen), result)

    def locate(lines: Column) -> Column:
        rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
        return T.let(rest, lambda r: T.let(
            F.struct(r.alias("rest"), F.array_position(r, "---").cast("int").alias("at"),
                     F.get(lines, F.lit(0)).alias("head")),
            split,
        ))

    return T.let(_lines(text), locate)


@T.built_once
def _front_matter() -> Column:
    return parse_front_matter(F.col("text"))


def _outcome(frame: DataFrame, check: str, problems: Column) -> DataFrame:
    listed = F.array_compact(problems)
    return frame.select(
        "ref", F.lit(check).alias("check_name"),
        F.when(F.size(listed) == 0, "passed").otherwise("failed").alias("status"),
        F.array_join(listed, "; ").alias("detail"),
    )


def _parsed(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("ref", "text", _front_matter().alias("fm"))


NEVER_CLOSED = "front matter opened on line 1 is never closed with a '---' line"


def lint_front_matter(artifacts: DataFrame, kind: str) -> DataFrame:
    """Every fault of the front matter of a prompt or runbook."""
    fm, keys = F.col("fm"), fixed.FRONT_MATTER_KEYS[kind]
    fields = fm["fields"]
    missing = F.array_except(F.array(*[F.lit(k) for k in keys]), F.map_keys(fields))
    typed = []
    for key in keys:
        raw = F.element_at(fields, F.lit(key))
        if key in fixed.LIST_KEYS:
            typed.append(F.when(raw.isNotNull() & ~_is_string_list(raw),
                                F.lit(f"'{key}' must be a list of strings")))
        else:
            typed.append(F.when(raw.isNotNull() & ~_is_string(raw), F.lit(f"'{key}' must be a string")))
    said = F.element_at(fields, F.lit("kind"))
    faults = F.concat(
        fm["problems"],
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))),
            *typed,
            F.when(said.isNotNull() & (said != f'"{kind}"'),
                   F.concat(F.lit("kind is "), said, F.lit(f", expected {kind}"))),
        ),
    )
    problems = (
        F.when(~fm["present"], F.array(F.lit("no front matter: line 1 must be '---'")))
        .when(~fm["closed"], F.array(F.lit(NEVER_CLOSED))).otherwise(faults)
    )
    return _outcome(_parsed(artifacts), f"{kind}-front-matter", problems)


def lint_prompt_body(artifacts: DataFrame) -> DataFrame:
    body = F.col("fm.body")
    return _outcome(_parsed(artifacts), "prompt-body", F.array(
        F.when(body.isNull(), NEVER_CLOSED).when(T.is_blank(body), "the body is blank")))


def editorial_fills(body: Column, body_line: Column) -> Column:
    """Unfinished bits with their file lines: ``'TODO' (line 7)``."""
    rx = fixed.EDITORIAL
    between = F.split(body, rx, -1)
    hits = F.regexp_extract_all(body, F.lit(rx), F.lit(0))

    def place(parts: Column) -> Column:
        return F.transform(parts["hits"], lambda h, i: F.concat(
            F.lit("'"), h, F.lit("' (line "),
            (body_line + F.aggregate(
                F.concat(F.slice(parts["between"], F.lit(1), i + 1), F.slice(parts["hits"], F.lit(1), i)),
                F.lit(0), lambda n, s: n + T.newlines(s))).cast("string"),
            F.lit(")"),
        ))

    return F.when(body.rlike(rx), T.let(F.struct(between.alias("between"), hits.alias("hits")), place)
                  ).otherwise(F.array().cast("array<string>"))


def lint_placeholders(artifacts: DataFrame) -> DataFrame:
    """Body and declared placeholders must be the same set; no fill-ins may remain."""
    fm = F.col("fm")
    raw = F.element_at(fm["fields"], F.lit("placeholders"))
    frame = _parsed(artifacts).withColumns({
        "declared": F.when(_is_string_list(raw), F.from_json(raw, "array<string>")),
        "used": emit.find_placeholders(fm["body"]),
        "fills": editorial_fills(fm["body"], fm["body_line"]),
    })
    undeclared = F.array_except("used", "declared")
    unused = F.array_except("declared", "used")

    def named(label: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, ", ")))

    problems = (
        F.when(fm["body"].isNull(), F.array(F.lit(NEVER_CLOSED)))
        .when(F.col("declared").isNull(), F.array(F.lit("no `placeholders` list of strings")))
        .otherwise(F.array(
            named("undeclared placeholders: ", undeclared),
            named("declared but unused placeholders: ", unused),
            named("editorial fill-ins remain: ", F.col("fills")),
        ))
    )
    return _outcome(frame, "prompt-placeholders", problems)


def lint_editorial(artifacts: DataFrame) -> DataFrame:
    """Fill-ins anywhere below the front matter, one row each."""
    frame = _parsed(artifacts).where(F.col("text").rlike(fixed.EDITORIAL))
    return frame.select(
        "ref", F.posexplode(editorial_fills(F.col("fm.body"), F.col("fm.body_line"))).alias("fill_no", "fill")
    )


def lint_runbook_title(artifacts: DataFrame) -> DataFrame:
    body = F.col("fm.body")
    first = M.first_block(body)
    frame = _parsed(artifacts).withColumn("first", first)
    line = F.col("fm.body_line") + F.col("first.line")
    return _outcome(frame, "runbook-title", F.array(
        F.when(body.isNull(), NEVER_CLOSED)
        .when(F.col("first.kind").isNull(), "the body is empty, so it has no title heading")
        .when(F.col("first.kind") != "heading", F.concat(
            F.lit("the first block of the body (line "), line.cast("string"), F.lit(") is a "),
            F.col("first.kind"), F.lit(", not a heading")))))


def lint_unlabeled_fences(artifacts: DataFrame) -> DataFrame:
    """Fences without a label, by file line."""
    body = F.col("fm.body")
    bare = F.filter(M.blocks(body), lambda b: (b["kind"] == "fence") & b["label"].isNull())
    frame = _parsed(artifacts).withColumn(
        "bare", F.when(M.may_hold_fence(body), bare)
    ).withColumn("at", F.transform(
        "bare", lambda b: (b["line"] + F.col("fm.body_line")).cast("string")))
    return _outcome(frame, "runbook-fences-labeled", F.array(
        F.when(body.isNull(), NEVER_CLOSED)
        .when(F.size("at") > 0, F.concat(
            F.lit("code fences without a language label at lines "), F.array_join("at", ", ")))))


def sql_lexical_profile(artifacts: DataFrame) -> DataFrame:
    """Statements, open quotes, parentheses and the last terminator of SQL files."""
    dialect = header_dialect(F.col("text"))
    frame = artifacts.select("ref", "text", dialect.alias("dialect")).withColumn(
        "family", T.lookup(fixed.SQL_FAMILIES, F.lower("dialect"))
    ).withColumn("scan", sql_scan("text", "family"))
    scan = F.col("scan")
    hint = F.when(F.col("family").isNotNull(), "").otherwise(F.concat(
        F.lit(" (dialect "), F.coalesce("dialect", F.lit("unspecified")),
        F.lit(": only standard SQL quoting is recognized; label the fence or set a default dialect)")))
    ender = F.when(F.col("family").eqNullSafe(F.lit("tsql")), "';' or a GO line").otherwise("';'")
    problem = (
        F.when(scan["error"].isNotNull(), F.concat(scan["error"], hint))
        .when(scan["open_line"].isNotNull(), F.concat(
            F.lit("'(' opened on line "), scan["open_line"].cast("string"),
            F.lit(" is never closed"), hint))
        .when((scan["statements"] == 0) & scan["trailing"].isNull(), "no SQL statement below the header")
        .when(scan["trailing"].isNotNull(), F.concat(
            F.lit("the last statement (from line "), scan["trailing"].cast("string"),
            F.lit(") does not end with "), ender, hint))
    )
    return frame.select(
        "ref", "dialect", F.lit("sql-lexical").alias("check_name"),
        F.when(problem.isNull(), "passed").otherwise("failed").alias("status"),
        F.coalesce(problem, F.lit("")).alias("detail"), scan["statements"].alias("statements"),
    )


# ---- verdicts ------------------------------------------------------------------------
def decide_verdict(results: DataFrame, planned: DataFrame) -> DataFrame:
    """Verdict per ref from ``results`` and ``planned(ref, complete, notes)``.

    One aggregate over the check rows; advisory checks never count, and a
    required failure beats everything else.
    """
    required = F.col("required")
    worst = results.groupBy("ref").agg(
        F.count_if(required).alias("n_required"),
        F.array_sort(F.collect_list(F.when(
            required & F.col("status").isin("failed", "not-run", "error"),
            F.struct("seq", "check_name", "status", "detail")))).alias("bad"),
    )
    frame = planned.join(worst, "ref", "left").withColumns({
        "n_required": F.coalesce("n_required", F.lit(0)),
        "bad": F.coalesce("bad", F.array().cast(worst.schema["bad"].dataType)),
    })
    failed = F.filter("bad", lambda c: c["status"] == "failed")
    unclear = F.filter("bad", lambda c: c["status"] != "failed")
    note = F.get("notes", F.lit(0))
    doubts = F.concat(
        F.array_compact(F.array(
            F.when(~F.col("complete"), F.concat(
                F.lit("plan is incomplete: cannot auto-verify"),
                F.when(note.isNotNull(), F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""))),
            F.when(F.col("n_required") == 0, F.lit("plan has no required check")),
        )),
        F.transform(unclear, lambda c: F.concat(
            F.lit("required check "), c["check_name"],
            F.when(c["status"] == "not-run", F.lit(" did not run: ")).otherwise(F.lit(" errored: ")),
            c["detail"])),
    )
    return frame.withColumns({"_failed": failed, "_doubts": doubts}).select(
        "ref",
        F.when(F.size("_failed") > 0, "failed").when(F.size("_doubts") > 0, "inconclusive")
        .otherwise("passed").alias("verdict"),
        F.when(F.size("_failed") > 0, F.transform("_failed", lambda c: F.concat(
            F.lit("required check "), c["check_name"], F.lit(" failed"))))
        .when(F.size("_doubts") > 0, F.col("_doubts"))
        .otherwise(F.array(F.concat(
            F.lit("all "), F.col("n_required").cast("string"), F.lit(" required check(s) passed"))))
        .alias("reasons"),
    )


def record_verification_run(runs: DataFrame) -> DataFrame:
    """Latest run per ref. ``max_by`` combines map-side, so a hot ref is cheap."""
    others = [c for c in runs.columns if c != "ref"]
    latest = F.max_by(F.struct(*others), F.struct("verified_at", "sha256")).alias("run")
    return runs.groupBy("ref").agg(latest).select("ref", "run.*")


def verification_freshness(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Whether a recorded run still describes the file: same stamp, same bytes."""
    now = artifacts.select("ref", F.col("compiled").alias("_compiled"), F.col("sha256").alias("_sha"))
    return records.join(now, "ref", "left").withColumn(
        "fresh",
        F.when(F.col("_sha").isNull(), "missing")
        .when((F.col("_compiled") == F.col("compiled")) & (F.col("_sha") == F.col("sha256")), "fresh")
        .otherwise("stale"),
    ).drop("_compiled", "_sha")
