"""Candidates to named, rendered drafts with their check plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill import TOOL, fixed
from snipmill.functions import text as T
from snipmill.operators.names import resolve_collisions

REVIEW_LINE = "DRAFT — not executable until approved"


@dataclass(frozen=True)
class RenderContext:
    """Header values that do not come from the candidate."""

    compiled_at: str
    tool: str = TOOL
    review: str = REVIEW_LINE
    default_dialect: str | None = None


def enabled_rules(enabled: Sequence[str] | None = None, rules: list[tuple] | None = None) -> list[tuple]:
    """Emitter rules by name; unknown or repeated names are refused."""
    rules = fixed.EMITTERS if rules is None else rules
    if enabled is None:
        return list(rules)
    known = {rule[0]: rule for rule in rules}
    unknown = [name for name in enabled if name not in known]
    if unknown:
        raise ValueError(f"unknown emitter names {unknown}; known are {list(known)}")
    if len(set(enabled)) != len(enabled):
        raise ValueError(f"emitter names listed more than once in {list(enabled)}")
    return [known[name] for name in enabled]


def assign_emitter(found: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Exactly one rule per candidate; none makes an ``unsupported-emitter`` skip.

    Two matching rules are a configuration error and fail the job.
    """
    rules = enabled_rules() if rules is None else rules
    if not rules:
        raise ValueError("at least one emitter must be enabled")
    kind, lang = F.col("artifact_type"), F.col("lang")
    matches = F.array_compact(F.array(*[
        F.when((kind == r[1]) & (F.lit(True) if r[2] is None else lang == r[2]), F.lit(r[0]))
        for r in rules
    ]))
    open_row = F.col("reason").isNull()
    checked = found.withColumn("_matches", F.when(open_row, matches)).withColumn(
        "emitter",
        F.when(F.size("_matches") > 1, F.raise_error(
            F.concat(F.lit("several emitters claim one candidate: "), F.array_join("_matches", ", "))
        )).otherwise(F.get("_matches", F.lit(0))),
    )
    missing = open_row & F.col("emitter").isNull()
    result = checked.withColumns({
        "detail": F.when(missing, F.concat(kind, F.lit(": no enabled emitter"))).otherwise(F.col("detail")),
        "reason": F.when(missing, F.lit("unsupported-emitter")).otherwise(F.col("reason")),
    }).drop("_matches")
    return result.withColumns({
        "extension": T.lookup({r[0]: r[3] for r in rules}, F.col("emitter")),
        "kind": T.lookup({r[0]: r[5] for r in rules}, F.col("emitter")),
        "executable_when_approved": F.coalesce(
            F.array_contains(F.array(*[F.lit(r[0]) for r in rules if r[4]]), F.col("emitter")),
            F.lit(False)),
    })


def filename_of(name: Column, extension: Column) -> Column:
    """File name of a proposal; anything but a plain slug fails the job."""
    stem = F.when(extension == ".py", F.replace(name, F.lit("-"), F.lit("_"))).otherwise(name)
    return F.when(name.isNull() | name.rlike(fixed.FILENAME_SLUG), F.concat(stem, extension)).otherwise(
        F.raise_error(F.concat(F.lit("not a file name slug: "), name))
    )


def propose_filename(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn(
        "proposed_filename", filename_of(F.col("name_proposal"), F.col("extension"))
    )


def name_drafts(assigned: DataFrame, taken: DataFrame, namespace: Column | None = None) -> DataFrame:
    """Give each assigned candidate its file name within its ``namespace``, a library.

    Names are settled on thin rows read several times over, so pass a frame
    that is cheap to read again (``cut_lineage``).
    """
    rows = propose_filename(assigned.where(F.col("reason").isNull())).withColumns({
        "namespace": F.lit("library") if namespace is None else namespace,
        "name": F.col("name_proposal"),
    })
    thin = rows.select("namespace", "kind", "extension", "name", "doc_key", "fence_no")
    named = resolve_collisions(thin, taken, ["doc_key", "fence_no"]).select(
        "doc_key", "fence_no", "suffix", "final_name"
    )
    return rows.drop("name").join(named, ["doc_key", "fence_no"]).withColumn(
        "filename", filename_of(F.col("final_name"), F.col("extension"))
    ).withColumn("renamed", F.col("filename") != F.col("proposed_filename"))


# ---- rendering ---------------------------------------------------------------------
def header_value(value: Column, default: str = fixed.FILL_IN) -> Column:
    return F.coalesce(F.nullif(T.one_line(value), F.lit("")), F.lit(default))


def source_label(source: Column, exported_at: Column, title: Column) -> Column:
    """``source exported_at "title"`` with the missing parts left out."""
    def given(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    return F.concat_ws(
        " ", F.coalesce(given(source), F.lit("-")), given(exported_at),
        F.concat(F.lit('"'), given(title), F.lit('"')),
    )


def find_placeholders(body: Column) -> Column:
    """Distinct ``{name}`` and ``{{ name }}`` names in order of first use."""
    rx = F.lit(fixed.PLACEHOLDER)
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, rx, F.lit(1)).alias("a"),
        F.regexp_extract_all(body, rx, F.lit(2)).alias("b"),
    )
    return F.array_distinct(
        F.transform(pairs, lambda p: F.when(p["a"] != "", p["a"]).otherwise(p["b"]))
    )


def _json_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, T.json_string), ", "), F.lit("]"))


def _comment_header(prefix: str, rows: list[tuple[str, Column]]) -> Column:
    parts = []
    for key, value in rows:
        parts += [F.lit(f"{prefix} {key + ':':<{fixed.HEADER_KEY_WIDTH}}"), value, F.lit("\n")]
    return F.concat(*parts)


def _front_matter(rows: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit(f"{key}: "), value) for key, value in rows]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


@dataclass(frozen=True)
class Parts:
    """What a renderer may put together: columns of a draft and of its header."""

    body: Column      # without a shebang line
    whole: Column     # with it
    shebang: Column   # that line with its end, or nothing
    dialect: Column
    rows: list[tuple[str, Column]]  # header rows in order

    def comments(self, prefix: str, rows: list[tuple[str, Column]] | None = None) -> Column:
        return _comment_header(prefix, self.rows if rows is None else rows)

    def matter(self, kind: str, extra: list[tuple[str, Column]] | None = None) -> Column:
        """Front matter with JSON values."""
        fields = [("kind", T.json_string(F.lit(kind)))]
        for key, value in self.rows[:-1]:
            fields.append((key, _json_list(F.col("flags")) if key == "risk-flags" else T.json_string(value)))
        return _front_matter([*fields, *(extra or []), ("verify-with", T.json_string(F.lit(fixed.FILL_IN)))])


def _bash(p: Parts) -> Column:
    return F.concat(F.lit(fixed.BASH_SHEBANG), p.comments("#"), F.lit(fixed.BASH_PREAMBLE + "\n"), p.body)


def _python(p: Parts) -> Column:
    return F.concat(F.lit(fixed.PYTHON_SHEBANG), p.comments("#"), F.lit("\n"), p.body)


def _powershell(p: Parts) -> Column:
    return F.concat(p.shebang, p.comments("#"), F.lit("\n"), p.body)


def _sql(p: Parts) -> Column:
    return F.concat(p.comments("--", [p.rows[0], ("dialect", p.dialect), *p.rows[1:]]), F.lit("\n"), p.whole)


def _prompt(p: Parts) -> Column:
    return F.concat(p.matter("prompt", [("placeholders", _json_list(find_placeholders(p.whole)))]), F.lit("\n"), p.whole)


def _runbook(p: Parts) -> Column:
    return F.concat(p.matter("runbook"), F.lit("\n"), p.whole)


#: Text of a draft by the name of its emitter.
RENDERERS = {"bash": _bash, "python": _python, "powershell": _powershell, "sql": _sql, "prompt": _prompt, "runbook": _runbook}


@T.built_once
def render(context: RenderContext, renderers: tuple) -> Column:
    """Whole text of a draft, from the columns of ``name_drafts`` and ``source``; ``renderers`` are (name, function)."""
    body, flags = F.col("body"), F.col("flags")
    compiled = F.lit(f"{context.tool} {context.compiled_at}")
    rows = [
        ("name", F.col("filename")),
        ("source", header_value(F.col("source"), "-")),
        ("compiled", header_value(compiled)),
        ("description", header_value(F.col("description"))),
        ("review", F.lit(context.review)),
        ("risk-flags", F.when(F.size(flags) > 0, F.array_join(flags, ", ")).otherwise("none")),
        ("verify-with", F.lit(fixed.FILL_IN)),
    ]
    shebang = T.rstrip(F.regexp_extract(T.unix_newlines(body), r"\A#![^\n]*\n?", 0))
    parts = Parts(
        body=T.artifact_body(body, strip_shebang=True), whole=T.artifact_body(body),
        shebang=F.when(shebang != "", F.concat(shebang, F.lit("\n"))).otherwise(""),
        dialect=F.coalesce("dialect", F.lit(context.default_dialect), F.lit("unspecified")), rows=rows)
    chain = None
    for name, make in renderers:
        chain = (F if chain is None else chain).when(F.col("emitter") == name, make(parts))
    return chain


def render_drafts(named: DataFrame, context: RenderContext, renderers: tuple = tuple(RENDERERS.items())) -> DataFrame:
    """Drafts with ``content``; needs ``source`` and the columns of ``name_drafts``."""
    return named.withColumn("content", render(context, tuple(renderers)))


# ---- check plans ---------------------------------------------------------------------
@T.built_once
def _plan_notes(default_dialect: str | None) -> Column:
    """Notes of a plan: what a pass would not show, then the risk note."""
    emitter, body, flags = F.col("emitter"), F.col("body"), F.col("flags")
    requires = F.regexp_extract_all(
        T.artifact_body(body, strip_shebang=True), F.lit(fixed.POWERSHELL_REQUIRES), F.lit(1)
    )
    dialect = F.coalesce(F.col("dialect"), F.lit(default_dialect))
    linter = T.lookup(fixed.SQL_LINT_DIALECTS, F.lower(dialect), F.lit(fixed.SQL_LINT_FALLBACK))
    unmapped = (linter == fixed.SQL_LINT_FALLBACK) & ~F.lower(
        F.coalesce(dialect, F.lit(""))
    ).eqNullSafe(F.lit(fixed.SQL_LINT_FALLBACK))
    return F.array_compact(F.array(
        F.when(emitter == "powershell", F.lit(
            "no required check: PowerShell can only be parsed by pwsh, which is not run here; "
            "treat as cannot-auto-verify")),
        F.when((emitter == "powershell") & (F.size(requires) > 0), F.concat(
            F.lit("declares #Requires "), F.array_join(requires, "; "),
            F.lit(" (not checked by parsing)"))),
        F.when((emitter == "sql") & unmapped, F.concat(
            F.lit("dialect '"), F.coalesce(dialect, F.lit("unspecified")),
            F.lit(f"' has no sqlfluff mapping; the sqlfluff parse uses '{fixed.SQL_LINT_FALLBACK}'"))),
        F.when(F.size(flags) > 0, F.concat(
            F.lit("risk flags present ("), F.array_join(flags, ", "),
            F.lit("): review these lines during manual verification"))),
    ))


def plans(drafts: DataFrame, default_dialect: str | None = None,
          incomplete: tuple[str, ...] = fixed.INCOMPLETE_PLANS) -> DataFrame:
    """One plan per draft: whether it can establish a pass, and its notes."""
    return drafts.withColumns({
        "complete": ~F.col("emitter").isin(*incomplete),
        "notes": _plan_notes(default_dialect),
    })


def plan_checks(drafts: DataFrame, default_dialect: str | None = None, checks: Sequence[tuple] = fixed.CHECKS,
                incomplete: tuple[str, ...] = fixed.INCOMPLETE_PLANS) -> DataFrame:
    """Each draft with its checks in order, one row per check of ``checks`` (emitter, seq, name, kind, required, tool, argv)."""
    table = tuple((*row[:6], tuple(row[6])) for row in checks)
    return plans(drafts, default_dialect, incomplete).select("*", F.inline(_check_rows(default_dialect, table)))


@T.built_once
def _check_rows(default_dialect: str | None, checks: tuple) -> Column:
    dialect = F.coalesce(F.col("dialect"), F.lit(default_dialect))
    linter = T.lookup(fixed.SQL_LINT_DIALECTS, F.lower(dialect), F.lit(fixed.SQL_LINT_FALLBACK))
    listed = None
    for emitter in dict.fromkeys(row[0] for row in checks):
        rows = [
            F.struct(
                F.lit(seq).alias("seq"), F.lit(name).alias("check_name"),
                F.lit(kind).alias("check_kind"), F.lit(required).alias("required"),
                F.lit(tool).cast("string").alias("tool"),
                (F.array(*[linter if a == "{dialect}" else F.lit(a) for a in argv])
                 if argv else F.array().cast("array<string>")).alias("argv"),
            )
            for owner, seq, name, kind, required, tool, argv in checks if owner == emitter
        ]
        listed = (F if listed is None else listed).when(F.col("emitter") == emitter, F.array(*rows))
    return listed
