"""Importers, emitters and checks by name.

``BUILT_IN`` lists the library's own. ``BUILT_IN.plus(...)`` gives a list with more, which ``compile_corpus``,
``run_checks``, ``verify_corpus``, ``detect`` and ``import_entries`` take: nothing in the library changes for a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.operators import emit, imports, verify
from snipmill.sources import files


@dataclass(frozen=True)
class Importer:
    """Reads entries of one export format: ``read(entries)`` gives ``(headers, turns, errors)``.

    A file is of this format if the first element has all ``keys``.
    """

    name: str
    keys: tuple[str, ...]
    read: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


@dataclass(frozen=True)
class Emitter:
    """Makes files of one kind from candidates of an artifact type (and language, if one is given).

    ``render`` gets the ``emit.Parts`` of a draft. ``checks`` are rows ``(seq, name, kind, required, tool, argv)``;
    a plan that is not ``complete`` can't establish a pass.
    """

    name: str
    artifact_type: str
    language: str | None
    extension: str
    executable: bool
    kind: str
    render: Callable[[emit.Parts], Column]
    checks: tuple[tuple, ...] = ()
    complete: bool = True

    @property
    def rule(self) -> tuple:
        return (self.name, self.artifact_type, self.language, self.extension, self.executable, self.kind)


@dataclass(frozen=True)
class Check:
    """A check that runs here: ``run(artifacts)`` gives ``(ref, check_name, status, detail)`` of files of a kind."""

    name: str
    kind: str
    extension: str
    run: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Extensions:
    importers: tuple[Importer, ...]
    emitters: tuple[Emitter, ...]
    checks: tuple[Check, ...]

    def plus(self, *more: Importer | Emitter | Check) -> Extensions:
        """This list with ``more`` behind it; a name that is there already is refused."""
        out = self
        for item in more:
            field = {Importer: "importers", Emitter: "emitters", Check: "checks"}[type(item)]
            held = getattr(out, field)
            if any(h.name == item.name for h in held):
                raise ValueError(f"{field} already have {item.name!r}")
            out = replace(out, **{field: (*held, item)})
        return out

    @property
    def rules(self) -> list[tuple]:
        return [e.rule for e in self.emitters]

    @property
    def renderers(self) -> tuple:
        return tuple((e.name, e.render) for e in self.emitters)

    @property
    def plan_rows(self) -> tuple:
        return tuple((e.name, *row[:5], tuple(row[5])) for e in self.emitters for row in e.checks)

    @property
    def incomplete(self) -> tuple[str, ...]:
        return tuple(e.name for e in self.emitters if not e.complete)


def _own_checks(emitter: str) -> tuple[tuple, ...]:
    return tuple(tuple(row[1:]) for row in fixed.CHECKS if row[0] == emitter)


BUILT_IN = Extensions(
    importers=(
        Importer(fixed.TREE_ADAPTER, fixed.ADAPTER_KEYS[fixed.TREE_ADAPTER], imports.import_tree),
        Importer(fixed.FLAT_ADAPTER, fixed.ADAPTER_KEYS[fixed.FLAT_ADAPTER], imports.import_flat),
    ),
    emitters=tuple(Emitter(*rule, render=emit.RENDERERS[rule[0]], checks=_own_checks(rule[0]),
                           complete=rule[0] not in fixed.INCOMPLETE_PLANS) for rule in fixed.EMITTERS),
    checks=(
        Check("prompt-front-matter", "prompts", ".md", lambda rows: verify.lint_front_matter(rows, "prompt")),
        Check("prompt-body", "prompts", ".md", verify.lint_prompt_body),
        Check("prompt-placeholders", "prompts", ".md", verify.lint_placeholders),
        Check("runbook-front-matter", "runbooks", ".md", lambda rows: verify.lint_front_matter(rows, "runbook")),
        Check("runbook-title", "runbooks", ".md", verify.lint_runbook_title),
        Check("runbook-fences-labeled", "runbooks", ".md", verify.lint_unlabeled_fences),
        Check("sql-lexical", "scripts", ".sql",
              lambda rows: verify.sql_lexical_profile(rows).select("ref", "check_name", "status", "detail")),
    ),
)


def detect(inputs: DataFrame, extensions: Extensions = BUILT_IN, adapter: str | None = None) -> DataFrame:
    """``(path, adapter, error)`` of inputs, among all importers of the list and plain Markdown."""
    return files.detect_format(inputs, adapter, keys={i.name: i.keys for i in extensions.importers})


def import_entries(entries: DataFrame, extensions: Extensions = BUILT_IN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers, turns, errors)`` of entries with the name of their importer in ``adapter``.

    Entries of an unknown importer are errors.
    """
    parts = [i.read(entries.where(F.col("adapter") == i.name).drop("adapter")) for i in extensions.importers]
    headers, turns, errors = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kind) for kind in zip(*parts, strict=True))
    known = F.col("adapter").isin(*[i.name for i in extensions.importers])
    unknown = entries.where(~F.coalesce(known, F.lit(False))).select("conv_key", F.lit("unknown importer").alias("error"))
    return headers, turns, errors.unionByName(unknown, allowMissingColumns=True)
