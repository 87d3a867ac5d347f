"""Whole chains over a corpus: import, compile, verify."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import secrets as S
from snipmill.operators import emit, events, extract, imports, refuse, verify
from snipmill.plans.extensions import BUILT_IN, Extensions
from snipmill.session import cut_lineage


@dataclass(frozen=True)
class Imported:
    """Frames of one import."""

    parts: DataFrame         # transcript parts of accepted conversations
    destinations: DataFrame  # where each accepted transcript goes
    refused: DataFrame       # conversations that hold a secret
    ledger: DataFrame        # one event row per conversation; empty on a dry run


def import_corpus(headers: DataFrame, turns: DataFrame, taken: DataFrame, *, year: str, month: str,
                  ts: Column, title: str | None = None, dry_run: bool = False,
                  patterns: S.Patterns | None = None, top: int | None = None) -> Imported:
    """Render, refuse, name and log imported conversations.

    ``headers`` carry ``source_path`` beside the header columns. A refused
    conversation gets a ``refused`` event and nothing else.
    """
    parts = imports.render_parts(headers, turns, title)
    segments = imports.part_segments(parts, top)
    # Read by the parts, the names and the ledger: scan the texts once.
    refused = cut_lineage(refuse.segment_secrets(segments, patterns))
    accepted = headers.join(refused.select("doc_key"), "doc_key", "left_anti")
    named = accepted if title is None else accepted.withColumn("title", F.lit(title))
    destinations = imports.transcript_destinations(named, taken, year, month)
    counts = turns.groupBy("doc_key").agg(F.count("*").cast("int").alias("turns"))
    logged = headers.join(counts, "doc_key", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))
    return Imported(
        parts=parts.join(refused.select("doc_key"), "doc_key", "left_anti"),
        destinations=destinations, refused=refused,
        ledger=events.import_events(logged, refused, destinations, ts, dry_run),
    )


@dataclass(frozen=True)
class Compiled:
    """Frames of one compile: nothing is written until a sink is given them."""

    refused: DataFrame      # documents that hold a secret
    drafts: DataFrame       # one row per draft, with name and content
    skipped: DataFrame      # one row per fence that made no draft
    accounting: DataFrame   # counts by document; reading it fails if a fence is in neither

    def outcomes(self) -> DataFrame:
        """One row for each fence and each refused document: (doc_key, fence_no, outcome, what)."""
        none = F.lit(None).cast("int")
        return self.drafts.select("doc_key", "fence_no", F.lit("draft").alias("outcome"), F.col("filename").alias("what")).unionByName(
            self.skipped.select("doc_key", "fence_no", F.lit("skipped").alias("outcome"), F.col("reason").alias("what"))
        ).unionByName(self.refused.select("doc_key", none.alias("fence_no"), F.lit("refused").alias("outcome"), F.col("label").alias("what")))


def compile_corpus(segments: DataFrame, taken: DataFrame, context: emit.RenderContext, *,
                   library: DataFrame | None = None, sources: DataFrame | None = None,
                   enabled: Sequence[str] | None = None,
                   languages: Collection[str] = fixed.LANGUAGES, include_user: bool = False,
                   similarity: bool = True, patterns: S.Patterns | None = None,
                   raw: DataFrame | None = None, namespace: Column | None = None,
                   top: int | None = None, extensions: Extensions = BUILT_IN) -> Compiled:
    """Scan, refuse, extract, assign, name and render every document of a corpus.

    ``sources(doc_key, source)`` gives the header's source label; it is scanned too, as is the front matter that
    ``segments`` carry in ``head``. ``raw(doc_key, text)`` are whole files, for segments that were cut
    from files without ``head``; segments with neither are a conversation's own turns. Refusal comes
    first and removes whole documents; no later frame sees a row of them. ``namespace`` names
    the library of a candidate from its columns; names clash within one only. ``top`` bounds
    segment and fence numbers when the caller knows them.
    """
    heads = [] if raw is None else [raw]
    if "head" in segments.columns:
        heads.append(segments.select("doc_key", F.col("head").alias("text")).where("text <> ''"))
    if sources is not None:
        heads.append(sources.select("doc_key", F.col("source").alias("text")))
    accepted, refused = refuse.refuse_segments(segments, patterns, heads)
    fences = extract.extract_fences(accepted, top=top)
    found = extract.candidates(fences, languages, include_user=include_user)
    revise = extract.supersede_by_similarity if similarity else extract.supersede_by_name
    revised = revise(found, top=top)
    if library is not None:
        revised = extract.dedup_against_library(revised, library)
    # Everything below reads the candidates several times: write them once.
    assigned = cut_lineage(emit.assign_emitter(revised, emit.enabled_rules(enabled, extensions.rules)))
    skipped = assigned.where(F.col("reason").isNotNull()).select(
        "doc_key", "fence_no", "reason",
        F.when(F.col("reason").isin("superseded", "dupe-in-library", "unsupported-emitter"),
               F.col("lang")).otherwise(F.col("lang_raw")).alias("lang"),
        "detail", "line_start", "line_end", "turn", "role",
    )
    named = emit.name_drafts(assigned, taken, namespace)
    if sources is None:
        named = named.withColumn("source", F.lit("-"))
    else:
        named = named.join(sources.select("doc_key", "source"), "doc_key", "left")
    drafts = emit.render_drafts(named, context, extensions.renderers)
    unsupported = F.col("reason") == "unsupported-emitter"
    outcomes = drafts.select("doc_key", F.lit("draft").alias("outcome")).unionByName(
        skipped.select("doc_key", F.when(unsupported, "unsupported").otherwise("skipped").alias("outcome")))
    return Compiled(
        refused=refused, drafts=drafts, skipped=skipped,
        accounting=extract.fence_accounting(fences, outcomes),
    )


def run_checks(artifacts: DataFrame, external: DataFrame | None = None, extensions: Extensions = BUILT_IN) -> DataFrame:
    """Plan rows of every artifact with the status of each check.

    The checks of ``extensions`` run here; ``external(ref, check_name, status, detail)``
    brings what linters and parsers found. A check nobody ran is ``not-run``.
    """
    planned = verify.rebuild_plan(artifacts, extensions.rules, extensions.plan_rows, extensions.incomplete)
    outcomes = [
        check.run(artifacts.where(F.col("ref").startswith(f"{check.kind}/") & F.col("ref").endswith(check.extension)))
        for check in extensions.checks
    ]
    if external is not None:
        outcomes.append(external.select("ref", "check_name", "status", "detail"))
    found = reduce(DataFrame.unionByName, outcomes)
    return planned.join(found, ["ref", "check_name"], "left").withColumns({
        "status": F.coalesce("status", F.lit("not-run")),
        "detail": F.coalesce("detail", F.lit("no result for this check")),
    })


def verify_corpus(artifacts: DataFrame, verified_at: str, external: DataFrame | None = None,
                  extensions: Extensions = BUILT_IN) -> DataFrame:
    """One verification record per artifact ``(ref, text, state, compiled)``."""
    results = run_checks(artifacts, external, extensions)
    planned = verify.rebuild_plan(artifacts, extensions.rules, extensions.plan_rows, extensions.incomplete).select("ref", "emitter", "complete", "notes").distinct()
    verdicts = verify.decide_verdict(results, planned)
    return artifacts.select(
        "ref", "state", "compiled", F.sha2("text", 256).alias("sha256"),
        F.lit(verified_at).alias("verified_at"),
    ).join(verdicts, "ref").join(planned.select("ref", "emitter"), "ref")
