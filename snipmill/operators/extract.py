"""Documents to fenced blocks to candidates.

A document is one or more *segments* ``(doc_key, seg_no, line_base, text)``: a
Markdown file is one segment, a conversation one segment per turn, so a long
conversation is never joined into one row. Headings, turns, paragraphs and
counts carry over between segments as running maxima and sums.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import markdown as M
from snipmill.functions import secrets as S
from snipmill.functions import text as T
from snipmill.operators.revisions import revision_groups
from snipmill.operators.running import SLICE, Running, add_running, add_total, top_position
from snipmill.session import cut_lineage

FRONT_MATTER_LINES = 10  # of a rendered transcript, see render.front_matter


@T.built_once
def _events() -> Column:
    return M.events(F.col("text"))


@T.built_once
def _ends_open() -> Column:
    return M.ends_open(F.col("text"))


# ---- segments ----------------------------------------------------------------
def strip_front_matter(docs: DataFrame) -> DataFrame:
    """``(doc_key, text)`` to one segment each; ``line_base`` counts the lines dropped.

    ``head`` is the front matter itself: a compile scans it for secrets, though no block comes from it.
    """
    matter = F.regexp_extract(F.col("text"), fixed.DOCUMENT_FRONT_MATTER, 0)
    return docs.select(
        "doc_key",
        F.lit(0).alias("seg_no"),
        T.newlines(matter).alias("line_base"),
        F.substring(F.col("text"), F.length(matter) + 1, F.length("text")).alias("text"),
        matter.alias("head"),
    )


@T.built_once
def turn_part() -> Column:
    """Marker line and content of one turn, as the transcript holds it."""
    content = T.strip_newlines(T.unix_newlines(F.col("content_md")))
    marker = F.concat(
        F.lit("<!-- turn "), F.col("idx").cast("string"), F.lit(" role="), F.col("role"),
        F.when((F.col("ts").isNotNull()) & (F.col("ts") != ""), F.concat(F.lit(" ts="), F.col("ts")))
        .otherwise(F.lit("")),
        F.lit(" -->"),
    )
    return T.let(
        content, lambda c: F.when(c == "", marker).otherwise(F.concat(marker, F.lit("\n"), c))
    )


def turn_segments(turns: DataFrame, top: int | None = None,
                  slice_size: int | None = None) -> DataFrame:
    """Turns ``(doc_key, idx, role, content_md, ts)`` to segments, one per turn.

    A turn that leaves a fence (or an HTML block with an end tag) open makes the turns after it fence text, and a
    fence body is one value. So from the first such turn on a document becomes
    one segment; all turns before it, and all other documents, stay as they are.
    ``top`` is an upper bound of ``idx`` when the caller has one.
    """
    parts = turns.select("doc_key", F.col("idx").cast("int").alias("seg_no"),
                         turn_part().alias("text"))
    open_parts = parts.where(M.may_stay_open(F.col("text"))).where(_ends_open())
    top = top_position(turns, "idx") if top is None else top
    if not open_parts.isEmpty():
        opened = open_parts.groupBy("doc_key").agg(F.min("seg_no").alias("_from"))
        marked = parts.join(opened, "doc_key", "left")
        tail = F.coalesce(F.col("seg_no") >= F.col("_from"), F.lit(False))
        glued = marked.where(tail).groupBy("doc_key", "_from").agg(
            F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("p")
        ).select("doc_key", F.col("_from").alias("seg_no"), F.array_join("p.text", "\n\n").alias("text"))
        parts = marked.where(~tail).drop("_from").unionByName(glued)
    height = T.newlines(F.col("text")) + 2
    based = add_running(
        parts, ["doc_key"], "seg_no", ["seg_no"],
        [Running("line_base", "sum", height, current=False)], top, slice_size or SLICE,
    )
    base = (F.col("line_base") + FRONT_MATTER_LINES + 1).cast("int")
    return based.select("doc_key", "seg_no", base.alias("line_base"), "text")


# ---- turn markers --------------------------------------------------------------
def turn_markers(segments: DataFrame) -> DataFrame:
    """One row per turn marker line, fences included; lines count from 1 in the file."""
    marked = segments.where(F.col("text").contains("<!--"))
    return marked.select(
        "doc_key", "line_base", F.explode(M.markers(F.col("text"))).alias("m")
    ).select(
        "doc_key", (F.col("line_base") + F.col("m.line") + 1).alias("line"),
        F.col("m.turn").alias("turn"), F.col("m.role").alias("role"),
    )


# ---- events with carried context -------------------------------------------------
def block_events(segments: DataFrame, *, whole_paragraphs: bool = False, top: int | None = None,
                 slice_size: int | None = None) -> DataFrame:
    """Markers, headings, paragraphs and fences in order, each with its context.

    Adds ``turn, role`` (last marker at or before the line), ``heading_path``,
    ``fence_no``, ``para`` (a paragraph with nothing but text since) and
    ``user_para`` (first paragraph of the latest earlier user turn). ``top`` is
    an upper bound of ``seg_no`` when the caller has one.
    """
    sizes = {"slice_size": slice_size or SLICE}
    top = top_position(segments, "seg_no") if top is None else top
    sliced = top >= sizes["slice_size"]
    # The automaton of containers is a function of its own column, so it comes before the generator. For a generator
    # that drops empty arrays the optimizer would add a filter on their size, and with it the automaton a second time.
    exploded = segments.select("doc_key", "seg_no", "line_base", _events().alias("_events")).select(
        "doc_key", "seg_no", "line_base", F.posexplode_outer("_events").alias("ev_no", "e")
    ).where("ev_no IS NOT NULL")
    text = F.col("e.text")
    if not whole_paragraphs:
        text = F.when(F.col("e.kind") == "para", T.first_sentence(text)).otherwise(text)
    events = exploded.select(
        "doc_key", "seg_no", "ev_no", F.col("e.kind").alias("kind"),
        (F.col("line_base") + F.col("e.line") + 1).alias("line_start"),
        (F.col("line_base") + F.col("e.line_end")).alias("line_end"),
        F.col("e.level").alias("level"), text.alias("text"), F.col("e.label").alias("lang_raw"),
        F.col("e.body").alias("body"), F.col("e.closed").alias("closed"),
        F.col("e.turn").alias("marker_turn"), F.col("e.role").alias("marker_role"),
    )
    if sliced:
        events = cut_lineage(events)  # the sliced form reads the events more than once

    place = [F.col("seg_no"), F.col("ev_no")]
    is_kind = {k: F.col("kind") == k for k in ("marker", "heading", "para", "fence")}
    order = ["seg_no", "ev_no"]
    levels = range(1, 7)
    events = add_running(
        events, ["doc_key"], "seg_no", order,
        [
            Running("_m", "max", F.when(is_kind["marker"], F.struct(*place, "marker_turn", "marker_role"))),
            Running("fence_no", "sum", is_kind["fence"].cast("int")),
            *[
                Running(f"_h{n}", "max",
                        F.when(is_kind["heading"] & (F.col("level") == n), F.struct(*place, "text")))
                for n in levels
            ],
        ],
        top, **sizes,
    )
    events = events.withColumn("turn", F.col("_m.marker_turn")).withColumn(
        "role", F.col("_m.marker_role")
    )
    # A heading stands when no heading of a higher rank came after it.
    standing = []
    for n in levels:
        at = F.struct(F.col(f"_h{n}.seg_no"), F.col(f"_h{n}.ev_no"))
        rule = F.col(f"_h{n}").isNotNull()
        for higher in range(1, n):
            above = F.struct(F.col(f"_h{higher}.seg_no"), F.col(f"_h{higher}.ev_no"))
            rule = rule & (F.col(f"_h{higher}").isNull() | (above < at))
        standing.append(F.when(rule, F.col(f"_h{n}.text")))
    events = events.withColumn(
        "heading_path", F.filter(F.array(*standing), lambda h: h.isNotNull())
    ).drop("_m", *[f"_h{n}" for n in levels])

    events = add_running(
        events, ["doc_key"], "seg_no", order,
        [
            Running(
                "_last", "max",
                F.when(~is_kind["marker"], F.struct(*place, "kind", "text", "turn")),
                current=False,
            ),
        ],
        top, **sizes,
    )
    pending = (F.col("_last.kind") == "para") & F.col("_last.turn").eqNullSafe(F.col("turn"))
    events = events.withColumn("para", F.when(pending, F.col("_last.text"))).drop("_last")

    # The role of a turn number is the one its last marker gives.
    by_turn = Window.partitionBy("doc_key", "turn")
    final_role = F.max(F.when(is_kind["marker"], F.struct(*place, "marker_role"))).over(by_turn)
    opening = F.min(F.when(is_kind["para"], F.struct(*place))).over(by_turn)
    events = events.withColumn(
        "_user_para",
        F.when(
            F.col("turn").isNotNull() & (final_role["marker_role"] == "user")
            & is_kind["para"] & (F.struct(*place) == opening),
            F.struct(F.col("turn"), F.col("text")),
        ),
    ).withColumn(
        "_at", F.coalesce(F.col("turn"), F.lit(-1)) * 2 + F.col("_user_para").isNotNull().cast("int")
    )
    turn_top = top_position(turn_markers(segments), "turn") * 2 + 1 if sliced else 0
    events = add_running(
        events, ["doc_key"], "_at", ["_at", "seg_no", "ev_no"],
        [Running("_said", "max", F.col("_user_para"), current=False)], turn_top, **sizes,
    )
    earlier = F.col("turn").isNotNull() & (F.col("_said.turn") < F.col("turn"))
    return events.withColumn("user_para", F.when(earlier, F.col("_said.text"))).drop(
        "_said", "_user_para", "_at", "marker_turn", "marker_role"
    )


def extract_fences(segments: DataFrame, **options) -> DataFrame:
    """Every fenced block with its label, body, lines and context."""
    events = block_events(segments, **options)
    return events.where(F.col("kind") == "fence").select(
        "doc_key", F.col("fence_no").cast("int").alias("fence_no"), "lang_raw", "body",
        "line_start", "line_end", "closed", "turn", "role", "heading_path", "para", "user_para",
    )


def document_fences(docs: DataFrame, **options) -> DataFrame:
    """Fences of whole documents; texts that cannot hold one are dropped at the scan."""
    segments = strip_front_matter(docs.where(M.may_hold_fence(F.col("text"))))
    return extract_fences(segments, top=0, **options)


# ---- classification --------------------------------------------------------------
def classify_label(fences: DataFrame) -> DataFrame:
    """Language, artifact type and dialect of a fence label; NULL when unknown."""
    return fences.withColumns(_label_columns())


@T.built_once
def _label_columns() -> dict[str, Column]:
    label = F.col("lang_raw")
    return {
        "lang": T.lookup({k: v[0] for k, v in fixed.LABELS.items()}, label),
        "artifact_type": T.lookup({k: v[1] for k, v in fixed.LABELS.items()}, label),
        "dialect": T.lookup({k: v[2] for k, v in fixed.LABELS.items() if v[2]}, label),
    }


def skip_reason(classified: DataFrame, languages: Collection[str] = fixed.DEFAULT_LANGUAGES, *,
                include_user: bool = False) -> DataFrame:
    """Why a fence is not a candidate: first rule that holds; NULL for candidates."""
    unknown = sorted(set(languages) - set(fixed.LANGUAGES))
    if unknown:
        raise ValueError(f"unknown languages {unknown}; known are {list(fixed.LANGUAGES)}")
    reason, detail = _reason_columns(tuple(languages), include_user)
    return classified.withColumn("reason", reason).withColumn("detail", detail)


@T.built_once
def _reason_columns(languages: tuple[str, ...], include_user: bool) -> tuple[Column, Column]:
    label, lang = F.col("lang_raw"), F.col("lang")
    rules = [
        (T.is_blank(F.col("body")), "empty"),
        (label.isNull(), "unlabeled"),
        (label.isin(*fixed.CONSOLE_LABELS), "console"),
        (lang.isNull(), "non-target-lang"),
        (~lang.isin(*languages), "non-target-lang"),
    ]
    if not include_user:
        rules.append((F.col("role").eqNullSafe(F.lit("user")), "user-turn"))
    detail = (
        F.when(F.col("reason") != "non-target-lang", "")
        .when(lang.isNull(), "unrecognized label")
        .when(F.col("reason").isNotNull(), F.concat(lang, F.lit(" not selected")))
    )
    return T.first_of(rules), detail


def fence_secrets(fences: DataFrame, patterns: S.Patterns | None = None) -> DataFrame:
    """Secrets inside fences, reported as lines of the file."""
    hit = S.find_secret(F.col("body"), patterns)
    return (
        fences.select("doc_key", "fence_no", "line_start", hit.alias("hit"))
        .where(F.col("hit").isNotNull())
        .select("doc_key", "fence_no", F.col("hit.label").alias("label"),
                (F.col("line_start") + F.col("hit.line")).alias("line"))
    )


# ---- candidate columns -------------------------------------------------------------
def _comment_name(body: Column, lang: Column) -> Column:
    lines = F.transform(F.slice(F.split(body, T.LINE_ENDS, -1), 1, fixed.NAME_SCAN_LINES), T.strip)
    chain = None
    for language, pattern in fixed.COMMENT_BY_LANGUAGE.items():
        skips = fixed.COMMENT_SKIP_BY_LANGUAGE.get(language, fixed.COMMENT_SKIP)

        def named(line: Column) -> Column:
            said = F.lower(F.regexp_extract(line, pattern, 1))
            keep = ~line.startswith("#!") & line.rlike(pattern)
            for skip in skips:
                keep = keep & ~said.startswith(skip)
            return keep

        found = F.get(F.filter(lines, named), F.lit(0))
        chain = (F if chain is None else chain).when(
            lang == language, T.slug(F.regexp_extract(found, pattern, 1))
        )
    return chain


@T.built_once
def _name_column() -> Column:
    heading = T.slug(F.get(F.col("heading_path"), F.size("heading_path") - 1))
    return F.coalesce(
        F.nullif(heading, F.lit("")),
        _comment_name(F.col("body"), F.col("lang")),
        F.format_string("block-%02d", F.col("fence_no")),
    )


def candidate_name(frame: DataFrame) -> DataFrame:
    """Slug of the last heading, else of the first comment, else ``block-NN``."""
    return frame.withColumn("name_proposal", _name_column())


@T.built_once
def _description_column() -> Column:
    empty = F.lit("")
    return F.coalesce(
        F.nullif(T.first_sentence(F.col("user_para")), empty),
        F.nullif(T.strip_lead_in(T.first_sentence(F.col("para"))), empty),
        F.array_join("heading_path", " / "),
    )


def candidate_description(frame: DataFrame) -> DataFrame:
    """Earlier user question, else the paragraph above, else the heading path."""
    return frame.withColumn("description", _description_column())


@T.built_once
def _normal_body() -> Column:
    return T.normalize(F.col("body"))


def normalize_and_hash(frame: DataFrame) -> DataFrame:
    return frame.withColumn("body_norm", _normal_body()).withColumn(
        "sha256", F.sha2(F.col("body_norm"), 256)
    )


def risk_flags(frame: DataFrame, generic: S.Patterns | None = None,
               by_language: dict[str, S.Patterns] | None = None) -> DataFrame:
    """Distinct labels in table order: the shared table, then that of the language."""
    generic = fixed.RISK_PATTERNS if generic is None else generic
    by_language = fixed.LANGUAGE_RISK_PATTERNS if by_language is None else by_language
    special = [(lang, *row) for lang, rows in by_language.items() for row in rows]
    return frame.withColumn("flags", _flags_column(T.table(generic), T.table(special)))


@T.built_once
def _flags_column(generic: tuple, special: tuple) -> Column:
    body = F.col("body")
    hits = [F.when(body.rlike(pattern), F.lit(label)) for label, pattern in generic]
    hits += [
        F.when((F.col("lang") == lang) & body.rlike(pattern), F.lit(label))
        for lang, label, pattern in special
    ]
    found = F.array(*hits) if hits else F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(found))


def candidates(fences: DataFrame, languages: Collection[str] = fixed.DEFAULT_LANGUAGES, *,
               include_user: bool = False, risk: S.Patterns | None = None,
               language_risk: dict[str, S.Patterns] | None = None) -> DataFrame:
    """All fences with ``reason``; rows without one carry the candidate columns."""
    ruled = skip_reason(classify_label(fences), languages, include_user=include_user)
    named = candidate_description(candidate_name(ruled))
    return risk_flags(normalize_and_hash(named), risk, language_risk)


# ---- revisions within one document ---------------------------------------------------
def supersede_by_name(found: DataFrame, *, all_revisions: bool = False, top: int | None = None,
                      slice_size: int | None = None) -> DataFrame:
    """Mark all but the last fence of one (document, language, name) as superseded.

    ``top`` is an upper bound of ``fence_no`` when the caller has one (0 when
    every document is one row); without it the data is asked.
    """
    return _mark_revisions(
        found, ["doc_key", "lang", "name_proposal"], F.col("name_proposal"),
        all_revisions, top, slice_size,
    )


def _mark_revisions(found: DataFrame, group: list[str], target: Column, all_revisions: bool,
                    top: int | None, slice_size: int | None) -> DataFrame:
    open_row = F.col("reason").isNull()
    if all_revisions:
        return found.withColumns({
            "supersedes": F.lit(None).cast("string"), "superseded_count": F.lit(0),
        })
    sizes = {} if slice_size is None else {"slice_size": slice_size}
    top = top_position(found, "fence_no") if top is None else top
    kept = add_running(
        found, group, "fence_no", ["fence_no"],
        [
            Running("_prev", "max", F.when(open_row, F.struct("fence_no", "sha256")), current=False),
            Running("_before", "sum", open_row.cast("int"), current=False),
        ],
        top, **sizes,
    )
    kept = add_total(kept, group, Running("_all", "sum", open_row.cast("int")), top, **sizes)
    last = F.col("_before") == F.col("_all") - 1
    return kept.withColumns({
        "supersedes": F.when(open_row & last, F.col("_prev.sha256")),
        "superseded_count": F.when(open_row & last, F.col("_before")).otherwise(0).cast("int"),
        "detail": F.when(open_row & ~last, F.concat(F.lit("→ "), target)).otherwise(F.col("detail")),
        "reason": F.when(open_row & ~last, F.lit("superseded")).otherwise(F.col("reason")),
    }).drop("_prev", "_before", "_all")


def supersede_by_similarity(found: DataFrame, *, all_revisions: bool = False,
                            top: int | None = None, slice_size: int | None = None) -> DataFrame:
    """Like ``supersede_by_name``, but bodies that are 70 % alike are revisions too.

    The rule is greedy and depends on order; ``revisions.revision_groups`` settles it in rounds, so that
    no task compares more than a chunk of a document with a tile of its groups.
    """
    if all_revisions:
        return supersede_by_name(found, all_revisions=True)
    found = cut_lineage(found)  # read for the groups and for the rows
    groups = revision_groups(found).withColumnsRenamed({"doc_key": "_doc", "fence_no": "_no"})
    numbered = found.join(groups, found.doc_key.eqNullSafe(F.col("_doc")) & (found.fence_no == F.col("_no")), "left").drop("_doc", "_no")
    top = top_position(found, "fence_no") if top is None else top
    limit = slice_size or SLICE
    if top >= limit:
        numbered = cut_lineage(numbered)  # the sliced form reads the rows more than once
    last = Running("_last", "max", F.when(
        F.col("reason").isNull(), F.struct("fence_no", "name_proposal")))
    group = ["doc_key", "lang", "revision_group"]
    named = add_total(numbered, group, last, top, limit)
    return _mark_revisions(
        named, group, F.col("_last.name_proposal"), False, top, slice_size
    ).drop("_last", "revision_group")


def dedup_against_library(found: DataFrame, library: DataFrame) -> DataFrame:
    """Survivors whose hash is in ``library(sha256)`` become ``dupe-in-library`` skips."""
    held = library.select(F.col("sha256").alias("_held")).where(F.col("_held").isNotNull()).distinct()
    joined = found.join(
        held, F.col("reason").isNull() & (found["sha256"] == F.col("_held")), "left"
    )
    dupe = F.col("_held").isNotNull()
    return joined.withColumns({
        "detail": F.when(dupe, F.col("name_proposal")).otherwise(F.col("detail")),
        "reason": F.when(dupe, F.lit("dupe-in-library")).otherwise(F.col("reason")),
    }).drop("_held")


# ---- accounting ------------------------------------------------------------------------
def document_stats(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Per document: fences seen, highest turn, transcript mode, candidates."""
    markers = turn_markers(segments).groupBy("doc_key").agg(F.max("turn").alias("turns"))
    fences = found.groupBy("doc_key").agg(
        F.count("*").alias("fences_seen"),
        F.count_if(F.col("reason").isNull()).alias("candidates"),
    )
    docs = segments.select("doc_key").distinct()
    return docs.join(markers, "doc_key", "left").join(fences, "doc_key", "left").select(
        "doc_key",
        F.coalesce("fences_seen", F.lit(0)).alias("fences_seen"),
        F.coalesce("turns", F.lit(0)).alias("turns"),
        F.col("turns").isNotNull().alias("transcript_mode"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def extract_stats(found: DataFrame) -> DataFrame:
    """Counts by raw label and by artifact type, in long form."""
    labels = found.groupBy(
        F.lit("label").alias("measure"), F.coalesce("lang_raw", F.lit("(unlabeled)")).alias("value")
    ).count()
    types = found.where(F.col("reason").isNull()).groupBy(
        F.lit("artifact_type").alias("measure"), F.col("artifact_type").alias("value")
    ).count()
    return labels.unionByName(types).withColumnRenamed("count", "n")


def fence_accounting(seen: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Check per document that fences seen = outcomes; a gap fails the job.

    ``outcomes`` holds one row per fence with ``outcome`` draft, skipped or
    unsupported. Counting partial aggregates keeps a hot document cheap.
    """
    counted = (
        seen.select("doc_key", F.lit("seen").alias("outcome"))
        .unionByName(outcomes.select("doc_key", "outcome"))
        .groupBy("doc_key")
        .agg(*[
            F.count_if(F.col("outcome") == o).alias(n)
            for o, n in (("seen", "fences_seen"), ("draft", "drafts"), ("skipped", "skipped"),
                         ("unsupported", "unsupported"))
        ])
    )
    balanced = F.col("fences_seen") == F.col("drafts") + F.col("skipped") + F.col("unsupported")
    return counted.where(
        F.when(balanced, True).otherwise(
            F.raise_error(F.concat(F.lit("fences lost in document "), F.col("doc_key").cast("string")))
            .cast("boolean")
        )
    )
