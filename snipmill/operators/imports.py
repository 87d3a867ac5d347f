"""Exports and Markdown to ordered turns and transcripts.

Export entries are ``(conv_key, entry)`` with ``entry`` a VARIANT, one row per
conversation. Turns are ``(doc_key, idx, role, content_md, ts, metadata)``.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.functions import text as T
from snipmill.functions import transcript as R
from snipmill.operators.extract import turn_part
from snipmill.operators.names import resolve_collisions
from snipmill.operators.running import Running, add_running, add_total, top_position
from snipmill.session import cut_lineage

# ---- variant helpers ---------------------------------------------------------
def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(_kind(value).startswith(kind), F.lit(False))


def _at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _text(value: Column, path: str) -> Column:
    """The string at a path; NULL for any other type."""
    found = _at(value, path)
    return F.when(_kind(found) == "STRING", F.try_variant_get(value, path, "string"))


def _number(value: Column, path: str) -> Column:
    found = _at(value, path)
    numeric = _kind(found).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(value, path, "double"))


def _first_text(value: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(_text(value, p), F.lit("")) for p in paths])


# ---- headers -------------------------------------------------------------------
def export_header(entries: DataFrame, adapter: str) -> DataFrame:
    """Id, title and time of each export entry, with the fallbacks of its family.

    ``listed_at`` is what a listing shows (update time only); ``exported_at``
    falls back to the creation time.
    """
    entry = F.col("entry")
    if adapter == fixed.TREE_ADAPTER:
        source = fixed.TREE_SOURCE
        ids, title = ("$.conversation_id", "$.id"), _first_text(entry, "$.title")
        updated, created = (R.iso_millis(_number(entry, p)) for p in ("$.update_time", "$.create_time"))
    elif adapter == fixed.FLAT_ADAPTER:
        source = fixed.FLAT_SOURCE
        ids, title = ("$.uuid", "$.id"), _first_text(entry, "$.name")
        updated, created = _text(entry, "$.updated_at"), _text(entry, "$.created_at")
    else:
        raise ValueError(f"unknown adapter {adapter!r}; known are {sorted(fixed.ADAPTER_KEYS)}")
    return entries.select(
        "conv_key", F.lit(source).alias("source"), F.lit(adapter).alias("adapter"),
        _first_text(entry, *ids).alias("conversation_id"),
        F.coalesce(title, F.lit("untitled")).alias("title"),
        F.coalesce(updated, created).alias("exported_at"), updated.alias("listed_at"),
    )


# ---- tree-shaped exports -----------------------------------------------------------
def _shaped(entries: DataFrame) -> DataFrame:
    """(conv_key, entry, error): what a tree-shaped entry must have."""
    entry = F.col("entry")
    mapping = _at(entry, "$.mapping")
    has_head = F.array_contains(F.map_keys(F.try_variant_get(entry, "$", "map<string,variant>")), "current_node")
    return entries.select(
        "conv_key", "entry",
        F.when(~_is(mapping, "OBJECT"), "missing mapping").when(
            ~F.coalesce(has_head, F.lit(False)), "missing current_node").alias("error"),
    )


def tree_nodes(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, heads, errors)`` of tree-shaped entries."""
    shaped = _shaped(entries)
    good = shaped.where(F.col("error").isNull())
    nodes = good.select(
        "conv_key", F.explode(F.try_variant_get("entry", "$.mapping", "map<string,variant>"))
        .alias("node_id", "node"),
    ).where(_is(F.col("node"), "OBJECT")).select(
        "conv_key", "node_id", F.try_variant_get("node", "$.parent", "string").alias("parent"),
        F.when(_is(_at(F.col("node"), "$.message"), "OBJECT"), _at(F.col("node"), "$.message")).alias("message"),
    )
    heads = good.select("conv_key", F.try_variant_get("entry", "$.current_node", "string").alias("current_node"))
    return nodes, heads, shaped.where(F.col("error").isNotNull()).select("conv_key", "error")


def linearize_tree(nodes: DataFrame, heads: DataFrame, most_nodes: int | None = None
                   ) -> tuple[DataFrame, DataFrame]:
    """Active path of each conversation: ``(turns, errors)``.

    ``nodes(conv_key, node_id, parent, has_message)`` and ``heads(conv_key,
    current_node)``. Parent links are followed by doubling: after k rounds a
    row jumps 2^k links, so a path of n nodes takes log2(n) joins. Joins are on
    (conversation, node), which is unique, so one huge conversation spreads
    over all tasks. ``turns`` has the 1-based ``idx`` of nodes with a message;
    branches off the path are never reached.
    """
    links = nodes.select("conv_key", "node_id", "parent", "has_message")
    if most_nodes is None:
        most_nodes = top_position(links.groupBy("conv_key").agg(F.count("*").alias("n")), "n")
    rounds = max(1, math.ceil(math.log2(most_nodes + 1)))
    started = heads.where(F.col("current_node").isNotNull())
    path = started.select("conv_key", F.col("current_node").alias("node_id"), F.lit(0).alias("depth"))
    jump = links.where(F.col("parent").isNotNull()).select(
        "conv_key", "node_id", F.col("parent").alias("ancestor")
    )
    for k in range(rounds):
        step = path.join(jump, ["conv_key", "node_id"], "left")
        steps = F.array_compact(F.array(
            F.struct("node_id", "depth"),
            F.when(F.col("ancestor").isNotNull(),
                   F.struct(F.col("ancestor").alias("node_id"), (F.col("depth") + 2**k).alias("depth"))),
        ))
        path = step.select("conv_key", F.explode(steps).alias("s")).select("conv_key", "s.*")
        if k + 1 < rounds:
            further = jump.select("conv_key", F.col("node_id").alias("ancestor"),
                                  F.col("ancestor").alias("beyond"))
            # The next round reads the jumps twice, so the plan must not nest.
            jump = cut_lineage(
                jump.join(further, ["conv_key", "ancestor"])
                .select("conv_key", "node_id", F.col("beyond").alias("ancestor"))
            )
    path = cut_lineage(path.join(
        links.withColumn("known", F.lit(True)), ["conv_key", "node_id"], "left"
    ))
    errors = path.groupBy("conv_key", "node_id").agg(
        F.count("*").alias("n"), F.max("known").alias("known"), F.min("depth").alias("depth")
    ).where((F.col("n") > 1) | F.col("known").isNull()).groupBy("conv_key").agg(
        F.when(F.max("n") > 1, "cycle in mapping")
        .when(F.min("depth") == 0, "current_node is not in mapping")
        .otherwise("missing mapping node").alias("error")
    )
    sound = path.where("has_message").join(errors, "conv_key", "left_anti")
    top = top_position(sound, "depth")
    counted = add_running(
        sound, ["conv_key"], "depth", ["depth"],
        [Running("_after", "sum", F.lit(1), current=False)], top,
    )
    counted = add_total(counted, ["conv_key"], Running("_all", "sum", F.lit(1)), top)
    turns = counted.select(
        "conv_key", "node_id", (F.col("_all") - F.col("_after")).cast("int").alias("idx")
    )
    return turns, errors


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def tree_messages(messages: DataFrame) -> DataFrame:
    """Turn columns of tree-shaped messages ``(…, message VARIANT)``."""
    message = F.col("message")
    content = _at(message, "$.content")
    kind = _text(message, "$.content.content_type")
    parts = F.try_variant_get(message, "$.content.parts", "array<variant>")
    has_parts = _is(_at(message, "$.content.parts"), "ARRAY")
    strings = F.filter(
        F.transform(F.filter(parts, lambda p: _kind(p) == "STRING"),
                    lambda p: F.try_variant_get(p, "$", "string")),
        lambda s: s != "",
    )
    is_text = kind.eqNullSafe(F.lit("text"))
    missing = ~_is(content, "OBJECT") | (is_text & ~has_parts)
    raw_kind = F.coalesce(F.to_json(_at(message, "$.content.content_type")), F.lit("null"))
    return messages.withColumns({
        "role": T.lookup(fixed.TREE_ROLES, _text(message, "$.author.role"), F.lit("unknown")),
        "content_md": F.when(is_text & has_parts, F.array_join(strings, "\n\n")).otherwise(""),
        "ts": R.iso_millis(_number(message, "$.create_time")),
        "metadata": F.when(missing, F.create_map(F.lit("missing_content"), F.lit("true")))
        .when(~is_text, F.create_map(F.lit("unsupported_content_type"), raw_kind))
        .otherwise(_empty_map()),
    })


# ---- flat exports ---------------------------------------------------------------------
def flat_messages(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(messages, errors)`` of flat entries: one row per message, in list order."""
    listed = _at(F.col("entry"), "$.chat_messages")
    rows = entries.select(
        "conv_key", _is(listed, "ARRAY").alias("ok"),
        F.try_variant_get("entry", "$.chat_messages", "array<variant>").alias("items"),
    )
    exploded = rows.where("ok").select("conv_key", F.posexplode("items").alias("at", "message"))
    bad = exploded.where(~_is(F.col("message"), "OBJECT")).groupBy("conv_key").agg(
        F.concat(F.lit("chat_messages["), F.min("at").cast("string"), F.lit("] is not an object"))
        .alias("error"))
    missing = rows.where(~F.col("ok")).select("conv_key", F.lit("missing chat_messages").alias("error"))
    messages = exploded.join(bad.select("conv_key"), "conv_key", "left_anti").select(
        "conv_key", (F.col("at") + 1).alias("idx"), "message"
    )
    return messages, missing.unionByName(bad)


def flat_turns(messages: DataFrame) -> DataFrame:
    """Turn columns of flat messages; references are kept, never fetched."""
    message = F.col("message")
    said = _text(message, "$.text")
    kept = []
    for key in fixed.FLAT_REFERENCE_KEYS:
        found = _at(message, f"$.{key}")
        filled = _is(found, "ARRAY") & (F.size(F.try_variant_get(message, f"$.{key}", "array<variant>")) > 0)
        kept.append(F.when(filled, F.struct(F.lit(key).alias("key"), F.to_json(found).alias("value"))))
    kept.append(F.when(said.isNull(), F.struct(
        F.lit("missing_content").alias("key"), F.lit("true").alias("value"))))
    return messages.withColumns({
        "role": T.lookup(fixed.FLAT_ROLES, _text(message, "$.sender"), F.lit("unknown")),
        "content_md": F.coalesce(said, F.lit("")),
        "ts": _text(message, "$.created_at"),
        "metadata": F.map_from_entries(F.array_compact(F.array(*kept))),
    })


TURN_COLUMNS = ["idx", "role", "content_md", "ts", "metadata"]


def _walks(ids: pa.Array, parents: pa.Array, talks: pa.Array, heads: pa.Array) -> pa.Array:
    """For each tree the 1-based turn of every node, 0 off the active path or without a message; or what is wrong."""
    out = []
    for names, above, spoken, at in zip(*(c.to_pylist() for c in (ids, parents, talks, heads)), strict=True):
        place = {name: i for i, name in enumerate(names or ())}
        turns, path, error = [0] * len(place), {}, None
        while at is not None and error is None:
            i = place.get(at)
            if i is None:
                error = "missing mapping node" if path else "current_node is not in mapping"
            elif i in path:
                error = "cycle in mapping"
            else:
                path[i], at = None, above[i]
        if error is None:  # a broken tree has no turns
            for turn, i in enumerate((i for i in reversed(path) if spoken[i]), 1):
                turns[i] = turn
        out.append({"turns": turns, "error": error})
    return pa.array(out, pa.struct([("turns", pa.list_(pa.int32())), ("error", pa.string())]))


@T.built_once
def _walk_udf():
    return F.arrow_udf(_walks, "turns array<int>, error string")


def walk_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(messages, errors)`` of tree-shaped entries: the nodes of the active path with ``idx`` and ``message``.

    An entry holds its whole tree, so it is walked where it lies, without a shuffle. Trees that come as tables of
    nodes go through ``linearize_tree``.
    """
    shaped = _shaped(entries)
    nodes = F.filter(F.map_entries(F.try_variant_get("entry", "$.mapping", "map<string,variant>")), lambda e: _is(e["value"], "OBJECT"))
    trees = shaped.where(F.col("error").isNull()).select(
        "conv_key", nodes.alias("nodes"), F.try_variant_get("entry", "$.current_node", "string").alias("head"))
    walked = trees.select("conv_key", "nodes", _walk_udf()(
        F.transform("nodes", lambda e: e["key"]),
        F.transform("nodes", lambda e: F.try_variant_get(e["value"], "$.parent", "string")),
        F.transform("nodes", lambda e: _is(_at(e["value"], "$.message"), "OBJECT")), F.col("head")).alias("walk"))
    placed = walked.select("conv_key", F.explode(F.arrays_zip(F.col("nodes"), F.col("walk.turns").alias("idx"))).alias("n")).where("n.idx > 0")
    messages = placed.select("conv_key", F.col("n.nodes.key").alias("node_id"), F.col("n.idx").alias("idx"),
                             _at(F.col("n.nodes.value"), "$.message").alias("message"))
    errors = walked.where("walk.error IS NOT NULL").select("conv_key", F.col("walk.error").alias("error"))
    wrong = errors.unionByName(shaped.where(F.col("error").isNotNull()).select("conv_key", "error"))
    return messages, wrong


def import_tree(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers, turns, errors)`` of tree-shaped exports."""
    messages, errors = walk_entries(entries)
    turns = tree_messages(messages).select(F.col("conv_key").alias("doc_key"), *TURN_COLUMNS)
    return _settled(export_header(entries, fixed.TREE_ADAPTER), turns, errors)


def import_flat(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers, turns, errors)`` of flat exports."""
    messages, errors = flat_messages(entries)
    turns = flat_turns(messages).select(F.col("conv_key").alias("doc_key"), *TURN_COLUMNS)
    return _settled(export_header(entries, fixed.FLAT_ADAPTER), turns, errors)


def _settled(headers: DataFrame, turns: DataFrame, errors: DataFrame):
    kept = headers.join(errors.select("conv_key"), "conv_key", "left_anti")
    return kept.withColumnRenamed("conv_key", "doc_key"), turns, errors


# ---- listing and selection ------------------------------------------------------------
def list_conversations(headers: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation, also without turns; counts combine map-side."""
    counts = turns.groupBy("doc_key").agg(F.count("*").alias("turn_count"))
    return headers.join(counts, "doc_key", "left").select(
        "doc_key", F.coalesce("conversation_id", F.lit("?")).alias("conversation_id"), "title",
        F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        F.col("listed_at").alias("exported_at"),
    )


def _grams(text: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    grams = F.transform(places, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(grams)).otherwise(
        F.array().cast("array<string>"))


def select_conversation(selectors: DataFrame, headers: DataFrame) -> DataFrame:
    """Resolve ``selectors(selector_id, export_key, wanted)`` among ``headers``.

    Exact id, then exact title, then title substring without case; the first
    stage with a hit decides and several hits at stage 2 or 3 are ambiguous. A
    NULL selector takes the only conversation of its export. Substrings are
    found by an equi join on the rarest three-letter piece of the needle, so no
    selector is compared with every title.
    """
    known = headers.select("export_key", "doc_key", "conversation_id", "title", "position")
    asked = selectors.where(F.col("wanted").isNotNull())

    def merged(column: Column) -> DataFrame:
        """Conversations that share a value as one row, so no pairs multiply."""
        return known.withColumn("value", column).where(F.col("value").isNotNull()).groupBy(
            "export_key", "value"
        ).agg(F.count("*").alias("n"), F.min(F.struct("position", "doc_key")).alias("first"))

    def exact(column: Column, number: int) -> DataFrame:
        held = merged(column).withColumnRenamed("value", "wanted")
        return asked.join(held, ["export_key", "wanted"]).select(
            "selector_id", F.lit(number).alias("stage"), "n", F.col("first.doc_key").alias("doc_key"))

    # One row per distinct needle and per distinct title, whatever their number.
    low = asked.withColumn("needle", F.lower("wanted"))
    needles = low.select("export_key", "needle").distinct()
    titles = merged(F.lower("title")).withColumnRenamed("value", "low")
    size = F.least(F.lit(3), F.length("needle"))
    pieces = titles.select("export_key", "low", "n", "first", F.explode(F.array_distinct(
        F.concat(*[_grams(F.col("low"), n) for n in (1, 2, 3)]))).alias("gram"))
    counts = pieces.groupBy("export_key", "gram").agg(F.count("*").alias("titles"))
    cut = needles.where("needle <> ''").select(
        "export_key", "needle",
        F.explode(F.when(size == 3, _grams(F.col("needle"), 3)).when(size == 2, _grams(F.col("needle"), 2))
                  .otherwise(_grams(F.col("needle"), 1))).alias("gram"),
    )
    rarest = cut.join(counts, ["export_key", "gram"], "left").groupBy("export_key", "needle").agg(
        F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("g")
    ).select("export_key", "needle", F.col("g.gram").alias("gram"))
    hits = rarest.join(pieces, ["export_key", "gram"]).where(F.col("low").contains(F.col("needle")))
    found = hits.groupBy("export_key", "needle").agg(
        F.sum("n").alias("n"), F.min("first").alias("first")
    ).unionByName(titles.groupBy("export_key").agg(
        F.sum("n").alias("n"), F.min("first").alias("first")).withColumn("needle", F.lit("")))
    by_part = low.join(found, ["export_key", "needle"]).select(
        "selector_id", F.lit(3).alias("stage"), "n", F.col("first.doc_key").alias("doc_key"))

    sizes = known.groupBy("export_key").agg(
        F.count("*").alias("n"), F.min_by("doc_key", "position").alias("doc_key"))
    unnamed = selectors.where(F.col("wanted").isNull()).join(sizes, "export_key", "left").select(
        "selector_id", F.lit(0).alias("stage"), F.coalesce("n", F.lit(0)).alias("n"), "doc_key")
    best = exact(F.col("conversation_id"), 1).unionByName(exact(F.col("title"), 2)).unionByName(
        by_part).unionByName(unnamed).groupBy("selector_id").agg(F.min(F.struct("stage", "n", "doc_key")).alias("b")).select("selector_id", "b.*")
    single = (F.col("stage") == 1) | (F.col("n") == 1)
    return selectors.join(best, "selector_id", "left").select(
        "selector_id",
        F.when(F.col("stage").isNull(), "not_found").when(single, "selected")
        .otherwise("ambiguous").alias("outcome"),
        "stage", F.when(single, F.col("doc_key")).alias("doc_key"),
    )


# ---- transcripts -------------------------------------------------------------------------
def render_parts(headers: DataFrame, turns: DataFrame, title: str | None = None) -> DataFrame:
    """The transcript of each conversation as ordered parts, one row per turn.

    Part 0 is the front matter. Joined with blank lines and a final newline the
    parts are the file. ``title`` overrides the title of every header.
    """
    counts = turns.groupBy("doc_key").agg(F.count("*").alias("turn_count"))
    titled = headers if title is None else headers.withColumn("title", F.lit(title))
    heads = titled.join(counts, "doc_key", "left").withColumn(
        "turn_count", F.coalesce("turn_count", F.lit(0))
    ).select("doc_key", F.lit(0).alias("part_no"), R.front_matter().alias("text"))
    body = turns.select("doc_key", F.col("idx").cast("int").alias("part_no"), turn_part().alias("text"))
    return heads.unionByName(body)


def part_segments(parts: DataFrame, top: int | None = None) -> DataFrame:
    """Transcript parts as segments of the file, for the secret scan.

    The front matter is part of the scan, as a title can hold a secret too.
    """
    top = top_position(parts, "part_no") if top is None else top
    height = T.newlines(F.col("text")) + 2
    based = add_running(parts, ["doc_key"], "part_no", ["part_no"],
                        [Running("line_base", "sum", height, current=False)], top)
    return based.select("doc_key", F.col("part_no").alias("seg_no"),
                        F.col("line_base").cast("int").alias("line_base"), "text")


def transcript_pieces(parts: DataFrame) -> DataFrame:
    """``parts`` with the line ends between them: in ``part_no`` order the texts are the file.

    A transcript is never one row, whatever its size.
    """
    ends = parts.groupBy("doc_key").agg(F.max("part_no").alias("_last"))
    return parts.join(ends, "doc_key").select(
        "doc_key", "part_no",
        F.concat("text", F.when(F.col("part_no") == F.col("_last"), "\n").otherwise("\n\n")).alias("text"))


def parse_turns(docs: DataFrame) -> DataFrame:
    """Turns of canonical bodies ``(doc_key, text)``, in marker order."""
    return docs.select("doc_key", F.posexplode(R.turns_of(F.col("text"))).alias("pos", "t")).select(
        "doc_key", (F.col("pos") + 1).alias("place"), "t.*"
    )


def validate_transcript(docs: DataFrame) -> DataFrame:
    """First rule each document breaks, NULL for a canonical transcript."""
    return docs.select("doc_key", R.parsed_text()["error"].alias("error"))


def scan_canonical(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(headers, turns, errors)`` of canonical transcripts."""
    rows = docs.select("doc_key", R.parsed_text().alias("p"))
    good = rows.where(F.col("p.error").isNull())
    headers = good.select(
        "doc_key", "p.source", "p.adapter", "p.title", "p.conversation_id", "p.exported_at",
        F.size("p.turns").alias("turn_count"),
    )
    turns = good.select("doc_key", F.explode("p.turns").alias("t")).select("doc_key", "t.*")
    return headers, turns, rows.where(F.col("p.error").isNotNull()).select("doc_key", "p.error")


def passthrough_markdown(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(headers, turns)`` of Markdown ``(doc_key, stem, text)``.

    A canonical transcript keeps its own turns; any other text is one
    assistant turn titled by its file stem.
    """
    rows = docs.select("doc_key", "stem", "text", R.parsed_text().alias("p"))
    canonical = F.col("p.error").isNull()
    whole = F.array(F.struct(
        F.lit(1).alias("idx"), F.lit("assistant").alias("role"),
        T.strip_newlines(F.col("text")).alias("content_md"), F.lit(None).cast("string").alias("ts"),
    ))

    def pick(name: str, other: Column) -> Column:
        return F.when(canonical, F.col(f"p.{name}")).otherwise(other).alias(name)

    null = F.lit(None).cast("string")
    headers = rows.select(
        "doc_key", pick("source", F.lit(fixed.MARKDOWN_SOURCE)),
        pick("adapter", F.lit(fixed.MARKDOWN_ADAPTER)), pick("title", F.col("stem")),
        pick("conversation_id", null), pick("exported_at", null),
    )
    turns = rows.select("doc_key", F.explode(F.when(canonical, F.col("p.turns")).otherwise(whole)).alias("t"))
    return headers, turns.select("doc_key", "t.*")


def transcript_destinations(headers: DataFrame, taken: DataFrame, year: str, month: str) -> DataFrame:
    """Path of each new transcript; names never clash and have no upper number."""
    slug = F.coalesce(F.nullif(T.slug(F.col("title"), fixed.TRANSCRIPT_SLUG_MAX), F.lit("")),
                      F.lit("untitled"))
    folder = f"transcripts/{year}/{month}"
    rows = headers.select(
        "doc_key", F.lit(folder).alias("namespace"), F.lit("transcripts").alias("kind"),
        F.lit(".md").alias("extension"), slug.alias("name"),
    )
    named = resolve_collisions(rows, taken, ["doc_key"])
    return named.select(
        "doc_key", F.col("name").alias("slug"),
        F.concat(F.lit(folder + "/"), "final_name", F.lit(".md")).alias("destination"),
    )
