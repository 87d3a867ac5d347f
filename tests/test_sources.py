"""Readers and writers over real files, and imports from them."""

from __future__ import annotations

import json
import random
import zipfile

import pytest

from pyspark.sql import functions as F

from snipmill.operators import imports as I
from snipmill.operators.curate import reference_status
from snipmill.operators.records import scan_records
from snipmill.sources import files, sinks


def node(parent, role=None, parts=None, kind="text", t=None):
    message = None if role is None else {
        "author": {"role": role}, "create_time": t, "content": {"content_type": kind, "parts": parts}}
    return {"parent": parent, "message": message}


TREE = [
    {"title": "Edited", "conversation_id": "c1", "update_time": 1700000000.25, "current_node": "d", "mapping": {
        "r": node(None), "a": node("r", "user", ["first try"]), "b": node("r", "user", ["second", "", "part"], t=1700000001),
        "c": node("a", "assistant", ["dropped"]), "d": node("b", "tool", ["x"], kind="image")}},
    {"title": None, "id": "c2", "create_time": 1600000000, "current_node": None, "mapping": {}},
    {"title": "Loop", "id": "c3", "current_node": "a", "mapping": {"a": node("b", "user", ["x"]), "b": node("a", "user", ["y"])}},
    {"title": "Lost", "id": "c4", "current_node": "z", "mapping": {"a": node(None)}},
    {"title": "Gap", "id": "c5", "current_node": "a", "mapping": {"a": node("q", "user", ["x"])}},
    {"title": "NoHead", "id": "c6", "mapping": {}}, {"title": "NoMap", "id": "c7", "current_node": "a"},
]
FLAT = [
    {"uuid": "u1", "name": "Basic", "created_at": "d1", "chat_messages": [
        {"sender": "human", "text": "hi", "created_at": "t1", "attachments": [{"n": 1}], "files": []},
        {"sender": "assistant", "text": None}, {"sender": "bot", "text": "x"}]},
    {"uuid": "u2", "name": "Broken"}, {"uuid": "u3", "name": "Odd", "chat_messages": ["text"]},
]


@pytest.fixture
def exports(tmp_path):
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "conversations.json").write_text(json.dumps(TREE), encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "flat.zip", "w") as z:
        z.writestr("a/other.json", "[]")
        z.writestr("a/conversations.json", json.dumps(FLAT))
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("x.txt", "x")
    (tmp_path / "fake.zip").write_bytes(b"no zip")
    (tmp_path / "bad.json").write_bytes(b"[\xff]")
    (tmp_path / "object.json").write_text("{}")
    (tmp_path / "note.md").write_text("# hi")
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


def _by_name(rows, *fields):
    return {r["path"].rsplit("/", 1)[1]: tuple(r[f] for f in fields) for r in rows}


def test_detect(spark, exports):
    inputs = files.scan_inputs(spark, str(exports))
    got = _by_name(files.detect_format(inputs).collect(), "adapter", "error")
    assert got == {
        "conversations.json": ("chatgpt-v1", None), "flat.zip": ("claude-v1", None), "note.md": ("markdown-v1", None),
        "empty.zip": (None, "unsupported"), "fake.zip": (None, "unsupported"), "bad.json": (None, "unsupported"),
        "object.json": (None, "unsupported"), "other.txt": (None, "unsupported"),
    }
    forced = files.detect_format(inputs, "claude-v1").collect()
    assert {r["adapter"] for r in forced} == {"claude-v1"}
    with pytest.raises(ValueError):
        files.detect_format(inputs, "other")


def test_export_errors(spark, exports):
    inputs = files.scan_inputs(spark, str(exports)).where("path like '%.zip' or path like '%.json'")
    _, errors = files.scan_chat_export(inputs)
    assert _by_name(errors.collect(), "error") == {
        "empty.zip": ("no conversations.json in the archive",), "fake.zip": ("not a valid zip archive",),
        "bad.json": ("not valid UTF-8",), "object.json": ("top level is not an array",)}


def _entries(spark, exports, name):
    inputs = files.scan_inputs(spark, str(exports)).where(f"path like '%{name}'")
    return files.scan_chat_export(inputs)[0]


def test_tree_import(spark, exports):
    headers, turns, errors = I.import_tree(_entries(spark, exports, "conversations.json"))
    ends = lambda key: int(key.rsplit("#", 1)[1])
    got = [(ends(r["doc_key"]), r["idx"], r["role"], r["content_md"], r["ts"], r["metadata"])
           for r in turns.orderBy("doc_key", "idx").collect()]
    assert got == [
        (0, 1, "user", "second\n\npart", "2023-11-14T22:13:21.000+00:00", {}),
        (0, 2, "tool", "", None, {"unsupported_content_type": '"image"'}),
    ]
    assert {ends(r["conv_key"]): r["error"] for r in errors.collect()} == {
        2: "cycle in mapping", 3: "current_node is not in mapping", 4: "missing mapping node",
        5: "missing current_node", 6: "missing mapping"}
    heads = {ends(r["doc_key"]): (r["conversation_id"], r["title"], r["exported_at"], r["listed_at"]) for r in headers.collect()}
    assert heads == {0: ("c1", "Edited", "2023-11-14T22:13:20.250+00:00", "2023-11-14T22:13:20.250+00:00"),
                     1: ("c2", "untitled", "2020-09-13T12:26:40.000+00:00", None)}
    listed = I.list_conversations(headers, turns).orderBy("doc_key").collect()
    assert [(r["conversation_id"], r["turn_count"]) for r in listed] == [("c1", 2), ("c2", 0)]


def test_flat_import(spark, exports):
    headers, turns, errors = I.import_flat(_entries(spark, exports, "flat.zip"))
    got = [(r["idx"], r["role"], r["content_md"], r["ts"], r["metadata"]) for r in turns.orderBy("idx").collect()]
    assert got == [
        (1, "user", "hi", "t1", {"attachments": '[{"n":1}]'}), (2, "assistant", "", None, {"missing_content": "true"}),
        (3, "unknown", "x", None, {})]
    assert {r["error"] for r in errors.collect()} == {"missing chat_messages", "chat_messages[0] is not an object"}
    assert [(r["conversation_id"], r["exported_at"], r["listed_at"]) for r in headers.collect()] == [("u1", "d1", None)]


def test_round_trip(spark):
    turns = spark.createDataFrame([
        (1, 1, "user", "héllo\r\nworld\n", "2026-01-01T00:00:00Z"), (1, 2, "tool", "", None),
        (1, 3, "assistant", "<!-- note -->\n\n```sh\nx\n```", None),
    ], "doc_key int, idx int, role string, content_md string, ts string")
    headers = spark.createDataFrame([(1, "s", "a-v1", None, 'Say "hi": yes\n', "2026"), (2, "-", "null", " x", "true", "")],
                                    "doc_key int, source string, adapter string, conversation_id string, title string, exported_at string")
    def whole(parts):
        return I.transcript_pieces(parts).groupBy("doc_key").agg(
            F.array_join(F.array_sort(F.collect_list(F.struct("part_no", "text")))["text"], "").alias("text"))

    texts = whole(I.render_parts(headers, turns))
    heads, back, errors = I.scan_canonical(texts)
    assert errors.count() == 0
    assert [(r["idx"], r["role"], r["content_md"], r["ts"]) for r in back.orderBy("idx").collect()] == [
        (1, "user", "héllo\nworld", "2026-01-01T00:00:00Z"), (2, "tool", "", None),
        (3, "assistant", "<!-- note -->\n\n```sh\nx\n```", None)]
    fields = ("source", "adapter", "conversation_id", "title", "exported_at")
    assert {tuple(r[f] for f in fields) for r in heads.collect()} == {tuple(r[f] for f in fields) for r in headers.collect()}
    renamed = whole(I.render_parts(headers, turns, title="Other"))
    assert all("title: Other\n" in r["text"] for r in renamed.collect())


def test_select(spark):
    heads = spark.createDataFrame([
        ("e", 0, "id0", "Deploy Plan", 0), ("e", 1, "id1", "deploy plan", 1), ("e", 2, "id2", "Other Ümlaut", 2), ("f", 3, "id3", "Solo", 0),
    ], "export_key string, doc_key int, conversation_id string, title string, position int")
    asks = spark.createDataFrame([
        (1, "e", "id1"), (2, "e", "deploy plan"), (3, "e", "PLAN"), (4, "e", "ümlaut"), (5, "e", "nothing"), (6, "e", None),
        (7, "f", None), (8, "f", "ol"), (9, "f", ""), (10, "e", "Id1"), (11, "g", None),
    ], "selector_id int, export_key string, wanted string")
    got = {r["selector_id"]: (r["outcome"], r["doc_key"]) for r in I.select_conversation(asks, heads).collect()}
    assert got == {
        1: ("selected", 1), 2: ("selected", 1), 3: ("ambiguous", None), 4: ("selected", 2), 5: ("not_found", None),
        6: ("ambiguous", None), 7: ("selected", 3), 8: ("selected", 3), 9: ("selected", 3), 10: ("not_found", None),
        11: ("ambiguous", None)}


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("\n\nhello\n", encoding="utf-8")
    (tmp_path / "b.markdown").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_text("no")
    docs, errors = files.scan_markdown(spark, str(tmp_path))
    headers, turns = I.passthrough_markdown(docs)
    assert [(r["title"], r["source"]) for r in headers.collect()] == [("a", "markdown")]
    assert [(r["idx"], r["role"], r["content_md"]) for r in turns.collect()] == [(1, "assistant", "hello")]
    assert errors.count() == 1


def test_library_and_registries(spark, tmp_path):
    for state in ("drafts", "approved", "revoked"):
        (tmp_path / "artifacts" / state / "scripts").mkdir(parents=True)
    (tmp_path / "artifacts/drafts/scripts/a.sh").write_text("#!/bin/sh\n# compiled:    gen 1 \nx\n")
    (tmp_path / "artifacts/approved/scripts/b.sh").write_text("x\n# compiled: gen 2\n")
    (tmp_path / "artifacts/revoked/scripts/c.sh").write_text("# compiled: gen 3\n")
    found = {r["ref"]: (r["state"], r["compiled"]) for r in files.scan_library(spark, str(tmp_path)).collect()}
    assert found == {"scripts/a.sh": ("draft", "gen 1"), "scripts/b.sh": ("approved", None)}
    refs = spark.createDataFrame([("scripts/a.sh", "gen 1"), ("scripts/a.sh", "old"), ("scripts/z.sh", "g")], "ref string, compiled string")
    status = reference_status(refs, files.scan_library(spark, str(tmp_path)))
    assert [r["status"] for r in status.orderBy("ref", "compiled").collect()] == ["draft", "stale", "missing"]

    tags = tmp_path / "tags.json"
    tags.write_text(json.dumps({"schema": "tags/1", "artifacts": {"scripts/a.sh": {"compiled": "g", "tags": ["b", "a", "b"]}}}))
    assert sorted(r["tag"] for r in files.scan_tags(spark, str(tags)).collect()) == ["a", "b"]
    for broken in ({"schema": "x", "artifacts": {}}, {"schema": "tags/1", "artifacts": {"bad": {"compiled": "g", "tags": ["a"]}}},
                   {"schema": "tags/1", "artifacts": {"scripts/a.sh": {"compiled": "", "tags": ["a"]}}},
                   {"schema": "tags/1", "artifacts": {"scripts/a.sh": {"compiled": "g", "tags": []}}},
                   {"schema": "tags/1", "artifacts": {"scripts/a.sh": {"compiled": "g", "tags": ["A B"]}}}):
        tags.write_text(json.dumps(broken))
        with pytest.raises(Exception, match="tags.json"):
            files.scan_tags(spark, str(tags)).collect()

    folder = tmp_path / "collections"
    folder.mkdir()
    good = {"schema": "collection/1", "name": "ops", "title": "t", "description": "", "members": [{"ref": "scripts/a.sh", "compiled": "g"}]}
    (folder / "ops.json").write_text(json.dumps(good))
    (folder / ".tmp.json").write_text("{")
    collections, members = files.scan_collections(spark, str(folder))
    assert [tuple(r) for r in collections.collect()] == [("ops", "t", "")]
    assert [tuple(r) for r in members.collect()] == [("ops", 1, "scripts/a.sh", "g")]
    (folder / "ops.json").write_text(json.dumps({**good, "members": good["members"] * 2}))
    with pytest.raises(Exception, match="listed twice"):
        files.scan_collections(spark, str(folder))[1].collect()


def test_record_files(spark, tmp_path):
    (tmp_path / "pub_1.json").write_text('{"id": "pub_1", "publication_state": "published"}')
    (tmp_path / "pub_2.json").write_text('{"id": "pub_9"}')
    (tmp_path / "pub_3.json").write_text("[1]")
    rows = scan_records(files.scan_record_files(spark, str(tmp_path)), "id string, publication_state string")
    assert _by_name(rows.collect(), "code") == {
        "pub_1.json": (None,), "pub_2.json": ("security_violation",), "pub_3.json": ("dependency_unavailable",)}


def test_event_lines(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, "é")], "a int, b string, c string")
    sinks.sink_events(frame, str(tmp_path / "log"))
    sinks.sink_events(frame, str(tmp_path / "log"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"a":1,"b":null,"c":"é"}'] * 2


def test_transcript_files_are_whole(spark, tmp_path):
    pieces = spark.createDataFrame(
        [(d, n, f"part {n} of {d} é\n\n" * (n + 1)) for d in range(7) for n in range(5)] + [(7, 0, None)],
        "doc_key long, part_no int, text string").repartition(6)
    places = spark.createDataFrame([(d, f"transcripts/2026/0{d % 3 + 1}/t {d}.md") for d in range(8)], "doc_key long, destination string")
    for _ in range(2):  # a second run, like a task that runs again, gives the same files
        written = {r.destination: r for r in sinks.sink_transcript_files(pieces, places, str(tmp_path)).collect()}
    assert len(written) == 8
    for d in range(8):
        name = f"transcripts/2026/0{d % 3 + 1}/t {d}.md"
        text = "".join(f"part {n} of {d} é\n\n" * (n + 1) for n in range(5)) if d < 7 else ""
        assert (tmp_path / name).read_text() == text
        assert (written[name].n_parts, written[name].n_bytes) == (5 if d < 7 else 1, len(text.encode()))
    assert not list(tmp_path.rglob("*.part"))
    assert sinks.sink_transcript_files(pieces.limit(0), places, str(tmp_path)).collect() == []


def test_walk_in_a_row_equals_the_walk_by_joins(spark):
    rng = random.Random(3)
    entries = [("none", {"mapping": {}, "current_node": None}), ("bad", {"mapping": [], "current_node": "a"}), ("headless", {"mapping": {}}),
               ("odd", {"mapping": {"a": 1, "b": {"parent": "a", "message": {}}}, "current_node": "b"}),
               ("long", {"mapping": {str(i): {"parent": str(i - 1) if i else None, "message": {"id": i}} for i in range(5000)}, "current_node": "4999"})]
    for k in range(60):
        n = rng.randint(1, 12)
        mapping = {f"n{i}": {"parent": rng.choice([None, f"n{rng.randrange(n + 1)}"]), **({"message": {"id": i}} if rng.random() < 0.8 else {})}
                   for i in range(n)}
        entries.append((f"k{k}", {"mapping": mapping, "current_node": rng.choice([None, f"n{rng.randrange(n + 1)}"])}))
    frame = spark.createDataFrame([(k, json.dumps(e)) for k, e in entries], "conv_key string, json string").select(
        "conv_key", F.parse_json("json").alias("entry")).cache()
    messages, errors = I.walk_entries(frame)
    nodes, heads, shape = I.tree_nodes(frame)
    turns, walk = I.linearize_tree(nodes.withColumn("has_message", F.col("message").isNotNull()), heads)
    assert sorted(map(tuple, messages.select("conv_key", "node_id", "idx").collect())) == sorted(map(tuple, turns.select("conv_key", "node_id", "idx").collect()))
    assert sorted(map(tuple, errors.collect())) == sorted(map(tuple, shape.unionByName(walk).collect()))
    assert "Exchange" not in messages._jdf.queryExecution().executedPlan().toString()
