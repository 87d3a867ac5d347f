"""Elements of JSON arrays in files, cut at every place a byte range can end."""

from __future__ import annotations

import json
import os
import random
import zipfile
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from snipmill.sources import json_arrays as J

TRICKY = [
    {"a": "}{][,\"\\", "b": ["x}", {"c": "\\\\\"}"}], "d": "}"}, 1, "s,]}", None, [], {}, [[1, 2], {"k": "é世}😀"}], -1.5, True,
    {"deep": [[[{"x": "}" * 50}]]]}, {"long": "z" * 500},
]


def cut(data: bytes, size: int):
    """All elements when ranges of ``size`` bytes are read on their own, like the tasks do."""
    bounds = [i + 1 for i, b in enumerate(data) if b == 0x7D]
    ranges, begin = [], 0
    for end in bounds:
        if end - begin >= size:
            ranges.append(data[begin:end])
            begin = end
    ranges.append(data[begin:])
    quotes = depth = position = 0
    began, parts, fault = False, {}, None
    for k, piece in enumerate(ranges):
        found = J.Elements(quotes, depth, position, began)
        for p, text, _ in [*found.read(piece), *found.rest()]:
            parts.setdefault(p, []).append(text)
        if k == len(ranges) - 1:
            found.end()
        fault = fault or found.fault
        summary = J.Range()
        summary.read(piece)
        state = quotes % 2
        position += summary.commas[state].get(1 - depth, 0)
        began |= summary.opened[state]
        depth += summary.depth[state]
        quotes = (quotes + summary.quotes) % 2
    return [b"".join(parts[p]) for p in sorted(parts)], fault


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
@pytest.mark.parametrize("indent", [None, 2])
def test_elements_of_any_ranges(size, indent):
    text = json.dumps(TRICKY, indent=indent, ensure_ascii=False).encode()
    found, fault = cut(text, size)
    assert fault is None
    assert [json.loads(x) for x in found] == TRICKY


def test_random_arrays():
    random.seed(2)

    def value(depth):
        kind = random.random()
        if depth and kind < 0.3:
            return [value(depth - 1) for _ in range(random.randint(0, 3))]
        if depth and kind < 0.6:
            return {random.choice("ab}\"\\"): value(depth - 1) for _ in range(random.randint(0, 3))}
        return random.choice([1, None, "", "".join(random.choices("\\\"{}[],x", k=5))])

    for _ in range(400):
        rows = [value(4) for _ in range(random.randint(1, 6))]
        found, fault = cut(json.dumps(rows).encode(), random.choice([1, 5, 30]))
        assert fault is None
        assert [json.loads(x) for x in found] == rows


@pytest.mark.parametrize(("text", "fault"), [
    ('{"a":[1]}', J.NO_ARRAY), ("12", J.NO_ARRAY), ("x[1]", J.NO_ARRAY), ("", J.NO_JSON), ("[1", J.NO_JSON), ('["a', J.NO_JSON),
    ("[1]]", J.NO_JSON), ("[1] x", J.NO_JSON), ("[1][2]", J.NO_JSON), ("[1}", J.NO_JSON), ("[1],", J.NO_JSON), ("[]", None), (" [ ] \n", None),
])
def test_faults_of_the_whole(text, fault):
    assert cut(text.encode(), 10_000)[1] == fault


@pytest.fixture
def exports(tmp_path):
    """A folder of exports: files, folders with neighbours, archives and broken ones."""
    def put(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else json.dumps(data, ensure_ascii=False).encode())

    def pack(name, members):
        path = tmp_path / name
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for member, data in members.items():
                archive.writestr(member, data if isinstance(data, bytes) else json.dumps(data))

    many = [{"id": i, "text": "line\\ \"}\" " * (i % 50)} for i in range(3000)]
    put("one.json", TRICKY)
    put("big/conversations.json", many)
    put("big/user.json", {"not": "an input"})
    put("plain/a.json", [{"x": 1}])
    put("plain/b b.JSON", [{"y": "}"}])
    put("none.json", [])
    put("bad/empty.json", b"")  # no reader of Spark gives a row for it
    put("bad/object.json", {"a": [1]})
    put("bad/open.json", b'[{"a": 1}, {"b": ')
    put("bad/tail.json", b"[1] }")
    put("bad/brace.json", b"[1]}")
    put("bad/comma.json", b"[1,]")
    put("bad/gap.json", b"[,1]")
    put("bad/inner.json", b'[{"a": 1}, {"b" 2}]')
    put("bad/bytes.json", b'[{"a": "\xff"}]')
    pack("z.zip", {"data/conversations.json": many, "other.json": []})
    pack("z0.ZIP", {"other.json": [1]})
    pack("zbad.zip", {"conversations.json": b'[{"a": 1}, '})
    put("znot.zip", b"no archive")
    return str(tmp_path), many


@pytest.mark.parametrize("split", ["64m", "1k"])
def test_files_folders_and_archives(spark, exports, split):
    folder, many = exports
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        entries, errors = J.scan_export_files(spark, folder)
        rows = entries.select("export_key", "position", F.to_json("entry").alias("entry"), "conv_key").collect()
        faults = {os.path.basename(r.path): r.error for r in errors.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r.export_key, r.position)):
        found.setdefault(unquote(r.export_key.split(f"{folder}/")[1]), []).append(json.loads(r.entry))
        assert r.conv_key == f"{r.export_key}#{r.position}"
    assert found == {"one.json": TRICKY, "big/conversations.json": many, "plain/a.json": [{"x": 1}],
                     "plain/b b.JSON": [{"y": "}"}], "z.zip": many}
    assert faults == {
        "object.json": J.NO_ARRAY, "open.json": J.NO_JSON, "tail.json": J.NO_JSON,
        "brace.json": J.NO_JSON, "comma.json": J.NO_JSON, "gap.json": J.NO_JSON, "inner.json": J.NO_JSON,
        "bytes.json": "not valid UTF-8", "z0.ZIP": "no conversations.json in the archive",
        "zbad.zip": J.NO_JSON, "znot.zip": "not a valid zip archive"}


def test_ranges_beyond_the_broadcast(spark, exports, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST", 0)
    entries, _ = J.scan_export_files(spark, exports[0] + "/big")
    assert [json.loads(r.e) for r in entries.orderBy("position").select(F.to_json("entry").alias("e")).collect()] == exports[1]


def test_small_pieces_of_members(tmp_path, monkeypatch):
    monkeypatch.setattr(J, "PIECE", 3)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("conversations.json", json.dumps(TRICKY))
    parts = [r for b in J._member(str(tmp_path / "a.zip")) for r in b.to_pylist()]
    assert [json.loads(r["part"]) for r in parts] == TRICKY
    assert all(r["whole"] for r in parts)
