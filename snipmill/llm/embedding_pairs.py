"""Near-duplicate embeddings: every pair with a high cosine, found tile by tile.

Equal vectors are merged first. The distinct unit vectors are turned into the axes of a
principal component analysis (without centring, so that products stay the same) and put
into tiles: a tree over the leading axes, split at medians of a bounded sample, names
a tile for each vector. The tiles are files in the shared folder, with their bounding boxes.

A pair of tiles whose boxes lie further apart than the threshold allows is left out. For
the others, products of the leading axes come first, as one matrix product; a pair ends
there if that sum plus the product of the lengths of the two rests can't reach the
threshold. What is left is added up over further axes in the same way and at last decided on the
vectors themselves in double precision. A task returns counts for each vector and a
forest of its links, never pairs. The work is that of all tile pairs which the boxes leave.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipmill.llm.common import Forest, NewFile, components, open_folder, staged, table
from snipmill.session import new_folder

#: Vectors of a tile, about, and rows of the sample that places the splits of the tree.
TILE = 2048
SAMPLE = 20_000
#: Axes of the first product, and of each further step.
LEADING, STEP = 16, 16
#: Margin of the bounds, above the error of products in single precision.
SLACK = 1e-4


def _usable(vector: str) -> str:
    return (f"size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
            f" AND exists({vector}, x -> x <> 0)")


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, zeros behind shorter ones, and their lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, width: int) -> np.ndarray:
    """Principal axes as columns, the widest first, from sums over all vectors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = unit(_rows(batch.column(0), width)[0])
            total += x.T @ x
        for i in range(width):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width, i)), pa.array(np.arange(width)), pa.array(total[i])], ["i", "j", "x"])

    out = np.zeros((width, width))
    sums = classes.select("vector").mapInArrow(of, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    for i, j, x in sums.collect():  # width squared numbers
        out[i, j] = x
    return np.linalg.eigh(out)[1][:, ::-1]


def _tree(sample: np.ndarray, leaves: int) -> dict:
    """Medians on the widest of the leading axes, until there are enough leaves."""
    if leaves <= 1 or len(sample) < 2:
        return {}
    head = sample[:, :LEADING]
    axis = int(np.argmax(head.std(axis=0)))
    cut = float(np.median(head[:, axis]))
    low = sample[:, axis] < cut
    if low.all() or not low.any():
        return {}
    return {"axis": axis, "cut": cut, "low": _tree(sample[low], leaves // 2), "high": _tree(sample[~low], leaves - leaves // 2)}


def _leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)

    def walk(node: dict, at: np.ndarray, number: int) -> int:
        if not node:
            out[at] = number
            return number + 1
        low = x[at, node["axis"]] < node["cut"]
        return walk(node["high"], at[~low], walk(node["low"], at[low], number))

    walk(tree, np.arange(len(x)), 0)
    return out


FIELDS = "leaf long, path string, n long, low array<double>, high array<double>"


def _write_tiles(routed: DataFrame, folder: str, axes: np.ndarray, width: int) -> DataFrame:
    """Files of up to ``TILE`` vectors of one leaf: ids, weights, lengths, turned and given vectors."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def save(tile: pa.Table) -> pa.RecordBatch:
            given, sizes = _rows(tile.column("vector").combine_chunks(), width)
            turned = unit(given) @ axes
            out = NewFile(folder, ".tile")
            for part in (tile.column("node").to_numpy(), tile.column("weight").to_numpy(), sizes.astype("<i8"),
                         turned.astype("<f4"), given):
                out.write(np.ascontiguousarray(part).tobytes())
            head = turned[:, :LEADING]
            return pa.RecordBatch.from_pylist([{
                "leaf": tile.column("leaf")[0].as_py(), "path": out.close(), "n": len(tile),
                "low": head.min(axis=0).tolist(), "high": head.max(axis=0).tolist()}])

        def leaf_of(rows: pa.RecordBatch) -> int:
            return rows.column("leaf")[0].as_py()

        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            for piece in np.split(np.arange(len(leaves)), np.flatnonzero(np.diff(leaves)) + 1):
                if not len(piece):
                    continue
                rows = batch.slice(piece[0], len(piece))
                if held and leaf_of(held[0]) != leaf_of(rows):
                    yield save(pa.Table.from_batches(held))
                    held.clear()
                while rows.num_rows:
                    room = TILE - sum(h.num_rows for h in held)
                    held.append(rows.slice(0, room))
                    rows = rows.slice(room)
                    if sum(h.num_rows for h in held) >= TILE:
                        yield save(pa.Table.from_batches(held))
                        held.clear()
        if held:
            yield save(pa.Table.from_batches(held))

    return routed.mapInArrow(write, FIELDS)


def load_tile(folder: str, path: str, n: int, width: int) -> dict[str, np.ndarray]:
    fs, _ = open_folder(folder)
    with fs.open_input_file(path) as file:
        data = file.read()
    out, at = {}, 0
    for name, kind, columns in (("node", "<i8", 0), ("weight", "<i8", 0), ("size", "<i8", 0), ("turned", "<f4", width), ("given", "<f8", width)):
        count = n * max(columns, 1)
        values = np.frombuffer(data, kind, count, at)
        out[name] = values.reshape(n, width) if columns else values
        at += count * values.itemsize
    out["rest"] = np.sqrt(np.maximum(  # length of what follows the first k axes
        np.cumsum((out["turned"].astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1], 0)).astype(np.float32)
    return out


def close_pairs(a: dict, b: dict, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two tiles with a cosine of ``threshold`` or more."""
    width = a["turned"].shape[1]
    k = min(LEADING, width)
    bound = a["turned"][:, :k] @ b["turned"][:, :k].T
    if k < width:
        bound += np.outer(a["rest"][:, k], b["rest"][:, k])
    if same:
        bound[np.tril_indices(len(bound))] = -2
    x, y = np.nonzero(bound >= threshold - SLACK)
    so_far = np.einsum("ij,ij->i", a["turned"][x, :k], b["turned"][y, :k])
    while k < width and len(x):
        end = min(k + STEP, width)
        so_far = so_far + np.einsum("ij,ij->i", a["turned"][x, k:end], b["turned"][y, k:end])
        rest = a["rest"][x, end] * b["rest"][y, end] if end < width else 0
        live = so_far + rest >= threshold - SLACK
        x, y, so_far, k = x[live], y[live], so_far[live], end
    live = a["size"][x] == b["size"][y]
    x, y = x[live], y[live]
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 16):
        p, q = a["given"][x[at:at + (1 << 16)]], b["given"][y[at:at + (1 << 16)]]
        keep[at:at + (1 << 16)] = np.einsum("ij,ij->i", unit(p), unit(q)) >= threshold
    return x[keep], y[keep]


def _compare(index: str, folder: str, width: int, threshold: float):
    """Tile by tile: its own pairs and those with the half of the other tiles that is its share."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = None
        reach = math.sqrt(max(2 - 2 * threshold, 0)) + SLACK
        for batch in batches:
            for number in batch.column(0).to_pylist():
                if tiles is None:
                    fs, path = open_folder(index)
                    with fs.open_input_file(path) as file:
                        tiles = json.loads(file.read())
                    low, high = (np.array([t[k] for t in tiles]) for k in ("low", "high"))
                gap = np.maximum(0, np.maximum(low - high[number], low[number] - high))
                near = np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach)
                # Of two tiles the lower number takes an odd sum, the higher an even one.
                near = near[(near == number) | (((near + number) % 2 == 1) == (near > number))]
                own = load_tile(folder, tiles[number]["path"], tiles[number]["n"], width)
                counts = np.zeros(len(own["node"]), np.int64)
                for other in near.tolist():
                    same = other == number
                    tile = own if same else load_tile(folder, tiles[other]["path"], tiles[other]["n"], width)
                    x, y = close_pairs(own, tile, threshold, same)
                    if not len(x):
                        continue
                    back = np.bincount(y, own["weight"][x], len(tile["node"])).astype(np.int64)
                    counts += np.bincount(x, tile["weight"][y], len(counts)).astype(np.int64)
                    # Rows of both tiles in one numbering for the forest.
                    offset = 0 if same else len(counts)
                    forest = Forest(offset + len(tile["node"]))
                    forest.join(x, y + offset)
                    names = own["node"] if same else np.concatenate([own["node"], tile["node"]])
                    a, b = forest.edges()
                    yield _out(names[a], names[b], 0)
                    if same:
                        counts += back
                    else:
                        hit = np.flatnonzero(back)
                        yield _out(tile["node"][hit], None, back[hit])
                hit = np.flatnonzero(counts)
                yield _out(own["node"][hit], None, counts[hit])

    return compare


def _out(a: np.ndarray, b: np.ndarray | None, n) -> pa.RecordBatch:
    other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), other, pa.array(np.broadcast_to(np.asarray(n, np.int64), len(a)))], ["a", "b", "n"])


def near_embeddings(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row of ``vectors``.

    A vector that is null, empty or zero, or holds a null or non-finite number, links with
    nothing, and neither do vectors of different lengths. Rows without a key have no links, a
    null component and are not kept. Rows that repeat a key with the same vector count as one
    vector, with different ones as one node of the components. An empty table gives none. Other columns
    are not read.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.select(
        F.col(key).cast("long").alias("node"),
        F.when(F.expr(_usable(f"`{vector}`")), F.col(vector).cast("array<double>")).alias("vector")), "vectors")
    # A row without links of its own vector is its own component.
    usable = rows.where("node IS NOT NULL AND vector IS NOT NULL").distinct()
    classes = staged(usable.groupBy("vector").agg(F.min("node").alias("node"), F.count("*").alias("weight")), "vector-classes")
    found = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not found.n:
        return rows.select(F.col("node").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"),
                           F.col("node").isNotNull().alias("kept"))
    axes = _axes(classes, found.width)
    sample = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").toArrow()
    turned = unit(_rows(sample.column(0).combine_chunks(), found.width)[0]) @ axes
    leaves = max(1, round(found.n / TILE))
    tree = _tree(turned, leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = _leaves(tree, unit(_rows(batch.column(0), found.width)[0]) @ axes)
            # A crowded leaf is spread over tasks; its tiles share a box.
            spread = batch.column(1).to_numpy() % 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf), pa.array(spread), *batch.columns], ["leaf", "spread", "vector", "node", "weight"])

    folder = new_folder(spark, "tiles")
    placed = classes.mapInArrow(place, "leaf long, spread long, vector array<double>, node long, weight long")
    routed = placed.repartitionByRange("leaf", "spread", "node").sortWithinPartitions("leaf", "spread", "node")
    index = NewFile(folder, ".json")
    tiles = [t.asDict() for t in staged(_write_tiles(routed, folder, axes, found.width), "tile-index").collect()]
    index.write(json.dumps(tiles).encode())  # a line for each tile of 2,048 vectors
    at = index.close()
    numbers = spark.range(len(tiles)).repartition(max(1, min(len(tiles), 4096)))
    results = staged(numbers.mapInArrow(
        _compare(at, folder, found.width, threshold), "a long, b long, n long"), "vector-links")
    # Rows with an equal vector link with each other and share the links of their class.
    counts = results.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    members = usable.alias("u").join(classes.alias("c"), F.col("u.vector") == F.col("c.vector")).select(
        F.col("u.node"), F.col("c.node").alias("class"), "weight")
    members = staged(members, "members")
    edges = results.where("b IS NOT NULL").select("a", "b").unionByName(
        members.where("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b")))
    roots = staged(components(edges), "roots")
    per_class = members.join(counts, "class", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = staged(per_class.groupBy("node").agg(F.sum("n_links").alias("n_links")), "linked")
    out = rows.select("node").join(linked, "node", "left").join(
        roots.select("node", "root"), "node", "left")
    component = F.coalesce("root", "node")
    return out.select(F.col("node").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("node") == component, F.lit(False)).alias("kept"))


def op10_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (
  SELECT vec_id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (
  SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = e.vec_id
LEFT JOIN (SELECT x, count(*) AS n FROM p GROUP BY x) l ON l.x = e.vec_id
"""

QUERIES = {"op10_embeddings": op10_embeddings}
ORACLES = {"op10_embeddings": OP10_SQL}
