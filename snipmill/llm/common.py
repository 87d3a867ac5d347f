"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.session import new_folder

#: Words of the query contracts: runs without ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by a URI; any store that Arrow reaches."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class NewFile:
    """A file under a name of its own for every attempt; only a finished one is named by a row.

    A retried or speculative task writes another file, and the manifest rows that
    Spark commits name the files that count.
    """

    def __init__(self, folder: str, suffix: str) -> None:
        self.fs, root = open_folder(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}{suffix}"
        self.out = self.fs.open_output_stream(self.path)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def tell(self) -> int:
        return self.out.tell()

    def close(self) -> str:
        self.out.close()
        return self.path


class Forest:
    """Groups of ``size`` numbered items that links join step by step; keeps the links that joined two groups."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)
        self.links: list[tuple[int, int]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        differ = np.flatnonzero(x != y)
        if not len(differ):
            return
        low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        size = len(self.label)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        pairs, at = np.unique(low * size + high, return_index=True)
        for pair, i in zip(pairs.tolist(), differ[at].tolist(), strict=True):
            x, y = root(pair // size), root(pair % size)
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.links.append((int(a[i]), int(b[i])))
        keys = np.array(sorted(parent))
        move = np.arange(size)
        move[keys] = [root(k) for k in keys.tolist()]
        self.label = move[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """The links that hold the groups together, one less than a group has items."""
        pairs = np.array(self.links, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not the smallest of its component.

    Alternating large and small stars: each round is a few joins on thin rows, and
    rounds grow with the logarithm of the longest path. The smallest neighbour of a
    node comes from a map-side combined minimum and is written before the join, so
    that the join stands alone and adaptive execution can split a hot centre.
    """
    state = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "edges")
    mark = _fingerprint(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = staged(
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # A node's links to its other smaller neighbours move to the smallest; only nodes with several need the join.
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = staged(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _fingerprint(state)
        if before == mark:
            break
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return tuple(row)


def with_component(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``nodes`` (one row per ``key``) with ``component_id``; nodes without links are their own."""
    roots = components(edges).select(F.col("node").alias(key), "root")
    return (nodes.join(roots, key, "left")
            .withColumn("component_id", F.coalesce("root", key)).drop("root"))


#: Bits of a Bloom filter at most; with more values it lets more others through.
FILTER = 1 << 28


def among(keys: DataFrame) -> Callable[[str], Column]:
    """A test of a column: true where its value is in the one column of ``keys``, and for few others (1.4 %).

    It comes before a join with ``keys`` that would shuffle wide rows. The Bloom filter has 16 bits or more for
    each value, up to ``FILTER`` (32 MB).
    """
    bits = min(FILTER, 1 << max(16, (16 * keys.count()).bit_length()))
    hashed = F.xxhash64(*keys.columns)
    places = keys.select(F.explode(F.array(hashed, F.shiftrightunsigned(hashed, 32))).alias("at")).select(
        F.col("at").bitwiseAND(bits - 1).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS int))")).alias("set")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    def may(hashes: pa.Array) -> pa.Array:
        held, out = shared.value.view(np.uint64), True
        for at in (hashes.to_numpy().view(np.uint64), hashes.to_numpy().view(np.uint64) >> np.uint64(32)):
            at = at & np.uint64(bits - 1)
            out = out & ((held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1)
        return pa.array(out)

    may = F.arrow_udf(may, "boolean")
    return lambda column: may(F.xxhash64(column))


class Remembered(dict):
    """What a worker process has found, in two generations of about ``most`` entries.

    A full generation becomes the old one. What is used again comes back from there; the rest goes with it.
    """

    def __init__(self, most: int) -> None:
        self.most, self.old = most, {}

    def new(self, wanted: set) -> set:
        """What of ``wanted`` is not known; all that is known can be looked up afterwards."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = wanted.difference(self)
        for key in new & self.old.keys():
            self[key] = self.old[key]
        return new.difference(self.old)


_LOADED: dict[str, object] = {}


def alone(name: str, make: Callable):
    """What this worker process keeps for one operator; what another one kept goes before it is made."""
    if name not in _LOADED:
        _LOADED.clear()
        gc.collect()
        made = make()  # may load what it is made of, which then stays with it
        _LOADED[name] = made
    return _LOADED[name]


def frequent_from(counts: DataFrame, most: int) -> int:
    """The least ``n`` at which at most ``most`` rows of ``counts`` have that much or more.

    Counts are compared by their four leading bits, so a few hundred numbers reach the driver.
    """
    drop = F.greatest(F.length(F.bin("n")) - 4, F.lit(0)).cast("int")
    low = F.expr("shiftleft(shiftright(n, drop), drop)")
    rows = counts.select("n", drop.alias("drop")).select(low.alias("low")).groupBy("low").count().collect()
    total, cut = 0, 1 << 62
    for low, count in sorted(map(tuple, rows), reverse=True):
        total += count
        if total > most:
            break
        cut = low
    return cut


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies on this machine; every executor has the package."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task: Spark shares out the cores
    return public_tokenizers.path(name)
