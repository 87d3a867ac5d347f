"""Near duplicates by SimHash, found with a generalised pigeonhole.

The 64 bits are cut into groups of correlated bits. Each group gets a threshold of
its own, so that two fingerprints within ``max_distance`` must come within the
threshold of one group at least: the thresholds add up to ``max_distance - groups + 1``
(-1 leaves a group out). Dynamic programming chooses them by estimated work. Some
bits of a group name buckets. Two fingerprints meet halfway: each goes to the buckets
within half the threshold of its own. The full distance verifies each candidate.

Equal fingerprints are merged first. Candidates are compared within tiles of bounded
size, and a tile returns a forest of its links, never all pairs.

Where the similarity of texts counts, the links of fingerprints are candidates, and fingerprints alone miss some: at a
similarity of 0.8 one pair in six is more than 12 bits apart. So texts that share a band of minimal shingle hashes
(MinHash) are candidates too. They only say which texts meet; those are compared pair by pair. By chance more and more
fingerprints of a growing table come close, so a link of fingerprints also needs sketches that agree: one bit for each of
64 minima.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipmill.llm.common import Forest, among, components, staged, table

BITS = 64
#: Members of a tile; a bucket with more is cut into several.
TILE = 1 << 15
#: Candidate pairs that a tile holds in memory at once.
PAIRS = 1 << 21
#: Shingles of a chunk of texts that are compared pair by pair; above so many chunks they grow, until they have 16 times that.
SHINGLES, CHUNKS = 1 << 15, 16
#: Bands and minima of each; texts of similarity s share none with probability (1 - s ** ROWS) ** BANDS: 5e-8 at 0.8.
BANDS, ROWS = 32, 4
#: Differing bits of two sketches from which their texts are no candidates: at a similarity of 0.8, 6.4 are expected, more than this
#: have a probability of 5e-7, and a band shows nearly all of those; of 32 that chance expects, one pair in 600 has no more.
SKETCH = 20
_draw = np.random.default_rng(17).integers(0, 1 << 63, (3, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


# --- fingerprints -----------------------------------------------------------------------

def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``words`` words, A-Z lower-cased; fewer words: of all of them."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(b" ".join(found), 42)]
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[: len(found) - words]]
    return [digest(joined[a:b - 1], 42) for a, b in zip(starts, ends[words - 1:], strict=True)]


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of hashes: bits set in over half of them."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def bands_of(hashes: np.ndarray) -> tuple[np.ndarray, np.int64]:
    """A number for each band of the minima of ``hashes`` in BANDS * ROWS orders, and a sketch: a bit of each of 64 minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[None, at:at + 1024] ^ _draw[0][:, None]
        mixed *= _draw[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    out = _draw[2][:BANDS].copy()
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    bits = (least[:BITS] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return out.view(np.int64), np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)[0]


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, fp long) of every row; texts that are null or without a word get fingerprint zero.

    With ``digest`` a column ``words`` names the sequence of lower-cased words, and ``bands`` and ``sketch`` have those of the
    shingles, null without a word; else all three are null.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            rows, counts, held = [], [], []
            bands: list = [None] * batch.num_rows
            sketches: list = [None] * batch.num_rows

            def settle(out=out, rows=rows, counts=counts, held=held):
                if rows:
                    n = np.array(counts)
                    out[rows] = majority(np.array(held, np.uint64), np.cumsum(n) - n, n)
                    rows.clear(), counts.clear(), held.clear()

            for i, value in enumerate(batch.column(1)):
                hashes = shingle_hashes(value.as_py(), words)
                if hashes:
                    rows.append(i), counts.append(len(hashes)), held.extend(hashes)
                    if digest:
                        bands[i], sketches[i] = bands_of(np.array(hashes, np.uint64))
                    if len(held) > 100_000:
                        settle()
            settle()
            names = [xxhash.xxh3_128_digest(b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()))
                     if digest else None for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out.view(np.int64)), pa.array(names, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.int64())], ["key", "fp", "words", "bands", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    thin = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return thin.mapInArrow(of, f"key {kind}, fp long, words binary, bands array<long>, sketch long").withColumnRenamed("key", key)


# --- plan -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Group:
    """Some of the bits, the threshold there, and how many of them name a bucket."""

    bits: tuple[int, ...]
    threshold: int
    high: int

    def values(self, fps: np.ndarray) -> np.ndarray:
        """These bits side by side, the first highest."""
        out = np.zeros(len(fps), np.int64)
        for bit in self.bits:
            out = (out << 1) | ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        return out


def masks(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits with up to ``most`` of them set."""
    return np.array([sum(1 << b for b in s) for k in range(min(most, width) + 1)
                     for s in itertools.combinations(range(width), k)], np.int64)


def _order(together: np.ndarray, n: int) -> list[int]:
    """Bits in an order in which each follows the ones it correlates with most."""
    p = np.diag(together) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    order, left = [], set(range(BITS))
    while left:
        near = order[-8:]
        nxt = max(sorted(left), key=lambda b: linked[b, near].sum() if near else linked[b].sum())
        order.append(nxt)
        left.discard(nxt)
    return order


def _within(bits: list[int], p: np.ndarray) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, ... of these bits."""
    share = np.array([1.0])
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        share = np.append(share * (1 - d), 0) + np.append(0, share * d)
    return np.cumsum(share)


def plan(together: np.ndarray, n: int, max_distance: int) -> list[Group]:
    """Groups and thresholds with the least estimated probes and candidates for ``n`` fingerprints."""
    p, order = np.diag(together) / max(n, 1), _order(together, max(n, 1))
    best: tuple[float, list[Group]] = (math.inf, [])
    for count in range(1, min(max_distance + 1, 16) + 1):
        cuts = np.linspace(0, BITS, count + 1).round().astype(int)
        parts = [order[a:b] for a, b in itertools.pairwise(cuts)]
        goal = max_distance - count + 1
        # By the sum of thresholds so far (from -count on): the least cost and the choice.
        states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in parts:
            share, after = _within(bits, p), {}
            probes = 0
            for t in range(-1, min(max(goal + count, 0), len(bits)) + 1):
                probes += math.comb(len(bits), t) if t >= 0 else 0
                if probes > 5_000:
                    break
                cost = 0.0 if t < 0 else n * (2 + 0.05 * probes) + 0.02 * n * n * share[t]
                for total, (so_far, chosen) in states.items():
                    if so_far + cost < after.get(total + t, (math.inf,))[0]:
                        after[total + t] = (so_far + cost, (*chosen, t))
            states = after
        if goal in states and states[goal][0] < best[0]:
            groups = [
                Group(tuple(bits), t, min(len(bits), max(3, math.ceil(math.log2(max(n, 1) / (TILE / 4) + 1)))))
                for bits, t in zip(parts, states[goal][1], strict=True) if t >= 0]
            best = (states[goal][0], groups)
    return best[1]


def _together(classes: DataFrame) -> np.ndarray:
    """How often two bits are both set, over all distinct fingerprints."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    rows = classes.select("fp").mapInArrow(of, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for i, j, n in rows.collect():  # 64 x 64 numbers at most
        out[i, j] = n
    return out


# --- probe and verify -------------------------------------------------------------------

def _bucket_key(group: int, bucket: np.ndarray) -> np.ndarray:
    return (np.int64(group) << np.int64(48)) | bucket.astype(np.int64)


def _hot(classes: DataFrame, groups: list[Group]) -> dict[int, int]:
    """Buckets with more members than a tile, and into how many chunks each is cut."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.concatenate([_bucket_key(g, x.values(fps) >> (len(x.bits) - x.high)) for g, x in enumerate(groups)])
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["bucket", "n"])

    counts = (classes.select("fp").mapInArrow(of, "bucket long, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > TILE))
    return {r.bucket: -(-r.n // TILE) for r in counts.collect()}  # at most rows / TILE of them for a group


def _routed(classes: DataFrame, groups: list[Group], hot: dict[int, int]) -> DataFrame:
    """A row for each tile that a fingerprint is in: its bucket and those within half the threshold.

    ``off``: the bits in which the bucket's name differs from the fingerprint. Of a hot bucket each two chunks meet.
    """

    def chunks(of: np.ndarray, many: int) -> np.ndarray:
        return ((of * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % many

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed, nodes, sketches = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            fps = signed.view(np.uint64)
            for g, group in enumerate(groups):
                own = group.values(fps) >> (len(group.bits) - group.high)
                for m in masks(group.high, (group.threshold + 1) // 2).tolist():
                    keys = _bucket_key(g, own ^ m)
                    many = np.array([hot.get(k, 1) for k in keys.tolist()]) if hot else np.ones(len(keys), np.int64)
                    for k in np.unique(many).tolist():
                        at = np.flatnonzero(many == k)
                        mine = chunks(fps[at], k)
                        for other in range(k):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(keys[at]), pa.array(np.minimum(mine, other) * k + np.maximum(mine, other)),
                                 pa.array(mine.astype(np.int32)), pa.array(np.full(len(at), m.bit_count(), np.int32)),
                                 pa.array(signed[at]), pa.array(nodes[at]), pa.array(sketches[at])],
                                ["bucket", "tile", "chunk", "off", "fp", "node", "sketch"])

    return classes.select("fp", "node", "sketch").mapInArrow(
        route, "bucket long, tile long, chunk int, off int, fp long, node long, sketch long")


def link_tile(table: pa.Table, groups: list[Group], max_distance: int) -> pa.Table:
    """Edges of a forest of the links between the fingerprints of a tile; a tile of two chunks links across them only.

    Two that differ in ``d`` bits of the bucket's name are both in a bucket halfway, ``d // 2`` bits from one and the rest
    from the other. The other bits of the group have what is left of the threshold.
    """
    get = lambda name: table.column(name).to_numpy()
    off, fps, nodes, sketch, chunk = get("off"), get("fp").view(np.uint64), get("node"), get("sketch"), get("chunk")
    group = groups[int(get("bucket")[0]) >> 48]
    width = len(group.bits) - group.high
    low = group.values(fps) & ((1 << width) - 1)
    items, number = np.unique(nodes, return_inverse=True)
    forest, across = Forest(len(items)), chunk.min() != chunk.max()
    by_off = [np.flatnonzero(off == i) for i in range((group.threshold + 1) // 2 + 1)]
    by_off = [x[np.argsort(low[x], kind="stable")] for x in by_off]
    for apart_in_name in range(group.threshold + 1):
        members, probes = by_off[apart_in_name // 2], by_off[(apart_in_name + 1) // 2]
        sorted_low = low[members]
        for mask in masks(width, group.threshold - apart_in_name).tolist():
            value = low[probes] ^ mask
            first = np.searchsorted(sorted_low, value, "left")
            many = np.searchsorted(sorted_low, value, "right") - first
            hit = np.flatnonzero(many)
            ends = np.cumsum(many[hit])
            done = 0
            while done < len(hit):
                base = ends[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
                some = hit[done:stop]
                n = many[some]
                a = np.repeat(probes[some], n)
                b = members[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                apart = np.bitwise_count(fps[a] ^ fps[b])
                near = np.flatnonzero(apart <= max_distance)
                near = near[np.bitwise_count((sketch[a[near]] ^ sketch[b[near]]).view(np.uint64)) <= SKETCH]
                if across:
                    near = near[chunk[a[near]] != chunk[b[near]]]
                a, b, apart = number[a[near]], number[b[near]], apart[near]
                for distance in np.unique(apart).tolist():  # the closest links first
                    forest.join(a[apart == distance], b[apart == distance])
                done = stop
    a, b = forest.edges()
    return pa.table({"a": items[a], "b": items[b]})


def near_links(classes: DataFrame, max_distance: int) -> DataFrame:
    """Links (a, b) that connect all ``classes`` (fp, node, sketch; those three unique) within ``max_distance`` bits.

    Links whose sketches differ in more than ``SKETCH`` bits are left out; where fingerprints alone count, sketches are null or equal.
    """
    classes = classes.select("fp", "node", F.coalesce("sketch", F.lit(0).cast("long")).alias("sketch"))
    n = classes.count()
    groups = plan(_together(classes), n, max_distance)
    routed = _routed(classes, groups, _hot(classes, groups))
    return routed.groupBy("bucket", "tile").applyInArrow(
        lambda t: link_tile(t, groups, max_distance), "a long, b long")


def band_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all ``classes`` (node, bands) with a band in common: to the smallest node there."""
    rows = classes.select("node", F.explode("bands").alias("band"))
    first = staged(rows.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("last"))
                   .where("b < last").select("band", "b"), "bands")
    return rows.join(first, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, root, hashes) of ``docs`` (node, root, text): the distinct shingles of each text, sorted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t.as_py(), words), np.uint64)).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["node", "root", "hashes"])

    return docs.select("node", "root", "text").mapInArrow(of, "node long, root long, hashes array<long>")


def check_tile(table: pa.Table, least: float) -> pa.Table:
    """Edges of a forest of all pairs of a tile (node, chunk, hashes) that share ``least`` of their shingles or more.

    A tile of two chunks compares across them only. Two sets that similar have one of the rarest
    ``n - ceil(least * n) + 1`` shingles of either in common, so others are never counted.
    """
    nodes, chunk = table.column("node").to_numpy(), table.column("chunk").to_numpy()
    hashes = table.column("hashes").combine_chunks()
    flat, sizes = hashes.flatten().to_numpy(), np.diff(hashes.offsets.to_numpy())
    items, number = np.unique(nodes, return_inverse=True)
    forest, across = Forest(len(items)), chunk.min() != chunk.max()
    starts = np.cumsum(sizes) - sizes
    _, code = np.unique(flat, return_inverse=True)
    often = np.bincount(code)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    holders = owner[np.argsort(code, kind="stable")]
    first = np.cumsum(often) - often
    mine = np.zeros(len(often), bool)
    empty = np.flatnonzero(sizes == 0)
    forest.join(number[empty[:1].repeat(len(empty))], number[empty])

    def runs(at: np.ndarray, many: np.ndarray) -> np.ndarray:
        return np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())

    for i in range(len(sizes)):
        n = int(sizes[i])
        own = code[starts[i]:starts[i] + n]
        rare = own[np.lexsort((own, often[own]))[:n - math.ceil(least * n - 1e-9) + 1]]
        rare = rare[often[rare] > 1]
        if not len(rare):
            continue
        near = holders[runs(first[rare], often[rare])]
        near = near[(forest.label[number[near]] != forest.label[number[i]])
                    & (np.minimum(sizes[near], n) >= least * np.maximum(sizes[near], n) - 1e-9)]
        near = np.unique(near[chunk[near] != chunk[i]] if across else near)
        near = near[near > i]
        mine[own] = True
        ends = np.cumsum(sizes[near])
        done = 0
        while done < len(near):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
            some = near[done:stop]
            both = np.add.reduceat(mine[code[runs(starts[some], sizes[some])]], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            linked = number[some[both >= least * (n + sizes[some] - both)]]
            forest.join(np.full(len(linked), number[i]), linked)
            done = stop
        mine[own] = False
    a, b = forest.edges()
    return pa.table({"a": items[a], "b": items[b]})


def similar(edges: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """Links that connect all ``docs`` (node, text) sharing ``least`` of their shingles or more among those
    that candidate ``edges`` (a, b) connect, directly or by way of others.

    ``edges`` only say which texts meet: every pair of a component is compared, so they may be a forest. Small
    components share tiles; one with more than ``SHINGLES`` shingles is cut into chunks, each of which meets every other.
    """
    roots = components(edges)
    members = staged(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    # Rows that repeat an id and a text are one; all texts of an id count.
    some = docs.where(among(members.select("node"))("node"))
    texts = some.join(members, "node").groupBy("node", "root", "text").agg(F.lit(1))
    sets = staged(_sets(texts, words), "shingles")
    weights = staged(sets.groupBy("root").agg(F.sum(F.size("hashes")).alias("n")), "weights")
    tiles = (weights.agg(F.sum("n")).first()[0] or 0) // SHINGLES + 1
    large = weights.where(F.col("n") > SHINGLES).select("root", F.greatest(
        F.least(F.ceil(F.col("n") / SHINGLES), F.lit(CHUNKS)), F.ceil(F.col("n") / (16 * SHINGLES))).cast("int").alias("parts"))
    # At most one row for SHINGLES shingles of the input is broadcast.
    dealt = (sets.join(F.broadcast(large), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
             .withColumn("chunk", F.expr("CAST(pmod(xxhash64(node), parts) AS int)"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(F.when(F.col("parts") > 1, F.col("root")).alias("tile_of"),
                     F.when(F.col("parts") > 1, F.least("chunk", "other")).otherwise(
                         F.pmod(F.xxhash64("root"), F.lit(tiles)).cast("int")).alias("low"),
                     F.greatest("chunk", "other").alias("high"), "node", "chunk", "hashes"))
    return dealt.groupBy("tile_of", "low", "high").applyInArrow(lambda t: check_tile(t, least), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, max_distance: int = 4, least: float | None = None,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``.

    With ``least``, texts link if they share that much of their shingles, as sets. Fingerprints within ``max_distance``
    are candidates, and so are texts farther apart that share a band; all pairs among texts that those connect are checked.

    Null and empty texts have fingerprint zero and link like any other. Rows with a
    null key get a fingerprint, link with nothing and have a null component. Rows that
    repeat a key stand for one document. An empty table gives none. Other columns of
    ``docs``, whatever their names, are not read.
    """
    found = staged(fingerprints(docs, words, key, text, least is not None).withColumnRenamed(key, "node"), "fingerprints")
    known = found.where("node IS NOT NULL")
    # Rows of a class link without a check: by fingerprint, or by their words where texts count.
    by = ["fp"] if least is None else ["fp", "words"]
    if least is None:
        classes = staged(known.groupBy(*by).agg(F.min("node").alias("node")), "classes")
        edges = near_links(classes.select("fp", "node", F.lit(None).cast("long").alias("sketch")).distinct(), max_distance)
    else:  # equal words have equal bands and sketches
        classes = staged(known.groupBy(*by).agg(F.min("node").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
        texts = docs.select(F.col(key).alias("node"), F.col(text).cast("string").alias("text"))
        near = near_links(classes.select("fp", "node", "sketch").distinct(), max_distance)
        edges = similar(near.unionByName(band_links(classes)), texts, words, least)
    # A key that repeats with another text links the classes of its texts.
    twice = known.groupBy("node").agg(F.countDistinct(*by).alias("n")).where("n > 1").select("node")
    more = (known.join(twice, "node").select(*by, F.col("node").alias("a"))
            .join(classes, by).select("a", F.col("node").alias("b")))
    roots = components(edges.unionByName(more))
    named = staged(classes.join(roots, classes.node == roots.node, "left")
                   .select(*by, F.coalesce("root", classes.node).alias("component")), "named")
    return found.join(named, by, "left").select(
        F.col("node").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("node").isNotNull(), F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, least: float = 0.8,
                key: str = "doc_id", text: str = "text", max_distance: int = 12) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest key.

    SimHash within ``max_distance`` bits, and bands for what lies farther apart, say which texts are compared.

    Of rows that repeat a key one stays, the same in every run; rows without a key all stay.
    """
    found = near_duplicates(docs, words, max_distance, least, key, text).select(key, "component_id")
    known = staged(found.where(F.col(f"`{key}`").isNotNull()).groupBy(key).agg(
        F.max(F.col(f"`{key}`") != F.col("component_id")).alias("gone"), F.count("*").alias("n")).where("gone OR n > 1"), "duplicates")
    gone = known.where("gone").select(key)
    # Only rows that a duplicate's or a repeated key may have are shuffled; all others are as they came.
    asked = F.col(f"`{key}`").isNotNull() & among(known.select(key))(f"`{key}`")
    # One of repeated keys needs the rows by key, as the join brings them; a hash of the row says which one.
    row = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.where(asked).join(gone, key, "left_anti").groupBy(F.col(f"`{key}`").alias("_key")).agg(
        F.min_by(F.struct(*row), F.xxhash64(*row)).alias("_row")).select("_row.*")
    return left.unionByName(docs.where(~asked))


# --- queries ----------------------------------------------------------------------------

def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, max_distance=4)


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
