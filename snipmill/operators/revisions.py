"""Revision groups of similar bodies, for sequences of any length.

The rule: in order, a body joins the first group whose latest body has its name or is 70 % alike, else it
opens a group. What "alike" is, ``similarity`` says; three bounds, each dearer than the one before, spare most
pairs that sum: lengths, counts of letters (for all open groups at once) and the longest common
subsequence in bit-parallel form.

A sequence is cut into chunks, each twice as long as the one before until they have ``CHUNK`` bodies. One round settles
one chunk of every sequence: the latest bodies of the groups so far, in tiles, are compared with the chunk by as many
tasks as there are tiles, and a walk over the chunk then needs only the few matches that come out. Sequences of one chunk
take one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from snipmill import fixed
from snipmill.operators.running import add_rank
from snipmill.session import written

#: Bodies of a chunk at most, if the first one is not longer, and groups of a tile.
CHUNK = 1024
#: Classes of letters whose counts are compared. Letters that share a class only loosen the bound.
_CLASSES = 256
#: Fixed values of the rule: from this length on, letters that make up more than a hundredth start no match.
_LONG, _SHARE = 200, 100


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; bits of one number stand for the places of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    free = mask
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & mask
    return len(a) - free.bit_count()


def similarity(a: str, b: str) -> float:
    """Twice the matched letters over all letters.

    The longest run that both hold is matched, then what lies left and right of it likewise. Of
    equally long runs the first in ``a`` counts, then the first in ``b``. In a long ``b`` a run must hold together
    without the frequent letters; beside a run they match too.
    """
    matched = 0
    for matched, _ in _matching(a, b):
        pass
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0


def _matching(a: str, b: str) -> Iterator[tuple[int, int]]:
    """Letters matched so far, and how many the rest could add at most."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (a, b))
    starts = np.ones(len(y), bool)
    if len(y) >= _LONG:
        _, at, times = np.unique(y, return_inverse=True, return_counts=True)
        starts = (times <= len(y) // _SHARE + 1)[at]
    places = {letter: np.flatnonzero((y == letter) & starts) for letter in np.unique(x).tolist()}
    line_x, line_y = x.tolist(), y.tolist()
    matched, todo = 0, [(0, len(x), 0, len(y))]
    possible = min(len(x), len(y))
    while todo:
        x0, x1, y0, y1 = todo.pop()
        possible -= min(x1 - x0, y1 - y0)
        end_x, end_y, size = _longest(line_x, places, x0, x1, y0, y1)
        begin_x, begin_y = end_x - size, end_y - size
        while begin_x > x0 and begin_y > y0 and line_x[begin_x - 1] == line_y[begin_y - 1]:
            begin_x, begin_y = begin_x - 1, begin_y - 1
        while end_x < x1 and end_y < y1 and line_x[end_x] == line_y[end_y]:
            end_x, end_y = end_x + 1, end_y + 1
        if end_x > begin_x:
            matched += end_x - begin_x
            for part in ((x0, begin_x, y0, begin_y), (end_x, x1, end_y, y1)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append(part)
                    possible += min(part[1] - part[0], part[3] - part[2])
        yield matched, possible


def _longest(line: list[int], places: dict[int, np.ndarray], x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int]:
    """Ends and size of the first longest run; without one the run is empty and at the front.

    ``run[j + 1]`` is how long the run is that ends at the last letter of ``a`` read and at ``j`` of ``b``.
    """
    run = np.zeros(y1 - y0 + 1, np.int64)
    before, best = np.zeros(0, np.int64), (x0, y0, 0)
    for i in range(x0, x1):
        at = places[line[i]]
        at = at[np.searchsorted(at, y0):np.searchsorted(at, y1)] - y0
        sizes = run[at] + 1
        run[before + 1] = 0
        run[at + 1] = sizes
        before = at
        if len(at):
            top = int(sizes.argmax())
            if sizes[top] > best[2]:
                best = (i + 1, y0 + int(at[top]) + 1, int(sizes[top]))
    return best


def alike(earlier: str, later: str, limit: float = fixed.SIMILARITY_THRESHOLD) -> bool:
    """Whether the similarity of two bodies reaches the limit; matching stops when that is settled."""
    total = len(earlier) + len(later)
    if earlier == later or not total:
        return True
    if 2.0 * common_subsequence(earlier, later) / total < limit:
        return False
    for matched, possible in _matching(earlier, later):
        if 2.0 * matched / total >= limit:
            return True
        if 2.0 * (matched + possible) / total < limit:
            return False
    return False


class Open:
    """The latest name and body of each open group, with what the cheap bounds need."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.bodies: list[str] = []
        self.counts = np.zeros((0, _CLASSES), np.int32)

    def put(self, place: int, name: str, body: str) -> None:
        if place == len(self.names):
            self.names.append(name)
            self.bodies.append(body)
            if place == len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros((max(place, 16), _CLASSES), np.int32)])
        self.names[place], self.bodies[place] = name, body
        self.counts[place] = _counts(body)

    def matches(self, name: str, body: str, limit: float) -> Iterator[int]:
        """Places of the groups that the body may join, in order."""
        some = len(self.names)
        mine = _counts(body)
        sizes = self.counts[:some].sum(1)
        shared = np.minimum(self.counts[:some], mine).sum(1)
        near = 2.0 * shared >= limit * (sizes + len(body)) - 1e-9
        for place in range(some):
            if self.names[place] == name or near[place] and alike(self.bodies[place], body, limit):
                yield place


def _counts(body: str) -> np.ndarray:
    points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(points % _CLASSES, minlength=_CLASSES).astype(np.int32)


_BLOCKS = "doc_key, lang, place, chunk, fence_no, name_proposal, body_norm"


def _doublings(first: int) -> int:
    return max(CHUNK // first, 1).bit_length() - 1


def _chunk_of(place: Column, first: int) -> Column:
    """The chunk of each place; the sizes are ``first`` times 1, 2, 4, ... and stay at the last one within ``CHUNK``."""
    doublings = _doublings(first)
    start, size = first * ((1 << doublings) - 1), first << doublings
    growing = F.length(F.bin(F.floor(place / first) + 1)) - 1
    return F.when(place < start, growing).otherwise(doublings + F.floor((place - start) / size)).cast("int")


def revision_groups(found: DataFrame, limit: float = fixed.SIMILARITY_THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """(doc_key, fence_no, revision_group) of the rows without a ``reason``; numbers count from 0 in a (doc_key, lang).

    Groups of a document and language are numbered as they open. A null name is a name like any other, a null
    body is empty. Rows without a document or a language, which no candidate lacks, have no group.
    """
    keys = {c: found.schema[c].dataType.simpleString() for c in ("doc_key", "lang")}
    ordered = add_rank(found.where("reason IS NULL").select("doc_key", "lang", "fence_no", "name_proposal", "body_norm"),
                       ["doc_key", "lang"], ["fence_no"], "place")
    blocks = written(ordered.select("doc_key", "lang", (F.col("place") - 1).alias("place"),
                                    _chunk_of(F.col("place") - 1, chunk).alias("chunk"), F.col("fence_no").cast("long"),
                                    "name_proposal", F.coalesce("body_norm", F.lit("")).alias("body_norm")), "revision-blocks")
    head = f"doc_key {keys['doc_key']}, lang {keys['lang']}"
    last = blocks.agg(F.max("chunk")).first()[0] or 0
    done, latest = [], None
    for number in range(last + 1):
        now = blocks.where(F.col("chunk") == number)
        matches = now.sparkSession.createDataFrame([], f"{head}, place long, revision_group long")
        if latest is not None:
            matches = _tiles(now, latest, limit, chunk << _doublings(chunk), head)
            sizes = latest.groupBy("doc_key", "lang").agg(F.max("revision_group").alias("top"))
            now = now.join(sizes, ["doc_key", "lang"])
        else:
            now = now.withColumn("top", F.lit(-1).cast("long"))
        settled = written(_spread(now, "doc_key", "lang").cogroup(_spread(matches, "doc_key", "lang")).applyInArrow(
            _walk(limit), f"{head}, fence_no long, revision_group long, latest boolean, name_proposal string, body_norm string"),
            "revision-round")
        done.append(settled.select("doc_key", "lang", "fence_no", "revision_group"))
        if number < last:
            moved = settled.where("latest").select("doc_key", "lang", "revision_group", "name_proposal", "body_norm")
            # Only sequences with more to come keep their groups.
            more = blocks.where(F.col("chunk") == number + 1).select("doc_key", "lang").distinct()
            kept = moved if latest is None else moved.unionByName(
                latest.join(moved, ["doc_key", "lang", "revision_group"], "left_anti"))
            latest = written(kept.join(more, ["doc_key", "lang"], "left_semi"), "revision-open")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_key", "fence_no", "revision_group")


def _spread(df: DataFrame, *keys: str) -> GroupedData:
    """Groups over all shuffle partitions: they are small in bytes, so they would be put together, but dear to compare."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *keys).groupBy(*keys)


def _tiles(now: DataFrame, latest: DataFrame, limit: float, chunk: int, head: str) -> DataFrame:
    """(doc_key, lang, place, revision_group): matches of a chunk with the groups before it, a task for each tile of groups."""
    tiled = latest.withColumn("tile", F.floor(F.col("revision_group") / chunk))
    tiles = tiled.select("doc_key", "lang", F.col("tile").alias("against")).distinct()
    sent = now.select("doc_key", "lang", "place", "name_proposal", "body_norm").join(tiles, ["doc_key", "lang"])

    def compare(blocks: pa.Table, groups: pa.Table) -> pa.Table:
        held, numbers = Open(), []
        for row in groups.sort_by("revision_group").to_pylist():
            held.put(len(numbers), row["name_proposal"], row["body_norm"])
            numbers.append(row["revision_group"])
        places, found = [], []
        if numbers:
            for row in blocks.to_pylist():
                for at in held.matches(row["name_proposal"], row["body_norm"], limit):
                    places.append(row["place"])
                    found.append(numbers[at])
        key = blocks.select(["doc_key", "lang"]).slice(0, 1)
        take = pa.array([0] * len(places), pa.int64())
        return key.take(take).append_column("place", pa.array(places, pa.int64())).append_column(
            "revision_group", pa.array(found, pa.int64()))

    return _spread(sent, "doc_key", "lang", "against").cogroup(_spread(tiled, "doc_key", "lang", "tile")).applyInArrow(
        compare, f"{head}, place long, revision_group long")


def _walk(limit: float):
    """Settles one chunk of one sequence: the first fitting group, of those before the chunk and those it moved or opened."""

    def walk(blocks: pa.Table, matches: pa.Table) -> pa.Table:
        before: dict[int, list[int]] = {}
        for place, group in zip(matches.column("place").to_pylist(), matches.column("revision_group").to_pylist(), strict=True):
            before.setdefault(place, []).append(group)
        rows = blocks.sort_by("place").to_pylist()
        count = rows[0]["top"] + 1
        held, numbers, at_of = Open(), [], {}
        groups, newest = [], {}
        for i, row in enumerate(rows):
            name, body = row["name_proposal"], row["body_norm"]
            old = min((g for g in before.get(row["place"], ()) if g not in at_of), default=None)
            fits = (numbers[at] for at in held.matches(name, body, limit))
            # Groups moved in this chunk do not lie in the order of their numbers, opened ones do.
            new = min(fits, default=None)
            group = min((g for g in (old, new) if g is not None), default=None)
            if group is None:
                group, count = count, count + 1
            if group not in at_of:
                at_of[group] = len(numbers)
                numbers.append(group)
            held.put(at_of[group], name, body)
            groups.append(group)
            newest[group] = i
        latest = [newest[g] == i for i, g in enumerate(groups)]
        out = blocks.sort_by("place")
        return pa.table({
            "doc_key": out.column("doc_key"), "lang": out.column("lang"), "fence_no": out.column("fence_no"),
            "revision_group": pa.array(groups, pa.int64()), "latest": pa.array(latest, pa.bool_()),
            # A body goes on only where it is a group's latest.
            "name_proposal": pa.array([r["name_proposal"] if l else None for r, l in zip(rows, latest, strict=True)], pa.string()),
            "body_norm": pa.array([r["body_norm"] if l else None for r, l in zip(rows, latest, strict=True)], pa.string())})

    return walk
