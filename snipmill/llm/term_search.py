"""Ranked lexical search by pipelined term partitioning.

Texts are read once, in blocks of documents. A block gives one posting list for each of its
terms that an item asks for, and the lengths of its documents. Owners share out the terms, rare
terms first and equal numbers of postings each. An item's bundle of sparse accumulators, document
numbers and integer scores of one block, goes from owner to owner: each stage is a cogroup of
bundles and the owner's posting lists by block, adds contributions and hands the bundle on. After
the last owner a block gives the best documents of each item, and a window the best of those.

A bundle drops a document only if all that later owners can add leaves it below the 50th score
that its block has already: nothing that could be among the best goes. The posting list of a
frequent term is cut by blocks, so no task holds it whole.

Items come in rounds of bounded size, whose terms every executor gets. Each round reads all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipmill.llm.common import staged, table

#: Terms of texts: letters and digits, and all that is not ASCII.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Owners of terms, one stage each.
OWNERS = 4
#: Documents of a block and, beyond one document, its postings.
BLOCK, POSTINGS = 8192, 2_000_000
#: Pairs of item and term of a round: some 20 MB for each executor.
ROUND = 400_000

_FOLD = bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ".find(b) + 97 if 65 <= b <= 90 else b if b >= 128 or re.match(TERMS, chr(b)) else 32
              for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of ``text`` in UTF-8. Bytes of other characters than ASCII are no separators, so bytes can be cut."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each item; rows with the same key are one item."""
    kind = items.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms_of(v.as_py() or ""))) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    thin = items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text"))
    return thin.mapInArrow(of, f"item {kind}, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()


_LISTS = T.StructType([T.StructField(n, k) for n, k in (
    ("block", T.LongType()), ("term", T.IntegerType()), ("docs", T.BinaryType()), ("numbers", T.BinaryType()),
    ("n_docs", T.LongType()), ("total", T.LongType()), ("most", T.LongType()), ("keys", T.ArrayType(T.LongType())))])
#: In place of a term: the lengths and keys of a block's documents.
_LENGTHS = -1


class _Block:
    """The documents of one block, until it is full."""

    def __init__(self) -> None:
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.hits: list[int] = []
        self.terms: list[int] = []
        self.often: list[int] = []

    def full(self, most: int) -> bool:
        return len(self.keys) >= most or len(self.terms) >= POSTINGS

    def rows(self, block: int) -> pa.RecordBatch:
        docs = np.repeat(np.arange(len(self.keys), dtype="<u4"), self.hits)
        terms, often = np.array(self.terms, np.int32), np.array(self.often, "<i8")
        order = np.argsort(terms, kind="stable")
        docs, terms, often = docs[order], terms[order], often[order]
        cut = np.flatnonzero(np.diff(terms, prepend=-1))
        parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(terms)], strict=False)) if len(terms) else []
        lengths = np.array(self.lengths, "<i8")
        return pa.RecordBatch.from_pydict({
            "block": [block] * (len(parts) + 1),
            "term": [_LENGTHS, *terms[cut].tolist()],
            "docs": [b"", *(docs[a:b].tobytes() for a, b in parts)],
            "numbers": [lengths.tobytes(), *(often[a:b].tobytes() for a, b in parts)],
            "n_docs": [len(lengths), *(b - a for a, b in parts)],
            "total": [int(lengths.sum()), *(int(often[a:b].sum()) for a, b in parts)],
            "most": [int(lengths.max()), *(int(often[a:b].max()) for a, b in parts)],
            "keys": [self.keys, *(None for _ in parts)],
        }, schema=_LISTS_ARROW)


_LISTS_ARROW = pa.schema([("block", pa.int64()), ("term", pa.int32()), ("docs", pa.binary()), ("numbers", pa.binary()),
                          ("n_docs", pa.int64()), ("total", pa.int64()), ("most", pa.int64()), ("keys", pa.list_(pa.int64()))])


def posting_lists(docs: DataFrame, number: dict[bytes, int], key: str, text: str, block_size: int = BLOCK) -> DataFrame:
    """Posting lists of the terms in ``number``, and the lengths of documents that have terms, by block."""
    wanted = docs.sparkSession.sparkContext.broadcast(number)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        names, at = known.keys(), TaskContext.get().partitionId() << 33
        block = _Block()
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                found = terms_of(value.as_py() or "")
                if not found:
                    continue
                counts = Counter(found)
                hits = list(counts.keys() & names)
                block.keys.append(name.as_py())
                block.lengths.append(len(found))
                block.hits.append(len(hits))
                block.terms.extend(map(known.__getitem__, hits))
                block.often.extend(map(counts.__getitem__, hits))
                if block.full(block_size):
                    yield block.rows(at)
                    block, at = _Block(), at + 1
        if block.keys:
            yield block.rows(at)

    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return thin.mapInArrow(of, _LISTS)


class Plan:
    """What the owners of one round know: the terms of each item with weights, by stage."""

    def __init__(self, items: dict[object, list[int]], spread: list[tuple[int, int, int]], n_docs: int, n_terms: int, best: int) -> None:
        self.names, self.n_docs, self.n_terms, self.best = list(items), n_docs, n_terms, best
        frequency = {term: df for term, df, _ in spread}
        self.owner, seen, total = {}, 0, sum(frequency.values())
        for term in sorted(frequency, key=lambda t: (frequency[t], t)):
            self.owner[term] = min(OWNERS * seen // max(total, 1), OWNERS - 1)
            seen += frequency[term]
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
        # No document gets more for a term than the most occurrences in a document without length would.
        bound = {t: weight[t] * (10**9 * most // (1000 * most + 20 * 50)) for t, _, most in spread}
        self.stages = [defaultdict(list) for _ in range(OWNERS)]
        self.rest = np.zeros((OWNERS, len(self.names)), np.int64)
        for item, terms in enumerate(items.values()):
            for term in terms:
                if term in frequency:
                    self.stages[self.owner[term]][item].append((term, weight[term]))
                    self.rest[:self.owner[term], item] += bound[term]

    def norms(self, lengths: list[int]) -> np.ndarray:
        return np.array([50 + (50 * n * self.n_docs) // self.n_terms for n in lengths], np.int64)

    def step(self, stage: int, bundles: dict[int, tuple], lists: dict[int, tuple], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, documents, scores) of a block after the owner's contributions."""
        mine = self.stages[stage]
        scores = np.zeros(size, np.int64)
        for item in sorted(bundles.keys() | mine.keys()):
            scores[:] = 0
            if item in bundles:
                at, so_far = bundles[item]
                scores[at] = so_far
            for term, weight in mine.get(item, ()):
                if term in lists:
                    at, gains = lists[term]
                    scores[at] += weight * gains
            docs = np.flatnonzero(scores)
            found = scores[docs]
            if len(docs) > self.best:
                least = np.partition(found, -self.best)[-self.best]
                keep = found + self.rest[stage, item] >= least
                docs, found = docs[keep], found[keep]
            if len(docs):
                yield item, docs, found


_BUNDLES = "block long, item int, docs binary, scores binary"


def _stage(bundles: DataFrame, lists: DataFrame, shared, stage: int, item_kind: T.DataType) -> DataFrame:
    """Bundles after one owner; after the last owner (item_id, doc_id, score) of the best of each block."""
    last = stage == OWNERS - 1
    schema = f"item_id {item_kind.simpleString()}, doc_id long, score long" if last else _BUNDLES

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        plan: Plan = shared.value
        bundles = {item: (np.frombuffer(d, "<u4"), np.frombuffer(s, "<i8")) for item, d, s in zip(
            *(left.column(c).to_pylist() for c in ("item", "docs", "scores")), strict=True)}
        found = {t: (np.frombuffer(d, "<u4"), np.frombuffer(n, "<i8")) for t, d, n in zip(
            *(right.column(c).to_pylist() for c in ("term", "docs", "numbers")), strict=True)}
        norms = plan.norms(found.pop(_LENGTHS)[1].tolist())
        lists = {t: (d, 10**9 * n // (1000 * n + 20 * norms[d])) for t, (d, n) in found.items()}
        block = right.column("block")[0].as_py()
        rows = list(plan.step(stage, bundles, lists, len(norms)))
        if not last:
            return pa.table({
                "block": pa.array([block] * len(rows), pa.int64()), "item": pa.array([r[0] for r in rows], pa.int32()),
                "docs": pa.array([r[1].astype("<u4").tobytes() for r in rows], pa.binary()),
                "scores": pa.array([r[2].astype("<i8").tobytes() for r in rows], pa.binary())})
        keys = next(k for k in right.column("keys").to_pylist() if k is not None)
        order = np.array([-(1 << 63) if k is None else k for k in keys], np.int64)
        items, docs, scores = [], [], []
        for item, at, totals in rows:
            best = np.lexsort((order[at], -totals))[:plan.best]
            items += [plan.names[item]] * len(best)
            docs += [keys[i] for i in at[best].tolist()]
            scores += totals[best].tolist()
        return pa.table({"item_id": pa.array(items, _ARROW.get(item_kind.typeName())), "doc_id": pa.array(docs, pa.int64()),
                         "score": pa.array(scores, pa.int64())})

    return bundles.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(of, schema)


#: Types of item keys that an empty column must not leave open.
_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}


def search(docs: DataFrame, items: DataFrame, best: int = 50, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", block_size: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0.

    A block has ``block_size`` documents. Document keys are integers. Equal scores are in ascending order of keys, a null key first. Null and empty texts have no
    terms; they are no documents and no items. Each of repeated document rows has a rank of its own. Item rows with the same
    key (null is a key too) are one item with the terms of all. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType
    pairs = staged(item_terms(items, item_key, item_text), "item-terms")
    rounds = math.ceil(pairs.count() / ROUND)
    parts = [_round(docs, pairs.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == r), best, key, text, kind, block_size)
             for r in range(rounds)]
    if not parts:
        return spark.createDataFrame([], T.StructType([
            T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return (reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
            .select("item_id", "rank", "doc_id", "score"))


def _round(docs: DataFrame, pairs: DataFrame, best: int, key: str, text: str, kind: T.DataType, block_size: int) -> DataFrame:
    """The best of each block for the items of ``pairs``, at most about ``ROUND`` rows."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    items: dict[object, list[int]] = defaultdict(list)
    for item, term in pairs.orderBy("item", "term").collect():
        items[item].append(number.setdefault(bytes(term), len(number)))
    lists = staged(posting_lists(docs, number, key, text, block_size), "postings")
    sizes = lists.groupBy("term").agg(F.sum("n_docs"), F.sum("total"), F.max("most")).collect()  # a row a term of the round
    spread = [(term, df, most) for term, df, _, most in sizes if term != _LENGTHS]
    whole = next(((n, total) for term, n, total, _ in sizes if term == _LENGTHS), (0, 0))
    plan = Plan(items, spread, *whole, best)
    shared = spark.sparkContext.broadcast(plan)
    owners = F.broadcast(spark.createDataFrame(list(plan.owner.items()), "term int, owner int"))
    owned = lists.join(owners, "term", "left")
    bundles = spark.createDataFrame([], _BUNDLES)
    for stage in range(OWNERS):
        last = stage == OWNERS - 1
        own = owned.where((F.col("owner") == stage) | (F.col("term") == _LENGTHS)).select(
            "block", "term", "docs", "numbers", *(["keys"] if last else []))
        bundles = _stage(bundles, own, shared, stage, kind)
    return bundles


def op13_term_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_term_search": op13_term_search}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {"op13_term_search": rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERMS}') AS terms
    FROM documents
), lengths AS (
    SELECT row, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0
), whole AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERMS}')) AS term FROM benchmark
), often AS (
    SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY row, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM often, whole GROUP BY term
), scores AS (
    SELECT item_id, row, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN often USING (term) JOIN lengths USING (row), whole
    GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 50
"""}
