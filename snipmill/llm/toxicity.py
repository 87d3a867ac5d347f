"""Toxicity by a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are the character n-grams of words with a mark at each end, hashed to a fixed
number of places. On labelled documents, each feature's presence gives a log ratio
of its smoothed rates in toxic and other documents. The classifier is a logistic
regression over the share of words that hold the feature, times that ratio. It is fitted in numpy on a bounded
sample of labelled rows and on the features that separate best.

A document's value is a mean over its words, so a word's share is found once and kept.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.llm.common import Remembered, alone, staged, table
from snipmill.llm.token_files import chunks

#: Lengths of n-grams in characters, with the marks of word ends.
GRAMS = (3, 4, 5)
#: Places of the hash table, features kept, and labelled rows of the fit at most.
PLACES = 1 << 20
FEATURES = 1_000
SAMPLE = 20_000
#: Words of a generation whose share a worker remembers, and the longest that is remembered.
REMEMBERED, LONG = 100_000, 64
#: Words of a generation whose n-grams are kept, and documents whose features are held at once.
GENERATION, ROWS = 50_000, 64
SMOOTH, PENALTY, ROUNDS = 0.5, 1e-4, 400
#: A feature's value is its share of the words times this.
SCALE = 100.0


def grams(word: str) -> set[int]:
    """Hashed n-grams of a word, lower-cased, with its ends marked."""
    marked = f"\x02{word}\x03"
    if marked.isascii():
        data = marked.encode()
        return {zlib.crc32(data[i:i + size]) % PLACES for size in GRAMS for i in range(len(data) - size + 1)}
    encoded = [c.encode("utf-8", "surrogatepass") for c in marked]
    found = set()
    for size in GRAMS:
        for i in range(len(encoded) - size + 1):
            found.add(zlib.crc32(b"".join(encoded[i:i + size])) % PLACES)
    return found


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Grams(Remembered):
    """The n-grams of words as arrays."""

    def of(self, words: Counter) -> list[np.ndarray]:
        for word in self.new(set(words)):
            self[word] = np.fromiter(grams(word), np.int32)
        return [self[word] for word in words]


def features(text: str, known: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Places and the share of words that have them."""
    words = Counter(words_of(text))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    arrays = known.of(words)
    counts = np.fromiter(words.values(), np.float64)
    places, at = np.unique(np.concatenate(arrays), return_inverse=True)
    sums = np.bincount(at, np.repeat(counts, [len(x) for x in arrays]))
    return places, (sums / counts.sum()).astype(np.float32)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]

    def share(self, word: str) -> float:
        return sum(self.weights[place] for place in sorted(self.weights.keys() & grams(word)))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of a fixed number of labelled rows at most, chosen by a hash of their key.

    The labels are bounded before the join, so they may be broadcast.
    """
    one = labels.where("key IS NOT NULL AND toxic IS NOT NULL").groupBy("key").agg(F.max("toxic").alias("toxic"))
    some = staged(one.orderBy(F.xxhash64("key"), "key").limit(SAMPLE), "toxic-labels")
    return docs.where("text IS NOT NULL").join(F.broadcast(some), "key").select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs`` (key, text) with ``labels`` (key, toxic); without both classes all score alike."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = alone("toxicity grams", lambda: Grams(GENERATION))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                pairs = [features(t.as_py(), known) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([p[0] for p in pairs], pa.list_(pa.int32())),
                     pa.array([p[1] for p in pairs], pa.list_(pa.float32()))], ["toxic", "place", "value"])

    rows = staged(_sample(docs, labels).select(F.col("toxic").cast("int"), "text").mapInArrow(
        of, "toxic int, place array<int>, value array<float>"), "toxic-features")
    total = dict(rows.groupBy((F.col("toxic") > 0).cast("int")).count().collect())
    good, bad = total.get(0, 0), total.get(1, 0)
    if not good or not bad:
        return Model(float(np.log((bad + SMOOTH) / (good + SMOOTH))), {})
    seen = rows.select("toxic", F.explode("place").alias("place")).groupBy("place").agg(
        F.sum((F.col("toxic") > 0).cast("long")).alias("bad"), F.sum((F.col("toxic") <= 0).cast("long")).alias("good"))
    ratio = F.log((F.col("bad") + SMOOTH) / (bad + 2 * SMOOTH)) - F.log((F.col("good") + SMOOTH) / (good + 2 * SMOOTH))
    spread = F.sqrt(1 / (F.col("bad") + SMOOTH) + 1 / (F.col("good") + SMOOTH))
    kept = seen.select("place", ratio.alias("ratio"), F.abs(ratio / spread).alias("z")).orderBy(
        F.desc("z"), "place").limit(FEATURES).select("place", "ratio").toPandas().sort_values("place")
    places, ratios = kept.place.to_numpy(), kept.ratio.to_numpy()
    wanted = spread_set(places)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for place, value in zip(batch.column(1), batch.column(2), strict=True):
                at = np.asarray(place.values)
                keep = wanted[at]
                out.append((at[keep], np.asarray(value.values)[keep]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.list_(pa.int32())),
                 pa.array([o[1] for o in out], pa.list_(pa.float32()))], batch.schema.names)

    # A bounded number of rows with a bounded number of features.
    data = rows.mapInArrow(narrow, rows.schema).orderBy("toxic", F.xxhash64("place", "value")).toArrow()
    y = (data.column("toxic").to_numpy() > 0).astype(float)
    lists = data.column("place").combine_chunks()
    column = np.searchsorted(places, lists.flatten().to_numpy())
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    value = data.column("value").combine_chunks().flatten().to_numpy().astype(float) * SCALE * ratios[column]
    bias, weights = logistic(row, column, value, y, len(places))
    return Model(bias, {int(p): float(SCALE * w * r) for p, w, r in zip(places, weights, ratios, strict=True) if w})


def spread_set(places: np.ndarray) -> np.ndarray:
    out = np.zeros(PLACES, bool)
    out[places] = True
    return out


def logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """Logistic regression with a squared penalty, by accelerated gradient steps.

    The step follows from the largest curvature, which power iteration finds.
    """
    direction = np.ones(width)
    for _ in range(30):
        direction /= np.linalg.norm(direction) or 1
        direction = np.bincount(column, value * np.bincount(row, value * direction[column], len(y))[row], width)
    step = 1 / (np.linalg.norm(direction) / len(y) / 4 + PENALTY)
    w, b = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * ahead[column], len(y)) + ahead_b, -30, 30))) - y
        new = ahead - step * (np.bincount(column, value * error[row], width) / len(y) + PENALTY * ahead)
        new_b = ahead_b - 2 * error.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return b, w


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """``docs`` with a double ``name`` from 0 to 1; null and empty texts have the score of the bias.

    Repeated rows are rows like any other, and an empty table gives none. A column called
    ``name`` is replaced; other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES numbers
    columns = [c for c in docs.columns if c != name]
    # The text goes to the workers once, inside its row, if the row has it as text.
    inside = columns.index(text) if text in columns and docs.schema[text].dataType.typeName() == "string" else None
    other = F.lit(None).cast("string") if inside is not None else F.col(f"`{text}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), other.alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scorer(shared.value)
        for batch in batches:
            column = batch.column(1) if inside is None else batch.column(0).field(inside)
            out = [found.of(texts) for texts in chunks(column)]
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["row", "score"])

    return rows.mapInArrow(of, rows.select("row").schema.add("score", "double")).select("row.*", F.col("score").alias(name))


class Scorer(Remembered):
    """The share of each word in a model's value."""

    def __init__(self, model: Model) -> None:
        super().__init__(REMEMBERED)
        self.model = model

    def of(self, texts: list[str]) -> np.ndarray:
        cut = [words_of(t) for t in texts]
        new = self.new(set().union(*cut))
        for word in new:
            self[word] = self.model.share(word)
        values = np.array([sum(map(self.__getitem__, words)) / max(1, len(words)) for words in cut])
        for word in new:
            if len(word) > LONG:
                del self[word]
        return 1 / (1 + np.exp(-np.clip(self.model.bias + values, -700, 700)))


def scorer(model: Model) -> Scorer:
    """One memory for all tasks of a worker process that have the same model; it holds the model, so its id is its own."""
    return alone(f"toxicity {id(model)}", lambda: Scorer(model))


def held_out(key) -> "F.Column":
    """Whether crc32 of the key as text leaves 0 by 5; a null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on labelled rows that are not held out. Of a document's labels the highest counts; null ones don't."""
    return fit(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")),
               labels.where(~held_out(key)).select(F.col(key).alias("key"), "toxic"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model, name="score").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
