"""Token counts from the counts of pre-tokens.

Each distinct pre-token of the corpus is encoded once, to count its pieces. A document's
count is the sum of these over its pre-token frequencies; no ids of a document are made.

The most frequent pre-tokens, a fixed number of them, are broadcast: they hold most
occurrences, and no hot key is left for the join. The others are joined by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipmill.llm.common import frequent_from, staged, table
from snipmill.llm.token_files import chunks, pre_tokens, tokenizer

#: Pre-tokens that are broadcast, a few MB.
HEAD = 200_000
#: Distinct pre-tokens that a task holds before it passes their counts on.
HELD = 400_000
#: Longer pre-tokens are counted where they stand, and not sent around.
LONG = 256


def frequencies(docs: DataFrame) -> DataFrame:
    """(word, n) of all pre-tokens of ``text``; a task passes sums on, not occurrences."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for texts in chunks(batch.column(0)):
                for text in texts:
                    found.update(pre_tokens(text))
                for word in [w for w in found if len(w) > LONG]:
                    del found[word]
                if len(found) > HELD:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pieces(words: DataFrame, vocabulary: str) -> DataFrame:
    """``words`` with the number of ids of each, in ``n_pieces``; one call encodes a batch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_batch_fast
        for batch in batches:
            counts = [len(e.ids) for e in encode(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["word", "n", "n_pieces"])

    return words.mapInArrow(of, "word string, n long, n_pieces long")


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens. Null and repeated keys are rows like any
    other. An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    words = staged(pieces(frequencies(thin), vocabulary), "pre-tokens")
    cut = frequent_from(words, HEAD)
    head = words.where(F.col("n") >= cut).select("word", "n_pieces").toArrow()  # at most HEAD rows
    shared = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in head.columns), strict=True)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        row = TaskContext.get().partitionId() << 33  # one attempt of each partition is in the table
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            names, sizes, sums, rest, freqs = [], [], [], [], []
            for value in batch.column(1):
                body = value.as_py() or ""
                total, left, often = 0, [], []
                for word, n in Counter(pre_tokens(body)).items():
                    found = known.get(word)
                    if found is None and len(word) > LONG:
                        found = len(encode(word, add_special_tokens=False).ids)
                    if found is None:
                        left.append(word)
                        often.append(n)
                    else:
                        total += n * found
                row += 1
                names.append(row)
                sizes.append(len(body.encode("utf-8", "surrogatepass")))
                sums.append(total)
                rest.append(left)
                freqs.append(often)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rest, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int32()))],
                ["key", "row", "n_bytes", "known", "words", "freqs"])

    kind = thin.schema["key"].dataType.simpleString()
    partial = staged(thin.mapInArrow(
        of, f"key {kind}, row long, n_bytes long, known long, words array<string>, freqs array<int>"), "frequencies")
    tail = words.where(F.col("n") < cut)
    rare = partial.select("row", F.explode(F.arrays_zip("words", "freqs")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.freqs").alias("freq"))
    sums = rare.join(tail, "word").groupBy("row").agg(F.sum(F.col("freq") * F.col("n_pieces")).alias("more"))
    return partial.join(sums, "row", "left").select(
        F.col("key").alias(key), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "word_bpe_49k.json").withColumn(
        "over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
