"""The corpus pipeline: quality, toxicity, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's documents. All but the last give the columns of documents.

Null and empty texts have no words, so the quality rules reject them; a stage that meets one
all the same treats it as the empty text. A null language or source is one of its own. Rows that
repeat a document are judged one by one, and the near duplicates keep one of each key. Rows
without a key are never each other's copies. Texts are read whole, however long. An empty table gives an empty
table. Further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snipmill.llm import mixing, pieces, quality, simhash, toxicity
from snipmill.llm.common import staged, table

VOCABULARY = "piece_bpe_32k.model"


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled thresholds keep."""
    verdict = _fresh(docs, "verdict")
    judged = quality.judged(docs, table(spark, sf_dir, "labels"), name=verdict)
    return judged.where(F.col(verdict)["kept"]).select(*_columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    score = _fresh(docs, "toxic_score")
    return toxicity.scored(docs, model, name=score).where(F.col(score) < 0.5).select(*_columns(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts share 0.8 of their five-word shingles or more."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    plan = _fresh(docs, "mix")
    mixed = mixing.mix(docs, name=plan).where(F.col(plan)["copies"] > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(plan)["copies"]))
    return mixed.select(F.struct(*_columns(docs)).alias("row"), each.alias("n")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, piece_ids) of every row, with whether decoding gives its text back."""
    return pieces.coded(docs, VOCABULARY, ["doc_id", "source"])


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("near duplicates", drop_copies),
    ("source mixing", mix_sources),
    ("token ids", encode_pieces),
]

#: A trained classifier and merges of pieces are nothing that SQL states.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
