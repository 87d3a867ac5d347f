from __future__ import annotations

import random

import numpy as np
import pytest

from snipmill.llm import pieces

NAME = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    from snipmill.llm.common import tokenizer_file

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(NAME))


def odd_texts():
    random.seed(9)
    letters = list("abcdeinrsthe    .,!1290éßñ\t\n▁世界가\x00AB<>|ꙮ😀 ")
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(2000)]
    return texts + [" " * k + "x" * (k % 17) + " " * k for k in range(40)]


def test_suffix_array_sorts_suffixes():
    line = np.array([2, 1, 3, 1, 2, 1, 3, 0])
    order = pieces.suffix_array(line, 16).tolist()
    assert order == sorted(range(8), key=lambda i: line[i:].tolist())


def test_ids_and_texts_equal_the_library(library):
    texts = odd_texts()
    found = [np.frombuffer(x, "<u4").tolist() for x in pieces.memory(NAME).encode(texts)]
    assert found == [library.encode(t) for t in texts]
    assert [pieces.vocabulary(NAME).decode(x) for x in found] == [library.decode(x) for x in found]


def test_encode_and_decode_columns(spark, documents, library):
    texts = [None, "", "one two", "the " * 20_000, "a" * 3000, " lead", "x▁y"]
    docs = documents(enumerate(texts)).withColumnRenamed("lang", "row").withColumnRenamed("source", "ids")
    rows = pieces.decode(pieces.encode(docs, NAME), NAME).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.piece_ids == library.encode(text)
        assert r.decoded == text.replace("▁", " ")
    assert pieces.encode(documents([]).limit(0), NAME).columns[-1] == "piece_ids"
    assert pieces.encode(documents([]).limit(0), NAME).collect() == []


def test_digests_of_odd_rows(documents):
    rows = pieces.digests(documents([(None, None), (1, "a"), (1, "a"), (2, "")]), NAME).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_pieces, r.round_trip) for r in rows) == [
        (0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 0, True)]
