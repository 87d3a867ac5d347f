from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from snipmill.llm import token_counts, token_files
from snipmill.session import new_folder

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from snipmill.llm.common import tokenizer_file

    return Tokenizer.from_file(tokenizer_file(NAME))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    random.seed(5)
    plain = list("abzABZ'stredvml019.,!#éÉßµ²½ª \t\n\r\x0b\x0c\x1c\x85\xa0<|>-_×\x00\xad")
    wide = [*plain, *"İΣ́　世 가ͅǅ", "<|endoftext|>", "<|startoftext|>"]
    return ["".join(random.choices(wide if i % 2 else plain, k=random.randint(0, 20))) for i in range(3000)]


def test_pre_tokens_give_the_ids_of_the_library(library):
    texts = odd_texts()
    found = token_files.Ids(NAME).of(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [ids_of(library, t) for t in texts]


def test_words_of_a_share_are_encoded_once():
    ids = token_files.Ids(NAME)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(200_000)]
    shares = [set(words[at:at + 20_000]) for at in range(0, len(words), 20_000)]
    for share in [*shares, shares[0]]:
        ids.learn(share)
    ids.tokenizer = None  # whatever is not remembered can't be encoded
    for share in shares:
        ids.learn(share)


def test_contractions_are_cut_as_the_pattern_of_the_file_does():
    assert token_files.pre_tokens("It's 42!'ll' 's'the'") == ["it", "'s", "4", "2", "!'", "ll", "'", "'s", "'t", "he", "'"]


def test_a_tokenizer_that_keeps_blanks_is_refused():
    with pytest.raises(ValueError):
        token_files.tokenizer("byte_bpe_50k.json")


def run(spark, docs):
    folder = new_folder(spark, "tokens")
    manifest = token_files.write_parts(docs, folder, NAME, end_id=1).persist()
    return token_files.read_parts(manifest, folder, max(1, manifest.count())).collect()


def test_parts_read_back_as_written(spark, documents, library):
    texts = [None, "", "Hello, world!", "the " * 60_000, *odd_texts()[:300]]
    rows = sorted(run(spark, documents(enumerate(texts))), key=lambda r: r.key)
    start = 0
    for row, text in zip(rows, texts, strict=True):
        ids = [*ids_of(library, text), 1]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_keys_that_are_null_or_repeat_and_an_empty_table(spark, documents):
    rows = run(spark, documents([(None, "a"), (3, "b"), (3, "b"), (None, "c c"), (-2, "")]))
    assert sorted((r.start, r.n_tokens, r.key) for r in rows)[2:] == [(5, 1, -2), (6, 2, 3), (8, 2, 3)]
    assert sorted(r.n_tokens for r in rows if r.key is None) == [2, 3]
    assert run(spark, documents([]).limit(0)) == []


@pytest.mark.parametrize("head", [3, 200_000])
def test_counts_equal_the_library(documents, library, by_id, monkeypatch, head):
    monkeypatch.setattr(token_counts, "HEAD", head)
    texts = [None, "", "the the cat", "x" * 5000, "the " * 30_000, *odd_texts()[:400]]
    docs = documents(enumerate(texts)).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    found = by_id(token_counts.token_counts(docs, NAME))
    for i, text in enumerate(texts):
        assert found[i]["n_tokens"] == len(ids_of(library, text))
        assert found[i]["n_bytes"] == len((text or "").encode())


def test_counts_of_repeated_and_missing_keys(documents):
    rows = token_counts.token_counts(documents([(None, "a b"), (1, "a"), (1, "a"), (1, "zzz b")]), NAME).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in rows) == [(0, 3), (1, 1), (1, 1), (1, 5)]
    assert token_counts.token_counts(documents([]).limit(0), NAME).collect() == []
