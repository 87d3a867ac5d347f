from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from snipmill.llm import byte_pieces as B

NAME = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks_of(NAME), special_tokens={})


def ids_of(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in B.codec(NAME).encode(texts)]


def test_model_numbers_are_ranks():
    found = B.codec(NAME)
    assert found.model.get_piece_size() == len(found.ranks) + 1
    assert all(found.ranks[piece] == i for i, piece in enumerate(found.pieces))


def test_odd_texts_equal_the_library(library):
    random.seed(4)
    letters = list("abcdefgh   ''sstdrevelm.,!?123\n\t\r\x1c\x85\xa0　éñß世界가😀ꙮ\0\x7f")
    texts = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(5000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 999 + "x", "é" * 4000, "<|endoftext|>", "\ud800"[:0]]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_character_beside_others(library):
    points = [*range(0, 0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x110000, 997)]
    texts = [f"a{c} {c}b 1{c}  {c}{c}.{c}" for c in map(chr, points)]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_whole_vocabulary_keeps_its_own_ids(library):
    words = [w for w in (p.decode("utf-8", "ignore") for p in B.codec(NAME).pieces) if w]
    assert ids_of(words) == [library.encode_ordinary(w) for w in words]


def test_encode_and_decode_columns(spark, documents, library):
    texts = [None, "", "one two", "the " * 20_000, "x" * 200_000, " lead  trail ", "ñ界"]
    docs = documents(enumerate(texts)).withColumnRenamed("lang", "row").withColumnRenamed("source", "value").withColumnRenamed("n_chars", "made")
    for r in B.decode(B.encode(docs, NAME), NAME).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert (r.row, r.value, r.made) == ("en", "s", 0)
    assert B.encode(documents([]).limit(0), NAME).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([0, None, -1, 60_000],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in B.decode(odd, NAME).collect()] == [None, b"", B.codec(NAME).pieces[0]]


def test_digests(documents, library):
    texts = [None, "", "a b", "a b", "long " * 30_000]
    rows = B.digests(documents([*enumerate(texts), (None, "x"), (2, "a b")]), NAME).collect()
    assert len(rows) == 7
    for r in rows:
        text = "x" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_gaps_in_ranks_are_refused(tmp_path, monkeypatch):
    import base64

    path = tmp_path / "gap.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + b" %d" % (b + (b > 9)) for b in range(256)))
    monkeypatch.setattr(B, "tokenizer_file", lambda name: str(path))
    with pytest.raises(ValueError, match="leaves ranks out"):
        B.ranks_of("gap")
