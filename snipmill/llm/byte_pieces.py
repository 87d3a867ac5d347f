"""Byte-level BPE through a sentencepiece model that is written from the vocabulary.

A rank file lists byte strings; the model is serialised from it directly: each byte becomes
a character of its own, each byte string a piece of such characters with the negative rank
as score, and the normaliser is the identity. Merging the best score first is then merging
the lowest rank first, so the library that runs sentencepiece models gives the ids of the
rank file, and a piece's number is its rank. Decoding maps the characters back to bytes.

Pre-tokens are merged one by one, each distinct one of a batch once; a worker remembers the short
ones. A pre-token that is in the vocabulary keeps its own id even where merges would not make it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipmill.llm.common import Remembered, table, tokenizer_file
from snipmill.llm.token_files import chunks

#: The character of byte 0; the others follow. None of them is white space or has another form.
FIRST = 0x100
#: Pre-tokens of a generation that a worker remembers, and the longest of them in characters.
REMEMBERED, LONG = 1 << 17, 64

#: Pre-tokens of a text of Latin-1 characters, as the rank file's own pattern finds them.
_LETTER, _DIGIT = ("".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind) for kind in "LN")
_SPACE = r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
                    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def to_characters(data: bytes) -> str:
    """A character for each byte."""
    return (np.frombuffer(data, np.uint8).astype("<u2") + FIRST).tobytes().decode("utf-16-le")


def to_bytes(characters: str) -> bytes:
    return bytes([ord(c) - FIRST for c in characters])


def ranks_of(name: str) -> dict[bytes, int]:
    """Byte strings of a rank file with their ranks, which must count from 0 without a gap."""
    with open(tokenizer_file(name), "rb") as lines:
        found = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    if sorted(found.values()) != list(range(len(found))) or not all(bytes([b]) in found for b in range(256)):
        raise ValueError(f"{name} does not rank every byte, or leaves ranks out")
    return found


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece numbers are ``ranks``; the unknown piece comes last."""
    pieces = [_field(1, to_characters(piece).encode()) + _field(2, -float(rank)) + _field(3, 1)
              for piece, rank in sorted(ranks.items(), key=lambda kv: kv[1])]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(40, len(ranks))  # BPE; the number of the unknown piece
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, piece) for piece in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """The model of one rank file, and the ids of pre-tokens that this process has met."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import regex
        import sentencepiece

        self.ranks = ranks_of(name)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(self.ranks))
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces = [to_bytes(self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        self.decimals = [str(i) for i in range(len(self.ranks))]
        self.found = Remembered(REMEMBERED)

    def pre_tokens(self, text: str) -> list[str]:
        """What the rank file's pattern cuts ``text`` into."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern(text)
        return _LATIN.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        cuts = [self.pre_tokens(t) for t in texts]
        long = self._learn(self.found.new(set().union(*cuts)))
        if long:
            return [b"".join([long[c] if c in long else self.found[c] for c in cut]) for cut in cuts]
        return [b"".join(map(self.found.__getitem__, cut)) for cut in cuts]

    def _learn(self, cuts: set[str]) -> dict[str, bytes]:
        """Remembers the ids of pre-tokens: their own rank, or what the model merges. Gives those of long ones."""
        merge, data = [], []
        for cut in cuts:
            piece = cut.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(piece)
            if rank is None:
                merge.append(cut)
                data.append(piece)
            else:
                self.found[cut] = rank.to_bytes(4, "little")
        line = to_characters(b"".join(data))
        ends = np.cumsum([0, *map(len, data)]).tolist()
        ids = self.model.encode([line[a:b] for a, b in pairwise(ends)], num_threads=1)
        made = dict(zip(merge, [array("I", i).tobytes() for i in ids], strict=True))
        long = {cut: made.pop(cut) for cut in merge if len(cut) > LONG}
        self.found.update(made)
        return long

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``; an id without a piece has none."""
        try:
            return b"".join(map(self.pieces.__getitem__, ids))
        except IndexError:
            return b"".join([self.pieces[i] for i in ids if i < len(self.pieces)])


@cache
def codec(name: str) -> Codec:
    """One model and memory for all tasks of a worker process."""
    return Codec(name)


def _with(docs: DataFrame, source: F.Column, to: str, kind: T.DataType, convert) -> DataFrame:
    """``docs`` with a column ``to`` that ``convert`` makes from an Arrow column of ``source``, some rows at a time."""
    columns = [c for c in docs.columns if c != to]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), source.alias("value"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in convert(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(made)), made], ["row", "made"])
                at += len(made)

    return rows.mapInArrow(of, rows.select("row").schema.add("made", kind)).select("row.*", F.col("made").alias(to))


def encode(docs: DataFrame, name: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in an array column ``to``.

    Null and empty texts have an empty array. Repeated rows are rows like any other. An empty
    table gives none. A column called ``to`` is replaced; all other columns stay, whatever their names.
    """
    def convert(column: pa.Array) -> Iterator[pa.Array]:
        for texts in chunks(column):
            ids = codec(name).encode(texts)
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4"))

    return _with(docs, F.col(text).cast("string"), to, T.ArrayType(T.IntegerType()), convert)


def decode(rows: DataFrame, name: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of ``ids`` in a binary column ``to``.

    Null ids give null, no ids no bytes; a null id, or one that the vocabulary lacks, adds nothing.
    """
    def convert(column: pa.Array) -> Iterator[pa.Array]:
        back = codec(name).decode
        yield pa.array([None if (x := v.as_py()) is None else back([i for i in x if i is not None and i >= 0])
                        for v in column], pa.binary())

    return _with(rows, F.col(ids).cast("array<int>"), to, T.BinaryType(), convert)


def digests(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row; encoded and decoded in one pass.

    Hashes are lower-case hex: of the decimal ids joined by commas, and of the decoded bytes.
    Null and empty texts have no ids. Null and repeated keys are rows like any other.
    """
    kind = docs.schema[key].dataType.simpleString()
    thin = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = codec(name)
        decimal = found.decimals.__getitem__
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                counts, hashes, back = [], [], []
                for data in found.encode(texts):
                    ids = np.frombuffer(data, "<u4").tolist()
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    back.append(hashlib.sha256(found.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(back)],
                    ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return thin.mapInArrow(of, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLES: dict[str, str] = {}
