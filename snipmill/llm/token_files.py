"""Token ids as flat binary files.

A part is three files in ascending order of the key: ``.tok`` holds the ids of all its
documents one after the other (little-endian, 16 bits if the vocabulary fits, else 32),
``.off`` the 64-bit offsets of its documents in tokens and the end, ``.ids`` the 64-bit
keys. A manifest has a row for each part; its ``base``, the tokens of all earlier
parts, comes from a prefix sum, so that a document's place in the whole is base + offset.
Readers map the files into memory; where a store can't be mapped, they are read.

Tasks write under names of their own, and the manifest that Spark commits names those
that count: a task that is lost and runs again leaves an unnamed file, no wrong one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snipmill.llm.common import NewFile, Remembered, open_folder, staged, table, tokenizer_file
from snipmill.session import new_folder

#: Pre-tokens of a generation that a worker remembers.
REMEMBERED = 1 << 18
#: What the last piece of each word ends with in the vocabulary.
END = "</w>"

_SPECIAL = "<|"
_RUN = re.compile(r"[^ \t\n\r]+")
#: Pre-tokens of a text of Latin-1 characters, as the tokenizer file's own pattern finds them:
#: letters, single digits, contractions, runs of anything else. White space is dropped. Letters are first as most
#: pre-tokens are; only contractions and the last kind can start alike.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = re.compile(rf"[{_LETTER}]++|[{_DIGIT}]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\x0b\x0c\r\x85\xa0{_LETTER}{_DIGIT}Ā-\U0010ffff]+")


def pre_tokens(text: str) -> list[str]:
    """Pieces of ``text`` that the word tokenizer encodes one by one, in order.

    Latin-1 texts without a special string are lower-cased and cut by the tokenizer's
    pattern. Other texts are cut at blanks, tabs and line ends, which no rule of the
    tokenizer reaches across; its normalisation and special strings then apply within.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _RUN.findall(text)
    if _SPECIAL in text:
        return _RUN.findall(text)
    return _LATIN.findall(text.lower())


@cache
def tokenizer(name: str):
    """The library's tokenizer; only for files whose encoding is the sum of its pre-tokens'."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_file(name))
    found.no_truncation()
    found.no_padding()
    for probe in ("Ab cd,ef 'tis it's 42", "  Été　世界 x<|endoftext|>y  "):
        whole = found.encode(probe, add_special_tokens=False).ids
        if whole != [i for p in pre_tokens(probe) for i in found.encode(p, add_special_tokens=False).ids]:
            raise ValueError(f"{name} does not drop white space; its texts can't be cut into words")
    return found


class Ids(Remembered):
    """The ids of pre-tokens as bytes."""

    def __init__(self, name: str) -> None:
        super().__init__(REMEMBERED)
        self.tokenizer = tokenizer(name)
        self.dtype = dtype_of(name)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(END)]] = True

    def learn(self, pieces: set[str]) -> None:
        """Encode in one call what is new; an id with the word end closes each pre-token."""
        new = list(self.new(pieces))
        words = [p for p in new if _LATIN.fullmatch(p)]
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(words):
                raise ValueError("the tokenizer does not mark the end of each word")
            size, data = ids.dtype.itemsize, ids.tobytes()
            self.update(zip(words, (data[a * size:b * size] for a, b in pairwise([0, *cuts.tolist()])), strict=True))
        for piece in new:
            if piece not in self:
                self[piece] = np.array(
                    self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        cut = [pre_tokens(t) for t in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in cut]


def chunks(values: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of a column, some at a time; null is empty."""
    held, size = [], 0
    for value in values:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


@cache
def remembered(name: str) -> Ids:
    """One memory for all tasks of a worker process."""
    return Ids(name)


def dtype_of(name: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(name).get_vocab_size() <= 1 << 16 else "<u4")


MANIFEST = "first long, tok string, off string, ids string, n_nulls long, n_docs long, n_tokens long, dtype string"


def write_parts(docs: DataFrame, folder: str, vocabulary: str, end_id: int,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, write the parts to ``folder`` and return the manifest with ``base``.

    Rows without a key come first; rows that repeat one are in the order of a hash of their texts.
    A null or empty text is the end id alone. An empty table gives an empty manifest. Other
    columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, files, nulls, first = remembered(vocabulary), None, 0, None
        end, offsets, total = np.array([end_id], ids.dtype).tobytes(), 0, 0
        for batch in batches:
            keys, places = batch.column(0), []
            if not batch.num_rows:
                continue
            if files is None:
                files = [NewFile(folder, suffix) for suffix in (".tok", ".off", ".ids")]
            for texts in chunks(batch.column(1)):
                for body in ids.of(texts):
                    files[0].write(body + end)
                    places.append(total)
                    total += len(body) // ids.dtype.itemsize + 1
            nulls += keys.null_count
            if first is None and keys.null_count < len(keys):
                first = keys[keys.null_count].as_py()
            offsets += len(places)
            files[1].write(np.array(places, "<i8").tobytes())
            files[2].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        if files is not None:
            files[1].write(np.array([total], "<i8").tobytes())
            row = [first, *[f.close() for f in files], nulls, offsets, total, ids.dtype.str]
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], SCHEMA)

    thin = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # The bounds of ranges come from a sample on the driver, so the key is short: a hash parts a key that repeats.
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ordered = thin.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    parts = staged(ordered.mapInArrow(write, MANIFEST), "manifest")
    # One row a part: their prefix sum is small, whatever the texts.
    before = Window.orderBy(F.col("first").asc_nulls_first(), F.col("n_nulls").desc(), "tok").rowsBetween(
        Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


NAMES = [c.split()[0] for c in MANIFEST.split(", ")]
SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in MANIFEST.split(", ")])


def load(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file of numbers, mapped where the store allows it."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_parts(manifest: DataFrame, folder: str, parts: int) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files that ``manifest`` names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for batch in batches:
            for part in batch.to_pylist():
                tok, off, ids = (load(fs, part[k], t) for k, t in (("tok", part["dtype"]), ("off", "<i8"), ("ids", "<i8")))
                for a in range(0, part["n_docs"], 8192):
                    b = min(a + 8192, part["n_docs"])
                    keys = pa.array(np.array(ids[a:b]), mask=np.arange(a, b) < part["n_nulls"])
                    crc = [zlib.crc32(tok[x:y].astype("<u4").tobytes()) for x, y in zip(off[a:b], off[a + 1:b + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(off[a:b] + part["base"]), pa.array(np.diff(off[a:b + 1])), pa.array(crc, pa.int64())],
                        ["key", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(parts).mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    manifest = staged(write_parts(table(spark, sf_dir, "documents"), folder, "word_bpe_49k.json", end_id=1), "parts")
    parts = max(1, manifest.count())
    return read_parts(manifest, folder, parts).withColumnRenamed("key", "doc_id")


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
