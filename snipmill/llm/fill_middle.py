"""Fill-in-middle transformation with cuts from a wavelet matrix.

Every character of the texts of a batch has a class: what kind it is (of a word, a blank, a
line end) and whether its run of words or white space ends there. A wavelet matrix over the
classes answers how often a class occurs before a position. The units that end before a
position are a sum of such ranks, so the place of a cut is found by bisection on ranks, for
both cuts of all texts at once.

Cuts, forms and outputs depend on the key and the text alone: runs, retries and partitions agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipmill.llm.common import WORDS, table
from snipmill.llm.token_files import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Kinds of characters; a class is twice the kind, and one more at the end of a run.
_WORD, _BLANK, _LINE = 0, 2, 4
#: Classes whose occurrences end a unit, by the name of the unit. What is left of a text is a last unit.
UNITS = {"word": (_WORD + 1,), "line": (_LINE, _LINE + 1)}


class WaveletMatrix:
    """Ranks of small numbers: one bit vector a level, zeros of a level before its ones."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.size, self.bits = len(values), bits
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for bit in reversed(range(bits)):
            ones = (values >> bit & 1).astype(bool)
            words = np.packbits(ones, bitorder="little")
            words = np.concatenate([words, np.zeros(-len(words) % 8 + 8, np.uint8)]).view("<u8")
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((words, before, self.size - int(before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often ``value`` occurs before each position of ``at``."""
        low, high = np.zeros_like(at), at
        for bit, (words, before, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            ones_low, ones_high = _ones(words, before, low), _ones(words, before, high)
            if value >> bit & 1:
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low


def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    word, bit = at >> 6, (at & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each character of texts that stand one after the other and end at ``ends``."""
    space = (points == 32) | (points >= 9) & (points <= 13)
    kind = np.where(points == 10, _LINE, np.where(space, _BLANK, _WORD)).astype(np.uint8)
    last = np.ones(len(points), bool)
    last[:-1] = space[1:] != space[:-1]
    last[ends[ends > 0] - 1] = True
    return kind + last


class Units:
    """Counts and ends of the units of some texts."""

    def __init__(self, texts: list[str], unit: str = "word") -> None:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.wanted = UNITS[unit]
        self.matrix = WaveletMatrix(classes(points, self.ends), 3)
        self.at_start = self._before(self.starts)
        self.closed = self._before(self.ends) - self.at_start
        # A text that goes on after its last end has one more unit.
        at_end = self._before(np.maximum(self.ends - 1, self.starts))
        self.counts = self.closed + ((sizes > 0) & (at_end - self.at_start == self.closed))

    def _before(self, at: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(value, at) for value in self.wanted)

    def cut(self, after: np.ndarray) -> np.ndarray:
        """The character of each text that follows ``after`` of its units, by bisection on ranks."""
        low, high = self.starts.copy(), self.ends.copy()
        while np.any(low < high):
            middle = (low + high) >> 1
            few = self._before(middle) - self.at_start < after
            low, high = np.where(few, np.minimum(middle + 1, high), low), np.where(few, high, middle)
        return low - self.starts


def draws(key: object, seed: int) -> list[int]:
    """Four numbers below 2**32 of a row, from its key in decimal digits (a null key has none)."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return np.frombuffer(digest, ">u4")[:4].tolist()


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "word",
                   seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    ``rate`` of 100 texts are cut after two random numbers of units; of these, ``suffix_first`` of 100
    come as suffix, prefix, middle (``spm``), the others as prefix, suffix, middle (``psm``). A unit is a
    ``word`` with the white space before it, or a ``line``. Empty texts and those that hold a marker stay ``plain``.

    Null texts are empty texts. A null key draws by the empty string. Repeated rows give equal rows.
    An empty table gives none. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    thin = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in chunks(batch.column(1)):
                keys = batch.column(0).slice(at, len(texts))
                made = _transformed(keys.to_pylist(), texts, unit, seed, rate, suffix_first)
                yield pa.RecordBatch.from_arrays([keys, *made], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])
                at += len(texts)

    return thin.mapInArrow(
        of, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def _transformed(keys: list, texts: list[str], unit: str, seed: int, rate: int, suffix_first: int) -> list[pa.Array]:
    units = Units(texts, unit)
    drawn = np.array([draws(k, seed) for k in keys], np.int64)
    ends = np.sort(drawn[:, :2] % (units.counts + 1)[:, None], axis=1)
    first, second = units.cut(ends[:, 0]).tolist(), units.cut(ends[:, 1]).tolist()
    forms, outputs = [], []
    for text, a, b, (_, _, third, fourth) in zip(texts, first, second, drawn.tolist(), strict=True):
        if not text or third % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
            forms.append("plain")
            outputs.append(text)
        elif fourth % 100 < suffix_first:
            forms.append("spm")
            outputs.append(f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}")
        else:
            forms.append("psm")
            outputs.append(f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}")
    plain = np.array([f == "plain" for f in forms], bool)
    a, b = np.array(first, np.int64), np.array(second, np.int64)
    return [pa.array(units.counts), pa.array(forms, pa.string()), pa.array(a, mask=plain), pa.array(b - a, mask=plain),
            pa.array(outputs, pa.string())]


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output was made from. No cut text holds a marker, so the markers part it."""
    part = F.split(F.col(output), "<[PSM]>", 4)
    return (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
            .otherwise(F.col(output)))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": rf"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*{WORDS}|[\x20\x09-\x0D]+') AS units
    FROM documents
), drawn AS (
    SELECT doc_id, text, units, len(units) AS n,
           list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INT), 8) AS BIGINT)) AS d
    FROM cut
), parted AS (
    SELECT doc_id, text, n,
           array_to_string(list_slice(units, 1, least(d[1] % (n + 1), d[2] % (n + 1))), '') AS prefix,
           array_to_string(list_slice(units, 1, greatest(d[1] % (n + 1), d[2] % (n + 1))), '') AS upto,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50
                THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), made AS (
    SELECT doc_id, text, n, form, prefix, substr(upto, length(prefix) + 1) AS middle, substr(text, length(upto) + 1) AS suffix
    FROM parted
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM made
"""}
