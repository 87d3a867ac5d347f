"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece reaches across: in front of a run of word marks, around line
ends, and between a letter and a sign. The distinct cuts of a batch stand one after the other, and a suffix array sorts
their positions. Binary search finds for every piece of the vocabulary the range of suffixes
that start with it; these occurrences are edges over the text. They are sorted by the
position at which they end and then relaxed, position by position, for all cuts at once.

The vocabulary merges pairs by score, so relaxing keeps no sums: exactly one edge into a
position is the last piece of the text up to there, the one that the merges of the two
neighbouring pieces would leave apart. That check undoes merges, from the later one to the
earlier, and asks whether a pair on the seam would have merged before.

Characters without a piece become bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipmill.llm.common import Remembered, alone, table, tokenizer_file

MARK = "▁"
#: Characters of cuts that are matched at once, and cuts of a generation that a worker remembers.
AT_ONCE, REMEMBERED, LONG = 400_000, 1 << 17, 256
#: Characters of texts that are encoded together.
TOGETHER = 1 << 20


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of what starts there, up to ``depth`` numbers, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    done, order = 1, np.argsort(rank, kind="stable")
    while done < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-done or None] = rank[done:]
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key)
        steps = np.empty(len(rank), np.int64)
        steps[0], steps[1:] = 1, np.diff(key[order]) > 0
        rank[order] = np.cumsum(steps)
        done *= 2
    return order


class Vocabulary:
    """Pieces of a model that merges by score, numbered by rank: characters first, then merges."""

    def __init__(self, name: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        size = model.get_piece_size()
        if model.normalize("á b") != f"{MARK}á{MARK}b" or model.encode("") != []:
            raise ValueError(f"{name} normalises texts; only plain models are matched")
        known = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(size)
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        across = re.compile(rf"[^{MARK}]{MARK}|\n|\0|[{_LETTERS}][{_SIGNS}]")
        if any(across.search(p) for _, p, _ in known):
            raise ValueError(f"{name} has pieces across the cuts")
        scores = Counter(score for _, p, score in known if len(p) > 1)
        self.scores = {p: score for _, p, score in known}
        if any(scores[score] > 1 and len(p) > 1 and p.strip(MARK) for _, p, score in known):
            raise ValueError(f"{name} has merges without an order")
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        known.sort(key=lambda k: (len(k[1]) > 1, -k[2], len(k[1])))
        self.ids = np.array([k[0] for k in known])
        self.number = {k[1]: n for n, k in enumerate(known)}
        self.pieces = [k[1] for k in known]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.depth = int(self.lengths.max())
        self.text = {i: p.replace(MARK, " ").encode() for i, p, _ in known}
        self.text |= {int(i): bytes([b]) for b, i in enumerate(self.bytes)}
        self._pairs()
        self._splits()
        reachable = np.flatnonzero((self.lengths == 1) | (self.left != np.arange(len(self.ids))))
        self.searched = reachable
        width = self.depth
        grid = np.zeros((len(reachable), width), ">u4")
        upper = np.full((len(reachable), width), 0xFFFFFFFF, ">u4")
        for row, n in enumerate(reachable):
            points = [ord(c) for c in self.pieces[n]]
            grid[row, :len(points)] = upper[row, :len(points)] = points
        self.lower, self.upper = (x.view(f"S{4 * width}").ravel() for x in (grid, upper))

    def _pairs(self) -> None:
        """Every pair of pieces that makes a piece."""
        keys, values = [], []
        for n, piece in enumerate(self.pieces):
            for cut in range(1, len(piece)):
                a, b = self.number.get(piece[:cut]), self.number.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * len(self.pieces) + b)
                    values.append(n)
        order = np.argsort(keys)
        self.pair_keys, self.pair_values = np.array(keys)[order], np.array(values)[order]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or a number above all."""
        key = a * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], len(self.pieces) + 2)

    def _splits(self) -> None:
        """The last merge that makes each piece; a piece that its own merges don't make keeps itself."""
        everyone = np.arange(len(self.pieces))
        self.left, self.right = everyone.copy(), everyone.copy()
        by_piece: dict[int, list[tuple[int, int]]] = {}
        for key, value in zip(self.pair_keys.tolist(), self.pair_values.tolist(), strict=True):
            by_piece.setdefault(value, []).append(divmod(key, len(self.pieces)))
        for n in range(len(self.pieces)):  # parts have smaller numbers, or are no merges of it
            for a, b in by_piece.get(n, ()):
                if max(a, b) < n and self._made(a) and self._made(b) and self.apart(np.array([a]), np.array([b]), limit=n)[0]:
                    self.left[n], self.right[n] = a, b
                    break

    def _made(self, n: int) -> bool:
        return self.lengths[n] == 1 or self.left[n] != n

    def apart(self, a: np.ndarray, b: np.ndarray, limit: int | None = None) -> np.ndarray:
        """Whether ``a`` and ``b`` stay two pieces side by side; up to the merge ``limit`` if it is given.

        The later of the two is undone, down to the characters at the seam; a pair there that
        merges before the last one undone would have won. Of equal merges the left one comes first.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        bound = np.full(len(a), len(self.pieces) + 1 if limit is None else limit, np.int64)
        while len(live):
            clash = self.merged(a, b) < bound
            out[live[clash]] = False
            single_a, single_b = self.lengths[a] == 1, self.lengths[b] == 1
            keep = ~clash & ~(single_a & single_b)
            live, a, b = live[keep], a[keep], b[keep]
            # The one with the higher number came later; a character can't be undone.
            first = (a > b) & (self.lengths[a] > 1) | (self.lengths[b] == 1)
            bound = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    # --- encoding -----------------------------------------------------------------------

    def merge(self, cut: str) -> bytes:
        """The ids of one cut by merging its pairs, the highest score first and the left one of equals.

        For runs of word marks only: their pieces share a score, so that no fixed order of merges
        is theirs, as relaxing needs it.
        """
        parts: list[str | None] = list(cut)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (score := self.scores.get(pair := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score, a, b, pair))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, pair = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != pair:
                continue
            parts[a], parts[b], after[a] = pair, None, after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        ids: list[int] = []
        for part in parts:
            if part in self.number:
                ids.append(int(self.ids[self.number[part]]))
            elif part is not None:
                ids.extend(self.bytes[list(part.encode("utf-8", "replace"))].tolist())
        return np.array(ids, "<u4").tobytes()

    def encode_cuts(self, cuts: list[str]) -> list[bytes]:
        """The ids of each cut (none of them empty), as little-endian 32-bit numbers."""
        lengths = np.array([len(c) for c in cuts])
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        line = np.frombuffer(("\0".join(cuts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        # A zero character of a text is no separator; it has no piece either.
        line = np.where(line == 0, 0xFFFFFFFE, line)
        line[starts + lengths] = 0
        edges = self._edges(line)
        last = self._relax(line, starts, lengths, *edges)
        # Walk back from each end in step.
        chosen = np.zeros(len(line) + 1, bool)
        at, least = starts + lengths, starts
        while len(at):
            chosen[at] = True
            at = at - np.where(last[at] < 0, 1, self.lengths[last[at]])
            go = at > least
            at, least = at[go], least[go]
        ends = np.flatnonzero(chosen)
        owner = np.searchsorted(starts, ends - 1, "right") - 1
        return self._ids(line, last, ends, owner, len(cuts))

    def _edges(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, piece) of all occurrences, by end and the longest first, and where each end's begin."""
        order = suffix_array(line, self.depth)
        padded = np.concatenate([line, np.zeros(self.depth, line.dtype)]).astype(">u4")
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)
        keys = np.ascontiguousarray(windows[order]).view(f"S{4 * self.depth}").ravel()
        # What follows a separator must not count: shorter suffixes would sort by another cut's text,
        # which is fine, as no piece holds the separator.
        low = np.searchsorted(keys, self.lower, "left")
        many = np.searchsorted(keys, self.upper, "right") - low
        hit = np.flatnonzero(many > 0)
        n = many[hit]
        at = order[np.repeat(low[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        piece = np.repeat(self.searched[hit], n)
        end = at + self.lengths[piece]
        sort = np.lexsort((-self.lengths[piece], end))
        end, piece = end[sort], piece[sort]
        return end, piece, np.searchsorted(end, np.arange(len(line) + 2))

    def _relax(self, line: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
               end: np.ndarray, piece: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The last piece of the encoding up to each position; -1 for a character without a piece."""
        last = np.full(len(line) + 1, -1, np.int64)
        begins = np.zeros(len(line) + 1, bool)
        begins[starts] = True
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        for offset in range(1, int(lengths.max(initial=0)) + 1):
            at = starts[:np.searchsorted(-lengths, -offset, "right")] + offset
            edge, stop = first[at], first[at + 1]
            while len(at):
                some = edge < stop
                at, edge, stop = at[some], edge[some], stop[some]
                new = piece[edge]
                start = at - self.lengths[new]
                before = last[start]
                free = begins[start] | (before < 0)
                fits = free.copy()
                check = np.flatnonzero(~free)
                fits[check] = self.apart(before[check], new[check])
                last[at[fits]] = new[fits]
                at, edge, stop = at[~fits], edge[~fits] + 1, stop[~fits]
        return last

    def _ids(self, line: np.ndarray, last: np.ndarray, ends: np.ndarray, owner: np.ndarray, many: int) -> list[bytes]:
        found = last[ends]
        points = np.where(found < 0, line[ends - 1], 0)
        points = np.where(points == 0xFFFFFFFE, 0, points)
        utf8 = [chr(x).encode("utf-8", "replace") for x in points[found < 0].tolist()]
        sizes = np.ones(len(found), np.int64)
        sizes[found < 0] = [len(x) for x in utf8]
        ids = np.repeat(self.ids[found], sizes)
        ids[np.repeat(found < 0, sizes)] = self.bytes[np.frombuffer(b"".join(utf8), np.uint8)]
        data = ids.astype("<u4").tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(owner, np.arange(many + 1))] * 4
        return [data[a:b] for a, b in pairwise(at.tolist())]

    def decode(self, ids) -> str:
        """Text of pieces; a space from the front is the one that encoding puts there."""
        text = b"".join([self.text.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def vocabulary(name: str) -> Vocabulary:
    return alone(f"vocabulary {name}", lambda: Vocabulary(name))


#: No piece goes from a letter to one of these signs.
_LETTERS, _SIGNS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", ".,;:!?"
_CUT = re.compile(rf"\n|{MARK}*[{_LETTERS}]+(?=[{_SIGNS}])|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def cuts_of(text: str) -> list[str]:
    """Parts of a text that are encoded one by one; blanks are word marks, and one comes first."""
    return _CUT.findall(MARK + text.replace(" ", MARK)) if text else []


class Memory(Remembered):
    """The ids of cuts as bytes."""

    def __init__(self, name: str) -> None:
        super().__init__(REMEMBERED)
        self.vocabulary = vocabulary(name)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [cuts_of(t) for t in texts]
        own: dict[str, bytes] = {}
        some, size = [], 0

        def settle() -> None:
            for text, ids in zip(some, self.vocabulary.encode_cuts(some), strict=True):
                (self if len(text) <= LONG else own)[text] = ids

        for text in self.new(set().union(*cut)):
            if text.startswith(MARK * 3):
                (self if len(text) <= LONG else own)[text] = self.vocabulary.merge(text)
                continue
            some.append(text)
            size += len(text) + 1
            if size >= AT_ONCE:
                settle()
                some, size = [], 0
        if some:
            settle()
        if own:
            return [b"".join([self[c] if c in self else own[c] for c in cuts]) for cuts in cut]
        return [b"".join(map(self.__getitem__, cuts)) for cuts in cut]


def memory(name: str) -> Memory:
    """One memory for all tasks of a worker process."""
    return alone(f"pieces {name}", lambda: Memory(name))


def encode(docs: DataFrame, name: str, text: str = "text", to: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each whole text in an array column ``to``.

    Null and empty texts have an empty array. Repeated rows are rows like any other. An
    empty table gives none. A column called ``to`` is replaced; other columns stay.
    """
    columns = [c for c in docs.columns if c != to]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = memory(name)
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                ids = found.encode(texts)
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], ["row", "ids"])
                at += len(texts)

    return rows.mapInArrow(of, rows.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))).select("row.*", F.col("ids").alias(to))


def _groups(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def decode(rows: DataFrame, name: str, ids: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids in a column ``to``; null ids are a null text, ids without a piece nothing."""
    columns = [c for c in rows.columns if c != to]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(ids).cast("array<int>").alias("ids"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(name)
        for batch in batches:
            texts = [None if (x := v.as_py()) is None else found.decode(x) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    return packed.mapInArrow(of, packed.select("row").schema.add("decoded", "string")).select(
        "row.*", F.col("decoded").alias(to))


def coded(docs: DataFrame, name: str, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` with n_pieces, piece_ids and round_trip: encoded, decoded and compared in one pass.

    The texts do not come back from the workers. Null and empty texts have an empty array, which gives them back.
    Repeated rows are rows like any other, and an empty table gives none.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = memory(name)
        back = found.vocabulary.decode
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                ids = found.encode(texts)
                sizes = [len(x) // 4 for x in ids]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), np.frombuffer(b"".join(ids), "<i4"))
                same = [back(np.frombuffer(x, "<u4").tolist()) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int32()), lists, pa.array(same)],
                    ["row", "n_pieces", "piece_ids", "round_trip"])
                at += len(texts)

    schema = (rows.select("row").schema.add("n_pieces", "integer").add("piece_ids", T.ArrayType(T.IntegerType()))
              .add("round_trip", "boolean"))
    return rows.mapInArrow(of, schema).select("row.*", "n_pieces", "piece_ids", "round_trip")


def digests(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_pieces, ids_crc32, round_trip) of every row: encoded, decoded and compared in one pass."""
    kind = docs.schema[key].dataType.simpleString()
    thin = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = memory(name)
        back = found.vocabulary.decode
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                ids = found.encode(texts)
                same = [back(np.frombuffer(x, "<u4").tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64()),
                     pa.array(same)], ["key", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])
                at += len(texts)

    return thin.mapInArrow(of, f"key {kind}, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean").withColumnRenamed("key", key)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLES: dict[str, str] = {}
