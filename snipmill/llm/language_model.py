"""Language model scores by a log-bilinear model, trained with noise-contrastive estimation.

Words are lower-cased runs without ASCII white space; an end closes each text. The most
frequent words are symbols of the model, and so is each class of the others, a class
being the words with the same hash of their last bytes. Every word with ``LEAST`` occurrences has vectors
of its own, so the model grows with the corpus; the rarer words of a class stand as one word.
The model predicts a symbol from the two words before it: the product of their vectors,
weighted by position, with the symbol's own; then the word within its class in the same way.
A class with many words is cut into groups, each with the mean of its words' vectors: the model predicts the group
in the class, then the word in its group, so that sums grow with the square root of the words. A rarer word gets
its smoothed share of the rest of its class.

Counts and training go over all documents outside the held-out tenth. In a round each task
trains on its share, from the same start, and the results are averaged by tokens. Shares are
so large that their models together take less room than the symbols they learn from. Noise
comes from the symbol counts and is shared by a batch, so that scores are matrix products.
The sums that normalise are exact: over all symbols, over the groups of a class, and over the words of
one class or group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipmill.llm.common import frequent_from, staged, table

#: Frequent words of the model, classes of the others, and length of vectors.
WORDS, CLASSES, WIDTH = 448, 64, 16
SYMBOLS = WORDS + CLASSES
#: Words from this count on have vectors of their own, however many they are.
LEAST = 50
#: Words whose counts are broadcast; the rest, unless it has vectors, is joined by shuffle.
HEAD = 200_000
#: Words of a class, its rest among them, from which on they are cut into groups, about as many as a group has words.
LARGE = 256
#: Numbers of a model that travel in one row, and of scores held at once.
BLOCK, SCORES = 1 << 14, 1 << 16
#: Scores up to which no maximum is taken out before the exponentials are summed.
SAFE = 60.0
#: Symbols of texts that a task trains on or scores at once, and characters of those it turns into symbols; a text stays whole.
AT_ONCE, CHARS = 1 << 20, 1 << 21
#: Symbols whose probabilities are found together; contexts that occur twice among them are normalised once.
TOGETHER = 1 << 19
#: Words of which a task keeps the exponentials of their scores with all symbols.
KEPT = 8192
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000
#: Smoothing of counts, rounds of training, tokens of a step, noise symbols of a step, step size.
ADD, ROUNDS, STEP, NOISE, RATE = 0.1, 2, 4096, 48, 0.15
#: What the histories of vectors that move by single occurrences begin with.
PAST = {"context": 1e2, "fine": 1e2, "fine_bias": 1e4}
#: Bytes of symbols that a share of the training has at least for each byte of the model that it passes on.
SHARE = 2
#: The end of a text, also in front of its first word; no word is empty.
END = b""


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?")[-2:]) % CLASSES


def classes_of(words: pa.Array) -> np.ndarray:
    """``class_of`` of all ``words``; there are few different ends."""
    ends = pc.binary_slice(pc.ascii_rtrim(words.view(pa.string()), ".,;:!?").view(pa.binary()), -2, None).dictionary_encode()
    return np.array([class_of(x) for x in ends.dictionary.to_pylist()], np.int32)[ends.indices.to_numpy()]


def held_out(key: str):
    """Whether crc32 of the key as text leaves 0 by 10; a null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def parts(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, some at a time: as many as have ``size`` bytes in ``column``, and one at least.

    A batch has thousands of rows whatever their length; what a task makes of it at once is many times its bytes.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """``words_of`` of all ``texts``, one after the other, by number of distinct words, and how many each text has."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = pc.ascii_split_whitespace(texts)
    sizes, empty = pc.list_value_length(found).to_numpy(), pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    words = found.flatten()
    if empty.any():  # one empty word each
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    return words.cast(pa.binary()).dictionary_encode(), np.where(empty, 0, sizes)


def counts_of(docs: DataFrame) -> DataFrame:
    """(word, class, n) of all words and ends of ``text``; a task passes sums on, not occurrences."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out(least: int) -> Iterator[pa.RecordBatch]:
            """What is held as one, which is passed on if that is more than ``least`` rows."""
            nonlocal held, rows
            one = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])
            held, rows = [one], one.num_rows
            if rows > least:
                word = one.column("word").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [word, pa.array(classes_of(word)), one.column("n").combine_chunks()], ["word", "class", "n"])
                held, rows = [], 0

        for batch in parts(batches, 0, 4 * CHARS):
            words, sizes = cut_words(batch.column(0))
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            held += [pa.table({"word": words.dictionary, "n": n}),
                     pa.table({"word": pa.array([END], pa.binary()), "n": np.array([len(sizes)])})]
            rows += len(n)
            if rows > 2 * HELD:
                yield from out(HELD)
        if held:
            yield from out(0)

    return docs.select("text").mapInArrow(of, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Lexicon:
    """What scoring needs of the counts: totals, and the frequent words with their numbers."""

    total: int
    distinct: int
    place: dict[bytes, int]
    number: np.ndarray
    base: np.ndarray
    within: np.ndarray
    log_noise: np.ndarray
    #: The words with vectors, WORDS at least; the rests of classes are numbered after them.
    vocabulary: int
    #: The symbol of each number, and the noise of those after WORDS.
    symbol: np.ndarray
    log_fine: np.ndarray
    end: int


def lexicon(counts: DataFrame) -> tuple[Lexicon, int, np.ndarray]:
    """The lexicon, the count from which words are in it, and the base of each class's shares."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cut = min(frequent_from(counts, HEAD), LEAST)
    # At most HEAD rows, the end, and the words that have vectors.
    head = counts.where((F.col("n") >= cut) | (F.length("word") == 0)).toArrow()
    words, classes, n = head.column("word").to_pylist(), head.column("class").to_numpy(), head.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (words[i] != END, -n[i], words[i]))
    words, classes, n = [words[i] for i in order], classes[order].astype(int), n[order].astype(float)
    vocabulary = max(WORDS, int((n >= LEAST).sum()) + bool(len(n) and n[0] < LEAST))  # the end is always one
    number = np.where(np.arange(len(words)) < vocabulary, np.arange(len(words)), vocabulary + classes)
    symbol = np.concatenate([np.arange(WORDS), WORDS + classes[WORDS:vocabulary], WORDS + np.arange(CLASSES)])
    of_class = np.zeros((CLASSES, 2))
    for c, tokens, kinds in counts.groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        of_class[c] = tokens, kinds
    for c, tokens in zip(classes[:WORDS], n[:WORDS], strict=True):
        of_class[c] -= tokens, 1
    noise = np.concatenate([np.pad(n[:WORDS], (0, WORDS - len(n[:WORDS]))), of_class[:, 0]]) + 1.0
    for c, tokens in zip(classes[WORDS:vocabulary], n[WORDS:vocabulary], strict=True):
        of_class[c] -= tokens, 1
    share = of_class[:, 0] + ADD * (of_class[:, 1] + 1)
    fine = np.concatenate([n[WORDS:vocabulary], share])
    return Lexicon(
        total, distinct, {w: i for i, w in enumerate(words)}, number,
        np.log10((n + ADD) / (total + ADD * (distinct + 1))),
        np.where(number < vocabulary, 0.0, np.log10((n + ADD) / share[classes])) if len(words) else np.zeros(0),
        np.log(noise / noise.sum()), vocabulary, symbol, np.log(fine / fine.sum()), 0), cut, share


def symbols_of(docs: DataFrame, shared) -> DataFrame:
    """Each document as numbers of words and rests of classes, with what the frequent words add, and its other words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        row = TaskContext.get().partitionId() << 33  # one attempt of each partition counts
        frequent = pa.array(list(lex.place), pa.binary())
        for batch in parts(batches, 2, 2 * CHARS):
            words, sizes = cut_words(batch.column(2))
            kind, texts = words.indices.to_numpy(), batch.num_rows
            of_text = np.repeat(np.arange(texts), sizes)
            kinds = words.dictionary
            place = pc.fill_null(pc.index_in(kinds, value_set=frequent), -1).to_numpy()
            classes = classes_of(kinds)
            number, base, within = np.empty(len(kinds), np.int64), np.zeros(len(kinds)), np.zeros(len(kinds))
            known, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            number[known], base[known], within[known] = lex.number[place[known]], lex.base[place[known]], lex.within[place[known]]
            number[rare] = lex.vocabulary + classes[rare]
            end = len(lex.number) > 0
            # Each text's numbers, and the end.
            stops = np.cumsum(sizes + 1)
            symbols = np.empty(len(kind) + texts, "<u4")
            symbols[stops - 1] = lex.end
            among = np.ones(len(symbols), bool)
            among[stops - 1] = False
            symbols[among] = number[kind]
            # Each text's other words, and how often it has them.
            is_rare = place[kind] < 0
            pairs, freqs = np.unique(of_text[is_rare] * len(kinds) + kind[is_rare], return_counts=True)
            other = pairs % max(1, len(kinds))
            lists = pa.array(np.searchsorted(pairs, np.arange(texts + 1) * len(kinds)), pa.int32())
            total = lambda x: np.bincount(of_text, x[kind], texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.arange(row + 1, row + texts + 1)), pa.array(sizes.astype(np.int64) + 1),
                 pa.array(total(place >= 0).astype(np.int64) + end), pa.array(total(base) + (lex.base[0] if end else 0)),
                 pa.array(total(within)),
                 pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(np.append(0, 4 * stops).astype(np.int32)), pa.py_buffer(symbols)]),
                 pa.ListArray.from_arrays(lists, kinds.take(pa.array(other))),
                 pa.ListArray.from_arrays(lists, pa.array(classes[other], pa.int32())),
                 pa.ListArray.from_arrays(lists, pa.array(freqs, pa.int32()))],
                ["key", "held_out", "row", "n_tokens", "known", "base", "within", "symbols", "words", "classes", "freqs"])
            row += texts

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "held_out", "text").mapInArrow(
        of, f"key {kind}, held_out boolean, row long, n_tokens long, known long, base double, within double, "
            "symbols binary, words array<binary>, classes array<int>, freqs array<int>")


# --- the model --------------------------------------------------------------------------

NAMES = ("context", "target", "position", "bias", "fine", "fine_bias")


@dataclass
class Model:
    """Vectors of words as context and of symbols as target, weights of the two positions, and biases.

    ``fine`` has the vectors of the words after WORDS and of the rests of classes as targets within their class.
    """

    context: np.ndarray
    target: np.ndarray
    position: np.ndarray
    bias: np.ndarray
    fine: np.ndarray
    fine_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in NAMES])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        # A context for each word, a fine vector and a fine bias for all but WORDS of them.
        known = (len(flat) - SYMBOLS * (WIDTH + 1) - 2 * WIDTH + WORDS * (WIDTH + 1)) // (2 * WIDTH + 1)
        cuts = np.cumsum([known * WIDTH, SYMBOLS * WIDTH, 2 * WIDTH, SYMBOLS, (known - WORDS) * WIDTH])
        a, b, c, d, e, f = np.split(np.asarray(flat, np.float32), cuts)
        return Model(a.reshape(-1, WIDTH), b.reshape(SYMBOLS, WIDTH), c.reshape(2, WIDTH), d, e.reshape(-1, WIDTH), f)

    def hidden(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = self.context.take(before, axis=0)
        out *= self.position[0]
        more = self.context.take(last, axis=0)
        more *= self.position[1]
        out += more
        return out

    def normaliser(self) -> np.ndarray:
        """Logarithm of the sum over all symbols, for every pair of the first SYMBOLS words."""
        everyone = np.arange(SYMBOLS)
        return np.stack([log_sum(self.hidden(np.full(SYMBOLS, x), everyone), self.target, self.bias) for x in everyone])


def log_sum(hidden: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of all scores, for each row of ``hidden``."""
    out = np.empty(len(hidden), np.float32)
    # The bias is one more number of each vector; a block of scores stays in the cache and in one piece of memory.
    wide = np.concatenate([target, bias[:, None]], axis=1, dtype=np.float32).T.copy()
    rows = max(1, min(len(hidden), SCORES // max(1, len(bias))))
    block, room, ones = np.ones((rows, wide.shape[0]), np.float32), np.empty((rows, len(bias)), np.float32), np.ones(len(bias), np.float32)
    # No score is beyond this; up to there exponentials and their sums are numbers as they are.
    steep = np.sqrt(np.einsum("ij,ij->i", target, target).max(initial=0)), np.abs(bias).max(initial=0)
    for at in range(0, len(hidden), rows):
        own = hidden[at:at + rows]
        block[:len(own), :-1] = own
        scores = np.matmul(block[:len(own)], wide, out=room[:len(own)])
        if np.sqrt(np.einsum("ij,ij->i", own, own).max()) * steep[0] + steep[1] < SAFE:
            out[at:at + rows] = np.log(np.exp(scores, out=scores) @ ones)
        else:
            top = scores.max(axis=1)
            scores -= top[:, None]
            out[at:at + rows] = top + np.log(np.exp(scores, out=scores) @ ones)
    return out


def start(log_noise: np.ndarray, symbol: np.ndarray | None = None, log_fine: np.ndarray | None = None) -> Model:
    """Random vectors, those of a class alike; the biases are the noise, so the first model is the symbol counts."""
    random = np.random.default_rng(11)
    draw = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
    symbol = np.arange(SYMBOLS) if symbol is None else symbol
    log_fine = np.full(len(symbol) - WORDS, -np.log(len(symbol) - WORDS)) if log_fine is None else log_fine
    return Model(draw(SYMBOLS, WIDTH)[symbol], draw(SYMBOLS, WIDTH), np.array([[0.5], [1.0]], np.float32).repeat(WIDTH, 1),
                 log_noise.astype(np.float32), np.zeros((len(log_fine), WIDTH), np.float32), log_fine.astype(np.float32))


def triples(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(second last, last, next) of every symbol; ends stand before the first."""
    pad = np.array([end, end], np.int32)
    line = np.concatenate([x for t in texts for x in (pad, t.view(np.int32))])
    sizes = np.array([len(t) + 2 for t in texts])
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(line), bool)
    keep[starts] = keep[starts + 1] = False
    return line[:-2][keep[2:]], line[1:-1][keep[2:]], line[2:][keep[2:]]


class Trainer:
    """Noise-contrastive steps with step sizes that shrink by each number's own history."""

    def __init__(self, model: Model, log_noise: np.ndarray, seed: int, symbol: np.ndarray | None = None,
                 log_fine: np.ndarray | None = None) -> None:
        self.model = model
        self.random = np.random.default_rng(seed)
        self.symbol = (np.arange(SYMBOLS) if symbol is None else symbol).astype(np.uint16)
        self.log_noise = log_noise.astype(np.float32)
        self.cumulated = np.cumsum(np.exp(log_noise))
        self.log_fine = model.fine_bias.copy() if log_fine is None else log_fine.astype(np.float32)
        self.cumulated_fine = np.cumsum(np.exp(self.log_fine.astype(float)))
        self.past = {name: np.full_like(getattr(model, name), PAST.get(name, 1e-2)) for name in NAMES}
        self.room, self.ones = np.empty((STEP // 4, NOISE), np.float32), np.ones(STEP // 4, np.float32)

    def _move(self, name: str, gradient: np.ndarray) -> None:
        past, value = self.past[name], getattr(self.model, name)
        past += gradient * gradient
        value += RATE * gradient / np.sqrt(past)

    def _move_rows(self, index: np.ndarray, **rows: np.ndarray) -> None:
        """As ``_move`` for the rows that occur: a rare word moves by its own occurrences, whatever the step's size."""
        order, starts, found = _equal(index)
        for name, x in rows.items():
            gradient = _sums(x.take(order, axis=0), starts)
            past, value = self.past[name], getattr(self.model, name)
            history = past.take(found, axis=0)
            history += gradient * gradient
            past[found] = history
            gradient *= np.float32(RATE)
            gradient /= np.sqrt(history, out=history)
            gradient += value.take(found, axis=0)
            value[found] = gradient

    def _contrast(self, hidden, nxt, target, bias, log_noise, cumulated):
        """Noise symbols, how much the true ones rise, the noise and its vectors fall, and what moves ``hidden``."""
        noise = np.minimum(np.searchsorted(cumulated, self.random.random(NOISE)), len(bias) - 1)
        right, wrong, log_k = target.take(nxt, axis=0), target.take(noise, axis=0), np.float32(np.log(NOISE))
        true = np.einsum("ij,ij->i", hidden, right)
        true += bias.take(nxt)
        true -= log_noise.take(nxt)
        true -= log_k
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
        right *= up[:, None]
        fall, fall_rows = np.zeros(NOISE, np.float32), np.zeros((NOISE, WIDTH), np.float32)
        minus, more = -wrong.T, bias[noise] - log_noise[noise] - log_k
        for at in range(0, len(nxt), len(self.room)):
            own = hidden[at:at + len(self.room)]
            # 1 / (1 + exp(-score)) for the noise, in a piece of memory that stays in the cache.
            down = np.matmul(own, minus, out=self.room[:len(own)])
            down -= more
            np.minimum(down, 30, out=down)
            np.exp(down, out=down)
            down += 1
            np.reciprocal(down, out=down)
            fall += self.ones[:len(own)] @ down
            fall_rows += down.T @ own
            right[at:at + len(own)] -= down @ wrong
        return noise, up, fall, fall_rows, right

    def step(self, before: np.ndarray, last: np.ndarray, nxt: np.ndarray) -> None:
        m, size = self.model, len(nxt)
        symbol = self.symbol.take(nxt)
        order = symbol.argsort(kind="stable")  # a step sums over all; those with classes come last
        symbol, before, last, nxt = symbol.take(order), before.take(order), last.take(order), nxt.take(order)
        starts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        context_0, context_1 = m.context.take(before, axis=0), m.context.take(last, axis=0)
        hidden = context_0 * m.position[0]
        hidden += context_1 * m.position[1]
        noise, up, fall, fall_rows, to_hidden = self._contrast(hidden, symbol, m.target, m.bias, self.log_noise, self.cumulated)
        to_target, to_bias = np.zeros_like(m.target), np.zeros_like(m.bias)
        to_target[symbol[starts]] = _sums(up[:, None] * hidden, starts)
        to_bias[symbol[starts]] = _sums(up, starts)
        np.subtract.at(to_target, noise, fall_rows)
        np.subtract.at(to_bias, noise, fall)
        inside = int(np.searchsorted(symbol, WORDS))
        if inside < size:
            # Contrasted with all words after WORDS: what is right up to a factor is right within a class.
            own, word = hidden[inside:], nxt[inside:] - WORDS
            noise, up, fall, fall_rows, more = self._contrast(own, word, m.fine, m.fine_bias, self.log_fine, self.cumulated_fine)
            to_hidden[inside:] += more
            self._move_rows(np.concatenate([word, noise]), fine=np.concatenate([up[:, None] * own, -fall_rows]),
                            fine_bias=np.concatenate([up, -fall]))
        to_position = np.stack([np.einsum("ij,ij->j", to_hidden, context_0), np.einsum("ij,ij->j", to_hidden, context_1)])
        self._move_rows(np.concatenate([before, last]),
                        context=np.concatenate([to_hidden * m.position[0], to_hidden * m.position[1]]))
        for name, gradient in (("target", to_target), ("bias", to_bias), ("position", to_position)):
            self._move(name, gradient / np.float32(size))


def _equal(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of ``index`` by value, where each value starts among them, and the values."""
    bits = max(1, len(index)).bit_length()
    keys = index.astype(np.int64) << bits
    keys |= np.arange(len(index))
    keys.sort()
    own = keys >> bits
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    keys &= (1 << bits) - 1
    return keys, starts, own.take(starts)


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows added up from each start to the next; two numbers of a row are added as one complex number."""
    if rows.ndim == 1:
        return np.add.reduceat(rows, starts)
    return np.add.reduceat(rows.view(np.complex64), starts, axis=0).view(np.float32)


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in column]


def shares(tokens: int, numbers: int) -> int:
    """Into how many shares ``tokens`` symbols may be cut, for a model of so many numbers; both take four bytes."""
    return max(1, tokens // (SHARE * numbers))


def train(symbols: DataFrame, lex_shared) -> Model:
    """Rounds of training on all rows of ``symbols``; a task gives its model as blocks of numbers with its tokens."""
    spark = symbols.sparkSession
    lex = lex_shared.value
    model = start(lex.log_noise, lex.symbol, lex.log_fine)
    # Each share passes a whole model on, and there are more and larger ones for a larger table if each task is a share.
    learnt = symbols.select("symbols").coalesce(shares(lex.total, len(model.flat())))
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.flat())

        def of(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            lex = lex_shared.value
            trainer = Trainer(Model.of(shared.value.copy()), lex.log_noise, 1000 * number + TaskContext.get().partitionId(),
                              lex.symbol, lex.log_fine)
            seen = 0
            for batch in parts(batches, 0, 4 * AT_ONCE):
                if not batch.num_rows:
                    continue
                data = triples(_texts(batch.column(0)), lex.end)
                order = trainer.random.permutation(len(data[0]))
                for at in range(0, len(order), STEP):
                    trainer.step(*(x.take(order[at:at + STEP]) for x in data))
                seen += len(order)
            if seen:
                flat = trainer.model.flat()
                cuts = range(0, len(flat), BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(cuts)), pa.int64()), pa.array([flat[c:c + BLOCK].tobytes() for c in cuts], pa.binary()),
                     pa.array([seen] * len(cuts), pa.int64())], ["i", "x", "n"])

        def mean(t: pa.Table) -> pa.Table:
            n = t.column("n").to_numpy().astype(float)
            x = np.stack([np.frombuffer(v.as_buffer(), np.float32) for v in t.column("x")])
            return pa.table({"i": t.column("i")[:1], "x": pa.array([((n / n.sum()) @ x).astype(np.float32).tobytes()], pa.binary())})

        rows = learnt.mapInArrow(of, "i long, x binary, n long").groupBy("i").applyInArrow(
            mean, "i long, x binary").collect()  # the model, in blocks
        if rows:
            model = Model.of(np.concatenate([np.frombuffer(r.x, np.float32) for r in sorted(rows, key=lambda r: r.i)]))
    return model


def groups_of(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each number after WORDS, or -1 in a class that is not cut, and the class of each group.

    Words of one group are about equally frequent. The rest of a class, its last number, is a group of its own.
    """
    members = np.argsort(symbol[WORDS:], kind="stable")
    cuts = np.searchsorted(symbol[WORDS:][members], np.arange(WORDS, SYMBOLS + 1))
    group, of = np.full(len(members), -1, np.int32), []
    for c in range(CLASSES):
        own = members[cuts[c]:cuts[c + 1]]
        if len(own) >= LARGE:
            at = np.arange(len(own)) // int(np.ceil(np.sqrt(len(own))))
            at[-1] = at[-2] + 1
            group[own] = len(of) + at
            of += [c] * int(at[-1] + 1)
    return group, np.array(of, np.int32)


class Probabilities:
    """Natural logarithms of the probabilities of numbers: of the symbol, the group in its class, the word in its group or class."""

    def __init__(self, model: Model, symbol: np.ndarray) -> None:
        self.model, self.symbol = model, symbol.astype(np.uint16)
        # The exponential of a sum is a product, so two frequent words need none of their own.
        first, second = (model.context[:KEPT] * x for x in model.position)
        norm = lambda x: np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0))
        safe = (norm(first) + norm(second)) * norm(model.target) + np.abs(model.bias).max() < SAFE
        self.kept = len(first) if safe else 0
        self.first, self.second = (np.exp(x[:self.kept] @ model.target.T + y) for x, y in ((first, model.bias), (second, np.float32(0))))
        group, of = groups_of(symbol)
        # A word lies in a group, or in a class that is not cut.
        cell = np.where(group < 0, len(of) + symbol[WORDS:] - WORDS, group)
        fine = _Level(model.fine, model.fine_bias, cell, len(of) + CLASSES)
        self.levels = [(fine, cell, np.arange(len(cell)))]
        if len(of):
            mean, bias = fine.means(len(of))
            self.levels.append((_Level(mean, bias, of, CLASSES), np.append(of, -1)[group], group))

    def __call__(self, before: np.ndarray, last: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        model = self.model
        hidden, of = model.hidden(before, last), self.symbol.take(nxt)
        out = np.einsum("ij,ij->i", hidden, model.target.take(of, axis=0))
        out += model.bias.take(of)
        # Contexts that are equal have equal sums.
        order, starts, _ = _equal(before.astype(np.int64) * len(self.symbol) + last)
        one = order.take(starts)
        sums = self.sums(hidden, before, last, one)
        out[order] -= sums.repeat(np.diff(starts, append=len(order)))
        inside = np.flatnonzero(nxt >= WORDS)
        word = nxt.take(inside) - WORDS
        for level, cell, own in self.levels:
            among = cell.take(word)
            at = np.flatnonzero((among >= 0) & level.several.take(among))
            if len(at):
                out[inside.take(at)] += level(hidden.take(inside.take(at), axis=0), among.take(at), own.take(word.take(at)))
        return out

    def sums(self, hidden: np.ndarray, before: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all symbols, for rows ``at``."""
        out = np.empty(len(at), np.float32)
        first, second = before.take(at), last.take(at)
        both = (first < self.kept) & (second < self.kept)
        near, far = np.flatnonzero(both), np.flatnonzero(~both)
        first, second = first.take(near), second.take(near)
        for x in range(0, len(near), SCORES // SYMBOLS):
            y = slice(x, x + SCORES // SYMBOLS)
            out[near[y]] = np.einsum("ij,ij->i", self.first.take(first[y], axis=0), self.second.take(second[y], axis=0))
        out[near] = np.log(out[near])
        if len(far):
            out[far] = log_sum(hidden.take(at.take(far), axis=0), self.model.target, self.model.bias)
        return out


class _Level:
    """Softmax over the rows of ``target`` that lie in one cell."""

    def __init__(self, target: np.ndarray, bias: np.ndarray, cell: np.ndarray, cells: int) -> None:
        self.order = np.argsort(cell, kind="stable")
        self.cuts = np.searchsorted(cell[self.order], np.arange(cells + 1))
        self.several = np.diff(self.cuts) > 1
        self.target, self.bias, self.by_cell, self.bias_by_cell = target, bias, target[self.order], bias[self.order]

    def means(self, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """For the first ``cells``, none of which is empty: the mean of the vectors by exponentials of biases, and the logarithm of these' sum."""
        starts, stop = self.cuts[:cells], self.cuts[cells]
        top = self.bias_by_cell[:stop].max()
        weight = np.exp(self.bias_by_cell[:stop].astype(float) - top)
        sums = np.add.reduceat(weight, starts)
        mean = np.add.reduceat(weight[:, None] * self.by_cell[:stop], starts, axis=0) / sums[:, None]
        return mean.astype(np.float32), (np.log(sums) + top).astype(np.float32)

    def __call__(self, hidden: np.ndarray, cell: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each row of ``hidden``: logarithm of the share that row ``own`` of ``target`` has in its ``cell``."""
        order, starts, found = _equal(cell)
        hidden, own = hidden.take(order, axis=0), own.take(order)
        value = np.einsum("ij,ij->i", hidden, self.target.take(own, axis=0))
        value += self.bias.take(own)
        for c, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            x, y = self.cuts[c], self.cuts[c + 1]
            value[a:b] -= log_sum(hidden[a:b], self.by_cell[x:y], self.bias_by_cell[x:y])
        out = np.empty_like(value)
        out[order] = value
        return out


def log_probabilities(before: np.ndarray, last: np.ndarray, nxt: np.ndarray, model: Model, symbol: np.ndarray) -> np.ndarray:
    return Probabilities(model, symbol)(before, last, nxt)


def score_texts(texts: list[np.ndarray], found: Probabilities, end: int) -> np.ndarray:
    """Logarithm to base 10 of the probability of the words and rests of classes of each text."""
    before, last, nxt = triples(texts, end)
    values = np.empty(len(nxt))
    for at in range(0, len(nxt), TOGETHER):
        values[at:at + TOGETHER] = found(*(v[at:at + TOGETHER] for v in (before, last, nxt)))
    sizes = np.array([len(t) for t in texts])
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) / np.log(10)


def language_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Null and empty texts are an end alone. Rows with a null key are learned from; rows that repeat a
    key are scored one by one. An empty table gives none. With nothing to learn from all counts are 0. Other
    columns are not read.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("held_out", held_out("key"))
    counts = staged(counts_of(thin.where(~F.col("held_out"))), "word-counts")
    lex, cut, share = lexicon(counts)
    lex_shared = spark.sparkContext.broadcast(lex)  # HEAD words, or those with vectors
    symbols = staged(symbols_of(thin, lex_shared), "symbols")
    model = train(symbols.where(~F.col("held_out")), lex_shared)
    shared = spark.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lex_shared.value
        found = Probabilities(shared.value, lex.symbol)
        for batch in parts(batches, 1, 4 * AT_ONCE):
            if batch.num_rows:
                values = score_texts(_texts(batch.column(1)), found, lex.end)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["row", "model"])

    by_row = staged(symbols.select("row", "symbols").mapInArrow(of, "row long, model double"), "model-scores")
    rare = symbols.select("row", F.explode(F.arrays_zip("words", "classes", "freqs")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.classes").alias("class"), F.col("w.freqs").alias("freq"))
    tail = counts.where((F.col("n") < cut) & (F.length("word") > 0)).select("word", "n")
    classes = spark.createDataFrame([(c, float(x)) for c, x in enumerate(share)], "class int, share double")
    # Words that no training text has are not in the counts.
    joined = rare.join(tail, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = joined.join(F.broadcast(classes), "class").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("freq")).otherwise(0)).alias("more_known"),
        F.sum(F.col("freq") * F.log10((F.col("n") + ADD) / (lex.total + ADD * (lex.distinct + 1)))).alias("more_base"),
        F.sum(F.col("freq") * F.log10((F.col("n") + ADD) / F.col("share"))).alias("more_within"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return symbols.select("row", "key", "held_out", "n_tokens", "known", "base", "within").join(by_row, "row").join(
        sums, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"),
        (F.col("model") + F.col("within") + zero("more_within")).alias("score"))


def op5_language_model(spark, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op5_language_model": op5_language_model}
ORACLES: dict[str, str] = {}
