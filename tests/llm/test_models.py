"""Embeddings, toxicity and the language model against brute force or held-out rows."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from snipmill.llm import embedding_pairs, language_model, toxicity
from snipmill.llm.common import Forest

VECTORS = "vec_id long, embedding array<float>, label int"


def close(vectors):
    """Links by the plain double-precision cosine."""
    n = len(vectors)
    out = np.zeros((n, n), bool)
    unit = {}
    for i, v in enumerate(vectors):
        if v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[i] = x / np.linalg.norm(x)
    for i in unit:
        for j in unit:
            if i != j and len(unit[i]) == len(unit[j]):
                out[i, j] = unit[i] @ unit[j] >= 0.9
    return out


@pytest.mark.parametrize("tile", [16, 2048])
def test_links_equal_brute_force(spark, by_id, monkeypatch, tile):
    monkeypatch.setattr(embedding_pairs, "TILE", tile)
    random_ = np.random.default_rng(4)
    vectors = []
    for _ in range(12):
        center = random_.normal(size=40)
        vectors += [(center + random_.normal(size=40) * s).tolist() for s in (0, .1, .2, .3, .33, .36, .4)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[0]], vectors[0][:39], None, [], [0.0] * 40,
                [float("nan")] * 40, [None] * 40, [float("inf"), *[1.0] * 39], [1.0] * 40, [1e-30] * 40, [1e30] * 40]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    docs = spark.createDataFrame(rows, VECTORS).repartition(3).withColumnRenamed("label", "node")
    found = by_id(embedding_pairs.near_embeddings(docs), "vec_id")
    links = close(vectors)
    forest = Forest(len(vectors))
    forest.join(*np.nonzero(links))
    for i in range(len(vectors)):
        assert found[i]["n_links"] == links[i].sum(), i
        assert found[i]["component_id"] == forest.label[i]
        assert found[i]["kept"] == (forest.label[i] == i)


def test_embeddings_of_odd_rows(spark):
    one = [1.0, 0.0]
    rows = spark.createDataFrame([(None, one, 0), (5, one, 0), (5, one, 0), (8, [0.0, 1.0], 0)], VECTORS)
    found = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_pairs.near_embeddings(rows).collect())
    assert found == [(0, 0, None, False), (5, 0, 5, True), (5, 0, 5, True), (8, 0, 8, True)]
    assert embedding_pairs.near_embeddings(rows.limit(0)).collect() == []


def test_bounds_leave_no_pair_out():
    random_ = np.random.default_rng(2)
    given = random_.normal(size=(60, 50)) * np.geomspace(1, 0.01, 50)
    turned = embedding_pairs.unit(given)
    rest = np.sqrt(np.cumsum((turned ** 2)[:, ::-1], axis=1)[:, ::-1]).astype(np.float32)
    tile = {"turned": turned.astype(np.float32), "given": given, "size": np.full(60, 50), "rest": rest}
    x, y = embedding_pairs.close_pairs(tile, tile, 0.9, same=True)
    want = np.argwhere(np.triu(turned @ turned.T >= 0.9, 1))
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


# --- toxicity ---------------------------------------------------------------------------

def insults(n):
    """Toxic texts hold words of three stems, with any ending."""
    random.seed(8)
    clean = ["".join(random.choices("aeinrst", k=random.randint(2, 7))) for _ in range(300)]
    for i in range(n):
        words = random.choices(clean, k=random.randint(20, 60))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[random.randrange(len(words))] = random.choice(["zokk", "quvv", "jidd"]) + random.choice(clean)
        yield i, " ".join(words), int(toxic)


def test_unseen_endings_are_found(spark, documents):
    rows = list(insults(800))
    docs = documents([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, toxicity.train(spark, docs, labels)).withColumn("held", toxicity.held_out("doc_id")).where("held").collect()
    assert len(out) > 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    wrong = sum((r.toxic_score >= 0.5) != (rows[r.doc_id][2] == 1) for r in out)
    assert wrong <= 0.05 * len(out)


def test_toxicity_of_odd_rows(spark, documents):
    docs = documents([(None, None), (1, ""), (1, ""), (2, "zokk " * 20_000), (3, "퟿ x")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "row")
    for labels in ([], [(None, 1, 1), (1, 1, None), (1, 1, 0)], [(1, 1, 0), (2, 1, 1), (2, 1, 0), (3, 0, 0)]):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        out = toxicity.scored(docs, toxicity.train(spark, docs, frame)).collect()
        assert len(out) == 5 and all(0 <= r.toxic_score <= 1 for r in out)
    empty = documents([]).limit(0)
    assert toxicity.scored(empty, toxicity.train(spark, empty, frame)).collect() == []


# --- language model ---------------------------------------------------------------------

def test_the_model_sums_to_one():
    model = language_model.start(np.log(np.full(language_model.SYMBOLS, 1 / language_model.SYMBOLS)))
    table = model.normaliser()
    for before, last in ((0, 0), (3, 500), (511, 7)):
        scores = model.hidden(np.array([before]), np.array([last])) @ model.target.T + model.bias
        assert np.exp(scores - table[before, last]).sum() == pytest.approx(1, rel=1e-4)


def test_noise_contrastive_steps_learn_what_follows():
    random_ = np.random.default_rng(3)
    noise = np.log(np.full(language_model.SYMBOLS, 1 / language_model.SYMBOLS))
    trainer = language_model.Trainer(language_model.start(noise), noise, 1)
    last = random_.integers(0, 40, 400_000)
    nxt = (last * 7 + 1) % 40
    before = random_.integers(0, 40, 400_000)
    for at in range(0, len(last), language_model.STEP):
        trainer.step(*(x[at:at + language_model.STEP].astype(np.int32) for x in (before, last, nxt)))
    m = trainer.model
    scores = m.hidden(before[:500], last[:500]) @ m.target.T + m.bias
    assert (scores.argmax(axis=1) == nxt[:500]).mean() > 0.9


@pytest.mark.parametrize("words", [600, 1800])
def test_vectors_grow_with_the_words_that_are_frequent(documents, words):
    texts = [" ".join(f"w{i}" for i in range(words))] * language_model.LEAST + ["seldom"]
    lex, _, _ = language_model.lexicon(language_model.counts_of(documents(enumerate(texts))))
    assert lex.vocabulary == words + 1  # and the end
    model = language_model.start(lex.log_noise, lex.symbol, lex.log_fine)
    assert len(model.context) == words + 1 + language_model.CLASSES
    assert language_model.Model.of(model.flat()).fine.shape == model.fine.shape


def test_words_beyond_the_symbols_are_learned():
    """Words of one class, each followed by one other: only vectors of their own can tell them apart."""
    random_ = np.random.default_rng(3)
    first, n = language_model.WORDS, 100
    symbol = np.concatenate([np.arange(first), np.full(n, first), first + np.arange(64)])
    noise = np.log(np.full(language_model.SYMBOLS, 1 / language_model.SYMBOLS))
    trainer = language_model.Trainer(language_model.start(noise, symbol), noise, 1, symbol)
    last, before = first + random_.integers(0, n, 600_000), first + random_.integers(0, n, 600_000)
    nxt = first + (last - first + 37) % n
    for at in range(0, len(last), language_model.STEP):
        trainer.step(*(x[at:at + language_model.STEP].astype(np.int32) for x in (before, last, nxt)))
    found = language_model.log_probabilities(before[:2000], last[:2000], nxt[:2000], trainer.model, symbol)
    assert found.mean() > np.log(1 / n) + 1


def test_words_of_all_classes_sum_to_one():
    random_ = np.random.default_rng(5)
    symbol = np.concatenate([np.arange(language_model.WORDS), language_model.WORDS + random_.integers(0, 64, 900),
                             language_model.WORDS + np.arange(64)])
    model = language_model.start(np.log(np.full(language_model.SYMBOLS, 1 / language_model.SYMBOLS)), symbol)
    model.fine += random_.normal(size=model.fine.shape).astype(np.float32)
    everyone = np.arange(len(symbol))
    for before, last in ((0, 0), (3, 700), (1400, 450)):
        found = language_model.log_probabilities(
            np.full(len(symbol), before), np.full(len(symbol), last), everyone, model, symbol)
        assert np.exp(found).sum() == pytest.approx(1, rel=1e-4)


def test_words_of_large_classes_are_normalised_over_few_scores(monkeypatch):
    """Groups of about equally frequent words stand between a large class and its words; probabilities still sum to one."""
    random_ = np.random.default_rng(7)
    n = 10_000
    inside = np.concatenate([np.full(n, 3), random_.integers(4, 60, 2000), np.arange(64)])
    symbol = np.concatenate([np.arange(language_model.WORDS), language_model.WORDS + inside])
    model = language_model.start(np.log(np.full(language_model.SYMBOLS, 1 / language_model.SYMBOLS)), symbol)
    model.fine += random_.normal(size=model.fine.shape).astype(np.float32)
    model.fine_bias += random_.normal(size=len(inside)).astype(np.float32)
    everyone, made, log_sum = np.arange(len(symbol)), [], language_model.log_sum

    def counted(hidden, target, bias):
        made.append(len(hidden) * len(bias))
        return log_sum(hidden, target, bias)

    monkeypatch.setattr(language_model, "log_sum", counted)
    for before, last in ((0, 0), (3, 9000), (12_000, 450)):
        made.clear()
        found = language_model.log_probabilities(np.full(len(symbol), before), np.full(len(symbol), last), everyone, model, symbol)
        assert np.exp(found.astype(float)).sum() == pytest.approx(1, rel=1e-3)
        assert sum(made) < len(symbol) * (language_model.SYMBOLS + 4 * n ** 0.5)


def test_words_cut_by_columns_equal_those_of_each_text():
    random.seed(1)
    letters = " \t\n\x0b\x0c\r\x1c\x85\xa0AZazÄé퟿x,."
    texts = pa.array(["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(3000)] + [None, "", " ", "\x1c \t"])
    for given in (texts, texts.slice(7, 1000), texts.slice(0, 0), pa.array([None, ""], pa.string())):
        words, sizes = language_model.cut_words(given)
        want = [language_model.words_of(x or "") for x in given.to_pylist()]
        assert sizes.tolist() == [len(x) for x in want]
        assert words.to_pylist() == [w for x in want for w in x]


def test_shares_pass_on_less_than_they_learn_from(spark, documents):
    """Tasks with few words each do not pass a model each on: a small table, however many partitions, is one share."""
    assert language_model.shares(0, 1000) == language_model.shares(3999, 1000) == 1
    assert language_model.shares(10_000, 1000) == 5
    docs = documents((i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(200)).selectExpr("doc_id AS key", "false AS held_out", "text")
    lex, _, _ = language_model.lexicon(language_model.counts_of(docs))
    shared = spark.sparkContext.broadcast(lex)
    symbols = language_model.symbols_of(docs, shared).repartition(6, "key").sortWithinPartitions("key").localCheckpoint()
    many, one = (language_model.train(x, shared).flat() for x in (symbols, symbols.coalesce(1)))
    assert np.array_equal(many, one)


def test_a_task_takes_few_bytes_at_once_and_every_row():
    """Batches have thousands of rows however long these are."""
    sizes = [3, 0, None, 40, 5, 5, 5, 0, 100, 100, 1]
    column = pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), column], ["i", "x"])
    batches = [whole, whole.slice(0, 0), whole.slice(4)]
    found = list(language_model.parts(iter(batches), 1, 16))
    assert [i for b in found for i in b.column(0).to_pylist()] == [*range(11), *range(4, 11)]
    held = [[len(x.as_py() or b"") for x in b.column(1)] for b in found]
    assert all(sum(x) <= 16 or sum(1 for n in x if n) == 1 for x in held)
    assert len(found) < 14


def test_triples_of_texts():
    texts = [np.array(t, "<u4") for t in ([5, 6, 9], [9], [7, 9])]
    before, last, nxt = language_model.triples(texts, 9)
    assert (before.tolist(), last.tolist(), nxt.tolist()) == ([9, 9, 5, 9, 9, 9], [9, 5, 6, 9, 9, 7], [5, 6, 9, 9, 7, 9])
    assert {x.dtype for x in (before, last, nxt)} == {np.dtype(np.int32)}


@pytest.mark.parametrize("head", [10, 200_000])
def test_base_scores_equal_brute_force_and_the_model_beats_them(documents, by_id, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    random.seed(6)
    words = [["der", "die", "und", "ein", "nicht"], ["the", "of", "and", "a", "not"]]
    texts = [" ".join(random.choices(words[i % 2], k=40)) + f" rare{i % 90}" for i in range(400)]
    texts += [None, "", "\x1c \t", "Ünknown THE\x0bThe", "x " * 30_000]
    docs = documents(enumerate(texts)).withColumnRenamed("lang", "row").withColumnRenamed("source", "n")
    found = by_id(language_model.language_scores(docs))
    cut = [[*(t or "").encode().lower().split(), b""] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    counts = collections.Counter(w for ws, h in zip(cut, held, strict=True) if not h for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    better = 0
    for i, ws in enumerate(cut):
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(ws), sum(w in counts for w in ws), total)
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        better += held[i] and r["score"] > base
    assert better > 0.9 * sum(held[:400])


def test_language_scores_of_odd_rows(documents):
    rows = language_model.language_scores(documents([(None, "a b"), (1, "a"), (1, "a"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens) for r in rows) == [(0, False, 3), (1, False, 2), (1, False, 2), (2, False, 1)]
    assert language_model.language_scores(documents([]).limit(0)).collect() == []
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = language_model.language_scores(documents([(only_held, "a b")])).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0)


@pytest.mark.parametrize("scale", [0.1, 1.0, 40.0])
def test_logarithms_of_sums_of_scores_however_steep(monkeypatch, scale):
    monkeypatch.setattr(language_model, "SCORES", 200)  # several blocks
    random = np.random.default_rng(3)
    hidden, target = random.normal(0, scale, (23, 16)).astype(np.float32), random.normal(0, 1, (70, 16)).astype(np.float32)
    bias = random.normal(0, scale, 70).astype(np.float32)
    exact = np.logaddexp.reduce(hidden.astype(float) @ target.T.astype(float) + bias, axis=1)
    assert np.allclose(language_model.log_sum(hidden, target, bias), exact, rtol=1e-5, atol=1e-5)
    assert language_model.log_sum(hidden[:0], target, bias).shape == (0,)
