from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from snipmill.llm import simhash
from snipmill.llm.common import Forest, among, components


def plain_fingerprint(text, words):
    """Bit by bit, as the definition has it."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fps, most):
    """Smallest id reachable over links of at most ``most`` bits, pair by pair."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= most and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def text_of(seed, n=60):
    random.seed(seed)
    return " ".join(f"w{random.randint(0, 400)}" for _ in range(n))


def variants():
    base = text_of(1, 300).split()
    out = []
    for k in range(60):
        copy = list(base)
        for _ in range(k % 9):
            copy[random.randrange(len(copy))] = f"v{random.randint(0, 99)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("tile", [4, 1 << 15])
def test_groups_equal_brute_force(documents, by_id, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)  # small tiles: crowded buckets are cut into chunks
    texts = [None, "", " \n", "one", "One", "a b c", *variants(), *[text_of(s) for s in range(40)], text_of(3), "x " * 20_000]
    docs = documents(enumerate(texts)).withColumnRenamed("lang", "fp").withColumnRenamed("source", "node")
    found = by_id(simhash.near_duplicates(docs))
    fps = {i: plain_fingerprint(t, 4) for i, t in enumerate(texts)}
    want = groups_of(fps, 4)
    for i in fps:
        assert found[i]["fingerprint"] == f"{fps[i]:016x}"
        assert found[i]["component_id"] == want[i]


def test_keys_that_are_null_or_repeat(documents):
    rows = simhash.near_duplicates(documents([
        (None, text_of(1)), (7, text_of(1)), (9, text_of(2)), (9, text_of(3)), (12, text_of(3))])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows if r.doc_id) == [(7, 7), (9, 9), (9, 9), (12, 9)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(documents([]).limit(0)).collect() == []


def test_the_stage_keeps_one_of_each_similar_group(documents):
    base = text_of(1, 200).split()
    near = [*base[:100], "changed", *base[101:]]
    half = [*base[:100], *text_of(77, 100).split()]
    texts = {1: base, 2: near, 3: half, 4: text_of(5, 200).split(), 5: base}
    docs = documents([*((i, " ".join(t)) for i, t in texts.items()), (4, " ".join(texts[4])), (None, "a"), (None, "a")])
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(k or 0 for k in kept) == [0, 0, 1, 3, 4]


def test_the_stage_finds_candidates_by_fingerprints(documents, monkeypatch):
    """Without a band, SimHash alone brings close texts together."""
    monkeypatch.setattr(simhash, "band_links", lambda classes: classes.select(
        classes.node.alias("a"), classes.node.alias("b")).limit(0))
    texts = {}
    for b in range(12):
        base = text_of(b, 200)
        texts |= {2 * b: base, 2 * b + 1: changed(base, 11 + b, 1)}
    assert all((plain_fingerprint(texts[2 * b], 5) ^ plain_fingerprint(texts[2 * b + 1], 5)).bit_count() <= 12 for b in range(12))
    kept = [r.doc_id for r in simhash.one_of_each(documents(texts.items())).collect()]
    assert sorted(kept) == [2 * b for b in range(12)]


def shingles_of(text, words=5):
    found = text.encode().lower().split()
    return {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))}


def likeness(a, b):
    return len(a & b) / len(a | b)


def changed(text, seed, spots):
    """``text`` with so many words replaced, at places far from each other."""
    out = text.split()
    for k in range(spots):
        out[(k * len(out)) // spots + seed % (len(out) // spots)] = f"c{seed}x{k}"
    return " ".join(out)


def test_candidates_that_fail_hide_no_true_link(spark):
    """The only candidates lead over a text that is like neither of the two that are alike."""
    texts = {1: text_of(1, 200), 2: text_of(2, 200), 3: changed(text_of(1, 200), 5, 3)}
    docs = spark.createDataFrame(list(texts.items()), "node long, text string")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {frozenset(r) for r in simhash.similar(edges, docs, 5, 0.8).collect()} == {frozenset((1, 3))}


@pytest.mark.parametrize("shingles", [500, 1 << 15])
def test_every_pair_of_a_component_is_compared(spark, monkeypatch, shingles):
    monkeypatch.setattr(simhash, "SHINGLES", shingles)  # few shingles: components are cut into chunks
    texts = {}
    for b in range(4):
        base = text_of(b, 120)
        texts |= {100 * b + k: changed(base, 7 * k, k % 5 + 1) for k in range(20)}
    sets = {i: shingles_of(t) for i, t in texts.items()}
    want = Forest(len(texts))
    ids = sorted(texts)
    links = [(x, y) for x, a in enumerate(ids) for y, b in enumerate(ids) if x < y and likeness(sets[a], sets[b]) >= 0.8]
    want.join(*np.array(links).T)
    docs = spark.createDataFrame(list(texts.items()), "node long, text string").repartition(3)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:], strict=False)], "a long, b long")
    found = Forest(len(texts))
    for a, b in simhash.similar(edges, docs, 5, 0.8).collect():
        assert likeness(sets[a], sets[b]) >= 0.8
        found.join(np.array([ids.index(a)]), np.array([ids.index(b)]))
    assert 4 <= len(set(want.label.tolist())) < len(texts)
    assert len(set(zip(want.label.tolist(), found.label.tolist(), strict=True))) == len(set(want.label.tolist())) == len(set(found.label.tolist()))


def test_no_two_kept_texts_are_similar(documents):
    """Pairs just above 0.8, many of them with fingerprints more than 12 bits apart."""
    texts = {}
    for b in range(80):
        base = text_of(b, 150)
        texts |= {2 * b: base, 2 * b + 1: changed(base, 11 + b % 10, 3)}
    sets = {i: shingles_of(t) for i, t in texts.items()}
    assert all(0.8 <= likeness(sets[2 * b], sets[2 * b + 1]) < 0.85 for b in range(80))
    far = [b for b in range(80) if (plain_fingerprint(texts[2 * b], 5) ^ plain_fingerprint(texts[2 * b + 1], 5)).bit_count() > 12]
    assert len(far) > 3
    kept = [r.doc_id for r in simhash.one_of_each(documents(texts.items())).collect()]
    assert sorted(kept) == [2 * b for b in range(80)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=2), st.integers(1, 12), st.integers(0, 12))
def test_thresholds_reach_every_pair(pair, distance, flips):
    """Two fingerprints within the distance come within the threshold of one group at least."""
    together = np.diag(np.full(64, 50.0)) + np.random.default_rng(1).integers(20, 30, (64, 64))
    groups = simhash.plan(together, 100, distance)
    a, b = pair[0], pair[0]
    for bit in random.Random(pair[1]).sample(range(64), min(flips, distance)):
        b ^= 1 << bit
    assert sum(g.threshold + 1 for g in groups) == distance + 1
    assert any(sum((a ^ b) >> bit & 1 for bit in g.bits) <= g.threshold for g in groups)


CLASSES = "fp long, node long, sketch long"


def signed(n):
    return n - (1 << 64) if n >> 63 else n


@pytest.mark.parametrize("tile", [4, 40, 1 << 15])
def test_fingerprints_meet_halfway(spark, monkeypatch, tile):
    """All links of 12 bits or fewer, from groups with thresholds of several bits, in hot buckets and in none."""
    monkeypatch.setattr(simhash, "TILE", tile)
    draw = random.Random(tile)
    fps = [draw.getrandbits(64) for _ in range(30)]
    for fp in fps[:30]:
        for flips in range(1, 15):
            bits = draw.sample(range(64), flips)
            fps.append(fp ^ sum(1 << b for b in bits))
    want = groups_of(dict(enumerate(fps)), 12)
    classes = spark.createDataFrame([(signed(fp), i, None) for i, fp in enumerate(fps)], CLASSES).repartition(3)
    forest = Forest(len(fps))
    for a, b in simhash.near_links(classes, 12).collect():
        assert (fps[a] ^ fps[b]).bit_count() <= 12
        forest.join(np.array([a]), np.array([b]))
    assert forest.label.tolist() == [want[i] for i in range(len(fps))]


def test_a_fingerprint_goes_to_few_buckets(spark):
    """Names of buckets get longer as the table grows; the rows for each fingerprint must not grow with their powers."""
    classes = spark.createDataFrame([(signed(7 ** 25 * i % (1 << 64)), i, 0) for i in range(50)], CLASSES)
    for threshold, most in ((0, 1), (1, 12), (2, 12), (3, 12 + 55), (4, 12 + 55)):
        routed = simhash._routed(classes, [simhash.Group(tuple(range(16)), threshold, 11)], {})
        assert routed.count() == 50 * most


def test_chance_links_are_no_candidates(spark):
    """Fingerprints that come close by chance, as their sketches show, do not tie groups together."""
    same, half = 0b1011 << 20, (1 << 32) - 1
    classes = spark.createDataFrame([(5, 1, 0), (7, 2, same), (4, 3, half)], CLASSES)
    assert {frozenset(r) for r in simhash.near_links(classes, 12).collect()} == {frozenset((1, 2))}


def test_sketches_of_similar_texts_agree():
    apart = lambda a, b: ((int(a) ^ int(b)) & ((1 << 64) - 1)).bit_count()
    sketch = lambda t: simhash.bands_of(np.array(simhash.shingle_hashes(t, 5), np.uint64))[1]
    texts = [text_of(s, 150) for s in range(60)]
    assert max(apart(sketch(t), sketch(changed(t, 11 + i % 10, 3))) for i, t in enumerate(texts)) <= simhash.SKETCH
    assert sum(apart(sketch(a), sketch(b)) <= simhash.SKETCH for a, b in itertools.combinations(texts, 2)) < 30
    assert 20 < np.mean([apart(sketch(a), sketch(b)) for a, b in itertools.combinations(["a", "b", "c d", *texts], 2)]) < 40


def test_what_is_among_the_keys_is_found(spark):
    keys = spark.range(-3000, 3000, 2).select("id")
    rows = spark.range(-60_000, 60_000)
    found = {r.id for r in rows.where(among(keys)("id")).collect()}
    assert set(range(-3000, 3000, 2)) <= found and len(found) < 3000 + 120_000 * 0.03
    assert rows.where(among(keys.limit(0))("id")).count() == 0
    assert rows.limit(0).where(among(keys)("id")).count() == 0


def test_repeated_keys_and_duplicates_among_rows_that_stay(documents):
    texts = [text_of(s, 80) for s in range(40)]
    docs = documents([*enumerate(texts), (100, texts[3]), (7, texts[8]), (None, "a"), (None, "a")])
    rows = simhash.one_of_each(docs).collect()
    # 7 repeats with the text of 8, so 8 goes; of the two rows of 7 one stays.
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in rows) == [-1, -1, *(i for i in range(40) if i != 8)]
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id not in (None, 7))


def test_components_over_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    edges = spark.createDataFrame(path + star + [(5, 5), (3, 4)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1001 + i: 1000 for i in range(300)}}


def test_forest_keeps_links_that_hold_groups_together():
    forest = Forest(6)
    forest.join(np.array([0, 1, 0]), np.array([1, 2, 2]))
    forest.join(np.array([4, 2]), np.array([5, 0]))
    a, b = forest.edges()
    assert forest.label.tolist() == [0, 0, 0, 3, 4, 4]
    assert len(a) == 3 and set(zip(a.tolist(), b.tolist(), strict=True)) <= {(0, 1), (1, 2), (0, 2), (4, 5)}
