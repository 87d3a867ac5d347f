from __future__ import annotations

import importlib
import sys

import pytest

import corpus_pipeline
from snipmill.llm.common import staged, table


def test_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        corpus_pipeline.keep_quality, corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies,
        corpus_pipeline.mix_sources, corpus_pipeline.encode_pieces]


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return [*out, docs]


def test_each_stage_works_on_what_came_before(results):
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in results[:5]]
    for before, after in zip(texts, texts[1:], strict=False):
        assert after.items() <= before.items()
    assert all(d.columns == results[0].columns for d in results[:5])


def test_quality_stage_drops_exactly_what_the_rules_reject(results):
    before, after = ({r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in results[:2])
    for i, text in before.items():
        words = text.split()
        if len(words) < 50:
            assert i not in after


def test_one_of_each_group_of_copies_stays(results):
    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}

    before, after = (d.select("doc_id", "text").collect() for d in results[2:4])
    kept = {r.doc_id: shingles(r.text) for r in after}
    sets = {r.doc_id: shingles(r.text) for r in before}
    for a in kept:  # no exact copies of sets stay
        assert not any(a != b and kept[a] == kept[b] for b in kept)
    for gone in set(sets) - set(kept):  # what went is similar to something
        assert max(len(sets[gone] & s) / len(sets[gone] | s) for i, s in sets.items() if i != gone) >= 0.8


def test_the_end_encodes_every_row_of_the_mix(results):
    from snipmill.llm.common import tokenizer_file
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(corpus_pipeline.VOCABULARY))
    texts = {r.doc_id: r.text for r in results[4].collect()}
    rows = results[5].collect()
    assert len(rows) == results[4].count()
    for r in rows:
        assert r.piece_ids == library.encode(texts[r.doc_id]) and r.round_trip


def test_run_gives_the_same_documents(spark, sf_dir, results):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in results[5].collect())


def test_the_entry_works_without_this_subpackage(monkeypatch):
    import __spark_entry__ as entry

    full = set(entry.queries())
    assert {"pipeline", *(q for q in full if q.startswith("op"))} <= full
    monkeypatch.setitem(sys.modules, "snipmill.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    for name in [m for m in sys.modules if m.startswith("snipmill.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    assert not any(q.startswith("op1") or q == "pipeline" for q in importlib.reload(entry).queries())


def test_the_operators_stay_without_the_pipeline(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    found = set(importlib.reload(entry).queries())
    assert "pipeline" not in found and sum(q.startswith("op") and q[2].isdigit() for q in found) == 13


def odd_documents(spark):
    """Nulls in every column, repeats, a long text, and columns with the names that the stages use themselves."""
    good = " ".join(f"word{i} about things number{i * 7}." for i in range(40))
    rows = [(i, good + f" own{i} " * 30, "en", "web", 9, "mine", "mine", "mine", "mine", "mine", 0.5) for i in range(12)]
    rows += [(0, *rows[0][1:]), (0, rows[1][1] + " more", *rows[0][2:]), (20, None, "en", "web", 0, *rows[0][5:]),
             (21, "", "en", "web", 0, *rows[0][5:]), (None, good, None, None, None, None, None, None, None, None, None),
             (None, good, None, None, None, None, None, None, None, None, None), (22, good + " tail" + " long text here" * 30_000, None, "books", 1, *rows[0][5:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, verdict string, mix string, "
                                       "copy string, row string, key string, toxic_score double").repartition(3)


def test_stages_take_odd_rows_and_clashing_names(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, sf_dir), "odd")
        assert out.columns == docs.columns, name
        assert {r.verdict for r in out.collect()} <= {"mine", None}
        assert {r.toxic_score for r in out.collect()} <= {0.5, None}
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.collect() == []
    coded = corpus_pipeline.encode_pieces(spark, docs, sf_dir).collect()
    assert len(coded) == docs.count()
    assert all(r.round_trip for r in coded)
    assert corpus_pipeline.encode_pieces(spark, docs.limit(0), sf_dir).collect() == []


def test_near_duplicates_of_repeated_keys_agree(spark, sf_dir):
    docs = odd_documents(spark)
    runs = [sorted(map(str, corpus_pipeline.drop_copies(spark, d, sf_dir).collect())) for d in (docs, docs.repartition(7), docs.coalesce(1))]
    assert runs[0] == runs[1] == runs[2]
    kept = corpus_pipeline.drop_copies(spark, docs, sf_dir).groupBy("doc_id").count().collect()
    assert all(r["count"] == 1 for r in kept if r.doc_id is not None)
    assert [r["count"] for r in kept if r.doc_id is None] == [2]
