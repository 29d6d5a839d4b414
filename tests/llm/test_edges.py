"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import decontamination, language, lm_scoring, mpeg_audio, near_duplicates, packing, quality, substrings, token_files, urls
from foliospark.storage import Scratch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, hash long, bucket long, place long, score double, slot long, m long, n_removed long, removed long, kept boolean, word long, stats long, file string"
LONG = "a long word list, " * 90_000  # more than three blocks
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (None, "one two three four five six seven"), (4, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "ONE two three four five six SEVEN"),
    (7, "émoji 😀 et <|endoftext|> ß ñ 日本語  x"), (8, LONG), (8, LONG), (9, "12 34 %% !!"), (10, "a"), (None, None), (11, "The cat sat. " * 30),
]


@pytest.fixture(scope="module")
def nasty(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None, None, 1, 1, 1, 1.0, 1, 1, 1, 1, True, 1, 1, "f") for i, t in ROWS]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "The cat sat on a mat and ate 12 kg of fish with Bob Stone."), (2, None), (None, "x")], "item_id long, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
    return d


def results(spark, docs):
    scratch = Scratch(spark, "test")
    measured = quality.measure(docs)
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    frequent, table = lm_scoring.learn(docs)
    folder = token_files._uri(spark, scratch.path("flat"))
    order = scratch.write(token_files.write_token_files(docs, folder), "order")
    return {
        1: language.identify(docs, language.learn(docs)),
        2: decontamination.contaminated(docs, bench),
        3: substrings.remove_repeated_spans(docs.select("doc_id", "text")),
        4: quality.score(measured, quality.fit(measured, labels, F.lit(True), scratch)),
        5: mpeg_audio.digests(mpeg_audio.store_texts(docs)),
        6: lm_scoring.score(docs, frequent, table),
        7: token_files.count_tokens(order, folder),
        8: packing.pack(spark, docs, with_ids=True),
        9: near_duplicates.near_duplicates(spark, docs),
    }


def test_nasty_rows(spark, nasty):
    got = {k: df.collect() for k, df in results(spark, nasty).items()}
    n = len(ROWS)
    assert [len(got[k]) for k in (1, 3, 4, 5, 6, 9)] == [n] * 6
    assert {(r.doc_id, r.lang_pred) for r in got[1] if r.lang_pred == "und"} >= {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (None, "und")}
    assert {r.doc_id for r in got[2]} == {None, 4, 5, 6}
    assert all(0 <= r.score <= 1 for r in got[4])
    assert {r.payload_bytes for r in got[5] if r.doc_id in (1, 2)} == {64}
    assert {r.n_tokens for r in got[6] if r.doc_id in (1, 2, 3)} == {0}
    words = lm_scoring.score_words(nasty).collect()
    assert len(words) == n and all(np.isfinite(r.log_prob) and (r.mean_log_prob is None) == (r.n_tokens == 0) for r in words)
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in words))) == sorted(map(repr, ((r.doc_id, r.n_tokens) for r in got[6])))
    assert len(got[7]) == n and all(r.terminated for r in got[7])
    assert len({r.sequence_id for r in got[8]}) * packing.WINDOW >= sum(r.length for r in got[8])
    near = {(r.doc_id, r.component_id, r.kept) for r in got[9]}
    assert {(4, 4, True), (5, 4, False), (6, 4, False), (8, 8, True), (1, 1, True), (10, 10, True)} <= near
    assert [(r.component_id, r.kept) for r in got[9] if r.doc_id is None and r.n_shingles] == [(4, False)]


def test_empty_table(spark, nasty):
    assert lm_scoring.score_words(nasty.limit(0)).count() == 0
    assert {k: df.count() for k, df in results(spark, nasty.limit(0)).items()} == dict.fromkeys(range(1, 10), 0)


@pytest.mark.parametrize("rows", ["nasty", "empty"])
def test_stages_keep_the_columns(spark, nasty, sf_dir, rows):
    docs = nasty if rows == "nasty" else nasty.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
            assert out.count() <= docs.count()
        else:
            whole = [r.doc_id for r in out.collect() if r.start == 0]
            assert sorted(map(repr, whole)) == sorted(repr(r.doc_id) for r in docs.collect())


def test_urls_without_host(spark):
    pages = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "no scheme", 3), (4, "http://X.NET/a?b", 4), (4, "http://X.NET/a?b", 4)], "page_id long, url string, host int")
    got = urls.judge(pages, urls.train(spark)).collect()
    assert [(r.host, r.path, r.rule) for r in got] == [("", "", None)] * 3 + [("x.net", "/a", "net/")] * 2
    assert urls.judge(pages.limit(0), urls.train(spark)).count() == 0
    assert np.isfinite([r.score for r in got]).all()
