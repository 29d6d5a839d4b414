"""The threshold search gives what ranking every row gives."""

import random

import pytest

from foliospark.operators import search


def rows_of(seed, n=600, queries=2):
    rng = random.Random(seed)
    return [(q, f"c{k:04d}", rng.choice([round(rng.random(), 2), 0.5, None]), rng.choice([0.0, 0.0, 0.0, round(rng.random(), 1)]), rng.choice(["RCP", "x", "y"]), f"g{rng.randrange(40)}") for q in range(queries) for k in range(n)]


@pytest.mark.parametrize("pool", [4, 50, 5000])
def test_top_fused_equals_full_ranks(spark, pool):
    df = spark.createDataFrame(rows_of(pool), "query_id int, chunk_id string, vec double, lex double, doc_type string, doc_group string").repartition(5)
    boost = search.type_boost(["RCP"])
    finish = lambda r: search.best(search.diversified(r, 2, 0.3), 10)
    want = [(r.query_id, r.rank, r.chunk_id, r.vec_rank, r.lex_rank) for r in finish(search.fused(search.ranked(df), boost)).orderBy("query_id", "rank").collect()]
    got = search.top_fused(df, finish, 10, boost, most_boost=0.01, pool=pool).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.chunk_id, r.vec_rank, r.lex_rank) for r in got] == want and len(want) == 20


def test_candidates_have_exact_ranks(spark):
    df = spark.createDataFrame(rows_of(1, 300, 3), "query_id int, chunk_id string, vec double, lex double, doc_type string, doc_group string").repartition(3)
    want = {(r.query_id, r.chunk_id): (r.vec_rank, r.lex_rank) for r in search.ranked(df).collect()}
    got = {(r.query_id, r.chunk_id): (r.vec_rank, r.lex_rank) for r in search.candidates(df, 20).collect()}
    assert got == {k: want[k] for k in got} and set(got) == {k for k, r in want.items() if min(r) <= 20}


def test_few_rows_none_and_a_small_bound_on_candidates(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(2, 30, 1), "query_id int, chunk_id string, vec double, lex double, doc_type string, doc_group string")
    finish = lambda r: search.best(search.diversified(r, 2, 0.3), 100)
    want = [r.chunk_id for r in finish(search.fused(search.ranked(df))).orderBy("rank").collect()]
    assert [r.chunk_id for r in search.top_fused(df, finish, 100, pool=3).orderBy("rank").collect()] == want
    monkeypatch.setattr(search, "MAX_CANDIDATES", 4)
    assert [r.chunk_id for r in search.top_fused(df, finish, 100, pool=3).orderBy("rank").collect()] == want
    assert search.top_fused(df.limit(0), finish, 5).count() == 0
