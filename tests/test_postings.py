"""The stored table of words: ranks as by reading the texts, phrases, partitions read."""

from pyspark.sql import functions as F

from foliospark.operators import postings, search

ROWS = [
    ("a", "Le contrat de syndic et les contrats d'entretien du contrat", "Contrat"), ("b", "Le syndic a signé le contrat", None), ("c", "Rien de tout cela", "Contrat de syndic"), ("d", None, None), ("e", "", "x"),
    ("f", "contrat syndic syndic contrat " * 40, ""), ("g", "syndic contrat", "autre"),
]


def table(spark, tmp_path, **more):
    rows = spark.createDataFrame(ROWS, "chunk_id string, text string, title string")
    return rows, postings.build(rows, str(tmp_path / "words"), title=F.col("title"), **more)


def test_ranks_equal_a_scan(spark, tmp_path):
    rows, words = table(spark, tmp_path)
    for query in ("contrats syndic", "contrat", "absent contrat", "", "le le contrat"):
        want = {r.chunk_id: round(r.rank, 9) for r in rows.select("chunk_id", search.lexical_rank(F.col("text"), F.col("title"), query).alias("rank")).where("rank > 0").collect()}
        assert {r.chunk_id: round(r.rank, 9) for r in postings.ranked(words, query).collect()} == want, query
    assert words.where("chunk_id = 'g' and word = 'contrat'").first().places == [1]


def test_phrases(spark, tmp_path):
    _, words = table(spark, tmp_path)
    assert {r.chunk_id: r.n for r in postings.phrases(words, "contrats syndic").collect()} == {"f": 40}
    assert {r.chunk_id: r.n for r in postings.phrases(words, "syndic contrat").collect()} == {"f": 40, "g": 1}
    assert {r.chunk_id: r.n for r in postings.phrases(words, "le contrat").collect()} == {"a": 1, "b": 1}
    assert postings.phrases(words, "").count() == 0 and postings.phrases(words, "absent contrat").count() == 0


def test_stop_words_and_partitions(spark, tmp_path):
    _, words = table(spark, tmp_path, stop=postings.STOP_WORDS)
    assert words.where("word in ('le', 'de', 'et')").count() == 0
    assert {r.chunk_id for r in postings.ranked(words, "le contrat de syndic", stop=postings.STOP_WORDS).collect()} == {"a", "b", "c", "f", "g"}
    plan = postings.of_words(words, ["contrat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(word), EqualTo(word,contrat)]" in plan
    assert postings.build(spark.createDataFrame([], "chunk_id string, text string"), str(tmp_path / "none")).count() == 0


def test_table_equals_stems_row_by_row(spark, tmp_path, monkeypatch):
    """Each row of the table from the stems of its chunk, in blocks of any size; nothing is shuffled to build it."""
    rows, _ = table(spark, tmp_path)
    docs = rows.unionByName(spark.createDataFrame([("h", "Écoutez les ÉTABLISSEMENTS, 12 abc3s x; nationales nations", "Été 2023"), ("h", "nations", "Nation")], "chunk_id string, text string, title string"))
    want = {}
    for r in docs.select("chunk_id", search.stems(F.coalesce("title", F.lit(""))).alias("head"), search.stems(F.coalesce("text", F.lit(""))).alias("body")).collect():
        for w in {*r["head"], *r["body"]}:
            want.setdefault((r.chunk_id, w), []).append((r["head"].count(w), [k for k, x in enumerate(r["body"]) if x == w]))
    plans = []
    real = type(docs.write).parquet
    monkeypatch.setattr(type(docs.write), "parquet", lambda self, *a, **b: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), real(self, *a, **b))[1])
    for size in (1, 3, 2048):
        monkeypatch.setattr(postings, "BLOCK", size)
        got = {}
        for r in postings.build(docs, str(tmp_path / f"n{size}"), title=F.col("title")).collect():
            got.setdefault((r.chunk_id, r.word), []).append((r.in_title, r.places))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(plans) == 3 and not any("Exchange" in p for p in plans)


def test_chunks_of_one_key_count_together(spark, tmp_path):
    rows = spark.createDataFrame([("a", "le contrat"), ("a", "du contrat de syndic"), ("b", "syndic")], "chunk_id string, text string")
    words = postings.build(rows, str(tmp_path / "same"))
    assert [r.chunk_id for r in postings.ranked(words, "contrat syndic").collect()] == ["a"]
    assert {r.chunk_id: r.n for r in postings.phrases(words, "du contrat").collect()} == {"a": 1}
