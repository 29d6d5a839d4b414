"""Confirmed copies: the cases that lose links, all pairs, and how candidates grow."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import dedup
from foliospark.storage import Scratch


def all_pairs(spark, p, block):
    side = lambda n: F.struct(*p.columns).alias(n)
    pairs = p.select(side("a")).join(p.select(side("b")), (F.col(f"a.{block}") == F.col(f"b.{block}")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    return {(r.x, r.y) for r in pairs.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), dedup.confirm("a", "b").alias("v")).where("v.copy").collect()}


def grouped(keys, edges):
    of = {k: {k} for k in keys}
    for a, b in edges:
        whole = of[a] | of[b]
        for x in whole:
            of[x] = whole
    return {k: min(v) for k, v in of.items()}


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id int, folder string, file_name string, text string")
    p = dedup.profile(docs)
    want = all_pairs(spark, p, "folder")
    links = {k: sum(k in pair for pair in want) for k, *_ in rows}
    group = grouped([k for k, *_ in rows], want)
    assert {(r.doc_id, r.group, r.links) for r in dedup.copy_groups(p, ["folder"]).collect()} == {(k, group[k], links[k]) for k in group}
    found = {(r.a, r.b) for r in dedup.confirmed_pairs(p, ["folder"]).where("copy").collect()}
    assert found <= want and grouped(group, found) == group
    return want


def test_classes_tell_dates_of_texts_and_lengths_apart(spark):
    """The middle text is the link: words equal to the first, dates equal to the third."""
    body = " ".join(f"mot{k}" for k in range(60))
    texts = [f"{body} le 1 2 2023", f"{body} le 1/2/2023", f"{body.replace('mot0 ', 'autre ')} le 1/2/2023"]
    assert check(spark, [(k, "f", f"n{k}.pdf", t) for k, t in enumerate(texts)]) == {(0, 1), (1, 2)}
    spaced = [body, body.replace(" ", "   "), body + " fin", body.replace(" ", "  ") + " fin", None, "", "court", "court"]
    check(spark, [(k, "f", f"n{k}.pdf", t) for k, t in enumerate(spaced)])


def test_copies_equal_all_pairs_of_made_texts(spark):
    rng, rows = random.Random(2), []
    words = [f"w{k}" for k in range(400)]
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(15, 90))]
        for _ in range(8):
            own = base[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                own[rng.randrange(len(own))] = rng.choice([*words, "1/2/2023", "2/2/2023", "le 3 mars 2021"])
            text = rng.choice((" ", "  ", ", ")).join(own)
            rows.append((len(rows), f"f{family % 3}", rng.choice(("a.pdf", "a 08-2023.pdf", "b.pdf")), text))
    assert len(check(spark, rows)) > 20


def test_copies_of_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").cast("int").alias("doc_id"), F.lit("f").alias("folder"), F.lit("a.pdf").alias("file_name"), "text")
    check(spark, [tuple(r) for r in docs.collect()])


def test_candidates_grow_with_the_folder(spark, monkeypatch):
    """Files that share a page of boilerplate and have as much of their own: no candidate, however many they are."""
    made = {}
    write = Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    shared = " ".join(f"clause{k}" for k in range(120))
    for n in (100, 200, 400):
        rows = [(k, "f", "a.pdf", shared + " " + " ".join(f"own{k}x{j}" for j in range(40))) for k in range(n)] + [(n, "f", "a.pdf", shared + " " + " ".join(f"own3x{j}" for j in range(40)) + " x")]
        p = dedup.profile(spark.createDataFrame(rows, "doc_id int, folder string, file_name string, text string"))
        assert [(r.a, r.b) for r in dedup.confirmed_pairs(p, ["folder"]).collect()] == [(3, n)]
        assert made["pairs"] <= 2 and made["marks"] <= 40


@pytest.mark.parametrize("rows", [[], [(1, "f", "a", None)]])
def test_nothing_to_compare(spark, rows):
    p = dedup.profile(spark.createDataFrame(rows, "doc_id int, folder string, file_name string, text string"))
    assert dedup.confirmed_pairs(p, ["folder"]).count() == 0
    assert [(r.doc_id, r.group, r.links) for r in dedup.copy_groups(p, ["folder"]).collect()] == [(k, k, 0) for k, *_ in rows]


def test_any_order_finds_every_pair_and_no_table_of_all_shingles_is_written(spark, monkeypatch):
    """Few documents in the sample, few frequent shingles known, blocks of two documents: the same links."""
    for name, value in (("SAMPLE", 4), ("FREQUENT", 3), ("SLICE", 2)):
        monkeypatch.setattr(dedup, name, value)
    made = {}
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (made.__setitem__(name, write(self, df, name)), made[name])[1])
    rng, shared = random.Random(9), " ".join(f"clause{k}" for k in range(40))
    rows = [(k, "f", "a.pdf", f"{shared if k % 2 else ''} " + " ".join(f"own{k // 3}x{j}" if j != 30 or rng.random() < 0.5 else f"z{k}" for j in range(60))) for k in range(30)]
    assert len(check(spark, rows)) > 5
    assert "shingles" not in made["profiles"].columns
    assert made["dated"].where("shingles is not null").count() < 30
