"""Windows of text, matches of cases and lines of pages: limits, ties, repeated keys."""

import datetime
import random
from itertools import pairwise

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.operators import entities, records
from foliospark.plans import record_queries  # noqa: F401
from foliospark.plans.queries import QUERIES
from foliospark.sources import files


def test_extraction_window_at_its_limits(spark):
    """Chunks that end one character before a limit, on it and behind it; null, empty and blank texts."""
    rows = []
    for n, kind in enumerate(("CONTRAT", "FACTURE")):
        for size in (1, 2, *range(496, 503), *range(1496, 1503), *range(1996, 2003)):
            for k, text in enumerate(("a" * 1500, "b" * 1500, "c" * size)):
                rows.append((f"{kind}/end{size}", kind, k, text))
            for k, text in enumerate(("a" * size, "b" * 1500, "c" * 700)):
                rows.append((f"{kind}/start{size}", kind, k, text))
        rows += [(f"{kind}/null", kind, 0, None), (f"{kind}/empty", kind, 0, ""), (f"{kind}/holes", kind, 0, None), (f"{kind}/holes", kind, 1, "x"), (f"{kind}/holes", kind, 2, None), (f"{kind}/holes", kind, 3, "")]
        rows += [(f"{kind}/spaces", kind, 0, "\u00a0 x\u3000\n"), (f"{kind}/spaces", kind, 1, " y\u00a0 ")]
    v_chunks = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("source_file", "doc_type", "chunk_index", "text"))})  # noqa: F841
    want = duckdb.sql("""WITH w AS (SELECT source_file, min(doc_type) AS doc_type, string_agg(text, chr(10) ORDER BY chunk_index) AS whole FROM v_chunks GROUP BY 1)
        SELECT source_file, doc_type, CASE WHEN doc_type = 'CONTRAT' THEN trim(left(whole, 1500)) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || trim(right(whole, 1500)) ELSE trim(left(whole, 2000)) END AS "window" FROM w""").fetchall()
    found = records.extraction_window(spark.createDataFrame(rows, "source_file string, doc_type string, chunk_index int, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(want)


CASE = "case_id string, code string, opened date, party string, name string"


def best_matches(erp, found, days=30):
    """The rule of ``matched``, all pairs."""
    words = lambda s: {w for w in (s or "").split() if len(w) > 2}
    one = {}
    for e, code, day, party, _ in erp:
        for c, other, opened, who, name in found:
            mine, theirs, also = words(party), words(who) or words(name), words(name)
            gap = days if day is None or opened is None else abs((day - opened).days)
            if code == other and code is not None and mine and theirs and (mine <= theirs or theirs <= mine) and gap <= days:
                direct = -1 if who is None else int(bool(mine & words(who)))
                rank = (-direct, -int(bool(mine & also)), gap, c)
                one[e] = min(one.get(e, rank), rank)
    two = {}
    for e, (direct, also, gap, c) in one.items():
        two[c] = min(two.get(c, (direct, also, gap, e)), (direct, also, gap, e))
    return {(e, c, gap) for c, (_, _, gap, e) in two.items()}


def test_matched_equals_all_pairs(spark):
    """Names that hold each other, frequent words, no dates, no names, repeated rows and ids."""
    rng, start = random.Random(5), datetime.date(2023, 1, 1)
    words = ["cloture", "attente", *(f"nom{x}" for x in "abcdefgh")]
    name = lambda: rng.choice([None, "", " ".join(rng.sample(words, rng.randrange(1, 4))), " ".join(rng.sample(words, 2))])
    row = lambda k: (str(k), rng.choice(["C1", "C2", "C2", None]), rng.choice([None, *(start + datetime.timedelta(rng.randrange(150)) for _ in range(6))]), name(), name())
    erp, found = [row(k % 190) for k in range(200)], [row(k % 290) for k in range(300)]
    erp, found = erp + erp[:20], found + found[:20]
    for days in (30, 0):
        got = entities.matched(spark.createDataFrame(erp, CASE), spark.createDataFrame(found, CASE), days).collect()
        assert len(got) > 10 and {(r.erp_id, r.case_id, r.gap) for r in got} == best_matches(erp, found, days)


def test_match_candidates_grow_with_the_cases(spark):
    """A word that every case has, and many cases of one name and day."""
    for n in (200, 800):
        day = F.date_add(F.lit("2020-01-01"), (F.col("id") % 40).cast("int"))
        party = F.concat(F.lit("cloture nom"), F.translate(F.floor(F.col("id") / 2).cast("string"), "0123456789", "abcdefghij"))
        a = spark.range(n).select(F.lit("C").alias("code"), day.alias("erp_date"), F.array_sort(F.split(party, " ")).alias("erp_names"))
        b = a.select("code", F.col("erp_date").alias("opened"), F.col("erp_names").alias("names"))
        assert entities.candidates(a, b, 30).count() <= 2 * n
    copies = [(str(k), "C", datetime.date(2023, 1, 1 + k % 2), "cloture", None) for k in range(3000)]
    got = entities.matched(spark.createDataFrame(copies[::2], CASE), spark.createDataFrame(copies[1::2], CASE)).collect()
    assert [tuple(r) for r in got] == [("0", "1", 1)]


def page_text(boxes):
    """The rule of ``page_lines``, word by word."""
    order = sorted(boxes, key=lambda b: (b[1], b[0]))
    running, found = order[0][2] or 0.01, [[order[0]]]
    for before, b in pairwise(order):
        if abs(b[1] - before[1]) > 0.4 * running:
            found.append([])
        found[-1].append(b)
        running = 0.8 * running + 0.2 * b[2] if b[2] > 0 else running
    out, bottom = [], 0.0
    for line in found:
        tall, line = max(b[2] for b in line), sorted(line, key=lambda b: b[0])
        out += [""] * bool(bottom > 0 and line[0][1] - bottom > 1.2 * tall) + [" ".join(b[3] for b in line)]
        bottom = line[0][1] + tall
    return "\n".join(out)


def test_lines_of_pages_word_by_word(spark):
    """Pages of 1 to 300 words: skewed lines, gaps, heights of zero, words at one place."""
    rng, rows, pages = random.Random(3), [], {}
    for k in range(60):
        boxes, tops = [], rng.choice((8, 15, 40))
        for n in range(rng.choice((1, 2, 7, 40, 300))):
            boxes.append((rng.randrange(0, 500), n // 6 * tops + rng.randrange(-3, 4), rng.choice((0, 9, 10, 12, 30)), rng.choice(("é", "", "a b", f"w{n}"))))
        boxes = list({b[:2]: b for b in boxes}.values())
        pages[("d" + str(k % 7), k)] = page_text(boxes)
        rows += [("d" + str(k % 7), k, *b) for b in boxes]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, page int, left int, top int, height int, word string")
    assert {(r.doc, r.page): r.text for r in files.lines(df).collect()} == pages
    assert files.lines(df.limit(0)).count() == 0
    same = spark.createDataFrame([("d", 1, [(0, 5, 9, "x"), (0, 5, 9, "y"), (0, 4, 9, "z")]), ("d", 2, [])], "doc string, page int, boxes array<struct<left: int, top: int, height: int, word: string>>")
    assert sorted(tuple(r) for r in files.page_lines(same).collect()) == [("d", 1, "z x y"), ("d", 2, "")]


def test_lines_of_documents_deal_no_words(spark, data):
    """What is shuffled are texts at most, never a row a word."""
    plan = QUERIES["sc7_lines"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "posexplode" in plan and plan.index("posexplode") < (plan + "Exchange").index("Exchange")
