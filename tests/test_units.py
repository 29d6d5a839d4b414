"""Rules on small inputs: invariants and edges."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import analytics, chunking, dedup, entities, incremental, lookup, search
from foliospark.operators.components import connected_components
from foliospark.sources import files
from foliospark.storage import Scratch


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}}
    assert connected_components(df.limit(0), "a", "b", Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize(
    "spec, wrong",
    [
        (analytics.Spec("count", "nothing"), "source"), (analytics.Spec("avg", "cases"), "operation"), (analytics.Spec("list", "cases", "secret"), "select_field"),
        (analytics.Spec("sum", "cases", metric="x; drop table"), "metric"), (analytics.Spec("count", "cases", filters={"or 1=1": 1}), "filter"),
    ],
)
def test_a_spec_outside_the_lists_is_refused(spec, wrong):
    error = analytics.validate(spec)
    assert wrong in error["error"] and error["allowed"]


def test_confirmation_is_symmetric_and_obeys_its_vetoes(spark):
    body = " ".join(f"mot{k}" for k in range(60))
    rows = [("a.pdf", body), ("b.pdf", body + " fin"), ("r_2023-08.pdf", body), ("r_2023-09.pdf", body), ("c.pdf", "court"), ("d.pdf", body.replace("mot5 ", "autre "))]
    p = dedup.profile(spark.createDataFrame(rows, "file_name string, text string"))
    side = lambda n: F.struct(*p.columns).alias(n)
    pairs = p.select(side("a")).crossJoin(p.select(side("b")))
    v = {(r.x, r.y): (r.v.copy, r.v.reason) for r in pairs.select(F.col("a.file_name").alias("x"), F.col("b.file_name").alias("y"), dedup.confirm("a", "b").alias("v")).collect()}
    assert all(v[x, y] == v[y, x] for x, y in v)
    assert v["a.pdf", "b.pdf"] == (True, "QUASI_IDENTIQUE")
    assert v["r_2023-08.pdf", "r_2023-09.pdf"] == (False, "PERIODES_NOM_DIFFERENTES")
    assert v["a.pdf", "c.pdf"] == (False, "TEXTE_TROP_COURT")
    assert v["a.pdf", "d.pdf"] == (False, "JACCARD_INSUFFISANT")


def test_version_families_and_variants(spark):
    body = " ".join(f"mot{k}" for k in range(60))
    rows = [("f/contrat_v1.pdf", "contrat_maintenance_v1.pdf", body, 1), ("f/contrat_v2.pdf", "contrat_maintenance_v2.pdf", body + " plus", 2), ("f/x.pdf", "reglement_interieur.pdf", body, 3), ("f/x_RGPD.pdf", "reglement_interieur_RGPD.pdf", body, 4)]
    p = dedup.profile(spark.createDataFrame(rows, "source_file string, file_name string, text string, mtime long").withColumn("folder", F.lit("f")))
    families = {r.source_file: r.ref_source_file for r in dedup.version_families(p).collect()}
    assert families["f/contrat_v1.pdf"] == "f/contrat_v2.pdf"
    assert {r.source_file: r.ref_source_file for r in dedup.variants(p).collect()} == {"f/x_RGPD.pdf": "f/x.pdf"}


@pytest.mark.parametrize("text", ["", "a", "x" * 12_000, "Phrase une. " * 900, "\n\n".join("paragraphe %d " % k * 20 for k in range(40)), "ligne\n" * 3000])
def test_chunks_are_bounded_and_hold_the_text(text):
    pieces = chunking.by_size(text)
    assert all(len(p) <= chunking.HARD_MAX for p in pieces)
    whole = "".join(pieces)
    assert all(w in whole for w in set(text.split()) if len(w) < 100)


def test_chunk_ids_count_equal_texts(spark):
    df = spark.createDataFrame([("s", "t", k) for k in range(3)], "source_file string, text string, chunk_index int")
    assert chunking.identified(df).select("chunk_id").distinct().count() == 3


def test_majority_and_tie(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None), (4, "z"), (4, "b"), (4, "b")], "g int, v string")
    assert {r.g: r.v for r in entities.majority(df, ["g"], "v").collect()} == {1: "a", 2: "AUTRE", 4: "b"}
    assert {r.g: r.v for r in entities.majority(df, ["g"], "v", priority=("z",)).collect()}[4] == "z"


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "q")], "k int, v string, w string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(incremental.upsert(old, new, ["k"])) == [(1, "a", "x"), (2, None, "z"), (3, "c", "q")]
    assert rows(incremental.upsert(old, new, ["k"], update=["w"])) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "q")]
    assert rows(incremental.upsert(old, new, ["k"], keep_old_if_null=True)) == [(1, "a", "x"), (2, "b", "z"), (3, "c", "q")]
    again = incremental.upsert(incremental.upsert(old, new, ["k"]), new, ["k"])
    assert rows(again) == rows(incremental.upsert(old, new, ["k"]))


def test_gates_and_caches(spark):
    before = spark.createDataFrame([("a", "PV_AG"), ("b", "RCP")], "path string, doc_type string")
    after = spark.createDataFrame([("a", "PV_AG"), ("c", "SINISTRE")], "path string, doc_type string")
    assert incremental.gates(before, after, {"claims": ["SINISTRE"], "summary": ["PV_AG"]}) == {"claims": True, "summary": False}
    hit, miss = incremental.cached(after, spark.createDataFrame([("a", 1)], "path string, n int"), "path", "n")
    assert (hit.count(), miss.count()) == (1, 1)


def test_tenant_filter_fails_closed(spark):
    df = spark.createDataFrame([(["x agency"],), (None,)], "labels array<string>")
    assert df.where(lookup.allowed("labels", [])).count() == 0
    assert df.where(lookup.allowed("labels", ["agency"])).count() == 1


def test_folds(spark):
    r = spark.createDataFrame([("Éœß",)], "s string").select(tx.fold_ascii(F.col("s")).alias("a"), tx.fold_marks(F.col("s")).alias("b")).first()
    assert (r.a, r.b) == ("e", "eœß")


def test_rerank_keeps_candidates_without_a_score(spark):
    df = spark.createDataFrame([(0, "a", 0.9, None), (0, "b", 0.5, 1.0), (0, "c", 0.4, 0.0)], "query_id int, chunk_id string, rrf double, rerank double")
    assert {r.chunk_id: r.final for r in search.reranked(df).collect()} == {"a": None, "b": 1.0, "c": 0.0}


def test_file_readers(tmp_path, spark):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns="m"><sheets><sheet name="Budget"/></sheets></w>')
        z.writestr("xl/sharedStrings.xml", '<s xmlns="m"><si><t>poste</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="m"><row><c t="s"><v>0</v></c><c><v>12</v></c></row></w>')
    assert files.extract("a.xlsx", book.getvalue()) == "--- Feuille: Budget ---\nposte | 12"
    assert files.extract("a.docx", b"plain text") == "plain text"
    assert files.extract("a.txt", "é".encode("latin-1")) == "é"
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "a.txt").write_text("bonjour")
    (tmp_path / "root.eml").write_text("Subject: s\n\ncorps\n")
    rows = {r.relative: r for r in files.inventory(spark, str(tmp_path)).collect()}
    assert rows["p1/a.txt"].property == "p1" and rows["root.eml"].property == "RACINE" and rows["root.eml"].category == "Mail"
    assert "corps" in "".join(r.text for r in files.read_texts(spark, str(tmp_path)).collect())
    (tmp_path / "reg.txt").write_text("# c\nKEY : http://x\nhttp://y\n")
    assert {tuple(r) for r in files.keyword_registry(spark, str(tmp_path / "reg.txt")).collect()} == {("KEY", "http://x"), ("http://y", "http://y")}


def test_scanned_lines(spark):
    rows = [("d", 1, 10, 0, 10, "b"), ("d", 1, 0, 1, 10, "a"), ("d", 1, 0, 15, 10, "c")]
    df = spark.createDataFrame(rows, "doc string, page int, left int, top int, height int, word string")
    assert files.lines(df).first().text == "a b\nc"


def test_exact_ranks_equal_one_window(spark, data):
    """Ranks dealt over tasks are those of one ordered window, with ties and nulls; a pool keeps the best of both scores."""
    rows = [(q, f"c{k:04d}", None if k % 97 == 0 else (k * 37 % 50) / 50, float(k % 3)) for q in (0, 1) for k in range(900)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, vec double, lex double").withColumn("text", F.lit("x"))
    want = {}
    for q in (0, 1):
        for name, at in (("vec", 2), ("lex", 3)):
            order = sorted((r for r in rows if r[0] == q), key=lambda r: (r[at] is None, -(r[at] or 0), r[1]))
            for k, r in enumerate(order):
                want.setdefault((q, r[1]), {})[name] = k + 1
    got = search.ranked(df).collect()
    assert {(r.query_id, r.chunk_id): {"vec": r.vec_rank, "lex": r.lex_rank} for r in got} == want and set(df.columns) <= set(got[0].asDict())
    pool = {(r.query_id, r.chunk_id): (r.vec_rank, r.lex_rank) for r in search.ranked(df, pool=1).collect()}
    assert pool == {k: (w["vec"], w["lex"]) for k, w in want.items() if 1 in w.values()} and len(pool) == 4


def test_copies_equal_all_pairs(spark, data):
    """Every pair of a source by the same rule, those of equal texts through their class."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text", F.concat(F.lit("doc_"), (F.col("doc_id") % 5).cast("string")).alias("file_name"))
    p = dedup.profile(docs)
    side = lambda n: F.struct("doc_id", "norm", "shingles", "text_dates", "name_dates", "name_periods", "chars").alias(n)
    pairs = p.select("source", side("a")).join(p.select("source", side("b")), "source").where("a.doc_id < b.doc_id")
    copies = {(r.x, r.y): r.v.score for r in pairs.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), dedup.confirm("a", "b").alias("v")).where("v.copy").collect()}
    found = {(r.a, r.b): r.score for r in dedup.confirmed_pairs(p, ["source"]).where("copy").collect()}
    assert found and set(found) <= set(copies) and all(copies[k] == pytest.approx(s) for k, s in found.items())
    joined = lambda edges: {frozenset(x) for x in _groups(edges)}
    assert joined(found) == joined(copies)


def _groups(edges):
    of = {}
    for a, b in edges:
        whole = of.get(a, {a}) | of.get(b, {b})
        for x in whole:
            of[x] = whole
    return of.values()


def test_periods_keep_copies_of_other_months_apart(spark):
    body = " ".join(f"mot{k}" for k in range(60))
    names = ["rapport 08-2023.pdf", "rapport 09-2023.pdf", "honoraires-t1-2025.pdf", "honoraires-t3-2025.pdf", "r_2023-08.pdf", "r_2023_08.pdf"]
    docs = spark.createDataFrame([(k, "s", n, body) for k, n in enumerate(names)], "doc_id int, source string, file_name string, text string")
    got = {(r.a, r.b) for r in dedup.confirmed_pairs(dedup.profile(docs), ["source"]).where("copy").collect()}
    assert got == {(0, 4), (0, 5)}


def test_folds_as_nfkd(spark):
    texts = ["Éœß ﬁn", "n° ½ ª", "plain", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(tx.canonical(F.col("s"))).collect()]
    assert got == ["e fin", "n 12 a", "plain", None]


def test_resolutions_and_articles():
    point = "\n".join(f"{k}- Résolution sur le point numéro {k} " + "avec des mots " * 12 for k in range(1, 6))
    assert len(chunking.RESOLUTIONS(point)) == 5
    long = point + "\n6- Travaux de toiture du bâtiment.\n" + "Une phrase assez longue. " * 400 + "En vertu de quoi, cette résolution est adoptée à la majorité."
    last = chunking.RESOLUTIONS(long)
    assert all(len(x) <= chunking.HARD_MAX for x in last) and any(x.startswith("[Suite résolution 6- Travaux de toiture") for x in last) and last[-1].endswith("majorité.")
    articles = "\n".join(f"Artic1e {k} Les lots et leurs parties communes sont décrits ici." for k in range(1, 5))
    assert len(chunking.ARTICLES(articles)) == 4
    plain = "Une phrase. " * 300
    assert chunking.RESOLUTIONS(plain) == chunking.by_size(plain)
    assert len(chunking.by_headings((r"\s*zzz",), ask=lambda t: r"(?=(?:^|\n)Artic1e)")(articles)) == 4


def test_rules_and_unknown_names():
    assert dedup.rules({"copy_markers": ["x"]})["copy_markers"] == ["x"] and dedup.rules()["stem_min_len"] == 8
    with pytest.raises(ValueError):
        dedup.rules({"nothing": 1})


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from foliospark.storage import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_files_without_reader_have_no_text(tmp_path, spark):
    assert files.extract("a.pdf", b"%PDF-1.4 x") is None and files.extract("b.MSG", b"x") is None
    (tmp_path / "a.xls").write_bytes(b"x")
    (tmp_path / "b.txt").write_text("oui")
    assert {(r.text, r.reason) for r in files.read_texts(spark, str(tmp_path)).collect()} == {(None, "NO_READER"), ("oui", None)}
    path = [r.path for r in files.read_texts(spark, str(tmp_path)).collect() if r.text is None][0]
    other = spark.createDataFrame([(path, "lu ailleurs")], "path string, text string")
    assert {r.text for r in files.read_texts(spark, str(tmp_path), other).collect()} == {"lu ailleurs", "oui"}


def test_shrinking_embedding(spark):
    from foliospark.plans import providers

    picky = lambda t: F.when(F.length(t) < 3000, F.length(t))
    assert spark.range(1).select(providers.shrinking(picky)(F.repeat(F.lit("x"), 9000)).alias("n")).first().n == 2450
