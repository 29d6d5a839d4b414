"""Merkle manifest, main text of pages and spelling variants: SQL twins, brute force, hand-made pages, edges."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import html_text, merkle, registry, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [
    (3, "One text of Words", "b", "en"), (3, "One text of Words", "b", "en"), (1, None, None, None), (None, "", "é", "fr"), (2, "Straßenbahn straßenbahn " * 30_000, "b", None),
    (4, "word", None, "x"), (5, "", "", ""), (None, None, None, None), (7, "Zéphyr zéphyr zephyr zephyrs\tzephyrs", "b", "fr"),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, s, lang, None if t is None else len(t), "x", 1, 2) for i, t, s, lang in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, word string, pos long, n long")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, data):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    found = registry.queries()[name](spark, data)
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, source, lang, n_chars), by whole trees."""

    def leaf(i, t, s, lang, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)))

    def siblings(nodes, at):
        out = []
        while len(nodes) > 1:
            run = at // 16 * 16
            out.append((nodes[run:at], nodes[at + 1 : run + 16]))
            nodes, at = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], at // 16
        return out, nodes[0]

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    subroots = [siblings([x for x, _ in by[s]], 0)[1] for s in order]
    out = []
    for k, s in enumerate(order):
        upper, root = siblings(subroots, k)
        for at, (own, (i, t, _, lang, n)) in enumerate(by[s]):
            steps = siblings([x for x, _ in by[s]], at)[0] + upper
            changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            node = leaf(i, t.translate(LOWER) if t is not None else None, s, lang, n) if changed else own
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            out.append((i, own, subroots[k], root, sha("".join(h for left, right in steps for h in left + right)), node, node == root))
    return out


def manifest_rows(df):
    return sorted(map(repr, ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())))


def test_op11_equals_whole_trees(spark, edges, monkeypatch):
    small = [(k, f"Text {k}", f"s{k % 3 if k < 40 else 5}", None, k) for k in range(360)]
    docs = spark.createDataFrame(small, "doc_id long, text string, source string, lang string, n_chars long")
    want = sorted(map(repr, brute_manifest(small)))
    for up, top in (((3,), 1 << 17), ((1,), 1 << 17), ((1, 2), 20), ((2,), 8)):
        monkeypatch.setattr(merkle, "BLOCK_LEVELS", up)
        monkeypatch.setattr(merkle, "TOP", top)
        assert manifest_rows(merkle.manifest(spark, docs, merkle.tampered())) == want
    monkeypatch.setattr(merkle, "TOP", 3)
    with pytest.raises(ValueError, match="more than 3"):
        merkle.manifest(spark, docs, merkle.tampered())
    monkeypatch.undo()
    assert manifest_rows(merkle.manifest(spark, edges, merkle.tampered())) == sorted(map(repr, brute_manifest([(i, t, s, lang, None if t is None else len(t)) for i, t, s, lang in EDGES])))
    assert merkle.manifest(spark, edges.limit(0), merkle.tampered()).count() == 0
    one = brute_manifest([(1, "A", "s", "en", 1)])
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == sha("")
    assert manifest_rows(merkle.manifest(spark, docs.limit(0).union(spark.createDataFrame([(1, "A", "s", "en", 1)], docs.schema)), merkle.tampered())) == sorted(map(repr, one))


def test_op11_a_changed_row_is_found(spark, edges):
    got = merkle.manifest(spark, edges, F.col("doc_id") == 7).collect()
    assert [r.doc_id for r in got if not r.verified] == [7]


def test_op12_equals_the_generated_articles(spark, data):
    def wanted(page):
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return "\n\n".join(filter(None, (" ".join(html.unescape(re.sub("</?(?:b|br)>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", article))))

    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = html_text.op12_html_block_rules(spark, data).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in got} == {(r.page_id, r.url, wanted(r.html), len(wanted(r.html))) for r in pages}


PROSE = "This is the long text of the day, in which we tell you what happened to all of the people who were there with us on that day."
PAGES = [
    ("<p>Hello world.</p><p>Second.</p>", "Hello world.\n\nSecond."),
    ("just text &amp; more", "just text & more"),
    ("", ""), (None, ""), ("<script>if (a<b) x('</p>')</script><style>p</style><p>a</p><script>open", "a"),
    ("<p>a<!-- x > y --> b</p><!-- open <p>c</p>", "a b"),
    ('<p title="a > b" data-x=\'c>d\'>ok</p><p>3 < 4 &lt; 5&nbsp;  &#233;\n\t&eacute;</p>', "ok\n\n3 < 4 < 5 é é"),
    ('<p title="open>text</p><p>more</p>', "text\n\nmore"),
    ("<p>one<br>line<br><br>next</p><p>cut <b", "one line\n\nnext\n\ncut"),
    ("<nav><ul><li><a>x</a><article><h1>T</h1><p>Body text.</article><footer>f", "T\n\nBody text."),
    ("<article><header><h1>T</h1></header><section><h2>S</h2><div>tiny</div></section><footer>by me</footer></article>", "T\n\nS\n\ntiny"),
    (
        '<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice"><p>' + PROSE + '</p></div><div id=menu><ul><li><a href=x>Home</a><li>About</ul></div>'
        '<main><article class="post"><h1>Title &amp; more</h1><p>' + PROSE + ' <a href="z">A link</a>.</p><div class="ad">Buy it now.</div><p>On.</p><ul><li>First<li>Second</ul><form><p>Your mail</p></form>'
        '<blockquote>Quoted</blockquote></article><section id="comments"><article class="comment"><p>' + PROSE + '</p></article></section></main><aside><p>' + PROSE + "</p></aside><footer>&copy; us</footer></body></html>",
        f"Title & more\n\n{PROSE} A link.\n\nOn.\n\nFirst\n\nSecond\n\nQuoted",
    ),
    (
        f'<body><div class=x><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div><div><h1>The day</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><div>Copyright © 2020</div><div><a href=1>Privacy</a></div></body>',
        f"The day\n\n{PROSE}\n\nShort one.\n\n{PROSE}",
    ),
    (f"<div>{PROSE}</div><div>by me</div><div>{'<a href=1>one of the links of the page</a> ' * 4}</div><div>{'<a href=1>one of the links of the page</a> ' * 4}</div><div>nearer to links</div>", f"{PROSE}\n\nby me"),
    ("<article><p>Words of an article. </p></article>" * 40_000, "\n\n".join(["Words of an article."] * 40_000)),
]


def test_op12_hand_made_pages(spark):
    rows = [(k, f"u{k}", page, "extra") for k, (page, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0], (None, None, "<p>x</p>", None)], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id is not None) == sorted((k, t, len(t)) for k, t in [*((k, t) for k, (_, t) in enumerate(PAGES)), (0, PAGES[0][1])])
    assert [r.text for r in got if r.page_id is None] == ["x"]
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ['<p title="x ' * 20_000, "<div>" * 30_000 + "x", '<b a="' * 20_000, "<p><table>" * 5_000, "<ul><li>" * 20_000, "<a>" * 20_000])
def test_op12_broken_pages_take_time_in_proportion(page):
    import time

    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 5


def brute_spelling(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [x for x in words if one(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def test_op13_equals_all_pairs(spark, edges):
    """Chains of forms, runs of equal letters, ties, accents, and the whole of edge cases."""
    counts = {
        "abcdef": 3200, "abcdeg": 640, "abcdeh": 640, "abcdegg": 128, "abcdeggg": 25, "abcdegggg": 5, "aabbcc": 50, "abbcc": 900, "aabcc": 900, "aabbccc": 9, "aaabbcc": 10, "éabcdé": 20, "eabcdé": 100, "éabcdz": 7,
        "zzzzzz": 6, "zzzzzzz": 30, "zzzzzzzz": 5, "lonely": 5, "rarest": 4,
    }
    rows = [(k, " ".join([w.upper() if w.isascii() and k % 2 else w] * 5) + ". ") for k, (w, n) in enumerate(counts.items()) for _ in range(n // 5)] + [(900, "rarest " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in spelling.group_variants(spark, docs).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == brute_spelling(rows)
    assert any(f and r != f for _, f, r, *_ in found)
    found = {tuple(r) for r in spelling.group_variants(spark, edges).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == brute_spelling([(i, t) for i, t, *_ in EDGES]) and found
    assert spelling.group_variants(spark, edges.limit(0)).count() == 0


def test_op13_equals_all_pairs_of_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert {tuple(r) for r in spelling.op13_spelling_variants(spark, data).select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_spelling(rows)


def test_spelling_sends_no_words_through_the_driver(spark, tmp_path, monkeypatch):
    """Files of words are small, their deletions are not: however small the files, nothing is broadcast."""
    spark.range(2000).select(F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), F.lit(9).cast("long").alias("n")).write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = spelling.forms(words, spelling.near_pairs(words))
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)
    plans = []
    write = spelling.Scratch.write
    monkeypatch.setattr(spelling.Scratch, "write", lambda self, df, name: (plans.append(plan(df)), write(self, df, name))[1])
    docs = spark.createDataFrame([(k, " ".join(["lettera"] * 30 + ["letterb"] * 6 + ["lettercb"] * 5)) for k in range(3)], "doc_id long, text string")
    plans.append(plan(spelling.group_variants(spark, docs)))
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
