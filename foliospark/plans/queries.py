"""One query for each operator over the archive's views, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import dates as dt
from foliospark.functions import text as tx
from foliospark.operators import analytics, chunking, dedup, entities, incremental, lookup, overview, registry, search
from foliospark.plans.views import DOC_TYPES, Views, with_views
from foliospark.sources import files as fs
from foliospark.sources.keyed import KeyedTable
from foliospark.storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Views as a query, with its SQL."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return put


def values(rows: list[tuple]) -> str:
    """A table of constants in SQL."""
    value = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows) + ")"


def made(v: Views, expression: str) -> DataFrame:
    """id, s for every document: a text made of its columns by an expression that Spark and DuckDB both read."""
    return v.table("documents").select(F.col("doc_id").alias("id"), F.expr(expression).alias("s"))


def made_sql(expression: str) -> str:
    return f"(SELECT doc_id AS id, {expression} AS s FROM documents)"


def cases(*expressions: str) -> str:
    """One of the expressions for each document in turn."""
    return f"CASE doc_id % {len(expressions)} " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(expressions)) + " END"


#: A year, a month, a day, a quarter and a number of four digits or more of a document, as text.
YEAR, MONTH, DAY, QUARTER, NUMBER = "cast(2000 + doc_id % 25 AS string)", "cast(1 + doc_id % 12 AS string)", "cast(1 + doc_id % 28 AS string)", "cast(1 + doc_id % 4 AS string)", "cast(1000 + doc_id AS string)"


def _accents(c: str) -> str:
    return f"translate({c}, '{tx._ACCENTS}', '{tx._PLAIN}')"


def _canonical(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9_]+', ' ', 'g'))"


def _readable(c: str, strict: bool = False) -> str:
    """The reason by the seven tests of readability."""
    text = f"{c}"
    alpha = f"(length({text}) - length(regexp_replace({text}, '[\\p{{L}} ]', '', 'g'))) / length({text})::double"
    control = f"(length({text}) - length(regexp_replace({text}, '[^\\P{{C}}\\n\\r\\t]', '', 'g'))) / length({text})::double"
    words = lambda x: f"regexp_extract_all({x}, '[a-zA-ZÀ-ÿ]{{3,}}')"
    various = lambda x: f"len(list_distinct({words(f'lower({x})')})) / greatest(1, len({words(f'lower({x})')}))::double"
    traces = " OR ".join(f"regexp_matches(left({text}, 2000), '{p}')" for p in (*chunking.BINARY[:3], "[\\x{10000}-\\x{10FFFF}]{3,}"))
    lines = f"list_filter(list_transform(string_split({text}, chr(10))[1:50], lambda y: trim(y)), lambda y: y <> '')"
    codes = f"list_filter({lines}, lambda y: length(y) > 20 AND len({words('y')}) < 2)"
    return f"""CASE WHEN {text} IS NULL OR length(trim({text})) < 30 THEN 'short' WHEN {control} > 0.15 THEN 'control' WHEN {alpha} < {0.45 if strict else 0.35} THEN 'alpha'
        WHEN ({traces}) AND NOT ({alpha} > 0.55 AND len({words(text)}) > 20) THEN 'binary' WHEN ({traces}) AND {various(f'left({text}, 3000)')} < 0.30 THEN 'binary_repetitive'
        WHEN regexp_matches(left({text}, 2000), '{chunking.WORD_MARKUP}') AND ({alpha} < 0.60 OR {various(text)} < 0.40) THEN 'markup' WHEN regexp_matches(left({text}, 500), '{chunking.IMAGE_HEADERS}') AND {alpha} < 0.40 THEN 'image'
        WHEN len({words(text)}) < {10 if strict else 5} THEN 'words' WHEN len({lines}) > 5 AND len({codes}) / len({lines})::double > 0.70 THEN 'garbage' ELSE 'ok' END"""


# --- sources ---------------------------------------------------------------------------------

_INVENTORY = "SELECT source AS property, count(*) AS n, sum(size)::bigint AS bytes FROM v_files GROUP BY 1"


@query("sc2_inventory_report", with_views("files") + _INVENTORY)
def _(v):
    return fs.report(fs.described(v.files.withColumn("relative", F.col("path"))), "property")


@query("sc1_inventory", with_views("files") + "SELECT path, regexp_extract(path, '(\\.[^.]+)$', 1) AS extension, 'Texte' AS category, split_part(path, '/', 1) AS property, round(size / 1048576.0::double, 2) AS mb FROM v_files")
def _(v):
    return fs.described(v.files.withColumn("relative", F.col("path"))).select("path", "extension", "category", "property", "mb")


@query("sc4_filter_decision", "SELECT page_id, CASE WHEN url LIKE '%.html' THEN true ELSE true END AS keep, CASE WHEN regexp_matches(url, '/[^/]*\\.html$') THEN 'LISIBLE' ELSE 'INCONNU' END AS reason FROM pages")
def _(v):
    d = fs.decision(F.col("url"))
    return v.table("pages").select("page_id", d["keep"].alias("keep"), d["reason"].alias("reason"))


@query("sc6_native_pages", """SELECT source AS path, count(*) AS pages, avg(n_chars) >= 300 AND (count(*) <= 2 OR sum(CASE WHEN n_chars >= 100 THEN 1 ELSE 0 END) / count(*) >= 0.8) AS "native" FROM documents GROUP BY 1""")
def _(v):
    return fs.native_pages(v.table("documents").select(F.col("source").alias("path"), F.col("n_chars").alias("chars")))


@query("sc8_changed_files", with_views("files") + "SELECT path, size || ':' || doc_id AS signature FROM v_files WHERE doc_id % 10 = 0 OR doc_id % 10 = 3")
def _(v):
    now = v.files.select("path", "doc_id", F.concat_ws(":", "size", "doc_id").alias("signature"))
    known = now.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 10 == 1, None).when(F.col("doc_id") % 10 == 3, "old").otherwise(F.col("signature")).alias("signature"))
    return fs.changed(now, known).select("path", "signature")


_DIFF = with_views("files") + ", b AS (SELECT * FROM v_files WHERE doc_id % 10 <> 0), a AS (SELECT * FROM v_files WHERE doc_id % 7 <> 0) "


def _changes(v):
    """New rows by key, with later ones of the same key (seq) and some without a key."""
    new = v.documents.where("doc_id % 3 = 0").select("doc_id", "source_file", F.lit(1).alias("seq"))
    return new.unionByName(new.where("doc_id % 6 = 0").withColumn("seq", F.lit(2))).unionByName(new.where("doc_id % 5 = 0").withColumns({"source_file": F.lit(None).cast("string"), "seq": F.lit(3)}))


@query("sc11_upsert", with_views("documents") + """SELECT source_file, CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE year END AS year, CASE WHEN doc_id % 3 = 0 THEN 'NEW' ELSE status END AS status FROM v_documents WHERE doc_id % 9 <> 0
    UNION ALL SELECT source_file, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END, 'NEW' FROM v_documents WHERE doc_id % 9 = 0 UNION ALL SELECT NULL, -1, NULL FROM (SELECT 1)""")
def _(v):
    """Keys that come twice, keys that are not known yet, and rows without a key on both sides."""
    old = v.documents.where("doc_id % 9 <> 0").select("source_file", "year", "status")
    old = old.unionByName(v.spark.range(1).select(F.lit(None).cast("string").alias("source_file"), F.lit(-1).alias("year"), F.lit(None).cast("string").alias("status")))
    new = _changes(v).select("source_file", F.col("seq").alias("year"), F.lit("NEW").alias("status"), "seq")
    return incremental.upsert(old, new, ["source_file"], order=["seq"])


@query("sc12_partial_upsert", with_views("documents") + "SELECT source_file, CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE year END AS year, file_name FROM v_documents")
def _(v):
    new = _changes(v).select("source_file", F.col("seq").alias("year"), F.lit("other").alias("file_name"), "seq")
    return incremental.upsert(v.documents.select("source_file", "year", "file_name"), new, ["source_file"], update=["year"], order=["seq"])


@query("sc14_coalesce_upsert", with_views("documents") + "SELECT source_file, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'FIRST' ELSE status END AS status, CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE year END AS year FROM v_documents")
def _(v):
    """The later row of a key has no status: the earlier one's stays."""
    new = _changes(v).select("source_file", F.when((F.col("doc_id") % 2 == 0) & (F.col("seq") == 1), "FIRST").alias("status"), F.col("seq").alias("year"), "seq")
    return incremental.upsert(v.documents.select("source_file", "status", "year"), new, ["source_file"], keep_old_if_null=True, order=["seq"])


@query("sc11_keyed_table", with_views("documents") + """SELECT source_file, CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE year END AS year, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'FIRST' WHEN doc_id % 2 = 0 THEN status END AS status
    FROM v_documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 5 <> 0""")
def _(v):
    """A stored table: filled, changed twice by the same rows, and purged."""
    table = KeyedTable.create(v.spark, Scratch(v.spark, "keyed").path("table"), "source_file string, year int, status string", ["source_file"], buckets=16)
    table.upsert(v.documents.where("doc_id % 2 = 0").select("source_file", "year", "status"))
    new = _changes(v).select("source_file", F.when((F.col("doc_id") % 2 == 0) & (F.col("seq") == 1), "FIRST").alias("status"), F.col("seq").alias("year"), "seq")
    for _ in range(2):
        table.upsert(new, keep_old_if_null=True, order=["seq"])
    table.delete(v.documents.where("doc_id % 5 = 0"))
    return table.read()


@query("sc15_replace_by_key", with_views("cases") + "SELECT case_id, CASE WHEN code = 'C3' THEN 0.0 ELSE amount END AS amount FROM v_cases")
def _(v):
    rows = v.cases.select("case_id", "code", "amount")
    return incremental.replaced(rows, rows.where("code = 'C3'").withColumn("amount", F.lit(0.0)), "case_id").select("case_id", "amount")


# --- analytics -------------------------------------------------------------------------------

_YEAR = "year(opened)"


@query("a1_count_by_property", with_views("cases") + f"SELECT code, min(name) AS name, count(*) AS value FROM v_cases WHERE status = 'EN_COURS' AND {_YEAR} >= 1996 GROUP BY 1")
def _(v):
    return analytics.plan(analytics.Spec("count", "cases", filters={"status": "EN_COURS", "year_min": 1996}), v.cases)


@query("a2_sum_by_property", with_views("cases") + f"SELECT code, name, round(value, 2) AS value FROM (SELECT code, min(name) AS name, coalesce(sum(amount), 0) AS value FROM v_cases WHERE case_type IN ('TRAVAUX', 'SINISTRE_DDE') AND {_YEAR} <= 1997 GROUP BY 1)")
def _(v):
    spec = analytics.Spec("sum", "cases", metric="amount", filters={"case_type": ["TRAVAUX", "", "SINISTRE_DDE", "null"], "year_max": 1997})
    return analytics.plan(spec, v.cases).withColumn("value", F.round("value", 2))


@query("a3_distinct_list", with_views("documents") + "SELECT DISTINCT code, name, coalesce(doc_type_fixed, doc_type) AS value FROM v_documents WHERE year = 2018 ORDER BY code, value LIMIT 5000")
def _(v):
    return analytics.plan(analytics.Spec("list", "documents", "doc_type", filters={"year": 2018}), v.documents)


@query("a4_distinct_parties", with_views("parties") + "SELECT DISTINCT 'P' || (order_id % 50) AS code, unnest(parties) AS value FROM v_parties ORDER BY code, value LIMIT 5000")
def _(v):
    base = v.parties.select(F.concat(F.lit("P"), (F.col("order_id") % 50).cast("string")).alias("code"), F.lit("x").alias("name"), "parties")
    return analytics.plan(analytics.Spec("list", "documents", "parties"), base).select("code", "value")


@query("a5_coverage", with_views("cases") + """, r AS (SELECT DISTINCT code FROM v_cases WHERE amount > 400000) SELECT (SELECT count(DISTINCT code) FROM v_cases) AS n_base, (SELECT count(*) FROM r) AS n_result,
    (SELECT array_to_string(list_sort(list(code)), ',') FROM (SELECT DISTINCT code FROM v_cases WHERE code NOT IN (SELECT code FROM r))) AS missing""")
def _(v):
    spec = analytics.Spec("count", "cases")
    return analytics.coverage(spec, v.cases, v.cases.where("amount > 400000")).withColumn("missing", F.nullif(F.array_join("missing", ","), F.lit("")))


@query("a6_concentration", with_views("documents") + """, r AS (SELECT code, count(*) AS value FROM v_documents GROUP BY 1), w AS (SELECT *, row_number() OVER (ORDER BY value DESC, code) AS k, sum(value) OVER (ORDER BY value DESC, code ROWS UNBOUNDED PRECEDING) AS run, sum(value) OVER () AS total, count(*) OVER () AS n FROM r)
    SELECT min(k)::int AS n_top, max(n) AS n_total, max(total)::bigint AS total FROM w WHERE run >= 0.75 * total HAVING max(n) >= 4 AND min(k) < max(n)""")
def _(v):
    return analytics.concentration(analytics.plan(analytics.Spec("count", "documents"), v.documents))


@query("a7_property_stats", with_views("documents") + "SELECT code, min(name) AS name, count(DISTINCT source_file) AS n_documents, array_to_string(list_sort(list(DISTINCT doc_type)), ',') AS doc_types, min(year) AS year_min, max(year) AS year_max FROM v_documents GROUP BY 1")
def _(v):
    return overview.property_stats(v.documents).withColumn("doc_types", F.array_join("doc_types", ","))


@query("a9_property_facts", with_views("documents") + """SELECT code, count(DISTINCT source_file) AS n_documents, max(CASE WHEN doc_type = 'PV_AG' THEN date END) AS last_meeting, count(*) FILTER (doc_type = 'CONTRAT') AS contracts, count(*) FILTER (status = 'CADUC') AS old FROM v_documents GROUP BY 1""")
def _(v):
    f = overview.facts(v.documents)
    return f.select("code", "n_documents", "last_meeting", F.coalesce(F.try_element_at("types", F.lit("CONTRAT")), F.lit(0)).alias("contracts"), F.coalesce(F.try_element_at("statuses", F.lit("CADUC")), F.lit(0)).alias("old"))


@query("a10_document_text", with_views("chunks") + "SELECT source_file, md5(string_agg(text, '' ORDER BY chunk_index)) AS hash, count(*) AS n FROM v_chunks GROUP BY 1")
def _(v):
    return overview.rolled_up(v.chunks).select("source_file", F.md5(F.col("text").cast("binary")).alias("hash"), "n")


@query("a11_first_known", with_views("documents") + "SELECT code, arg_min(status, doc_id) FILTER (status IS NOT NULL) AS status, arg_min(case_id, doc_id) FILTER (case_id IS NOT NULL) AS case_id FROM v_documents GROUP BY 1")
def _(v):
    return v.documents.groupBy("code").agg(entities.first_known("status", "doc_id").alias("status"), entities.first_known("case_id", "doc_id").alias("case_id"))


@query("a12_majority", with_views("documents") + """, c AS (SELECT code, year, subtype, count(*) AS n FROM v_documents GROUP BY 1, 2, 3), t AS (SELECT *, max(n) OVER (PARTITION BY code, year) AS most FROM c)
    SELECT code, year, CASE WHEN count(*) > 1 THEN 'AUTRE' ELSE max(subtype) END AS subtype FROM t WHERE n = most GROUP BY 1, 2""")
def _(v):
    return entities.majority(v.documents, ["code", "year"], "subtype")


@query("a15_type_lengths", with_views("chunks") + "SELECT doc_type, count(*) AS n, round(avg(n_chars), 2) AS avg_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM v_chunks GROUP BY 1")
def _(v):
    return overview.type_lengths(v.chunks)


@query("a15_repeated_texts", with_views("chunks") + "SELECT md5(text) AS hash, count(*) AS n, count(DISTINCT source_file) AS n_documents FROM v_chunks GROUP BY 1 HAVING count(*) > 1")
def _(v):
    return overview.repeated_texts(v.chunks)


@query("a16_coverage_percent", with_views("documents") + "SELECT round(100.0::double * count(status) / count(*), 2) AS status, round(100.0::double * count(case_id) / count(*), 2) AS case_id FROM v_documents")
def _(v):
    return overview.filled(v.documents, ["status", "case_id"])


@query("a17_reclassified", with_views("documents") + "SELECT doc_type, doc_type_fixed, count(*) AS n FROM v_documents WHERE doc_type_fixed IS NOT NULL GROUP BY 1, 2")
def _(v):
    return overview.reclassified(v.documents)


@query("a18_token_cost", """SELECT event_type AS model, count(*) AS calls, sum(user_id)::bigint AS tokens_in, sum(event_id % 100)::bigint AS tokens_out, round((sum(user_id) * 3.0::double + sum(event_id % 100) * 15.0::double) / 1e6, 6) AS price FROM events GROUP BY 1""")
def _(v):
    return overview.cost(v.table("events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out")), 3.0, 15.0)


@query("a19_preflight", with_views("files") + ", g AS (SELECT size, sha, count(*) AS n FROM v_files GROUP BY 1, 2) SELECT sum(n)::bigint AS files, sum(n * size)::bigint AS bytes, sum(n - 1)::bigint AS copies, sum((n - 1) * size)::bigint AS copied_bytes, round(100.0::double * sum(n - 1) / sum(n), 2) AS copied_percent FROM g")
def _(v):
    return overview.preflight(v.files)


@query("a21_most_frequent", with_views("documents") + "SELECT subtype, count(*) AS n FROM v_documents GROUP BY 1 ORDER BY n DESC, subtype LIMIT 20")
def _(v):
    return overview.most_frequent(v.documents, "subtype")


# --- predicates and joins --------------------------------------------------------------------


@query("p2_documents_filter", with_views("documents") + "SELECT doc_id FROM v_documents WHERE coalesce(doc_type_fixed, doc_type) = 'CONTRAT' AND year BETWEEN 2016 AND 2021")
def _(v):
    return v.documents.where(analytics.is_in(analytics.effective_type(), "CONTRAT") & F.col("year").between(2016, 2021)).select("doc_id")


@query("p5_retrieval_base", with_views("chunks") + "SELECT chunk_id, source_file FROM v_chunks WHERE n_chars >= 500 AND NOT excluded AND doc_type <> 'COURRIER' AND (category IS NULL OR category NOT IN ('PROCEDURE_AG'))")
def _(v):
    return search.base(v.chunks, excluded_categories=["PROCEDURE_AG"], excluded_types=["COURRIER"]).select("chunk_id", "source_file")


@query("p6_prefilter", with_views("documents", "chunks") + ", f AS (SELECT source_file FROM v_documents WHERE case_id = 'D4' AND year >= 2016) SELECT chunk_id FROM v_chunks WHERE source_file IN (SELECT source_file FROM f) OR (SELECT count(*) NOT BETWEEN 1 AND 50 FROM f)")
def _(v):
    found = search.prefilter(v.documents, (F.col("case_id") == "D4") & (F.col("year") >= 2016))
    return v.chunks.where(analytics.is_in("source_file", found)).select("chunk_id")


@query("p7_years_or_unknown", with_views("documents") + "SELECT doc_id FROM v_documents WHERE nullif(year, 2016) IS NULL OR year BETWEEN 2019 AND 2020")
def _(v):
    return v.documents.withColumn("year", F.nullif("year", F.lit(2016))).where(analytics.years("year", 2019, 2020, unknown=True)).select("doc_id")


@query("p8_array_overlap", with_views("parties") + "SELECT order_id FROM v_parties WHERE list_has_any(parties, ['Supplier#000000001', 'Supplier#000000002'])")
def _(v):
    return v.parties.where(analytics.overlaps("parties", ["Supplier#000000001", "Supplier#000000002"])).select("order_id")


@query("p9_contains", with_views("cases") + "SELECT case_id FROM v_cases WHERE lower(party) LIKE '%customer#000000%' AND lower(party) LIKE '%7'")
def _(v):
    return v.cases.where(analytics.holds("party", "Customer#000000") & analytics.holds("party", "7", anywhere=False)).select("case_id")


@query("p10_regex_extract", with_views("cases") + "SELECT case_id, regexp_extract(party, '([0-9]+)$', 1) AS number FROM v_cases WHERE regexp_matches(party, '#0*[1-9][0-9]$')")
def _(v):
    return analytics.extracted(v.cases, "party", "#0*[1-9][0-9]$", "([0-9]+)$", "number").select("case_id", "number")


_CODES = cases(f"'aa' || cast(doc_id % 10 AS string) || ' ' || lpad({NUMBER}, 6, '0')", f"lpad({NUMBER}, 5, '9')", "replace(substr(text, 1, 9), 'ß', 's')", "''", "NULL", f"'Bb' || lpad({NUMBER}, 7, '1')", f"'{'x' * 2}' || {NUMBER}")


@query("p14_codes", f"""SELECT id, c AS canonical, coalesce(regexp_matches(c, '^([A-Z]{{2}}[0-9]{{7}}|[0-9]{{4,6}})$'), false) AS valid, CASE WHEN regexp_matches(c, '^[A-Z]{{2}}[0-9]{{7}}$') THEN left(c, 3) || '-' || substr(c, 4, 3) || '-' || substr(c, 7, 3) ELSE c END AS shown
    FROM (SELECT id, regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') AS c FROM {made_sql(_CODES)})""")
def _(v):
    return made(v, _CODES).select("id", tx.canonical_code(F.col("s")).alias("canonical"), tx.valid_code(F.col("s")).alias("valid"), tx.display_code(F.col("s")).alias("shown"))


@query("p15_alias", "SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS canonical FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def _(v):
    alias = v.table("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("key_"), F.col("n_name").alias("name_"))
    return lookup.canonical_of(v.table("customer"), "c_nationkey", alias, "canonical").select("c_custkey", "canonical")


@query("p16_tenant", with_views("parties") + "SELECT order_id FROM v_parties WHERE len(list_filter(parties, lambda x: contains(x, '00003') OR contains(x, '00007'))) > 0")
def _(v):
    return v.parties.where(lookup.allowed("parties", ["00003", "00007"])).select("order_id")


@query("p17_all_tokens", with_views("cases") + "SELECT case_id FROM v_cases WHERE contains(lower(concat_ws(' ', party, case_type, status)), 'sinistre') AND contains(lower(concat_ws(' ', party, case_type, status)), 'cloture')")
def _(v):
    return v.cases.where(lookup.all_tokens(["party", "case_type", "status"], ["Sinistre", "cloture"])).select("case_id")


@query("p18_chunks_by_id", with_views("chunks") + ", i AS (SELECT chunk_id AS w, row_number() OVER (ORDER BY chunk_id) - 1 AS position FROM (SELECT DISTINCT chunk_id FROM v_chunks) ORDER BY w LIMIT 5) SELECT position, w AS wanted, source_file, true AS found FROM i JOIN v_chunks ON w = chunk_id UNION ALL SELECT 5, 'nothing', NULL, false")
def _(v):
    ids = [r[0] for r in v.chunks.select("chunk_id").distinct().orderBy("chunk_id").limit(5).collect()]
    return lookup.by_ids(v.chunks, [*ids, "nothing"]).select(F.col("position").cast("long").alias("position"), "wanted", "source_file", "found")


@query("p18_document_budget", with_views("chunks") + "SELECT source_file, chunk_index FROM (SELECT *, sum(n_chars + 2) OVER (PARTITION BY source_file ORDER BY chunk_index) AS used FROM v_chunks) WHERE used <= 6000")
def _(v):
    return lookup.document_text(v.chunks, budget=6000).select("source_file", "chunk_index")


@query("j1_chunks_documents", with_views("chunks", "documents") + "SELECT c.chunk_id, d.year, d.status FROM v_chunks c LEFT JOIN v_documents d ON c.source_file = d.source_file AND d.doc_id % 2 = 0")
def _(v):
    d = v.documents.where("doc_id % 2 = 0").select("source_file", "year", "status")
    return v.chunks.join(d, "source_file", "left").select("chunk_id", "year", "status")


@query("j2_explode", with_views("parties") + "SELECT order_id, unnest(parties) AS party FROM v_parties")
def _(v):
    return v.parties.select("order_id", F.explode("parties").alias("party"))


@query("j3_explode_outer", with_views("parties") + ", p AS (SELECT order_id, CASE WHEN order_id % 3 = 0 THEN [] ELSE parties END AS parties FROM v_parties) SELECT order_id, party FROM p LEFT JOIN LATERAL (SELECT unnest(p.parties) AS party) ON true")
def _(v):
    p = v.parties.withColumn("parties", F.when(F.col("order_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("parties")))
    return p.select("order_id", F.explode_outer("parties").alias("party"))


@query("j4_semi", with_views("chunks", "documents") + "SELECT chunk_id FROM v_chunks WHERE source_file IN (SELECT source_file FROM v_documents WHERE year = 2019)")
def _(v):
    return v.chunks.join(v.documents.where("year = 2019").select("source_file"), "source_file", "left_semi").select("chunk_id")


@query("j5_anti", _DIFF + "SELECT path, 'NEW' AS change FROM a WHERE path NOT IN (SELECT path FROM b) UNION ALL SELECT path, 'DELETED' FROM b WHERE path NOT IN (SELECT path FROM a)")
def _(v):
    return incremental.snapshot_diff(*v.snapshots)


@query("j6_code_of_case", with_views("documents") + "SELECT case_id, min(code) AS code, count(*) AS n FROM v_documents WHERE case_id IS NOT NULL GROUP BY 1")
def _(v):
    cases = v.documents.where("case_id is not null").select("case_id").distinct()
    codes = v.documents.groupBy("case_id").agg(F.min("code").alias("code"), F.count("*").alias("n"))
    return cases.join(codes, "case_id", "left")


@query("j7_registry", with_views("documents") + """SELECT source_file, CASE WHEN doc_id % 5 = 2 THEN 'INGERE' WHEN doc_id % 4 = 0 THEN 'REJETE' WHEN doc_id % 2 = 0 THEN 'EN_COURS' ELSE 'DECOUVERT' END AS status,
    CASE WHEN doc_id % 5 <> 2 AND doc_id % 4 = 0 THEN 'DOUBLON' END AS reason, CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS n_chunks, doc_id % 5 = 2 AND doc_id % 4 = 0 AS inconsistent FROM v_documents""")
def _(v):
    d = v.documents.select("doc_id", "source_file")
    rejected = d.where("doc_id % 4 = 0").select("source_file", F.lit("DOUBLON").alias("reason"))
    return incremental.registry(d, rejected, d.where("doc_id % 2 = 0"), d.where("doc_id % 5 = 2")).withColumn("n_chunks", F.col("n_chunks").cast("int"))


@query("a20_registry_counts", with_views("documents") + "SELECT CASE WHEN doc_id % 5 = 2 THEN 'INGERE' WHEN doc_id % 4 = 0 THEN 'REJETE' ELSE 'DECOUVERT' END AS status, count(*) AS n FROM v_documents GROUP BY 1")
def _(v):
    d = v.documents.select("doc_id", "source_file")
    return incremental.registry(d, d.where("doc_id % 4 = 0").select("source_file", F.lit("X").alias("reason")), d.limit(0), d.where("doc_id % 5 = 2")).groupBy("status").agg(F.count("*").alias("n"))


#: Seven artefacts cut from documents: the filter's decisions (one file in 17 is gone), true exact copies, and what later stages left.
_ARTEFACTS = """WITH d AS (SELECT *, source || '/' || doc_id AS source_file, sha256(text) AS sha, ceil(n_chars / 1500.0)::bigint AS slices, doc_id % 17 = 16 AS gone FROM documents),
    s AS (SELECT *, min(doc_id) FILTER (NOT gone) OVER (PARTITION BY sha) AS first_id, count(*) FILTER (NOT gone) OVER (PARTITION BY sha) AS same FROM d),
    k AS (SELECT s.*, CASE WHEN same > 1 AND NOT gone THEN sha END AS sha256, CASE WHEN same > 1 AND NOT gone AND doc_id <> first_id THEN (SELECT f.source_file FROM d f WHERE f.doc_id = first_id) END AS ref_source_file,
        CASE WHEN doc_id % 5 < 3 THEN slices ELSE 0 END AS written, CASE WHEN doc_id % 5 < 2 THEN slices + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END WHEN doc_id % 23 = 0 THEN slices ELSE 0 END AS stored FROM s),
    j AS (SELECT *, CASE WHEN ref_source_file IS NOT NULL THEN 'DOUBLON_EXACT' WHEN doc_id % 10 = 4 THEN 'FILTRAGE_PHOTO' WHEN doc_id % 10 = 5 THEN 'FILTRAGE_AUTRE' WHEN doc_id % 10 = 7 THEN 'FILTRAGE_GOOGLE_NATIF' END AS rejected, doc_id % 10 = 8 AS failed FROM k),
    r AS (SELECT source_file, doc_id, sha256, CASE WHEN sha256 IS NOT NULL THEN length(text) END AS size, CASE WHEN doc_id % 3 = 0 THEN 'sig' || doc_id END AS signature, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS chars, ref_source_file, rejected, stored, written, gone,
        CASE WHEN gone THEN 'SUPPRIME' WHEN stored > 0 THEN 'INGERE' WHEN written > 0 THEN 'ERREUR' WHEN rejected IS NOT NULL THEN 'REJETE' WHEN failed THEN 'ERREUR' ELSE 'REJETE' END AS status,
        CASE WHEN gone OR stored > 0 THEN NULL WHEN written > 0 THEN 'CHARGEMENT_KO' WHEN rejected IS NOT NULL THEN rejected WHEN failed THEN 'COPIE_KO' WHEN doc_id % 7 = 0 THEN 'TEXTE_VIDE' WHEN n_chars < 200 THEN 'NON_EXPLOITABLE' ELSE 'DOUBLON_PROCHE' END AS reason,
        CASE WHEN stored > 0 THEN stored WHEN written > 0 THEN written END AS n_chunks, CASE WHEN stored > 0 OR written > 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'AUTRE' WHEN written > 0 THEN 'T' || (doc_id % 4) END END AS doc_type,
        CASE WHEN gone THEN '' ELSE concat_ws(',', CASE WHEN (stored > 0 OR written > 0) AND rejected IS NOT NULL THEN 'INGERE_MALGRE_' || rejected END, CASE WHEN stored > 0 AND written = 0 THEN 'INGERE_HORS_SHARD' END, CASE WHEN stored > 0 AND written > 0 AND stored <> written THEN 'CHUNKS_HORS_SHARD' END) END AS drift FROM j)"""


def _registry(v):
    d = v.table("documents").withColumn("source_file", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).withColumn("slices", F.ceil(F.col("n_chars") / F.lit(1500.0)).cast("int"))
    seen = d.where("doc_id % 17 <> 16")
    kind = F.col("doc_id") % 10
    decision = F.when(kind.isin(4, 5), "EXCLURE").when(kind == 7, "EXCLURE_GOOGLE_NATIF").when(kind == 8, "ERREUR_COPIE").otherwise("GARDER")
    decisions = seen.select("source_file", decision.alias("decision"), F.when(kind == 4, ".JPG").otherwise(".pdf").alias("extension"))
    hashed = seen.select("source_file", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.length("text").cast("long").alias("size"))
    groups = hashed.groupBy("sha256").agg(F.min_by("source_file", "doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    chunk = lambda rows, n: rows.where(n > 0).select("source_file", "doc_id", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    stored = F.when(F.col("doc_id") % 5 < 2, F.col("slices") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)).when(F.col("doc_id") % 23 == 0, F.col("slices")).otherwise(0)
    chunks = chunk(d.where("doc_id % 5 < 3"), F.col("slices")).withColumn("doc_type", F.concat(F.lit("T"), (F.col("doc_id") % 4).cast("string")))
    return registry.registry(
        decisions, hashed.join(groups, "sha256"), d.where("doc_id % 3 = 0").select("source_file", F.concat(F.lit("sig"), F.col("doc_id").cast("string")).alias("signature")),
        d.where("doc_id % 7 <> 0").select("source_file", F.col("n_chars").alias("chars"), (F.col("n_chars") < 200).alias("skipped")), chunks, d.where("doc_id % 11 = 0").select("source_file", F.lit("AUTRE").alias("doc_type")), chunk(d, stored), previous=d,
    )


@query("j7_artefacts", _ARTEFACTS + "SELECT source_file, status, reason, sha256, size, signature, chars, n_chunks, doc_type, ref_source_file, drift FROM r")
def _(v):
    return _registry(v).drop("step").withColumn("drift", F.array_join("drift", ","))


@query("i7_counters", _ARTEFACTS + "SELECT kind, name, count(*) AS n FROM (SELECT 'status' AS kind, status AS name FROM r UNION ALL SELECT 'reason', reason FROM r UNION ALL SELECT 'drift', unnest(string_split(drift, ',')) FROM r WHERE drift <> '') WHERE name IS NOT NULL GROUP BY 1, 2")
def _(v):
    return registry.counters(_registry(v))


@query("j8_property_list", with_views("documents", "chunks", "cases") + "SELECT code, count(DISTINCT d.source_file) AS n_documents, (SELECT count(*) FROM v_chunks c WHERE c.code = d.code) AS n_chunks, d.code IN (SELECT code FROM v_cases) AS has_cases FROM v_documents d GROUP BY code")
def _(v):
    return overview.property_list(v.documents, v.chunks, v.cases).select("code", "n_documents", "n_chunks", "has_cases")


def _parties(v: Views) -> DataFrame:
    """Cases whose party is a word for each customer, every other one with a second word: one set of words may hold another."""
    word = F.translate(F.substring("party", 10, 20), "0123456789", "abcdefghij")
    return v.cases.withColumn("party", F.concat_ws(" ", word, F.when(F.col("case_id").cast("long") % 2 == 0, F.lower("status"))))


_EVENTS = """, e AS (SELECT case_id, code, case_type, opened, amount, translate(substr(party, 10, 20), '0123456789', 'abcdefghij') AS w, list_sort(list_distinct(regexp_extract_all(translate(substr(party, 10, 20), '0123456789', 'abcdefghij') || CASE WHEN case_id::bigint % 2 = 0 THEN ' ' || lower(status) ELSE '' END, '[a-z]{3,}'))) AS names FROM v_cases),
    link AS (SELECT a.case_id AS a, b.case_id AS b FROM e a JOIN e b ON a.code = b.code AND a.case_type = b.case_type AND a.w = b.w AND a.case_id < b.case_id AND abs(datediff('day', a.opened, b.opened)) <= 30 AND (list_has_all(a.names, b.names) OR list_has_all(b.names, a.names))) """


@query("j10_event_links", with_views("cases") + _EVENTS + "SELECT * FROM link")
def _(v):
    return entities.event_links(_parties(v))


@query("j12_only_candidate", with_views("cases") + """, e AS (SELECT * FROM v_cases WHERE case_id::bigint % 2 = 0), f AS (SELECT * FROM v_cases WHERE case_id::bigint % 2 = 1), p AS (SELECT e.case_id AS erp_id, f.case_id, count(*) OVER (PARTITION BY e.case_id) AS n FROM e JOIN f ON e.code = f.code AND e.opened = f.opened AND e.case_type = f.case_type) SELECT erp_id, case_id FROM p WHERE n = 1""")
def _(v):
    return entities.only_candidate(v.cases.where("cast(case_id as bigint) % 2 = 0"), v.cases.where("cast(case_id as bigint) % 2 = 1"))


@query("j13_linked_names", "SELECT o_custkey AS code, array_to_string(list_sort(list(o_orderpriority)), ',') AS names FROM orders GROUP BY 1")
def _(v):
    hub = v.table("orders").groupBy(F.col("o_custkey").alias("code")).agg(F.collect_list("o_orderkey").alias("ids"))
    return lookup.linked(hub, v.table("orders"), "ids", "o_orderkey", F.col("o_orderpriority"), "names").select("code", F.array_join("names", ",").alias("names"))


# --- windows and ranking ---------------------------------------------------------------------

_TERMS = ("the", "tion", "der")
_LEX = " + ".join(f"CASE WHEN contains(lower(c.text), '{t}') THEN 0.1::double ELSE 0.0::double END" for t in _TERMS)
_SCORED = with_views("chunks", "documents") + f""", q AS (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT c.chunk_id, c.code, c.doc_type, d.doc_group, d.year, c.source_file, c.chunk_index, c.text,
    list_dot_product(c.embedding::double[], q.v) / (sqrt(list_dot_product(c.embedding::double[], c.embedding::double[])) * sqrt(list_dot_product(q.v, q.v))) AS vec, {_LEX} AS l FROM v_chunks c LEFT JOIN v_documents d ON c.source_file = d.source_file, q
    WHERE c.n_chars >= 500 AND NOT c.excluded), t AS (SELECT *, l / (l + 1) AS lex FROM s),
    k AS (SELECT *, row_number() OVER (ORDER BY round(vec, 9) DESC, chunk_id) AS vec_rank, row_number() OVER (ORDER BY round(lex, 9) DESC, chunk_id) AS lex_rank FROM t),
    f AS (SELECT *, 1.0::double / (60 + vec_rank) + 1.0::double / (60 + lex_rank) + CASE WHEN doc_type = 'RCP' THEN 0.01::double ELSE 0.0::double END AS rrf FROM k),
    g AS (SELECT *, row_number() OVER (PARTITION BY doc_group ORDER BY rrf DESC, chunk_id) AS gr FROM f) """


def scored(v: Views) -> DataFrame:
    """Chunks that may be found, with both scores for the flagship's query."""
    one = v.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("query")).limit(1)
    docs = v.documents.select("source_file", "doc_group", "year")
    rows = search.base(v.chunks).join(docs, "source_file", "left").crossJoin(F.broadcast(one))  # one row
    return rows.withColumn("query_id", F.lit(0)).withColumn("vec", F.round(search.cosine(F.col("embedding"), F.col("query")), 9)).withColumn("lex", F.round(search.lexical(F.col("text"), _TERMS), 9)).drop("embedding", "query")


def fused(v: Views) -> DataFrame:
    return search.fused(search.ranked(scored(v)), search.type_boost(["RCP"]))


@query("flagship_hybrid_search", _SCORED + "SELECT chunk_id, code, doc_type, year, round(rrf, 6) AS rrf, round(vec, 4) AS vec, round(lex, 4) AS lex FROM g WHERE gr <= 3 AND vec >= 0.15 ORDER BY g.rrf DESC, chunk_id LIMIT 12")
def flagship(v):
    found = search.top_fused(scored(v), lambda rows: search.best(search.diversified(rows, *search.MODES["balanced"]), 12), 12, search.type_boost(["RCP"]), most_boost=0.01)
    return found.select("chunk_id", "code", "doc_type", "year", F.round("rrf", 6).alias("rrf"), F.round("vec", 4).alias("vec"), F.round("lex", 4).alias("lex"))


@query("t1_cosine_top_k", with_views("chunks") + """SELECT chunk_id, round(list_dot_product(c.embedding::double[], q.v) / (sqrt(list_dot_product(c.embedding::double[], c.embedding::double[])) * sqrt(list_dot_product(q.v, q.v))), 6) AS vec FROM v_chunks c, (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0) q ORDER BY vec DESC, chunk_id LIMIT 200""")
def _(v):
    one = v.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("query")).limit(1)
    rows = v.chunks.crossJoin(F.broadcast(one)).select("chunk_id", F.round(search.cosine(F.col("embedding"), F.col("query")), 6).alias("vec"))  # one row
    return search.top_k(rows, [F.desc("vec"), F.col("chunk_id")], 200)


@query("t4_rank_fusion", _SCORED + "SELECT chunk_id, vec_rank::int AS vec_rank, lex_rank::int AS lex_rank, round(rrf, 9) AS rrf FROM f")
def _(v):
    return fused(v).select("chunk_id", "vec_rank", "lex_rank", F.round("rrf", 9).alias("rrf"))


@query("t6_diversity", _SCORED + "SELECT chunk_id, gr::int AS group_rank FROM g WHERE gr <= 2 AND vec >= 0.1")
def _(v):
    return search.diversified(fused(v), 2, 0.1).select("chunk_id", "group_rank")


@query("p12_threshold_bypass", _SCORED + "SELECT chunk_id FROM g WHERE gr <= 2 AND (vec >= 0.2 OR doc_type = 'RCP')")
def _(v):
    return search.diversified(fused(v), 2, 0.2, bypass=F.col("doc_type") == "RCP").select("chunk_id")


@query("w6_first_of_text", _SCORED + "SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY trim(left(text, 300)) ORDER BY rrf DESC, chunk_id) AS r FROM f) WHERE r = 1")
def _(v):
    return search.first_of_text(fused(v)).select("chunk_id")


@query("w7_source_cap", _SCORED + "SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY rrf DESC, chunk_id) AS r FROM f) WHERE r <= 2")
def _(v):
    return search.capped_by_source(fused(v), 2).select("chunk_id")


@query("t9_balance", _SCORED + ", b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY rrf DESC, chunk_id) <= 2 THEN 0 ELSE 1 END AS late FROM f WHERE code IN ('src1', 'src2', 'src3')) SELECT chunk_id, code FROM b ORDER BY late, rrf DESC, chunk_id LIMIT 8")
def _(v):
    return search.balanced(fused(v).where(F.col("code").isin("src1", "src2", "src3")), 3, 8).select("chunk_id", "code")


@query("t10_quota", _SCORED + ", b AS (SELECT *, doc_type = 'FACTURE' AND row_number() OVER (PARTITION BY doc_type = 'FACTURE' ORDER BY rrf DESC, chunk_id) <= 3 AS first FROM f) SELECT chunk_id, doc_type FROM b ORDER BY first DESC, rrf DESC, chunk_id LIMIT 10")
def _(v):
    return search.with_quota(fused(v), 10, F.col("doc_type") == "FACTURE", 3).select("chunk_id", "doc_type")


@query("t11_rerank", _SCORED + """, p AS (SELECT *, (chunk_index * 37 % 100) / 100.0::double AS rerank FROM f ORDER BY rrf DESC, chunk_id LIMIT 200), m AS (SELECT *, min(rrf) OVER () AS lo, max(rrf) OVER () AS hi FROM p) SELECT chunk_id, round(0.25::double * (rrf - lo) / (hi - lo) + 0.75::double * rerank, 6) AS final FROM m ORDER BY final DESC, chunk_id LIMIT 20""")
def _(v):
    rows = fused(v).withColumn("rerank", (F.col("chunk_index") * 37 % 100) / F.lit(100.0))
    return search.reranked(rows).where("in_pool").select("chunk_id", F.round("final", 6).alias("final")).orderBy(F.desc("final"), "chunk_id").limit(20)


@query("t12_rank_rerank", _SCORED + ", n AS (SELECT *, (chunk_index * 37 % 100) / 100.0::double AS rerank, row_number() OVER (ORDER BY rrf DESC, chunk_id) AS r, count(*) OVER () AS n FROM f) SELECT chunk_id, round(0.4::double * (1 - (r - 1)::double / greatest(1, n - 1)) + 0.6::double * rerank, 6) AS final FROM n")
def _(v):
    rows = fused(v).withColumn("rerank", (F.col("chunk_index") * 37 % 100) / F.lit(100.0))
    return search.rank_normalised(rows).select("chunk_id", F.round("final", 6).alias("final"))


@query("t13_yearly", _SCORED + """, o AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY round(vec, 9) DESC, chunk_id) AS vr, row_number() OVER (PARTITION BY year ORDER BY round(lex, 9) DESC, chunk_id) AS lr FROM t WHERE year BETWEEN 2016 AND 2020),
    e AS (SELECT *, 1.0::double / (60 + vr) + 1.0::double / (60 + lr) + CASE WHEN doc_type = 'RCP' THEN 0.01::double ELSE 0.0::double END AS rrf FROM o), y AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY year ORDER BY rrf DESC, chunk_id) <= 5 THEN 0 ELSE 1 END AS late FROM e) SELECT chunk_id, year, round(rrf, 9) AS rrf FROM y ORDER BY late, y.rrf DESC, chunk_id LIMIT 40""")
def _(v):
    """Each year of a span is a query of its own, with its own ranks."""
    by_year = search.fused(search.ranked_by_year(scored(v), 2016, 2020), search.type_boost(["RCP"]))
    return search.yearly(by_year, 2016, 2020, 40).select("chunk_id", "year", F.round("rrf", 9).alias("rrf"))


@query("t14_status_order", with_views("cases") + "SELECT case_id, CASE status WHEN 'EN_COURS' THEN 1 WHEN 'EN_ATTENTE' THEN 2 WHEN 'CLOTURE' THEN 3 ELSE 4 END AS status_rank FROM v_cases ORDER BY status_rank, opened DESC NULLS LAST, case_id LIMIT 50")
def _(v):
    return lookup.by_status(v.cases).select("case_id", "status_rank").limit(50)


@query("t15_relevance", with_views("cases") + ", r AS (SELECT case_id, 3 * contains(h, '77')::int + 2 * contains(h, 'customer#00000001')::int + contains(h, 'sinistre')::int AS score FROM (SELECT case_id, lower(concat_ws(' ', case_id, party, case_type)) AS h FROM v_cases)) SELECT * FROM r ORDER BY score DESC, case_id LIMIT 30")
def _(v):
    hay = F.lower(F.concat_ws(" ", "case_id", "party", "case_type"))
    return v.cases.select("case_id", lookup.relevance(["77"], ["customer#00000001"], ["sinistre"], hay).alias("score")).orderBy(F.desc("score"), "case_id").limit(30)


@query("t17_directory", "SELECT n_nationkey, CASE WHEN lower(n_name) = 'nation_1' THEN 10 WHEN contains(lower(n_name), 'nation_1') OR contains('nation_1', lower(n_name)) THEN 5 ELSE 0 END AS score FROM nation WHERE contains(lower(n_name), 'nation_1') OR contains('nation_1', lower(n_name)) OR NOT EXISTS (SELECT 1 FROM nation WHERE contains(lower(n_name), 'nation_1') OR contains('nation_1', lower(n_name)))")
def _(v):
    return lookup.directory(v.table("nation"), ["n_name"], "nation_1", "n_nationkey").select("n_nationkey", "score")


@query("t21_history", """SELECT conv_id, turn FROM (SELECT *, coalesce(sum((role = 'user')::int) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS asked, sum(length(CASE WHEN role = 'assistant' THEN left(text, 4000) ELSE text END)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE asked < 3 AND used <= 16000""")
def _(v):
    return lookup.history(v.turns).select("conv_id", "turn")


@query("w5_discovery", with_views("chunks") + """, n AS (SELECT *, round(list_dot_product(c.embedding::double[], q.v) / (sqrt(list_dot_product(c.embedding::double[], c.embedding::double[])) * sqrt(list_dot_product(q.v, q.v))), 9) AS vec FROM v_chunks c, (SELECT embedding::double[] AS v FROM embeddings WHERE vec_id = 0) q WHERE NOT excluded ORDER BY vec DESC, chunk_id LIMIT 200) SELECT code, count(*) AS n_chunks, count(DISTINCT source_file) AS n_documents, round(max(vec), 4) AS similarity FROM n GROUP BY 1""")
def _(v):
    vector = v.table("embeddings").where("vec_id = 0").select("embedding").first()[0]
    return search.discover(v.chunks, [float(x) for x in vector]).select("code", "n_chunks", "n_documents", "similarity")


@query("s2_ordered_union", with_views("parties") + "SELECT order_id, len(list_distinct(list_concat(parties, ['Supplier#000000001']))) AS n FROM v_parties")
def _(v):
    return v.parties.select("order_id", F.size(F.array_union("parties", F.array(F.lit("Supplier#000000001")))).cast("long").alias("n"))


# --- texts -----------------------------------------------------------------------------------


@query("f3_canonical", f"SELECT doc_id, md5({_canonical('text')}) AS hash FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(tx.canonical(F.col("text")).cast("binary")).alias("hash"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')))"


@query("f4_shingles", f"SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len({_GRAMS}) END AS n FROM (SELECT doc_id, list_filter(string_split({_canonical('text')}, ' '), lambda x: x <> '') AS w FROM documents)")
def _(v):
    return v.table("documents").select("doc_id", F.size(tx.shingles(tx.canonical(F.col("text")))).cast("long").alias("n"))


@query("f7_slug", with_views("cases") + "SELECT case_id, left(upper(trim(regexp_replace(party, '[^A-Za-z0-9]+', '_', 'g'), '_')), 50) AS slug FROM v_cases")
def _(v):
    return v.cases.select("case_id", tx.slug(F.col("party")).alias("slug"))


@query("f10_unit_number", with_views("cases") + "SELECT case_id, nullif(regexp_extract(case_id || ' x', '\\b(\\d{2,4})\\b', 1), '') AS unit FROM v_cases")
def _(v):
    return v.cases.select("case_id", tx.unit_number(F.concat("case_id", F.lit(" x"))).alias("unit"))


_UNCLEAN = cases("' ' || substr(text, 1, 20) || '  '", "'null'", "''", "NULL", "'NULL  '", "source || chr(1)", "'   '", "substr(text, 5, 5)")


@query("f14_clean", f"SELECT id, CASE WHEN trim(s) = '' OR lower(trim(s)) = 'null' THEN NULL ELSE trim(s) END AS s FROM {made_sql(_UNCLEAN)}")
def _(v):
    return made(v, _UNCLEAN).select("id", tx.clean(F.col("s")).alias("s"))


@query("f15_paths", with_views("files") + "SELECT path, regexp_extract(path, '[^/]*$') AS base, regexp_replace(path, '/?[^/]*$', '') AS folder FROM v_files")
def _(v):
    return v.files.select("path", tx.basename(F.col("path")).alias("base"), tx.dirname(F.col("path")).alias("folder"))


@query("f22_digests", "SELECT doc_id, left(md5(text), 12) AS short, sha256(text) AS sha FROM documents")
def _(v):
    c = F.col("text").cast("binary")
    return v.table("documents").select("doc_id", F.substring(F.md5(c), 1, 12).alias("short"), F.sha2(c, 256).alias("sha"))


def _sql_dates(text: str) -> str:
    """Dates of a text as a sorted list of year-month-day strings."""
    full = lambda y: f"CASE WHEN length({y}) = 2 THEN CASE WHEN {y}::int < 50 THEN 2000 ELSE 1900 END + {y}::int ELSE {y}::int END"
    one = lambda pattern, y, m, d, fold="": f"list_transform(regexp_extract_all({fold or text}, '{pattern}', 0), lambda x: {{'y': regexp_extract(x, '{pattern}', {y}), 'm': regexp_extract(x, '{pattern}', {m}), 'd': regexp_extract(x, '{pattern}', {d})}})"
    plain = [one(r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\b", 3, 2, 1), one(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", 1, 2, 3), one(r"\b((?:19|20)\d{2})([01]\d)([0-3]\d)\b", 1, 2, 3)]
    named = one(rf"\b(\d{{1,2}})(?:er)? ({'|'.join(dt.MONTHS)}) (\d{{4}})\b", 3, 2, 1, f"lower({_accents(text)})")
    months = "[" + ", ".join(f"'{m}'" for m in dt.MONTHS) + "]"
    number = f"list_transform(list_concat({', '.join(plain)}), lambda x: [{full('x.y')}, x.m::int, x.d::int])"
    return f"list_sort(list_distinct(list_filter(list_concat({number}, list_transform({named}, lambda x: [x.y::int, list_position({months}, x.m)::int, x.d::int])), lambda x: x[2] BETWEEN 1 AND 12 AND x[3] BETWEEN 1 AND 31)))"


_DATED = cases(
    f"'le ' || {DAY} || '/' || {MONTH} || '/' || {YEAR} || ' ' || substr(text, 1, 100)", f"substr(text, 1, 100) || ' ' || {DAY} || '.' || lpad({MONTH}, 2, '0') || '.' || substr({YEAR}, 3, 2) || ' et ' || cast(50 + doc_id % 50 AS string) || '-13-2020'",
    f"{YEAR} || '-' || {MONTH} || '-' || {DAY} || ' ' || substr(text, 1, 50) || ' ' || {YEAR} || lpad({MONTH}, 2, '0') || lpad({DAY}, 2, '0')", f"substr(text, 1, 50) || ' ' || {DAY} || ' ' || CASE doc_id % 3 WHEN 0 THEN 'Février' WHEN 1 THEN 'août' ELSE 'décembre' END || ' ' || {YEAR} || '.'",
    f"'45/13/2020 32-1-{YEAR} 31-02-' || {YEAR}", "text", "NULL", f"'1er mai ' || {YEAR} || ', 12/12/49, 1-1-50, ' || {DAY} || '/' || {MONTH} || '/' || {YEAR} || '/1'",
)


@query("dt1_dates", f"SELECT id, coalesce(array_to_string(list_transform({_sql_dates('s')}, lambda x: array_to_string(x, '-')), ','), '') AS dates FROM {made_sql(_DATED)}")
def _(v):
    c = F.col("s")
    found = F.transform(dt.dates(c, tx.fold_latin(c)), lambda x: F.concat_ws("-", x["y"], x["m"], x["d"]))
    return made(v, _DATED).select("id", F.coalesce(F.array_join(found, ","), F.lit("")).alias("dates"))


_DATES = cases(YEAR, f"{YEAR} || '-' || lpad({MONTH}, 2, '0')", f"{YEAR} || '-05-06T10'", f"{YEAR} || '-13'", "substr(text, 1, 10)", "NULL", f"' ' || {YEAR} || '-' || {MONTH} || '-' || {DAY} || ' '", f"{YEAR} || '-' || {MONTH}", f"{YEAR} || '-02-' || cast(27 + doc_id % 5 AS string)", "''")


@query("dt3_padded_dates", f"""SELECT id, try_cast(CASE WHEN regexp_full_match(d, '\\d{{4}}') THEN d || '-01-01' WHEN regexp_full_match(d, '\\d{{4}}-\\d{{2}}') THEN d || '-01' WHEN regexp_full_match(d, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN d END AS date) AS d,
    CASE WHEN regexp_full_match(d, '\\d{{4}}(-\\d{{1,2}})?(-\\d{{1,2}})?') THEN left(d, 4) || '-' || lpad(coalesce(nullif(split_part(d, '-', 2), ''), '1'), 2, '0') || '-' || lpad(coalesce(nullif(split_part(d, '-', 3), ''), '1'), 2, '0') END AS loose FROM (SELECT id, trim(s) AS d FROM {made_sql(_DATES)})""")
def _(v):
    return made(v, _DATES).select("id", dt.padded(F.col("s")).alias("d"), dt.padded_text(F.col("s")).alias("loose"))


@query("dt6_years", with_views("documents") + "SELECT doc_id, unnest(range(year, year + 3))::int AS y FROM v_documents")
def _(v):
    return v.documents.select("doc_id", F.explode(dt.years(F.col("year"), F.col("year") + 2)).alias("y"))


_PHRASES = ("x", "Approbation des comptes", "Renouvellement des membres du conseil syndical", "Rapport d''activité du conseil syndical", "Travaux de toiture", "Désignation du Secrétaire de séance", "donner quitus", "Candidature de Madame Zoé", "Dispense de mise en concurrence")
_MINUTES = cases(*[f"'{p} ' || substr(text, 1, 700)" for p in _PHRASES], "substr(text, 1, 490) || ' Approbation des comptes'", "substr(text, 1, 700)", "NULL").replace("''activité", "' || chr(39) || 'activité")
_BY_PATTERN = " ".join(f"WHEN regexp_matches(left(s, 500), '(?i){p}') THEN '{name}'" for name, patterns in chunking.CATEGORIES.items() for p in patterns)


@query("x14_category", f"SELECT id, CASE WHEN id % 13 = 12 THEN NULL WHEN id % 5 = 0 THEN 'PROCEDURE_AG' {_BY_PATTERN} ELSE 'FOND' END AS category FROM {made_sql(_MINUTES)}")
def _(v):
    """Phrases of minutes before and behind the texts of documents; every thirteenth is no minutes, every fifth a preamble."""
    kind = F.when(F.col("id") % 13 == 12, "RCP").otherwise("PV_AG")
    return made(v, _MINUTES).select("id", chunking.category(F.col("s"), kind, F.col("id") % 5, chunking.CATEGORIES).alias("category"))


@query("x1_readable", f"SELECT doc_id, {_readable('text')} AS reason FROM documents")
def _(v):
    return v.table("documents").select("doc_id", chunking.readable(F.col("text"))["reason"].alias("reason"))


@query("x15_chunk_ids", with_views("chunks") + ", o AS (SELECT *, row_number() OVER (PARTITION BY source_file, text ORDER BY chunk_index) - 1 AS k FROM v_chunks) SELECT source_file, chunk_index, left(md5(source_file || '|' || text || CASE WHEN k > 0 THEN '#' || k ELSE '' END), 12) AS chunk_id FROM o")
def _(v):
    return chunking.identified(v.chunks.drop("chunk_id", "embedding")).select("source_file", "chunk_index", "chunk_id")


@query("x7_chunk_by_size")
def _(v):
    docs = v.documents.select("doc_id", "source_file", "doc_type").join(v.table("documents").select("doc_id", "text"), "doc_id")
    return chunking.chunked(docs)


@query("x2_file_verdict", f"""WITH b AS (SELECT doc_id, text, ceil(length(text) / 1000.0)::int AS blocks FROM documents), n AS (SELECT *, greatest(1, least(100, blocks)) AS n FROM b), t AS (SELECT *, greatest(1, blocks // n)::int AS step FROM n),
    g AS (SELECT *, len(list_filter(list_transform(range(n), lambda k: substr(text, (k * step * 1000 + 1)::int, 1000)), lambda x: ({_readable('x')}) = 'ok')) AS good FROM t)
    SELECT doc_id, CASE WHEN text IS NULL OR length(trim(text)) < 30 THEN 'SKIP' WHEN good / n::double >= 0.10 THEN 'OK' ELSE 'PLACEHOLDER' END AS verdict FROM g""")
def _(v):
    return v.table("documents").select("doc_id", chunking.file_verdict(F.col("text")).alias("verdict"))


# --- copies, cases, state --------------------------------------------------------------------


@query("e1_exact_copies", with_views("files") + ", r AS (SELECT *, row_number() OVER (PARTITION BY size, sha ORDER BY depth, lower(path), path) AS k, first_value(path) OVER (PARTITION BY size, sha ORDER BY depth, lower(path), path) AS p FROM v_files WHERE size > 0) SELECT path, k = 1 AS keep, CASE WHEN k > 1 THEN p END AS ref_path FROM r UNION ALL SELECT path, true, NULL FROM v_files WHERE size = 0")
def _(v):
    return dedup.exact_copies(v.files).select("path", "keep", "ref_path")


@query("j14_copy_groups", with_views("files") + "SELECT sha, count(*) AS n FROM v_files WHERE size IN (SELECT size FROM v_files GROUP BY 1 HAVING count(*) > 1) GROUP BY 1 HAVING count(*) > 1")
def _(v):
    sizes = v.files.groupBy("size").agg(F.count("*").alias("c")).where("c > 1").select("size")
    return v.files.join(sizes, "size", "left_semi").groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")


#: Every pair of a language is compared, with the rules of confirmation in their order; names tell two months apart.
_ALL_COPIES = f"""WITH RECURSIVE e AS (SELECT doc_id, lang, text, length(text) AS chars, doc_id % 2 AS month, {_canonical("text")} AS norm FROM documents),
    w AS (SELECT *, string_split(norm, ' ') AS words, {_sql_dates("text")} AS dates FROM e),
    p AS (SELECT *, CASE WHEN norm = '' THEN [] WHEN len(words) < 5 THEN [norm] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) END AS sh FROM w),
    pairs AS (SELECT a.lang, a.doc_id AS x, b.doc_id AS y, a.norm = b.norm AS same, a.dates = b.dates AS dated, len(list_intersect(a.sh, b.sh)) AS met, len(a.sh) + len(b.sh) AS total, least(a.chars, b.chars) / greatest(a.chars, b.chars)::double AS ratio FROM p a JOIN p b ON a.lang = b.lang AND a.doc_id <> b.doc_id AND a.month = b.month AND least(a.chars, b.chars) >= 100 AND (a.norm = b.norm OR least(a.chars, b.chars) >= 0.9 * greatest(a.chars, b.chars))),
    copies AS (SELECT lang, x, y, CASE WHEN same THEN 1.0::double ELSE met / (total - met)::double END AS score FROM pairs WHERE same OR (met / (total - met)::double >= 0.9 AND dated AND ratio >= 0.9))"""


def _copy_profiles(v):
    name = F.concat(F.lit("rapport "), F.when(F.col("doc_id") % 2 == 0, "08-2023").otherwise("09-2023"), F.lit(".pdf"))
    return dedup.profile(v.table("documents").select("doc_id", "lang", "text", name.alias("file_name")))


@query("e2_copy_groups", _ALL_COPIES + """, reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, c.y FROM reach r JOIN copies c ON r.b = c.x)
    SELECT d.lang, d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS "group", (SELECT count(*) FROM copies WHERE x = d.doc_id) AS links FROM documents d""")
def _(v):
    """Every document with the group of copies it is in, and the number of its copies."""
    return dedup.copy_groups(_copy_profiles(v), ["lang"])


@query("e2_confirmed_copies", _ALL_COPIES + """, c AS (SELECT p.*, min(p.doc_id) OVER (PARTITION BY lang, norm, month, chars >= 100) AS g, min(p.doc_id) OVER (PARTITION BY lang, norm, month, chars, dates) AS k FROM p)
    SELECT lang, g AS a, doc_id AS b, true AS copy, 1.0::double AS score, 'TEXTE_IDENTIQUE' AS reason FROM c WHERE g <> doc_id AND chars >= 100
    UNION SELECT s.lang, x, y, true, round(s.score, 9), 'QUASI_IDENTIQUE' FROM copies s JOIN c a ON a.doc_id = x AND a.k = x JOIN c b ON b.doc_id = y AND b.k = y WHERE x < y AND a.norm <> b.norm""")
def _(v):
    return dedup.confirmed_pairs(_copy_profiles(v), ["lang"]).where("copy").withColumn("score", F.round("score", 9))


@query("e10_case_groups", with_views("documents") + "SELECT code || '_' || doc_type || '_' || upper(subtype) || '_' || year AS case_id, min(code) AS code, arg_min(status, doc_id) FILTER (status IS NOT NULL) AS party, min(date) AS opened, count(*) AS n FROM v_documents GROUP BY code, doc_type, subtype, year")
def _(v):
    docs = v.documents.select("code", F.col("doc_type").alias("case_type"), F.col("subtype").alias("folder"), F.col("status").alias("party"), F.make_date("year", F.lit(1), F.lit(1)).alias("opened_"), F.col("date").alias("opened"), F.col("date").alias("closed"), F.col("doc_id").alias("seq"), "source_file")
    return entities.case_groups(docs).select("case_id", "code", "party", "opened", F.size("documents").cast("long").alias("n"))


@query("e11_clusters", with_views("cases").replace("WITH ", "WITH RECURSIVE ") + _EVENTS + """, two_way AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach AS (SELECT case_id AS a, case_id AS b FROM e UNION SELECT r.a, x.b FROM reach r JOIN two_way x ON r.b = x.a), c AS (SELECT a AS case_id, min(b) AS cluster FROM reach GROUP BY 1)
    SELECT cluster, min(case_id) AS case_id, min(opened) AS opened, max(opened) AS closed, count(*) AS members, array_to_string(list_sort(list(case_id)), ',') AS documents FROM c JOIN e USING (case_id) GROUP BY 1""")
def _(v):
    c = _parties(v)
    rows = entities.clusters(c, entities.event_links(c)).withColumn("documents", F.array("case_id")).withColumn("closed", F.col("opened"))
    return entities.merged(rows).select("cluster", F.array_min("documents").alias("case_id"), "opened", "closed", "members", F.array_join("documents", ",").alias("documents"))


@query("e12_erp_match", with_views("cases") + _EVENTS + """, p AS (SELECT a.case_id AS erp_id, b.case_id, abs(datediff('day', a.opened, b.opened)) AS gap FROM e a JOIN e b ON a.code = b.code AND a.w = b.w AND a.case_id::bigint % 3 = 0 AND b.case_id::bigint % 3 <> 0 AND abs(datediff('day', a.opened, b.opened)) <= 30 AND (list_has_all(a.names, b.names) OR list_has_all(b.names, a.names))),
    one AS (SELECT *, row_number() OVER (PARTITION BY erp_id ORDER BY gap, case_id) AS r FROM p), two AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY gap, erp_id) AS q FROM one WHERE r = 1) SELECT erp_id, case_id, gap::int AS gap FROM two WHERE q = 1""")
def _(v):
    c = _parties(v)
    return entities.matched(c.where("cast(case_id as bigint) % 3 = 0"), c.where("cast(case_id as bigint) % 3 <> 0"))


@query("e14_closed_types", with_views("documents") + "SELECT doc_id, CASE WHEN doc_type IN ('PV_AG', 'CONTRAT', 'RCP') THEN doc_type ELSE 'AUTRE' END AS doc_type FROM v_documents")
def _(v):
    return v.documents.select("doc_id", analytics.closed_type(F.col("doc_type"), ["PV_AG", "CONTRAT", "RCP"]).alias("doc_type"))


@query("i1_snapshot_types", _DIFF + f"SELECT DISTINCT {'([' + ','.join(repr(t) for t in DOC_TYPES) + '])[(doc_id % 5)::int + 1]'} AS doc_type FROM a WHERE path NOT IN (SELECT path FROM b)")
def _(v):
    before, after = v.snapshots
    return after.join(before.select("path"), "path", "left_anti").select("doc_type").distinct()


@query("i4_pending", with_views("chunks") + "SELECT chunk_id FROM v_chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM v_chunks WHERE chunk_index = 0)")
def _(v):
    return incremental.pending(v.chunks.select("chunk_id"), v.chunks.where("chunk_index = 0").select("chunk_id"), "chunk_id")


@query("i5_stale", with_views("documents") + ", c AS (SELECT code, count(*) AS n FROM v_documents GROUP BY 1) SELECT code, CASE WHEN code = 'src1' THEN 'missing' ELSE 'n:+2' END AS reasons FROM c WHERE code IN ('src1', 'src2')")
def _(v):
    now = v.documents.groupBy("code").agg(F.count("*").alias("n"))
    stored = now.where("code <> 'src1'").withColumn("n", F.col("n") - F.when(F.col("code") == "src2", 2).otherwise(0))
    return incremental.stale(stored, now, "code", ["n"]).withColumn("reasons", F.array_join("reasons", ","))


@query("i8_recent", "SELECT user_id, max(event_id) AS last FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1")
def _(v):
    return analytics.recent(v.table("events"), "ts").groupBy("user_id").agg(F.max("event_id").alias("last"))


@query("w8_occurrence", with_views("chunks") + "SELECT chunk_id, code, (row_number() OVER (PARTITION BY code, text ORDER BY source_file, chunk_index) - 1)::int AS k FROM v_chunks")
def _(v):
    again = Window.partitionBy("code", F.md5(F.col("text").cast("binary"))).orderBy("source_file", "chunk_index")
    return v.chunks.select("chunk_id", "code", (F.row_number().over(again) - 1).alias("k"))


# --- more of the inventory -------------------------------------------------------------------


@query("p1_polymorphic_in", with_views("documents") + "SELECT doc_id FROM v_documents WHERE subtype IN ('S0', 'S2') AND code = 'src3'")
def _(v):
    return v.documents.where(analytics.is_in("subtype", ["S0", "null", "", "S2"]) & analytics.is_in("code", "src3") & analytics.is_in("status", None)).select("doc_id")


@query("p4_effective_type", with_views("documents") + "SELECT coalesce(doc_type_fixed, doc_type) AS doc_type, count(*) AS n FROM v_documents GROUP BY 1")
def _(v):
    return v.documents.groupBy(analytics.effective_type().alias("doc_type")).agg(F.count("*").alias("n"))


@query("j15_single_scope", with_views("cases") + "SELECT party, count(DISTINCT code) = 1 AS single, min(code) AS code FROM v_cases GROUP BY 1")
def _(v):
    return analytics.single_scope(v.cases, "party")


@query("t16_keyword_search", with_views("cases") + "SELECT case_id FROM v_cases WHERE (contains(lower(party), '00012') AND status = 'EN_COURS') OR contains(case_id, '999') ORDER BY opened DESC NULLS LAST, case_id LIMIT 5")
def _(v):
    hit = (F.lower("party").contains("00012") & (F.col("status") == "EN_COURS")) | F.col("case_id").contains("999")
    return lookup.keyword_search(v.cases, hit, 5).select("case_id")


@query("t18_virtual_rows", _SCORED + "SELECT chunk_id, 1 AS priority FROM (SELECT chunk_id FROM f ORDER BY rrf DESC, chunk_id LIMIT 5) UNION ALL SELECT 'case-1', 0")
def _(v):
    rows = search.best(fused(v), 5).select("chunk_id", "rrf", "vec")
    return lookup.with_virtual(rows, v.spark.createDataFrame([("case-1",)], "chunk_id string")).select("chunk_id", "priority")


@query("t19_context", _SCORED + ", top AS (SELECT chunk_id FROM f ORDER BY rrf DESC, chunk_id LIMIT 5), c AS (SELECT chunk_id, row_number() OVER (ORDER BY round(vec, 9) DESC, chunk_id) AS r FROM f WHERE vec >= 0.25 AND chunk_id NOT IN (SELECT chunk_id FROM top)) SELECT chunk_id FROM top UNION ALL SELECT chunk_id FROM c WHERE r <= 2")
def _(v):
    rows = fused(v)
    return lookup.with_context(search.best(rows, 5).select("query_id", "chunk_id", "vec"), rows.select("query_id", "chunk_id", "vec")).select("chunk_id")


@query("s1_union", with_views("documents") + "SELECT doc_id, 'old' AS part FROM v_documents WHERE year < 2017 UNION ALL SELECT doc_id, 'new' FROM v_documents WHERE year > 2022")
def _(v):
    part = lambda c, name: v.documents.where(c).select("doc_id", F.lit(name).alias("part"))
    return part("year < 2017", "old").unionByName(part("year > 2022", "new"))


@query("s5_containment", with_views("parties") + "SELECT a.order_id, round(len(list_intersect(a.parties, b.parties)) / least(len(a.parties), len(b.parties))::double, 6) AS score FROM v_parties a JOIN v_parties b ON a.order_id + 1 = b.order_id")
def _(v):
    b = v.parties.select((F.col("order_id") - 1).alias("k"), F.col("parties").alias("others"))
    return v.parties.join(b, F.col("order_id") == F.col("k")).select("order_id", F.round(tx.containment(F.col("parties"), F.col("others")), 6).alias("score"))


@query("f5_jaccard", with_views("parties") + "SELECT a.order_id, round(len(list_intersect(a.parties, b.parties)) / len(list_distinct(list_concat(a.parties, b.parties)))::double, 6) AS score FROM v_parties a JOIN v_parties b ON a.order_id + 1 = b.order_id")
def _(v):
    b = v.parties.select((F.col("order_id") - 1).alias("k"), F.col("parties").alias("others"))
    return v.parties.join(b, F.col("order_id") == F.col("k")).select("order_id", F.round(tx.jaccard(F.col("parties"), F.col("others")), 6).alias("score"))


@query("f8_subtype", "SELECT p_partkey, regexp_replace(upper(trim(split_part(p_type, ',', 1))), '[ -]+', '_', 'g') AS subtype FROM part")
def _(v):
    return v.table("part").select("p_partkey", tx.subtype(F.col("p_type")).alias("subtype"))


@query("f9_name_tokens", """SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(c_name || ' Mme Zoe de Lancre ' || c_mktsegment), '[a-z]{3,}'), lambda w: w NOT IN ('monsieur', 'madame', 'mademoiselle', 'mme', 'mlle')))), ' ') AS names,
    array_to_string(list_sort(regexp_extract_all(regexp_replace(upper('M. ' || c_mktsegment || ' DDE Al'), '\\b(MR|MME|MADAME|MONSIEUR|SINISTRE_DDE|DDE|M)\\b', '', 'g'), '[A-Z]{2,}')), ' ') AS sorted FROM customer""")
def _(v):
    names, person = F.concat("c_name", F.lit(" Mme Zoé de Lancre "), "c_mktsegment"), F.concat(F.lit("M. "), "c_mktsegment", F.lit(" DDE Al"))
    return v.table("customer").select("c_custkey", F.array_join(tx.name_tokens(names), " ").alias("names"), tx.person_key(person).alias("sorted"))


_PATHS = cases(
    f"'raw/AA' || lpad({NUMBER}, 7, '0') || '/x.pdf'", f"'raw/' || {NUMBER} || ' - Rue/x.pdf'", f"'note ' || {NUMBER} || '.pdf'", "substr(text, 1, 40)", f"{NUMBER} || ' - 2-6 BIS/x'", f"'TIVOLI(' || {NUMBER} || ')'", f"'a' || chr(92) || {NUMBER} || ' - b'",
    f"'DDE 777 - ' || {NUMBER} || ' - CV'", "NULL", f"'12 - ' || {NUMBER} || '-' || source",
)


@query("f12_property_code", f"""SELECT id, coalesce(nullif(regexp_extract(s, '^\\s*(\\d{{4,6}})\\s*-\\s*', 1), ''), nullif(regexp_extract(s, '\\((\\d{{4,6}})\\)', 1), ''), nullif(regexp_extract(s, '[\\\\/](\\d{{4,6}})\\s*-\\s*', 1), ''),
    nullif(regexp_extract(s, '(?:^|[^0-9])(\\d{{4,6}})\\s+-\\s+', 1), ''), nullif(regexp_extract(s, '([A-Z]{{2}}\\d{{7}})', 1), '')) AS code FROM {made_sql(_PATHS)}""")
def _(v):
    return made(v, _PATHS).select("id", tx.property_code(F.col("s")).alias("code"))


@query("f16_haystack", with_views("cases") + f"SELECT case_id, lower({_accents('concat_ws(chr(32), party, status)')}) AS hay FROM v_cases")
def _(v):
    return v.cases.select("case_id", tx.haystack("party", "status").alias("hay"))


@query("f17_query_tokens", "SELECT c_custkey, array_to_string(regexp_extract_all(lower(c_mktsegment || ' ' || c_name), '([a-z0-9]{3,})', 1), ' ') AS tokens FROM customer")
def _(v):
    return v.table("customer").select("c_custkey", F.array_join(tx.query_tokens(F.concat_ws(" ", "c_mktsegment", "c_name")), " ").alias("tokens"))


@query("f18_passage", with_views("chunks", "documents") + "SELECT c.chunk_id, c.source_file, '[' || c.doc_type || '] ' || 'doc ' || d.doc_id || chr(10) || left(c.text, 1900) AS passage FROM v_chunks c JOIN v_documents d ON c.source_file = d.source_file")
def _(v):
    rows = v.chunks.drop("doc_id").join(v.documents.select("source_file", "file_name"), "source_file")
    return rows.select("chunk_id", "source_file", tx.passage(F.col("doc_type"), F.col("file_name"), F.col("text")).alias("passage"))


@query("f23_quality_metrics", "SELECT doc_id, length(text)::int AS length, len(regexp_extract_all(text, '\\p{L}{3,}'))::int AS long_words FROM documents")
def _(v):
    m = tx.quality_metrics(F.col("text"))
    return v.table("documents").select("doc_id", m["length"].alias("length"), m["long_words"].alias("long_words"))


@query("dt5_year_and_gap", with_views("cases") + "SELECT case_id, year(opened)::int AS y, abs(datediff('day', opened, DATE '1996-01-01'))::int AS gap FROM v_cases")
def _(v):
    return v.cases.select("case_id", F.year("opened").alias("y"), F.abs(F.datediff("opened", F.lit("1996-01-01").cast("date"))).alias("gap"))


@query("x3_filtered_chunks", with_views("chunks") + f"SELECT chunk_id, source_file FROM v_chunks WHERE ({_readable('text', True)}) = 'ok'")
def _(v):
    return chunking.filtered(v.chunks.drop("embedding"))[0].select("chunk_id", "source_file")


@query("x5_type_of_path", with_views("files") + "SELECT path, CASE WHEN path LIKE '%/b/%' THEN 'PV_AG' WHEN path LIKE '%7.txt' THEN 'FACTURE' ELSE 'AUTRE' END AS doc_type FROM v_files")
def _(v):
    return v.files.select("path", chunking.type_of_path(F.col("path"), {"b": "PV_AG"}, {"7\\.txt$": "FACTURE"}).alias("doc_type"))


@query("e7_flagged_chunks", with_views("chunks") + "SELECT chunk_id, source_file, excluded OR doc_id % 6 = 0 AS excluded FROM v_chunks")
def _(v):
    flags = v.documents.where("doc_id % 6 = 0").select("source_file", F.lit("x").alias("ref_source_file"), F.lit("VARIANTE").alias("reason"))
    return dedup.flagged(v.chunks, flags).select("chunk_id", "source_file", "excluded")


@query("e13_trusted_type", with_views("documents") + "SELECT doc_id, CASE WHEN doc_type = 'RCP' THEN 'RCP' ELSE coalesce(doc_type_fixed, doc_type) END AS doc_type FROM v_documents")
def _(v):
    return v.documents.select("doc_id", analytics.trusted_type().alias("doc_type"))


@query("i2_purge", with_views("chunks") + "SELECT chunk_id, source_file FROM v_chunks WHERE doc_id % 9 <> 0")
def _(v):
    return incremental.purge(v.chunks, v.documents.where("doc_id % 9 = 0").select("source_file"), "source_file").select("chunk_id", "source_file")


@query("i3_cache_misses", with_views("chunks") + "SELECT chunk_id FROM v_chunks WHERE doc_id % 2 = 1")
def _(v):
    cache = v.chunks.where("doc_id % 2 = 0").select("chunk_id", F.lit("FOND").alias("kind"))
    return incremental.cached(v.chunks.select("chunk_id"), cache.distinct(), "chunk_id", "kind")[1]
