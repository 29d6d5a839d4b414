"""The archive's tables as views over the generic test tables, in DataFrames and in DuckDB SQL.

Both definitions give the same rows; queries take the DataFrames and their SQL starts with ``WITH``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.storage import spread

SLICE = 1500
#: Tables whose rows are long enough that work on them should use all cores.
TEXTS = ("documents", "pages")
DOC_TYPES = ("PV_AG", "CONTRAT", "FACTURE", "COURRIER", "RCP")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


class Views:
    """The tables of one data folder; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(found) if name in TEXTS else found

    @property
    def documents(self) -> DataFrame:
        d, q = self.table("documents"), self.table("labels")
        annee = (F.lit(2015) + F.col("doc_id") % 10).cast("int")
        named = d.join(q, "doc_id", "left").select(
            "doc_id",
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_file"),
            F.col("source").alias("code"),
            F.concat(F.lit("Residence "), "source").alias("name"),
            F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"),
            _pick(DOC_TYPES, F.col("doc_id") % 5).alias("doc_type"),
            F.when(F.col("doc_id") % 11 == 0, "AUTRE").alias("doc_type_fixed"),
            annee.alias("year"),
            F.make_date(annee, (1 + F.col("doc_id") % 12).cast("int"), (1 + F.col("doc_id") % 28).cast("int")).alias("date"),
            F.concat(F.lit("S"), (F.col("doc_id") % 3).cast("string")).alias("subtype"),
            F.when(F.col("quality") == 1, "EN_VIGUEUR").when(F.col("quality") == 0, "CADUC").alias("status"),
            (F.col("n_chars") / F.lit(100.0)).alias("amount"),
            F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("D"), (F.col("doc_id") % 50).cast("string"))).alias("case_id"),
        )
        return named.withColumn("doc_group", F.concat_ws("_", "doc_type", "year", "code"))

    @property
    def slices(self) -> DataFrame:
        """The chunks without their vectors, for what reads texts only: nothing is joined."""
        d, n = self.table("documents"), self.table("embeddings").count()
        slices = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(float(SLICE)))).cast("int")
        each = d.withColumn("total_chunks", slices).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
        each = each.select(
            "doc_id", F.col("source").alias("code"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_file"), _pick(DOC_TYPES, F.col("doc_id") % 5).alias("doc_type"),
            "chunk_index", "total_chunks", F.substring("text", F.lit(1) + SLICE * F.col("chunk_index"), F.lit(SLICE)).alias("text"),
            (F.col("doc_id") % 23 == 0).alias("excluded"), F.when(F.col("doc_id") % 7 == 0, "PROCEDURE_AG").when(F.col("doc_id") % 7 == 1, "FOND").alias("category"), (F.col("doc_id") % n).alias("vec_id"),
        )
        hashed = F.md5(F.concat("source_file", F.lit("#"), F.col("chunk_index").cast("string"), F.lit("#"), "text").cast("binary"))
        return each.withColumn("chunk_id", F.substring(hashed, 1, 12)).withColumn("n_chars", F.length("text"))

    @property
    def chunks(self) -> DataFrame:
        return self.slices.join(self.table("embeddings").select("vec_id", "embedding"), "vec_id", "left")

    @property
    def cases(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer")
        kind = F.when(F.col("o_orderpriority").startswith("1"), "SINISTRE_DDE").when(F.col("o_orderpriority").startswith("2"), "SINISTRE_INCENDIE").when(F.col("o_orderpriority").startswith("3"), "TRAVAUX").otherwise("CONTENTIEUX")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").cast("string").alias("case_id"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("code"), F.concat(F.lit("Residence "), F.col("c_nationkey").cast("string")).alias("name"),
            kind.alias("case_type"), F.when(F.col("o_orderstatus") == "F", "CLOTURE").when(F.col("o_orderstatus") == "O", "EN_COURS").otherwise("EN_ATTENTE").alias("status"),
            F.to_date("o_orderdate").alias("opened"), F.col("o_totalprice").alias("amount"), F.col("c_name").alias("party"), F.col("c_acctbal").alias("indemnity"),
        )

    @property
    def parties(self) -> DataFrame:
        x, s = self.table("lineitem"), self.table("supplier")
        return x.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sort_array(F.collect_set("s_name")).alias("parties"))

    @property
    def files(self) -> DataFrame:
        d = self.table("documents")
        folder = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "a/").otherwise("a/b/")
        return d.select(
            F.concat("source", F.lit("/"), folder, F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "source", F.length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
            (F.col("doc_id") % 3).cast("int").alias("depth"), "doc_id",
        )

    @property
    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        f = self.files.select("path", "sha", "doc_id", _pick(DOC_TYPES, F.col("doc_id") % 5).alias("doc_type"))
        return f.where("doc_id % 10 <> 0"), f.where("doc_id % 7 <> 0")

    @property
    def turns(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", "role", "text")


_TYPE = "(['PV_AG','CONTRAT','FACTURE','COURRIER','RCP'])[(doc_id % 5)::int + 1]"

SQL = {
    "v_documents": f"""v_documents AS (SELECT *, concat_ws('_', doc_type, year, code) AS doc_group FROM (SELECT d.doc_id, d.source || '/' || d.doc_id AS source_file, d.source AS code, 'Residence ' || d.source AS name,
        'doc_' || d.doc_id || '.pdf' AS file_name, {_TYPE.replace("doc_id", "d.doc_id")} AS doc_type, CASE WHEN d.doc_id % 11 = 0 THEN 'AUTRE' END AS doc_type_fixed, (2015 + d.doc_id % 10)::int AS year,
        make_date(2015 + d.doc_id % 10, 1 + d.doc_id % 12, 1 + d.doc_id % 28) AS date, 'S' || (d.doc_id % 3) AS subtype, CASE WHEN q.quality = 1 THEN 'EN_VIGUEUR' WHEN q.quality = 0 THEN 'CADUC' END AS status,
        d.n_chars / 100.0::double AS amount, CASE WHEN d.doc_id % 4 = 0 THEN 'D' || (d.doc_id % 50) END AS case_id FROM documents d LEFT JOIN labels q ON d.doc_id = q.doc_id))""",
    "v_chunks": f"""v_chunks AS (SELECT s.*, e.embedding FROM (SELECT *, left(md5(source_file || '#' || chunk_index || '#' || text), 12) AS chunk_id, length(text)::int AS n_chars FROM (
        SELECT doc_id, source AS code, source || '/' || doc_id AS source_file, {_TYPE} AS doc_type, i::int AS chunk_index, n::int AS total_chunks, substr(text, 1 + {SLICE} * i, {SLICE}) AS text, doc_id % 23 = 0 AS excluded,
        CASE doc_id % 7 WHEN 0 THEN 'PROCEDURE_AG' WHEN 1 THEN 'FOND' END AS category, doc_id % (SELECT count(*) FROM embeddings) AS vec_id
        FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(1, ceil(length(text) / {SLICE}.0))::int AS n FROM documents)))) s LEFT JOIN embeddings e ON s.vec_id = e.vec_id)""",
    "v_cases": """v_cases AS (SELECT o_orderkey::varchar AS case_id, 'C' || c_nationkey AS code, 'Residence ' || c_nationkey AS name, CASE left(o_orderpriority, 1) WHEN '1' THEN 'SINISTRE_DDE' WHEN '2' THEN 'SINISTRE_INCENDIE' WHEN '3' THEN 'TRAVAUX' ELSE 'CONTENTIEUX' END AS case_type,
        CASE o_orderstatus WHEN 'F' THEN 'CLOTURE' WHEN 'O' THEN 'EN_COURS' ELSE 'EN_ATTENTE' END AS status, o_orderdate::date AS opened, o_totalprice AS amount, c_name AS party, c_acctbal AS indemnity FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "v_parties": "v_parties AS (SELECT l_orderkey AS order_id, list_sort(list(DISTINCT s_name)) AS parties FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)",
    "v_files": """v_files AS (SELECT source || '/' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a/' ELSE 'a/b/' END || 'f' || doc_id || '.txt' AS path, source, length(text)::bigint AS size, sha256(text) AS sha, (doc_id % 3)::int AS depth, doc_id FROM documents)""",
}


def with_views(*names: str) -> str:
    """The start of a query over views."""
    return "WITH " + ", ".join(SQL[f"v_{n}"] for n in names) + " "
