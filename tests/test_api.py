"""Tools, providers and the stream."""

import json

from pyspark.sql import functions as F

from foliospark.operators.analytics import Spec
from foliospark.plans import api, providers
from foliospark.plans.views import Views
from foliospark.streaming import ingest


def test_scope():
    assert api.scope([]) == {"codes": [], "scope": "global"}
    assert api.scope(["aa0-000-001", "AA0000001", ""]) == {"codes": ["AA0000001"], "scope": "single"}
    assert api.scope(["1", "2"])["scope"] == "multi"


def test_search_invariants(spark, data):
    v = Views(spark, data)
    chunks, documents = v.chunks, v.documents
    vector = v.table("embeddings").where("vec_id = 0").first().embedding
    assert "error" in api.search_chunks(chunks, documents, vector, ["the"], [])
    rows = api.search_chunks(chunks, documents, vector, ["the"], ["src0"], mode="inventory", limit=8).orderBy("rank").collect()
    assert 0 < len(rows) <= 8 and {r.code for r in rows} == {"src0"} and not any(r.excluded for r in rows)
    assert [r.rrf for r in rows] == sorted((r.rrf for r in rows), reverse=True)
    two = api.search_chunks(chunks, documents, vector, ["the"], ["src0", "src1", "src2", "src3"], mode="inventory", limit=6).collect()
    assert 0 < len(two) <= 6 and {r.code for r in two} <= {"src0", "src1", "src2", "src3"}
    narrow = api.search_chunks(chunks, documents, vector, ["the"], ["src0", "src4", "src8"], condition=F.col("case_id") == "D4").collect()
    assert len({r.source_file for r in narrow}) <= 50


def test_other_tools(spark, data):
    v = Views(spark, data)
    assert "error" in api.run_analytical_query(Spec("count", "x"), v.cases)
    assert api.run_analytical_query(Spec("count", "cases"), v.cases).count() > 0
    assert "error" in api.full_document(v.chunks, "%")
    assert [r.chunk_index for r in api.full_document(v.chunks, "src1/1").collect()][:1] == [0]
    assert api.search_cases(v.cases, "Customer sinistre", 5).count() == 5
    assert api.list_properties(v.documents, v.chunks, v.cases, "src1").first().code == "src1"
    assert api.property_overview(v.documents, "src1").count() == 1


def test_providers(spark):
    df = spark.createDataFrame([("the cat sat",), ("",), (None,)], "t string")
    rows = providers.enriched(df, "e", providers.hashed_embedding(8), "t").collect()
    assert abs(sum(x * x for x in rows[0].e) - 1) < 1e-6 and sum(rows[1].e) == 0
    assert [r.g for r in providers.enriched(df, "g", providers.relevance_gate(("cat",)), "t").collect()] == [True, False, True]
    assert df.select(providers.closed_label(("A",), "AUTRE", lambda c: c)(F.lit(" a "))).first()[0] == "A"


def test_stream_adds_each_record_once(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    schema = "chunk_id string, code string, text string"
    for k, ids in enumerate((["a", "b"], ["b", "c"])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"chunk_id": i, "code": "x", "text": i}) for i in ids))
        for _ in range(2):
            ingest.ingest(ingest.landing(spark, folder, schema), out, check)
    assert sorted(r.chunk_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
