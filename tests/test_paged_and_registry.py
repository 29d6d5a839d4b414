"""The paged source (pages, filters, caps, retries, marks), the registry of artefacts, the package for workers."""

import http.server
import json
import threading
import urllib.parse
import zipfile

import pytest

from foliospark.operators import registry
from foliospark.sources import paged
from foliospark.storage import ship

SCHEMA = "id string, name string, kind string, n long"


@pytest.fixture(scope="module")
def server():
    """250 records; pages by number with a total, or by marks; every third request fails first."""
    asked, failed = [], set()

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = urllib.parse.parse_qs(url.query)
            asked.append(q)
            if len(asked) % 3 == 0 and self.path not in failed:
                failed.add(self.path)
                self.send_error(503)
                return
            if url.path == "/refused":
                self.send_error(403)
                return
            size, fields = int(q["pageSize"][0]), q.get("fields[]", [])
            rows = [{"id": f"r{k}", "fields": {"name": f"name {k}", "kind": "ab"[k % 2], "n": k}} for k in range(250)]
            if "filterByFormula" in q:
                rows = [r for r in rows if q["filterByFormula"] == [f"OR({{kind}}='{r['fields']['kind']}')"]]
            start = int(q["offset"][0].removeprefix("m")) if "offset" in q else int(q["page"][0]) * size
            part = [{"id": r["id"], "fields": {k: v for k, v in r["fields"].items() if k in fields}} for r in rows[start : start + size]]
            body = {"records": part} | ({"total": len(rows)} if url.path == "/numbered" else {"offset": f"m{start + size}"} if start + size < len(rows) else {})
            raw = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    one = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_address[1]}", asked
    one.shutdown()


@pytest.mark.parametrize("kind", ["numbered", "marked"])
def test_pages_of_an_api(spark, server, kind):
    url, asked = server
    df = paged.paged(spark, f"{url}/{kind}", SCHEMA, page_size=40, pages_per_task=2, wait=0.01)
    assert {(r.id, r.name, r.kind, r.n) for r in df.collect()} == {(f"r{k}", f"name {k}", "ab"[k % 2], k) for k in range(250)}
    assert df.rdd.getNumPartitions() == (4 if kind == "numbered" else 1)
    del asked[:]
    some = paged.paged(spark, f"{url}/{kind}", "id string, kind string, n long", page_size=40, wait=0.01).where("kind = 'a' and n >= 100")
    assert sorted(r.n for r in some.collect()) == list(range(100, 250, 2))
    assert all(q["filterByFormula"] == ["OR({kind}='a')"] and q["fields[]"] == ["kind", "n"] for q in asked)
    assert {r.n for r in paged.paged(spark, f"{url}/{kind}", SCHEMA, page_size=40, cap=90, wait=0.01).where("kind = 'a'").collect()} == set(range(0, 90, 2))


def test_a_page_that_never_comes(spark, server, tmp_path):
    with pytest.raises(Exception, match="403"):
        paged.paged(spark, f"{server[0]}/refused", SCHEMA, wait=0.01).collect()
    with pytest.raises(Exception, match="page 0 of .* after 2 tries"):
        paged.paged(spark, str(tmp_path / "none"), SCHEMA, tries=2, wait=0.01).collect()


def test_stored_answers(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", None if k % 5 == 0 else k) for k in range(37)], "key long, name string, n long")
    for n, folder in ((37, "all"), (0, "none")):
        paged.store_answers(rows.limit(n), str(tmp_path / folder), "key", page_size=10)
        found = paged.paged(spark, str(tmp_path / folder), "id string, name string, n long", page_size=10)
        assert sorted((int(r.id), r.name, r.n) for r in found.collect()) == [(k, f"n{k}", None if k % 5 == 0 else k) for k in range(n)]


def test_registry_states(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    kept = [(f, "GARDER", ".pdf") for f in ("in", "lost", "near", "bad", "empty", "copy", "copyin", "more")]
    decisions = t([*kept, ("photo", "EXCLURE", ".JPG"), ("zip", "EXCLURE", ".zip"), ("g", "EXCLURE_GOOGLE_NATIF", ".gdoc"), ("ko", "ERREUR_COPIE", ".pdf"), (None, "GARDER", ".pdf")], "source_file string, decision string, extension string")
    args = (
        decisions, t([("in", "h", 5, "in"), ("copy", "h", 5, "in"), ("copyin", "h", 5, "in")], "source_file string, sha256 string, size long, kept string"), t([("in", "s")], "source_file string, signature string"),
        t([("in", 10, False), ("near", 9, False), ("bad", 3, True)], "source_file string, chars long, skipped boolean"), t([("in", "A")] * 2 + [("lost", "A"), ("copyin", "A"), ("more", "A"), ("stray", "A")], "source_file string, doc_type string"),
        t([("in", "B")], "source_file string, doc_type string"), t([("in",)] * 2 + [("copyin",)] + [("more",)] * 3 + [("photo",)], "source_file string"),
    )
    got = {r.source_file: (r.status, r.reason, r.n_chunks, r.doc_type, r.ref_source_file, r.drift) for r in registry.registry(*args, previous=t([("in",), ("gone",)], "source_file string")).collect()}
    assert got == {
        "in": ("INGERE", None, 2, "B", None, []), "lost": ("ERREUR", "CHARGEMENT_KO", 1, "A", None, []), "near": ("REJETE", "DOUBLON_PROCHE", None, None, None, []), "bad": ("REJETE", "NON_EXPLOITABLE", None, None, None, []),
        "empty": ("REJETE", "TEXTE_VIDE", None, None, None, []), "copy": ("REJETE", "DOUBLON_EXACT", None, None, "in", []), "copyin": ("INGERE", None, 1, "A", "in", ["INGERE_MALGRE_DOUBLON_EXACT"]), "more": ("INGERE", None, 3, "A", None, ["CHUNKS_HORS_SHARD"]),
        "photo": ("INGERE", None, 1, None, None, ["INGERE_MALGRE_FILTRAGE_PHOTO", "INGERE_HORS_SHARD"]), "zip": ("REJETE", "FILTRAGE_AUTRE", None, None, None, []), "g": ("REJETE", "FILTRAGE_GOOGLE_NATIF", None, None, None, []),
        "ko": ("ERREUR", "COPIE_KO", None, None, None, []), "gone": ("SUPPRIME", None, None, None, None, []),
    }
    running = {r.source_file: r.status for r in registry.registry(*args, running=True).collect()}
    assert (running["lost"], running["near"], running["empty"], running["copy"]) == ("EN_COURS", "EN_COURS", "DECOUVERT", "REJETE") and "gone" not in running
    plan = registry.registry(*args)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    counts = {(r.kind, r.name): r.n for r in registry.counters(registry.registry(*args)).collect()}
    assert counts["status", "INGERE"] == 4 and counts["drift", "CHUNKS_HORS_SHARD"] == 1


def test_the_package_for_workers(spark):
    with zipfile.ZipFile(ship(spark)) as z:
        assert {"foliospark/__init__.py", "foliospark/operators/search.py", "foliospark/sources/pdf.py"} <= set(z.namelist())
