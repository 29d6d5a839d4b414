"""A source that asks an API page by page, as a Spark data source: pages are partitions, filters and fields go with the question.

``format("paged")`` after ``register``. Options: ``url`` (http, https, or a folder of stored answers), ``schema`` (as
JSON; workers have no parser of types),
``page_size``, ``cap`` (records at most), ``pages_per_task``, ``fields`` (comma list: only these are asked for), ``tries`` and
``wait`` (seconds before a page is asked again, doubled each time), ``token`` (sent as a bearer token).

An answer is {"records": [{"id": .., "fields": {..}}], "total": n} or, of an API that numbers nothing, {"records": [..], "offset":
mark of the next page}. With ``total`` pages are shared among tasks by their number; with marks one task follows them.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliospark.storage import Scratch

NAME = "paged"


class Unanswered(RuntimeError):
    """A page was asked for as often as was allowed."""


class Pages(InputPartition):
    """Pages ``first`` to ``last`` (exclusive), or all by marks where ``last`` is None."""

    def __init__(self, first: int, last: int | None):
        super().__init__((first, last))
        self.first, self.last = first, last


class Client:
    """Asks for one page; conditions are (field, allowed values)."""

    def __init__(self, options: dict[str, str], fields: Sequence[str], conditions: Sequence[tuple[str, tuple[Any, ...]]]):
        self.url, self.size = options["url"].rstrip("/"), int(options.get("page_size", "100"))
        self.tries, self.wait, self.token = int(options.get("tries", "5")), float(options.get("wait", "0.5")), options.get("token")
        self.fields, self.conditions = list(fields), list(conditions)

    def page(self, number: int, mark: str | None = None) -> dict[str, Any]:
        """The answer for a page, asked again where it fails."""
        for k in range(self.tries):
            try:
                return self._http(number, mark) if self.url.startswith(("http://", "https://")) else self._stored(number)
            except (OSError, ValueError, TimeoutError) as error:
                if isinstance(error, urllib.error.HTTPError) and error.code < 500 and error.code not in (408, 429):
                    raise
                last = error
                if k + 1 < self.tries:
                    time.sleep(self.wait * 2**k)
        raise Unanswered(f"page {number} of {self.url} after {self.tries} tries") from last

    def formula(self) -> str:
        """The conditions as the API's filter: values as text, alternatives and all of them joined."""
        quoted = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        each = ["OR(" + ",".join(f"{{{field}}}={quoted(v)}" for v in values) + ")" for field, values in self.conditions]
        return each[0] if len(each) == 1 else "AND(" + ",".join(each) + ")" if each else ""

    def _http(self, number: int, mark: str | None) -> dict[str, Any]:
        asked = [("pageSize", str(self.size)), *[("fields[]", f) for f in self.fields]]
        asked += [("offset", mark)] if mark is not None else [("page", str(number))]
        asked += [("filterByFormula", self.formula())] if self.conditions else []
        request = urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(asked)}", headers={"Authorization": f"Bearer {self.token}"} if self.token else {})
        with urllib.request.urlopen(request, timeout=30) as answer:
            return json.loads(answer.read())

    def _stored(self, number: int) -> dict[str, Any]:
        """A stored answer; the folder stands for the API and so does what the API would do with the conditions."""
        store, path = fs.FileSystem.from_uri(self.url if "://" in self.url or self.url.startswith("file:") else f"file://{self.url}")
        with store.open_input_stream(f"{path}/page-{number}.json") as stream:
            answer = json.loads(stream.read())
        fits = lambda r: all(r["fields"].get(f) in values for f, values in self.conditions)
        return answer | {"records": [{"id": r["id"], "fields": {k: v for k, v in r["fields"].items() if k in self.fields}} for r in answer["records"] if fits(r)]}


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, dict(options)
        self.conditions: list[tuple[str, tuple[Any, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities and lists of values of fields go with the question; Spark checks the others."""
        plain = {f.name for f in self.schema.fields if f.dataType.typeName() in ("string", "integer", "long", "boolean")} - {"id"}
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in plain and "cap" not in self.options:
                self.conditions.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def client(self) -> Client:
        return Client(self.options, [f.name for f in self.schema.fields if f.name != "id"], self.conditions)

    def partitions(self) -> Sequence[InputPartition]:
        first = self.client().page(0)
        if "total" not in first:
            return [Pages(0, None)]
        size = int(self.options.get("page_size", "100"))
        wanted = min(int(first["total"]), int(self.options.get("cap", first["total"])))
        n, step = -(-wanted // size), int(self.options.get("pages_per_task", "10"))
        return [Pages(k, min(k + step, n)) for k in range(0, n, step)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        client, kind = self.client(), to_arrow_schema(self.schema)
        size, cap = client.size, int(self.options["cap"]) if "cap" in self.options else None
        number, mark, given = partition.first, None, partition.first * client.size
        while partition.last is None or number < partition.last:
            answer = client.page(number, mark)
            records = answer["records"] if cap is None else answer["records"][: max(0, cap - given)]
            given += size if partition.last is not None else len(records)
            if records:
                yield pa.RecordBatch.from_pylist([{"id": r["id"], **r["fields"]} for r in records], schema=kind)
            number, mark = number + 1, answer.get("offset")
            if partition.last is None and (mark is None or cap is not None and given >= cap):
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        whole = StructType.fromJson(json.loads(self.options["schema"]))
        asked = [f.strip() for f in self.options.get("fields", "").split(",") if f.strip()]
        return StructType([f for f in whole.fields if not asked or f.name in asked or f.name == "id"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``format("paged")`` known to the session and lets it push filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def store_answers(rows: DataFrame, folder: str, key: str, page_size: int = 100) -> None:
    """Writes rows as stored answers below ``folder``, in the order of ``key``: each page by one task.

    Rows are numbered in ranges of the key, so no task sees the whole; ``folder`` must be one that tasks can write to.
    """
    total = rows.count()
    fields = [c for c in rows.columns if c != key]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("at_", F.monotonically_increasing_id())
    held = Scratch(rows.sparkSession, "answers").write(dealt.select((F.shiftright("at_", 33)).alias("part_"), F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)).alias("k_"), F.to_json(F.struct(F.col(key).cast("string").alias("id"), F.struct(*fields).alias("fields"))).alias("record")), "held")
    before, sizes = {}, {r["part_"]: r.n for r in held.groupBy("part_").agg(F.count("*").alias("n")).collect()}  # a row for each part
    for k, p in enumerate(sorted(sizes)):
        before[p] = sum(sizes[q] for q in sorted(sizes)[:k])
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part_")) if before else F.lit(0)
    numbered = held.select((start + F.col("k_")).alias("place"), "record").withColumn("page", F.floor(F.col("place") / page_size).cast("long"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(path, recursive=True)
        held_page, records = None, []

        def flush() -> None:
            if held_page is not None:
                with store.open_output_stream(f"{path}/page-{held_page}.json") as stream:
                    stream.write(json.dumps({"records": records, "total": total}).encode())

        for batch in batches:
            for page, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page != held_page:
                    flush()
                    held_page, records = page, []
                records.append(json.loads(record))
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["page"])

    out = numbered.repartition("page").sortWithinPartitions("page", "place").select("page", "record").mapInArrow(put, "page long")
    out.write.format("noop").mode("overwrite").save()
    if not total:
        store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/page-0.json") as stream:
            stream.write(json.dumps({"records": [], "total": 0}).encode())


def paged(spark: SparkSession, url: str, schema: str, **options: object) -> DataFrame:
    """The records of a paged API: id and the fields of ``schema`` (which must hold id)."""
    register(spark)
    kinds = StructType.fromDDL(schema)
    fields = ",".join(f.name for f in kinds.fields)
    return spark.read.format(NAME).options(url=url, schema=kinds.json(), **({"fields": fields} | {k: str(v) for k, v in options.items()})).load()
