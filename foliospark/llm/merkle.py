"""Merkle manifest of a table: every row a leaf, a tree for each source, a tree of their roots.

Rows are dealt by ranges of (source, doc_id) and numbered by counts of the parts. Blocks of 16^k
leaves are then reduced by tasks; the driver gets one digest for each block, builds the few levels
that are left and broadcasts them. From them executors take the path above each block, finish the
proof of every row, and fold every row's leaf (as it is now) up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.storage import Scratch

FAN = 16
#: Levels that a task reduces: 3 where that leaves few enough blocks, 5 (a million leaves) at most.
BLOCK_LEVELS = (3, 4, 5)
#: Digests that the driver takes at most: 64 bytes each, and the name of each source.
TOP = 1 << 17

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


def levels(leaves: Sequence[str], up: int) -> list[list[str]]:
    """The leaves and ``up`` levels above them; each run of 16, the last with fewer, becomes one node."""
    out = [list(leaves)]
    for _ in range(up):
        below = out[-1]
        out.append([digest("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
    return out


def path(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """The siblings before and after the node ``at`` of the lowest level, and so on below the top."""
    steps = []
    for level in tree[:-1]:
        run = at - at % FAN
        steps.append(("".join(level[run:at]), "".join(level[at + 1 : run + FAN])))
        at //= FAN
    return steps


class Top:
    """The levels above the blocks: of each source up to its subroot, and of the subroots up to the root."""

    def __init__(self, blocks: dict[str | None, list[str]]):
        self.trees = {s: levels(nodes, height(len(nodes))) for s, nodes in blocks.items()}
        order = sorted(blocks, key=lambda s: (s is not None, (s or "").encode()))
        self.place = {s: k for k, s in enumerate(order)}
        subroots = [self.trees[s][-1][0] for s in order]
        self.upper = levels(subroots, height(len(subroots)))
        self.root = self.upper[-1][0] if subroots else digest("")

    def subroot(self, source: str | None) -> str:
        return self.trees[source][-1][0]

    def suffix(self, source: str | None, block: int) -> list[tuple[str, str]]:
        """The path from a block's node to the root."""
        return path(self.trees[source], block) + path(self.upper, self.place[source])


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digests(docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, source, leaf, now: the digest of each row, and that of its changed text where it is changed (else null)."""
    own, other = [_field(F.col(c)) for c in FIELDS[:-1]], F.translate(F.col("text"), UPPER, LOWER)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.sha2(F.concat(*own, _field(F.col("text"))), 256).alias("leaf"),
        F.when(changed, F.sha2(F.concat(*own, _field(other)), 256)).alias("now"),
    )


def tampered() -> Column:
    """The rows whose text is tampered with: 5 divides the crc32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def numbered(scratch: Scratch, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves with their place in their source, parts): ranges of rows in order, added up from counts of the parts."""
    order = ("source", "doc_id", "leaf")
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = scratch.write(leaves, "leaves")
    dealt = scratch.write(leaves.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    source = Window.partitionBy("source")
    before = F.coalesce(F.sum("n").over(source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    parts = scratch.write(parts.select("source", "part", "first", before.alias("before"), F.sum("n").over(source).alias("total")), "parts")
    p = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "first", "before", "total")
    joined = dealt.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    return joined.select("source", "doc_id", "leaf", "now", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "total"), parts


def _block_levels(parts: DataFrame) -> int:
    """The lowest block height that leaves the driver no more than TOP digests."""
    totals = parts.groupBy("source").agg(F.first("total").alias("total"))
    counts = totals.agg(*[F.sum(F.ceil(F.col("total") / FAN**k)).alias(f"k{k}") for k in BLOCK_LEVELS]).first()
    fits = [k for k in BLOCK_LEVELS if (counts[f"k{k}"] or 0) <= TOP]
    if not fits:
        raise ValueError(f"the table has more than {TOP} sources or blocks of {FAN ** BLOCK_LEVELS[-1]} rows")
    return fits[0]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """One table for each block: rows come in order, and a block starts where its size divides the place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("pos").to_numpy() % size == 0)
        for a, b in pairwise(np.unique(np.concatenate([[0], starts, [batch.num_rows]])).tolist()):
            if held and a in starts:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def manifest(spark: SparkSession, docs: DataFrame, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``changed`` marks rows whose text is lower-cased (A-Z) before their leaf is folded up again.
    Nulls are leaves of ``-`` fields; a null source is the first source, a null doc_id the first of
    its source; rows of equal (source, doc_id) stand in the order of their digests, and repeated rows
    are leaves of their own with equal digests. Texts of any length are hashed whole. Extra columns
    are not read. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "merkle")
    leaves, parts = numbered(scratch, leaf_digests(docs, changed))
    up = _block_levels(parts)
    size = FAN**up
    blocks = leaves.withColumn("block", F.floor(F.col("pos") / size)).repartition("source", "block").sortWithinPartitions("source", "block", "pos")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, size):
            total = rows["total"][0].as_py()
            tree = levels(rows["leaf"].to_pylist(), min(up, height(total)))
            yield pa.RecordBatch.from_pydict({"source": pa.array([rows["source"][0].as_py()], pa.string()), "block": [rows["block"][0].as_py()], "node": [tree[-1][0]]})

    nodes = scratch.write(blocks.select("source", "block", "pos", "total", "leaf").mapInArrow(reduced, "source string, block long, node string"), "nodes")
    found: dict[str | None, list[tuple[int, str]]] = {}
    for row in nodes.toLocalIterator():
        found.setdefault(row.source, []).append((row.block, row.node))
    top = spark.sparkContext.broadcast(Top({s: [node for _, node in sorted(own)] for s, own in found.items()}))

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = top.value
        for rows in _blocks(batches, size):
            source, block = rows["source"][0].as_py(), rows["block"][0].as_py()
            own, now = rows["leaf"].to_pylist(), rows["now"].to_pylist()
            tree, suffix = levels(own, min(up, height(rows["total"][0].as_py()))), above.suffix(source, block)
            proofs, folded = [], []
            for run in range(0, len(own), FAN):
                steps = (path(tree[1:], run // FAN) if len(tree) > 1 else []) + suffix
                rest = "".join(left + right for left, right in steps)
                for k in range(run, min(run + FAN, len(own))):
                    left, right = ("".join(own[run:k]), "".join(own[k + 1 : run + FAN])) if len(tree) > 1 else ("", "")
                    proofs.append(digest(left + right + rest))
                    node = now[k] or own[k]
                    if len(tree) > 1:
                        node = digest(left + node + right)
                    for left, right in steps:
                        node = digest(left + node + right)
                    folded.append(node)
            n, root = len(own), above.root
            fields = {
                "doc_id": rows["doc_id"].combine_chunks(), "leaf": pa.array(own, pa.string()), "subroot": pa.array([above.subroot(source)] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded]),
            }
            for part in pa.table(fields).to_batches(max_chunksize=10_000):
                yield part

    return blocks.mapInArrow(proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole documents table."""
    return manifest(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered())


def crc_table_sql() -> str:
    """A DuckDB expression of the 256 remainders of CRC-32."""
    return "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"


def crc_sql(codes: str, table: str) -> str:
    """A DuckDB expression of the unsigned CRC-32 of a list of bytes."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)))"


def oracle() -> str:
    """DuckDB SQL for up to 16^4 rows a source and 16^3 sources."""
    ctes, deep, wide = [], 4, 3

    def field(name: str, value: str) -> str:
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value} END"

    own = " || ".join(field(c, c) for c in FIELDS[:-1])
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes.append(f"t AS (SELECT {crc_table_sql()} AS remainders)")
    crc = crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT)", "remainders")
    ctes.append(f"d AS (SELECT doc_id, source, sha256({own} || {field('text', 'text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({own} || {field('text', low)}) END AS now FROM documents, t)")
    ctes.append("a0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n, doc_id, now FROM d)")

    def climb(name: str, up: int) -> None:
        for k in range(up):
            ctes.append(f"{name}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // {FAN})")
            sides = ", ".join(f"coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos {op} x.pos), '') AS {side}" for op, side in (("<", "l"), (">", "r")))
            ctes.append(f"{name}s{k} AS (SELECT x.tree, x.pos, {sides} FROM {name}{k} x JOIN {name}{k} y ON x.tree IS NOT DISTINCT FROM y.tree AND x.pos // {FAN} = y.pos // {FAN} WHERE x.n > 1 GROUP BY x.tree, x.pos)")

    climb("a", deep)
    ctes.append("sub AS (" + " UNION ALL ".join(f"SELECT tree AS source, h FROM a{k} WHERE n = 1" for k in range(deep + 1)) + ")")
    ctes.append("b0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, source FROM sub)")
    climb("b", wide)
    ctes.append("top AS (" + " UNION ALL ".join(f"SELECT h AS root FROM b{k} WHERE n = 1" for k in range(wide + 1)) + ")")
    steps = [*(f"as{k}" for k in range(deep)), *(f"bs{k}" for k in range(wide))]
    joins = " ".join(f"LEFT JOIN as{k} ON as{k}.tree IS NOT DISTINCT FROM x.tree AND as{k}.pos = x.pos // {FAN**k}" for k in range(deep))
    joins += " JOIN b0 ON b0.source IS NOT DISTINCT FROM x.tree " + " ".join(f"LEFT JOIN bs{k} ON bs{k}.pos = b0.pos // {FAN**k}" for k in range(wide))
    sides = ", ".join(f"{s}.l AS {s}l, {s}.r AS {s}r" for s in steps)
    ctes.append(f"w AS (SELECT x.doc_id, x.h AS leaf, b0.h AS subroot, root, coalesce(x.now, x.h) AS f, {sides} FROM a0 x {joins}, top)")
    last = "w"
    for k, s in enumerate(steps):
        ctes.append(f"w{k} AS (SELECT * REPLACE (CASE WHEN {s}l IS NULL THEN f ELSE sha256({s}l || f || {s}r) END AS f) FROM {last})")
        last = f"w{k}"
    proof = " || ".join(f"coalesce({s}l || {s}r, '')" for s in steps)
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"
