"""Hybrid retrieval: vector and lexical ranks, reciprocal-rank fusion, diversity, quotas, balance.

Many queries are ranked in one plan: every function works on a DataFrame of scored candidates with a
query_id, and every ranking ends with chunk_id, so that ties are settled the same way everywhere.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from foliospark.functions import text as tx
from foliospark.storage import Scratch

RRF_K = 60
#: chunks per document group and least similarity, by mode.
MODES = {"targeted": (2, 0.20), "balanced": (3, 0.15), "inventory": (6, 0.10)}
MIN_CHARS = 500
MAX_PREFILTER = 50
POOL = 200
#: Rows by either score that a search takes as candidates at most, before it ranks the table instead.
MAX_CANDIDATES = 20_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in double precision; 0 where a vector is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def lexical(text: Column, terms: Sequence[str], title: Column | None = None) -> Column:
    """Share of query terms: 1.0 for a term in the title, 0.1 in the text only, saturated as r / (r + 1)."""
    low = F.lower(text)
    score = F.lit(0.0)
    for t in terms:
        inside = F.when(low.contains(t.lower()), 0.1).otherwise(0.0)
        score = score + (F.when(F.lower(title).contains(t.lower()), 1.0).otherwise(inside) if title is not None else inside)
    return score / (score + 1)


def base(chunks: DataFrame, codes: Sequence[str] | None = None, excluded_categories: Sequence[str] = (), excluded_types: Sequence[str] = ("BORDEREAU_AR",), min_chars: int = MIN_CHARS) -> DataFrame:
    """Chunks that may be found at all; a chunk without category is never excluded by category."""
    kept = chunks.where((F.col("n_chars") >= min_chars) & ~F.coalesce(F.col("excluded"), F.lit(False)) & ~F.col("doc_type").isin(list(excluded_types)))
    if codes:
        kept = kept.where(F.col("code").isin(list(codes)))
    return kept.where(F.col("category").isNull() | ~F.col("category").isin(list(excluded_categories))) if excluded_categories else kept


def prefilter(documents: DataFrame, condition: Column) -> list[str] | None:
    """Source files that match, if there are 1 to MAX_PREFILTER; else None: no filter applies."""
    found = [r[0] for r in documents.where(condition).select("source_file").distinct().orderBy("source_file").limit(MAX_PREFILTER + 1).collect()]
    return found if 0 < len(found) <= MAX_PREFILTER else None


def dynamic_cap(max_chunks: int, groups: int) -> int:
    """Chunks of a group when a prefilter left so many groups."""
    return min(15, max(2, max_chunks // max(1, groups)))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def exact_rank(scores: DataFrame, score: str, name: str, scratch: Scratch) -> DataFrame:
    """scores (query_id, chunk_id, score) with the rank by score, then chunk_id, in every query.

    No task sees a whole query: rows are dealt by ranges of query, score and chunk_id, so that equal scores
    are parted too, and written; the numbers of rows in the parts before, one for each part and query, are
    added to the rank within a part.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scores.repartitionByRange(parts, F.col("query_id"), F.desc_nulls_last(score), F.col("chunk_id")).withColumn("part", F.spark_partition_id())
    dealt = scratch.write(dealt, f"by_{score}")
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("part")) - F.col("n")
    counts = dealt.groupBy("query_id", "part").agg(F.count("*").alias("n")).select(F.col("query_id").alias("q_"), F.col("part").alias("part_"), before.alias("before"))
    within = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc_nulls_last(score), "chunk_id"))
    found = dealt.withColumn("within", within).join(counts, F.col("query_id").eqNullSafe(F.col("q_")) & (F.col("part") == F.col("part_")))
    return found.select(*scores.columns, (F.col("before") + F.col("within")).cast("int").alias(name))


def ranked(df: DataFrame, pool: int | None = None) -> DataFrame:
    """df (query_id, vec, lex, chunk_id and more) with each candidate's vec_rank and lex_rank in its query.

    Scores are computed once and ranked without the other columns, which join by chunk_id at the end; it
    must name one row of a query. With ``pool`` only candidates among the best of either score stay, with
    their ranks in both.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    scores = scratch.write(df.select("query_id", "chunk_id", "vec", "lex"), "scores")
    ranks = exact_rank(exact_rank(scores, "vec", "vec_rank", scratch), "lex", "lex_rank", scratch)
    if pool is not None:
        ranks = ranks.where((F.col("vec_rank") <= pool) | (F.col("lex_rank") <= pool))
    rest = df.drop("vec", "lex").withColumnRenamed("query_id", "q_").withColumnRenamed("chunk_id", "c_")
    found = ranks.join(rest, F.col("query_id").eqNullSafe(F.col("q_")) & (F.col("chunk_id") == F.col("c_")))
    return found.select(*df.columns, "vec_rank", "lex_rank")


def fused(df: DataFrame, boost: Column | float = 0.0, k: int = RRF_K) -> DataFrame:
    """rrf from both ranks and a boost."""
    return df.withColumn("rrf", 1.0 / (k + F.col("vec_rank")) + 1.0 / (k + F.col("lex_rank")) + (boost if isinstance(boost, Column) else F.lit(float(boost))))


def _first_of(batches: Iterator[pa.RecordBatch], pool: int) -> Iterator[pa.RecordBatch]:
    """The ``pool`` best rows of each query by either score, of one partition."""
    held: pa.Table | None = None

    def cut(rows: pa.Table) -> pa.Table:
        kept = []
        for query in pc.unique(rows["query_id"]):
            own = rows.filter(pc.equal(rows["query_id"], query) if query.is_valid else pc.is_null(rows["query_id"]))
            at = [pc.select_k_unstable(own, min(pool, own.num_rows), [(score, "descending"), ("chunk_id", "ascending")]) for score in ("vec", "lex")]
            kept.append(own.take(pc.unique(pa.concat_arrays(at))))
        return pa.concat_tables(kept)

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            held = cut(rows if held is None else pa.concat_tables([held, rows]))
    if held is not None:
        yield from held.combine_chunks().to_batches()


def candidates(df: DataFrame, pool: int) -> DataFrame:
    """query_id, chunk_id, vec, lex, vec_rank, lex_rank: the ``pool`` best of each query by either score, with their exact ranks in both.

    Two passes over the scores, and nothing of the table is ordered, shuffled or written: each part gives its
    best rows; then each counts its rows before every candidate, and the counts are added up. Meant for a
    handful of queries at a time: their candidates are known to every task.
    """
    low = F.lit(float("-inf"))
    scores = df.select("query_id", "chunk_id", F.coalesce("vec", low).alias("vec"), F.coalesce("lex", low).alias("lex"))
    some = scores.mapInArrow(lambda batches: _first_of(batches, pool), scores.schema)
    order = lambda score: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))
    tops = some.withColumns({"v_": order("vec"), "l_": order("lex")}).where((F.col("v_") <= pool) | (F.col("l_") <= pool)).drop("v_", "l_").collect()  # twice the pool for a query
    marks: dict[tuple[Any, str], list[tuple[float, str]]] = {}
    for row in tops:
        for score in ("vec", "lex"):
            marks.setdefault((row.query_id, score), []).append((-row[score], row.chunk_id))
    marks = {k: sorted(own) for k, own in marks.items()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[Any, str, int]] = Counter()
        for batch in batches:
            rows = batch.to_pydict()
            for score in ("vec", "lex"):
                for query, name, value in zip(rows["query_id"], rows["chunk_id"], rows[score], strict=True):
                    own = marks[query, score]
                    if (-value, name) <= own[-1]:  # what stands behind all candidates counts for none
                        found[query, score, bisect.bisect_right(own, (-value, name))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], batch_type), pa.array([k[1] for k in found], pa.string()), pa.array([k[2] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["query_id", "score", "at", "n"])

    kind = dict(scores.dtypes)["query_id"]
    batch_type = to_arrow_type(scores.schema["query_id"].dataType)
    counts = scores.mapInArrow(counted, f"query_id {kind}, score string, at long, n long").groupBy("query_id", "score", "at").agg(F.sum("n").alias("n")).collect()
    before: dict[tuple[Any, str], Counter[int]] = {}
    for row in counts:
        before.setdefault((row.query_id, row.score), Counter())[row["at"]] += row.n
    rank: dict[tuple[Any, str, str], int] = {}
    for (query, score), own in marks.items():
        total = 0
        for k, (_, name) in enumerate(own):
            total += before.get((query, score), Counter())[k]
            rank[query, score, name] = total + 1
    rows = [(r.query_id, r.chunk_id, r.vec, r.lex, rank[r.query_id, "vec", r.chunk_id], rank[r.query_id, "lex", r.chunk_id]) for r in tops]
    return df.sparkSession.createDataFrame(rows, StructType([*scores.schema.fields, StructField("vec_rank", IntegerType()), StructField("lex_rank", IntegerType())]))


def top_fused(df: DataFrame, finish: Callable[[DataFrame], DataFrame], n: int, boost: Column | float = 0.0, most_boost: float = 0.0, pool: int = 1000, k: int = RRF_K) -> DataFrame:
    """``finish(fused(ranked(df)))`` for a finish that gives the n best of each query by rrf, without ranking the table.

    A row that is among the ``pool`` best by neither score has an rrf of at most 2 / (k + pool + 1) + ``most_boost``.
    If each query's n rows are at least that, no other row can take a place among them or in their groups; else
    the pool is made larger, and beyond MAX_CANDIDATES the table is ranked after all. Intermediate rows are
    dropped; what is returned are the n rows, written.
    """
    scratch = Scratch(df.sparkSession, "search")
    total = None
    while pool <= MAX_CANDIDATES:
        found = candidates(df, pool)
        rest = df.drop("vec", "lex").withColumnRenamed("query_id", "q_").withColumnRenamed("chunk_id", "c_")
        whole = rest.join(F.broadcast(found), F.col("q_").eqNullSafe(F.col("query_id")) & (F.col("c_") == F.col("chunk_id"))).select(*df.columns, "vec_rank", "lex_rank")  # twice the pool for a query
        done = scratch.write(finish(fused(whole, boost, k)), f"found-{pool}")
        bound = 2.0 / (k + pool + 1) + most_boost
        known = {r.query_id: r.n for r in done.where(F.col("rrf") >= bound).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
        asked = {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
        short = [q for q in asked if known.get(q, 0) < n]
        if short:
            total = total or {r.query_id: r.n for r in df.groupBy("query_id").agg(F.count("*").alias("n")).collect()}
        if all(asked[q] == total[q] for q in short):
            return done
        scratch.drop(f"found-{pool}")
        pool *= 8
    return scratch.write(finish(fused(ranked(df), boost, k)), "found")


def type_boost(types: Sequence[str], amount: float = 0.01) -> Column:
    return F.when(F.col("doc_type").isin(list(types)), F.lit(amount)).otherwise(F.lit(0.0))


def diversified(df: DataFrame, cap: int, threshold: float, group: str = "doc_group", bypass: Column | None = None) -> DataFrame:
    """At most ``cap`` of a group by rrf, then the similarity threshold: it must not change the ranks.

    ``bypass`` keeps rows below the threshold for which it holds.
    """
    within = Window.partitionBy("query_id", group).orderBy(F.desc("rrf"), "chunk_id")
    near = F.col("vec") >= threshold
    return df.withColumn("group_rank", F.row_number().over(within)).where(F.col("group_rank") <= cap).where(near if bypass is None else near | bypass)


def first_of_text(df: DataFrame, chars: int = 300) -> DataFrame:
    """The best chunk of each opening of ``chars`` characters."""
    order = Window.partitionBy("query_id", F.trim(F.substring("text", 1, chars))).orderBy(F.desc("rrf"), "chunk_id")
    return df.withColumn("text_rank", F.row_number().over(order)).where("text_rank = 1").drop("text_rank")


def capped_by_source(df: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("query_id", "source_file").orderBy(F.desc("rrf"), "chunk_id")
    return df.withColumn("source_rank", F.row_number().over(order)).where(F.col("source_rank") <= cap).drop("source_rank")


def best(df: DataFrame, n: int) -> DataFrame:
    """The n best of each query, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _leading(df: DataFrame, within: Sequence[str], n: int, name: str) -> DataFrame:
    """The n best by rrf of each group with their rank: tasks keep n rows of a group before anything is shuffled."""
    order = Window.partitionBy(*within).orderBy(F.desc("rrf"), "chunk_id")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= n)


def _late_last(df: DataFrame, n: int, late: Column) -> DataFrame:
    """The n best of each query, those that are not late first; df holds a bounded number of rows of a query."""
    order = Window.partitionBy("query_id").orderBy("late", F.desc("rrf"), "chunk_id")
    return df.withColumn("late", late.cast("int")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("late")


def balanced(df: DataFrame, n_codes: int, n: int) -> DataFrame:
    """Each property's share first, then the best of the rest; at last by rrf."""
    target = max(1, n // max(1, n_codes))
    return _late_last(_leading(df, ["query_id", "code"], n, "place"), n, F.col("place") > target).drop("place", "rank")


def with_quota(df: DataFrame, n: int, wanted: Column, quota: int) -> DataFrame:
    """The n best, of which ``quota`` (or all there are) fulfil ``wanted``."""
    kinds = _leading(df.withColumn("wanted", F.coalesce(wanted, F.lit(False))), ["query_id", "wanted"], n, "place")
    return _late_last(kinds, n, ~(F.col("wanted") & (F.col("place") <= quota))).drop("place", "rank", "wanted")


def reranked(df: DataFrame, weight: float = 0.75, pool: int = POOL) -> DataFrame:
    """final = (1 - weight) * rrf scaled to 0..1 + weight * rerank over the best ``pool``; candidates
    without a rerank score keep their rrf order behind (fail open). ``place`` is the rank in the pool, null behind it."""
    pooled = _leading(df, ["query_id"], pool, "place").withColumn("in_pool", F.col("rerank").isNotNull())
    whole = Window.partitionBy("query_id", "in_pool")
    low, high = F.min("rrf").over(whole), F.max("rrf").over(whole)
    scaled = F.when(high > low, (F.col("rrf") - low) / (high - low)).otherwise(0.0)
    scored = pooled.withColumn("final", F.when(F.col("in_pool"), (1 - weight) * scaled + weight * F.col("rerank")))
    last = pooled.where(F.col("place") == pool).select(F.col("query_id").alias("q_"), F.col("rrf").alias("least_"), F.col("chunk_id").alias("c_"))  # a row for each query
    behind = (F.col("rrf") < F.col("least_")) | ((F.col("rrf") == F.col("least_")) & (F.col("chunk_id") > F.col("c_")))
    rest = df.join(F.broadcast(last), F.col("query_id").eqNullSafe(F.col("q_"))).where(behind).drop("q_", "least_", "c_")
    return scored.unionByName(rest.withColumns({"place": F.lit(None).cast("int"), "in_pool": F.lit(False), "final": F.lit(None).cast("double")}))


def rank_normalised(df: DataFrame, alpha: float = 0.4) -> DataFrame:
    """The older fusion: alpha * rank score + (1 - alpha) * rerank, ranks scaled to 1..0 over all candidates of a query."""
    scratch = Scratch(df.sparkSession, "ranks")
    held = scratch.write(df, "rows")
    places = exact_rank(held.select("query_id", "chunk_id", "rrf"), "rrf", "place_", scratch)
    sizes = held.groupBy("query_id").agg(F.count("*").alias("size_"))
    known = places.join(sizes, places["query_id"].eqNullSafe(sizes["query_id"])).select(places["query_id"].alias("q_"), F.col("chunk_id").alias("c_"), "place_", "size_")
    share = 1 - (F.col("place_") - 1) / F.greatest(F.lit(1), F.col("size_") - 1)
    both = held.join(known, F.col("query_id").eqNullSafe(F.col("q_")) & (F.col("chunk_id") == F.col("c_")))
    return both.withColumn("final", alpha * share + (1 - alpha) * F.col("rerank")).drop("q_", "c_", "place_", "size_")


def yearly(df: DataFrame, first: int, last: int, n: int) -> DataFrame:
    """A span of three years or more as one query a year: each year's best fill a quota, the rest by rrf."""
    inside = df.where(F.col("year").between(first, last))
    if last - first < 2:
        return best(inside, n)
    years = last - first + 1
    quota = max(5, n // (2 * years))
    return _late_last(_leading(inside, ["query_id", "year"], n, "place"), n, F.col("place") > quota).drop("place")


def ranked_by_year(df: DataFrame, first: int, last: int) -> DataFrame:
    """``ranked`` with one sub-query for each year of a span: ranks, and what follows from them, are a year's own."""
    by_year = df.where(F.col("year").between(first, last)).withColumn("asked", F.col("query_id")).withColumn("query_id", F.concat_ws("/", F.col("asked").cast("string"), F.col("year").cast("string")))
    return ranked(by_year).drop("query_id").withColumnRenamed("asked", "query_id")


def discover(chunks: DataFrame, query: Sequence[float], n: int = POOL) -> DataFrame:
    """Properties that a query vector meets: the n nearest chunks, then count, best snippet and similarity by code."""
    vector = F.array(*map(F.lit, query))
    near = chunks.where(~F.coalesce(F.col("excluded"), F.lit(False))).withColumn("vec", cosine(F.col("embedding"), vector))
    near = near.orderBy(F.desc("vec"), "chunk_id").limit(n)
    best_first = F.struct("vec", F.expr("reverse(chunk_id)"))
    return near.groupBy("code").agg(F.count("*").alias("n_chunks"), F.countDistinct("source_file").alias("n_documents"), F.sort_array(F.collect_set("doc_type")).alias("doc_types"), F.round(F.max("vec"), 4).alias("similarity"), F.max_by(F.substring("text", 1, 220), best_first).alias("snippet"))


# Questions about elections.
ELECTIONS = ("[ée]lu|[ée]lection|membre.*conseil.*syndical", "qui.*(?:siège|compose|élu)", "conseil\\s+syndical.*(?:compos|membre|élu)", "titulaire|suppléant", "pr[ée]sident.*(?:séance|AG|assemblée)")
PROCEDURAL = ("PROCEDURE_AG", "ELECTION_CS")


def without_procedure(df: DataFrame, question: str, mode: str) -> DataFrame:
    """In an inventory, procedural chunks go unless the question is about elections; chunks without category stay."""
    if mode != "inventory" or any(re.search(p, question, re.I) for p in ELECTIONS):
        return df
    return df.where(F.col("category").isNull() | ~F.col("category").isin(list(PROCEDURAL)))


# Endings of French words that a light stemmer takes off, the longest first.
ENDINGS = ("issements", "issement", "atrices", "ateurs", "ations", "atrice", "ateur", "ation", "ements", "ement", "euses", "ences", "ances", "iques", "ismes", "ables", "istes", "euse", "ence", "ance", "ique", "isme", "able", "iste", "ives", "ités", "ites", "ifs", "ive", "ité", "ite", "eux", "aux", "if", "ées", "ée", "és", "er", "es", "é", "e", "s", "x")


#: The longest ending of a folded word that leaves three letters.
ENDING = "(?<=[a-z]{3})(" + "|".join(sorted({tx.plain(e) for e in ENDINGS}, key=lambda e: (-len(e), e))) + ")$"


def folded_words(text: Column) -> Column:
    """Folded words of two letters or digits or more, as they stand in the text."""
    return F.regexp_extract_all(tx.fold_latin(text), F.lit("([a-z0-9]{2,})"), 1)


def stems(text: Column) -> Column:
    """Folded words of two letters or digits or more, without their longest ending that leaves three letters."""
    return F.transform(folded_words(text), lambda w: F.regexp_replace(w, ENDING, ""))


def lexical_rank(text: Column, title: Column, query: str) -> Column:
    """Rank of a document for the words of a query by stems: a hit in the title weighs 1.0, in the text 0.1, both
    with falling weight for each further hit (1 / k ** 2), saturated as r / (r + 1); 0 unless every word occurs."""
    wanted = F.array_distinct(stems(F.lit(query)))

    def score(body: Column, head: Column) -> Column:
        def one(w: Column) -> Column:
            count = lambda where: F.size(F.filter(where, lambda x: x == w))
            series = lambda n: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, k: s + 1.0 / (k * k))).otherwise(0.0)
            return series(count(head)) + 0.1 * series(count(body))

        hits = F.transform(wanted, one)
        total = F.aggregate(hits, F.lit(0.0), lambda s, x: s + x)
        return F.when((F.size(wanted) > 0) & F.forall(hits, lambda x: x > 0), total / (total + 1)).otherwise(0.0)

    return tx.let(F.struct(stems(text).alias("body"), stems(F.coalesce(title, F.lit(""))).alias("head")), lambda x: score(x["body"], x["head"]))
