"""Language identification by compression.

Each language has a zstandard dictionary of raw content: fragments of labelled documents. A text,
lower-cased and reduced to letters, is compressed with each dictionary in blocks, all of it; the
language whose dictionary gives the fewest bytes is the answer, and the answer is rejected where the
runner-up is almost as small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta

#: The bounded sample that dictionaries are made of: documents of a language, characters of each.
SAMPLE_DOCS, FRAGMENT = 320, 1024
#: Bytes compressed at once, so that a long text cannot crowd the dictionary out of the window.
BLOCK = 1 << 14
#: Up to so many bytes the parser that looks for the smallest form is worth its time. Ties go to the more frequent language.
SHORT = 512
#: Rejected if the runner-up's bytes are less than this share above the smallest.
MARGIN = 0.002

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def crc_bucket(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def letters(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in small letters with single spaces for all that is ASCII and no letter, each by itself."""
    out = _FOLD[buf]
    if len(buf) > 1:
        upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[upper] += 0x20
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
        keep[offsets[offsets < len(out)]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], kept[offsets]


def learn(documents: DataFrame) -> dict[str, bytes]:
    """lang to the raw content of its dictionary, from rows with text and lang; the most frequent first.

    Every value of lang is learned. What reaches the driver are two counts for each language and
    SAMPLE_DOCS fragments of each. Rows are chosen by a hash of their text, so copies count once.
    """
    rows = documents.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r[0]: r[2] for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * SAMPLE_DOCS / n))])
    drawn = rows.where((F.pmod("h", F.lit(1 << 20)) / float(1 << 20)) < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h")
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.lit(1), F.length("text") - FRAGMENT + 1)) + 1
    cut = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).select("lang", "k", F.substring("text", at.cast("int"), F.lit(FRAGMENT)).alias("part"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in cut.collect():
        found.setdefault(r.lang, []).append((r.k, r.part))
    out = {}
    for lang, parts in sorted(found.items()):
        raw = " ".join(p for _, p in sorted(parts)).encode()
        buf, _ = letters(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out[lang] = buf.tobytes()
    return {k: out[k] for k in counts if len(out.get(k, b"")) >= 8}


class Classifier:
    """Compressors of all languages, made anew in each worker."""

    def __init__(self, contents: dict[str, bytes]):
        import zstandard as zs

        self.langs = list(contents)
        usual = {"strategy": zs.STRATEGY_GREEDY, "min_match": 4, "search_log": 3}
        short = {"strategy": zs.STRATEGY_BTULTRA, "min_match": 3, "search_log": 6}
        self.usual, self.short = ([self._compressor(zs, contents[lang], kind) for lang in self.langs] for kind in (usual, short))

    @staticmethod
    def _compressor(zs, raw: bytes, kind: dict) -> Callable[[bytes], bytes]:
        params = zs.ZstdCompressionParameters(hash_log=17, chain_log=17, window_log=19, write_content_size=False, write_checksum=False, write_dict_id=False, **kind)
        content = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        return zs.ZstdCompressor(compression_params=params, dict_data=content).compress

    def sizes(self, text: bytes) -> list[int]:
        if len(text) <= SHORT:
            return [len(f(text)) for f in self.short]
        blocks = [text[o : o + BLOCK] for o in range(0, len(text), BLOCK)]
        return [sum(len(f(b)) for b in blocks) for f in self.usual]

    def judge(self, text: bytes) -> tuple[str, float, float]:
        """(language, score, margin) of a text of letters."""
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(rest) - sizes[best]) / max(1, min(rest)) if rest else 1.0
        scale = 4 + 0.01 * sizes[best]
        return self.langs[best], float(1 / (1 + np.exp([(sizes[best] - s) / scale for s in rest]).sum())), margin


def _judged(model: Classifier, batch: pa.RecordBatch, text: int) -> tuple[list[str], list[float], list[float], list[bool]]:
    buf, offsets, null = ta.column(batch.column(text))
    out: tuple[list[str], list[float], list[float], list[bool]] = ([], [], [], [])
    for a, b in ta.row_slices(offsets):
        part, bounds = letters(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        raw = part.tobytes()
        for k in range(b - a):
            body = raw[bounds[k] : bounds[k + 1]]
            lang, score, margin = "und", 0.0, 0.0
            if model.langs and not null[a + k] and body.strip():
                some = min(body.translate(None, b" "), default=255) < 128 or any(c.isalpha() for c in body.decode("utf-8", "replace"))
                if some:
                    lang, score, margin = model.judge(body)
            for x, y in zip(out, (lang, score, margin, lang == "und" or margin < MARGIN), strict=True):
                x.append(y)
    return out


def identify(documents: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for each row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0 and rejected, as is every text if
    no language was learned. Rows repeated give equal rows; extra columns are not read; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(contents)
        for batch in batches:
            lang, score, margin, rejected = _judged(model, batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(ta.tidy(run), "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def _learned(documents: DataFrame) -> dict[str, bytes]:
    return learn(documents.where(F.coalesce(crc_bucket("doc_id", 4) != 2, F.lit(True))))


def op1_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole documents table; a null doc_id counts as not held out."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(documents, _learned(documents))
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose language is rejected; columns stay as they are.

    Rows with a null text, an empty one or one without a letter go; repeated rows are judged alike; where no
    row has a language nothing is learned and every row goes; an empty table stays empty.
    """
    contents, text, schema = _learned(docs), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(contents)
        for batch in batches:
            yield batch.filter(pa.array([not x for x in _judged(model, batch, text)[3]], pa.bool_()))

    return docs.mapInArrow(ta.tidy(run), schema)
