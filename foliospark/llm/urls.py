"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

The classifier is trained on the driver from a small labelled table of URLs, a parameter. Scoring
hashes the n-grams of a batch of URLs as ranges of one byte array and sums their weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta

GRAMS = (3, 4, 5)
BITS = 16
#: (action, host, path); a rule fits its host and all subdomains where the path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: URLs labelled by hand: 1 is unwanted.
LABELLED = (
    ("http://www.cheap-pills.test/buy/now", 1), ("https://cheap-meds.test/pills?id=1", 1), ("http://online-pills-shop.test/discount", 1), ("https://best-pharmacy-deals.test/viagra", 1),
    ("http://free-bets.test/en/12", 1), ("https://m.freebets-online.test/bonus", 1), ("http://casino-royal.test/slots", 1), ("https://lucky-casino.test/poker/free", 1), ("http://bets-and-slots.test/win", 1),
    ("https://adult-x.test/videos", 1), ("http://www.adult-cams.test/live", 1), ("https://xxx-adult.test/fr/9", 1), ("http://hot-adult-dating.test/join", 1),
    ("http://spam-farm.test/links", 1), ("https://www.spam-links-farm.test/es/31.html", 1), ("http://www.casino-wins.test/en/85", 1), ("https://link-farm.test/page1", 1), ("http://spamfarm.test/en/seo-links", 1), ("https://seo-spam.test/backlinks", 1),
    ("http://replica-watches-cheap.test/sale", 1), ("https://payday-loans-fast.test/apply", 1), ("http://get-rich-quick.test/crypto", 1), ("https://download-free-cracks.test/keygen", 1),
    ("http://warez-torrent.test/crack", 1), ("https://clickbait-news.test/you-wont-believe", 1), ("http://free-ringtones.test/download", 1),
    ("https://www.library.test/catalogue/history", 0), ("http://news.daily-report.test/world/2021/05", 0), ("https://blog.gardening.test/tomatoes", 0), ("http://university.test/departments/physics", 0),
    ("https://docs.project.test/en/guide/install", 0), ("http://www.cityhall.test/services/permits", 0), ("https://museum.test/exhibits/ancient", 0), ("http://recipes.test/fr/soup", 0),
    ("https://m.weather.test/forecast/today", 0), ("http://forum.cycling.test/thread/88", 0), ("https://www.bakery.test/bread", 0), ("http://journal.science.test/articles/77", 0),
    ("https://en.encyclopedia.test/wiki/river", 0), ("http://school.test/lessons/math", 0), ("https://www.theatre.test/programme", 0), ("http://travel.test/de/berlin", 0),
    ("https://hospital.test/en/clinics", 0), ("http://archive.test/es/12", 0), ("https://maps.test/region/north", 0), ("http://www.books.test/page?id=4", 0),
    ("https://radio.test/shows/morning", 0), ("http://www.parliament.test/records", 0), ("https://music.test/en/330", 0), ("http://www.theory.test/fr/550.html", 0),
    ("https://blog.other.test/en/118", 0), ("http://m.thatinn.test/de/217", 0), ("https://www.thestreet.test/es/76", 0), ("http://this-and-that.test/en/9/", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for null or without ``://``."""
    known = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(known > 0, F.substring(url, known + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts with a mark before and after each, and their bounds."""
    raw = [b"\x02" + (t or "").encode() + b"\x03" for t in texts.to_pylist()]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=bounds[1:])
    return np.frombuffer(b"".join(raw), np.uint8), bounds


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram of host and path, each kind hashed on its own."""
    rows, slots = [], []
    for field, texts in enumerate((hosts, paths)):
        buf, bounds = _flat(texts)
        if not len(buf):
            continue
        ranges = ta.Ranges(ta.numbers(41, 256)[buf])
        row, stop = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
        for n in GRAMS:
            at = np.flatnonzero(np.arange(len(buf)) + n <= stop)
            rows.append(row[at])
            slots.append((ta.mix(ranges.hash(at, at + n) ^ np.uint64(16 * field + n)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*slots, np.zeros(0, np.int64)])


class Model:
    """Weights of hashed n-grams; a row's input is the mean of its n-grams' weights, times SCALE."""

    SCALE = 8.0

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    @classmethod
    def train(cls, hosts: pa.Array, paths: pa.Array, labels: np.ndarray, ridge: float = 1e-4, rounds: int = 1500, rate: float = 2.0) -> Model:
        row, slot = features(hosts, paths)
        n = len(labels)
        share = cls.SCALE / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]
        used, column = np.unique(slot, return_inverse=True)
        x = np.zeros((n, len(used)))
        np.add.at(x, (row, column), share)
        w, b = np.zeros(len(used)), 0.0
        gram = x @ x.T / n
        rate = rate / (np.linalg.eigvalsh(gram)[-1] / 4 + ridge)
        for _ in range(rounds):
            error = 1 / (1 + np.exp(-(x @ w + b))) - labels
            w -= rate / 2 * (x.T @ error / n + ridge * w)
            b -= 0.5 * float(error.mean())
        weights = np.zeros(1 << BITS)
        weights[used] = w
        return cls(weights, b)

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, slot = features(hosts, paths)
        n = len(hosts)
        total = np.bincount(row, self.weights[slot], n).astype(float) * self.SCALE / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        return 1 / (1 + np.exp(-(total + self.intercept)))


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED) -> Model:
    """A model from a small table of (url, label)."""
    if not labelled:
        return Model(np.zeros(1 << BITS), -1.0)
    host, path = host_and_path(F.col("url"))
    rows = spark.createDataFrame(list(labelled), "url string, label int").select(host, path, "label").collect()
    return Model.train(pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), np.array([r[2] for r in rows], float))


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page.

    The longest rule that fits decides (of equal ones the first), else a score of 0.5 or more blocks.
    A null URL or one without ``://`` has an empty host and path. Rows repeated give equal rows; extra
    columns are not read; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last that fits stays
        fits = ((F.col("host") == rule_host) | F.col("host").endswith(f".{rule_host}")) & F.col("path").startswith(rule_path)
        rule, action = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, act).otherwise(action)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column(1), batch.column(2)))], [*batch.schema.names, "score"])

    scored = named.mapInArrow(run, "page_id long, host string, path string, score double")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op10_url_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole pages table."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), train(spark))
