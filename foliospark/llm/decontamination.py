"""Benchmark decontamination by templates.

Texts become sequences of template tokens: words with a digit are <number>, measures after a number
are <unit>, runs of capitalised words inside a sentence are <name>, all others (words in capitals too)
stand for themselves in small letters without punctuation. Windows of template tokens of the benchmark are hashed, the
windows of every document are looked up among them, and for each document and item that share enough
windows, or RUN of them side by side, the slots are compared along the best alignment: an item's value
must always stand for the same value of the document. So copies are found, and questions asked again with other numbers or names.

Items without a window (of fewer than SHORTEST tokens, or of placeholders nearly all) are looked for
word by word instead, as they are.

A benchmark of up to BLOCK_CHARS characters is a hash table that each task holds. A larger one is a
table of windows that is joined by hash with those of the documents; only the documents and items that
meet there often enough are judged, pair by pair, by the same rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta
from foliospark.llm.near_duplicates import slot_of, wanted_bits
from foliospark.storage import Scratch

WINDOW = 8
#: Shorter items are one window of their own length; below this their words are looked for as they are.
SHORTEST = 4
#: Fewer words than this say nothing.
FEWEST = 2
#: Words of an item without windows that are looked up; the others are compared where these stand.
HEAD = 8
#: Share of an item's windows that must stand in a document; share of slots that must be consistent.
COVERAGE, CONSISTENCY = 0.5, 0.85
#: Windows side by side that suffice whatever their share of the item is: 20 tokens in a row, with consistent slots.
RUN = 13
#: Share of a window's tokens that must be words: placeholders alone identify nothing.
LITERAL = 0.5
#: Characters of a benchmark that each task may hold: measured, its index has 7 bytes for each (58 MB), 4 of them shipped, and 45 while the driver builds it.
BLOCK_CHARS = 8_000_000

UNITS = ("mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
         "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl dl l liter liters litre litres gallon gallons cup cups pint pints "
         "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
         "kmh kph mph ms hz khz mhz ghz w kw mw wh kwh v kv a ma n kn pa kpa bar j kj cal kcal c f k kelvin celsius fahrenheit degree degrees percent "
         "cent cents dollar dollars euro euros eur usd gbp yen b kb mb gb tb bit bits byte bytes").split()  # fmt: skip

_U = np.uint64
NUMBER, UNIT, NAME = 1, 2, 3
_TAGS = ta.numbers(909, 4)

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SOLID = np.ones(256, bool)
_SOLID[[b for b in range(128) if not chr(b).isalnum()]] = False


def _unit_hashes() -> np.ndarray:
    raw = " ".join(UNITS).encode()
    return np.sort(ta.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), bare=True).hashes)


_UNITS = _unit_hashes()


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


class Templates:
    """Template tokens of a block of texts: token and value hashes, kind (0: a word), row bounds; words and
    word_bounds are the plain words behind them."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = buf
        upper = (buf >= 65) & (buf <= 90)
        if len(buf) > 1:
            wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97))
            low = buf.copy()
            low[wide + 1] += 0x20
            upper[wide] = True
        words = ta.Words(low, offsets, bare=True)
        row = words.rows()
        if not len(row):
            self.tokens = self.values = np.zeros(0, _U)
            self.kinds, self.bounds = np.zeros(0, np.int8), np.zeros(len(offsets), np.int64)
            self.words, self.word_bounds = self.tokens, self.bounds
            return
        solid = np.flatnonzero(_SOLID[buf])
        first = np.append(solid, len(buf))[np.searchsorted(solid, words.starts)]
        some = first < words.ends
        digits, breaks = np.zeros(len(buf) + 1, np.int64), np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_DIGIT[buf], out=digits[1:])
        np.cumsum(buf == 10, out=breaks[1:])
        opens = np.ones(len(row), bool)
        opens[1:] = _ENDS[buf[words.ends[:-1] - 1]] | (breaks[words.starts[1:]] > breaks[words.ends[:-1]]) | (row[1:] != row[:-1])
        number = digits[words.ends] > digits[words.starts]
        head = np.minimum(first, len(buf) - 1)
        second = head + 1 + (buf[head] >= 0xC0)
        shout = (second < words.ends) & upper[np.minimum(second, len(buf) - 1)]
        name = upper[head] & ~shout & ~opens & ~number
        kept = np.flatnonzero(some)
        h, row, number, name, opens = words.hashes[kept], row[kept], number[kept], name[kept], opens[kept]
        if not len(kept):
            self.tokens = self.values = np.zeros(0, _U)
            self.kinds, self.bounds = np.zeros(0, np.int8), np.zeros(len(offsets), np.int64)
            self.words, self.word_bounds = self.tokens, self.bounds
            return
        self.words, self.word_bounds = h, np.searchsorted(row, np.arange(len(offsets)))
        after = np.zeros(len(h), bool)
        after[1:] = number[:-1] & (row[1:] == row[:-1])
        kinds = np.where(number, NUMBER, np.where(after & _among(_UNITS, h), UNIT, np.where(name, NAME, 0))).astype(np.int8)
        head = np.ones(len(h), bool)
        head[1:] = ~((kinds[1:] == NAME) & (kinds[:-1] == NAME) & (row[1:] == row[:-1]))
        at = np.flatnonzero(head)
        upto = np.append(at[1:], len(h))
        self.kinds = kinds[at]
        self.values = ta.Ranges(h).hash(at, upto)
        self.tokens = np.where(self.kinds > 0, _TAGS[self.kinds], self.values)
        self.bounds = np.searchsorted(row[at], np.arange(len(offsets)))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of all windows of n tokens with enough words in them."""
        if len(self.tokens) < n:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        stop = np.repeat(self.bounds[1:], np.diff(self.bounds))
        at = np.arange(len(self.tokens) - n + 1)
        words = np.zeros(len(self.kinds) + 1, np.int64)
        np.cumsum(self.kinds == 0, out=words[1:])
        at = at[(at + n <= stop[: len(at)]) & (words[at + n] - words[at] >= LITERAL * n)]
        return at, ta.mix(ta.Ranges(self.tokens).hash(at, at + n) ^ _U(n))


class Index:
    """Windows of benchmark items, by hash."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        raw = [t.encode() for _, t in items]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=offsets[1:])
        t = Templates(buf, offsets)
        self.templates = t
        sizes = np.diff(t.bounds)
        hashes, items_, places = [], [], []
        self.lengths = sorted({int(min(WINDOW, n)) for n in sizes if n >= SHORTEST})
        owner = np.repeat(np.arange(len(raw)), sizes)
        for n in self.lengths:
            at, h = t.windows(n)
            fits = np.minimum(sizes[owner[at]], WINDOW) == n
            hashes.append(h[fits])
            items_.append(owner[at[fits]])
            places.append(at[fits])
        h = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.place = h[order], np.concatenate([*items_, np.zeros(0, np.int64)])[order], np.concatenate([*places, np.zeros(0, np.int64)])[order]
        self.total = np.bincount(self.item, minlength=len(raw))
        self.width = np.minimum(sizes, WINDOW)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.hashes >> _U(44)] = True
        plain = np.diff(t.word_bounds)
        self.exact = np.flatnonzero((self.total == 0) & (plain >= FEWEST))
        ranges = ta.Ranges(t.words)
        start = t.word_bounds[self.exact]
        self.exact_size = plain[self.exact]
        self.exact_hash = ranges.hash(start, start + self.exact_size)
        heads = ta.mix(ranges.hash(start, start + np.minimum(self.exact_size, HEAD)) ^ np.minimum(self.exact_size, HEAD).astype(_U))
        order = np.argsort(heads, kind="stable")
        self.heads, self.exact, self.exact_size, self.exact_hash = heads[order], self.exact[order], self.exact_size[order], self.exact_hash[order]

    def stands(self, t: Templates) -> list[tuple[int, int]]:
        """(row, item) of the items without windows that stand in the rows of t word by word."""
        n = len(t.words)
        if not len(self.exact) or not n:
            return []
        ranges, stop, out = ta.Ranges(t.words), np.repeat(t.word_bounds[1:], np.diff(t.word_bounds)), set()
        for size in np.unique(np.minimum(self.exact_size, HEAD)).tolist():
            at = np.flatnonzero(np.arange(n) + size <= stop)
            h = ta.mix(ranges.hash(at, at + size) ^ _U(size))
            lo, hi = np.searchsorted(self.heads, h, "left"), np.searchsorted(self.heads, h, "right")
            for k in np.flatnonzero(hi > lo).tolist():
                entry = np.arange(lo[k], hi[k])
                end = at[k] + self.exact_size[entry]
                entry, end = entry[end <= stop[at[k]]], end[end <= stop[at[k]]]
                same = ranges.hash(np.full(len(end), at[k]), end) == self.exact_hash[entry]
                row = int(np.searchsorted(t.word_bounds, at[k], "right")) - 1
                out |= {(row, int(i)) for i in self.exact[entry[same]]}
        return sorted(out)

    def matches(self, t: Templates) -> tuple[np.ndarray, np.ndarray]:
        """(document position, index entry) of all windows found."""
        found = []
        for n in self.lengths:
            at, h = t.windows(n)
            may = np.flatnonzero(self.marks[h >> _U(44)])
            at, h = at[may], h[may]
            lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            count = hi - lo
            entry = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append((np.repeat(at, count), entry))
        return (np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _judge(index: Index, t: Templates) -> list[tuple[int, int, float, int, float, bool]]:
    """(row, item, coverage, slots, consistency, verbatim) of what is found in the rows of t."""
    at, entry = index.matches(t)
    out = [(row, i, 1.0, 0, 1.0, True) for row, i in index.stands(t)]
    if not len(at):
        return out
    row = np.searchsorted(t.bounds, at, "right") - 1
    item = index.item[entry]
    order = np.lexsort((index.place[entry], item, row))
    at, entry, row, item = at[order], entry[order], row[order], item[order]
    edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
        place = index.place[entry[a:b]]
        i = int(item[a])
        coverage = len(np.unique(place)) / index.total[i]
        shift = at[a:b] - place
        if coverage >= COVERAGE:
            best, count = np.unique(shift, return_counts=True)
            tries = [(int(best[count.argmax()]), place[shift == best[count.argmax()]], False)]
        else:
            tries = []
        tries += _runs(place, shift)
        for shift_, held, exact in tries:
            agreed = _agreement(index, t, i, held, shift_)
            if agreed[2] if exact else agreed[1] >= CONSISTENCY:
                out.append((int(row[a]), i, float(coverage), *agreed))
                break
    return out


def _runs(place: np.ndarray, shift: np.ndarray) -> list[tuple[int, np.ndarray, bool]]:
    """(shift, places, exact) of all runs of RUN or more windows found side by side, the longest first.

    The parts of RUN windows follow, which count only if they are verbatim (exact): a part of a run
    whose slots differ has too few slots to tell new parameters from another text.
    """
    if len(place) < RUN:
        return []
    order = np.lexsort((place, shift))
    p, s = place[order], shift[order]
    edges = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (p[1:] > p[:-1] + 1), [True]]))
    found = [(int(s[x]), p[x:y], False) for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if y - x >= RUN]
    parts = [(k, held[o : o + RUN], True) for k, held, _ in found for o in range(len(held) - RUN + 1)]
    return sorted(found, key=lambda x: -len(x[1])) + parts


def _agreement(index: Index, t: Templates, i: int, held: np.ndarray, shift: int) -> tuple[int, float, bool]:
    """(slots, consistency, verbatim) of the windows held of an item."""
    tokens = np.unique(np.add.outer(held, np.arange(index.width[i])))
    slots = tokens[index.templates.kinds[tokens] > 0]
    asked, said = index.templates.values[slots], t.values[slots + shift]
    agree = 0
    for v in np.unique(asked):
        agree += int(np.unique(said[asked == v], return_counts=True)[1].max())
    return len(slots), agree / len(slots) if len(slots) else 1.0, bool((asked == said).all())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()


def _index(items: DataFrame) -> Index | None:
    """The table that each task holds; None if the benchmark is too large for that."""
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if chars > BLOCK_CHARS:
        return None
    return Index(sorted(((r[0], r[1]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))  # BLOCK_CHARS characters at most


def _batches(batch: pa.RecordBatch, text: int, index: Index) -> Iterator[tuple[int, list[tuple[int, int, float, int, float, bool]]]]:
    buf, offsets, _ = ta.column(batch.column(text))
    for a, b in ta.row_slices(offsets):
        yield a, _judge(index, Templates(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def _found(ids: pa.Array, items: pa.Array, found: list[tuple[float, int, float, bool]]) -> pa.RecordBatch:
    coverage, slots, consistency, verbatim = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [ids, items, pa.array(coverage, pa.float64()), pa.array(slots, pa.int32()), pa.array(consistency, pa.float64()), pa.array(["verbatim" if v else "reparameterised" for v in verbatim], pa.string())],
        ["doc_id", "item_id", "coverage", "n_slots", "consistency", "kind"],
    )


_SCHEMA = "doc_id long, item_id long, coverage double, n_slots int, consistency double, kind string"


def _keys(kinds: str):
    """Hashes of the windows of each row (kinds: ``item``, with the number that suffices, or ``doc``), and of the heads of items without windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = ta.column(batch.column(1))
            for a, b in ta.row_slices(offsets):
                t = Templates(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size, rows, hashes, exact = np.diff(t.bounds), [], [], []
                for n in range(SHORTEST, WINDOW + 1):
                    at, h = t.windows(n)
                    row = np.searchsorted(t.bounds, at, "right") - 1
                    fits = (np.minimum(size[row], WINDOW) == n) if kinds == "item" else np.ones(len(at), bool)
                    rows.append(row[fits])
                    hashes.append(h[fits])
                    exact.append(np.zeros(int(fits.sum()), bool))
                ranges, plain = ta.Ranges(t.words), np.diff(t.word_bounds)
                total = np.bincount(np.concatenate(rows), minlength=b - a)
                for n in range(FEWEST, HEAD + 1):
                    if kinds == "item":
                        row = np.flatnonzero((total == 0) & (np.minimum(plain, HEAD) == n))
                        at = t.word_bounds[row]
                    else:
                        stop = np.repeat(t.word_bounds[1:], plain)
                        at = np.flatnonzero(np.arange(len(stop)) + n <= stop)
                        row = np.searchsorted(t.word_bounds, at, "right") - 1
                    rows.append(row)
                    hashes.append(ta.mix(ta.mix(ranges.hash(at, at + n) ^ _U(n)) ^ _U(1)) if len(at) else np.zeros(0, _U))
                    exact.append(np.ones(len(at), bool))
                row, h, exact_ = np.concatenate(rows), np.concatenate(hashes), np.concatenate(exact)
                enough = np.where(exact_, 1, np.minimum(np.ceil(COVERAGE * total[row]), RUN)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row + a).cast(pa.int64()), ta.signed(h), pa.array(enough)], ["row", "hash", "enough"])

    return run


def _numbered(keys, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The keys of a batch with the columns that name its rows instead of their numbers."""
    for found in keys(iter([rows])):
        at = found.column(0)
        yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(2).take(at), found.column(1), found.column(2)], ["id", "sum", "hash", "enough"])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``contaminated`` for a benchmark of any size: windows of both sides meet by hash, pairs are judged.

    Rows are named by id and a hash of their text. Only hashes, names and counts are shuffled until it
    is known which pairs share as many windows as a finding needs.
    """
    scratch = Scratch(docs.sparkSession, "decontamination")
    named = lambda df, name: df.select(F.col(name).alias("id"), "text", F.xxhash64("text").alias("sum"))
    keyed = lambda df, kind: df.mapInArrow(lambda batches: (out for b in batches for out in _numbered(_keys(kind), b)), "id long, sum long, hash long, enough long")
    ours = scratch.write(keyed(named(items, "item_id").distinct(), "item").groupBy(F.col("id").alias("item_id"), F.col("sum").alias("item_sum"), "hash").agg(F.count("*").alias("places"), F.min("enough").alias("enough")), "items")
    bits = wanted_bits(ours, "hash")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits, np.uint8)
        for batch in batches:
            slot = np.asarray(batch.column(3)).astype(np.int64)
            keep = (held[slot >> 3] >> (slot & 7)) & 1
            yield batch.filter(pa.array(keep.astype(bool)))

    theirs = keyed(named(docs, "doc_id").where("text is not null"), "doc").select("id", "sum", "hash", slot_of("hash").alias("slot")).mapInArrow(wanted, "id long, sum long, hash long, slot long")
    theirs = scratch.write(theirs.select(F.col("id").alias("doc_id"), F.col("sum").alias("doc_sum"), F.col("hash").alias("hash_")).distinct(), "documents")
    met = theirs.join(ours, F.col("hash_") == F.col("hash")).groupBy("doc_id", "doc_sum", "item_id", "item_sum").agg(F.sum("places").alias("n"), F.min("enough").alias("enough"))
    met = scratch.write(met.where("n >= enough").drop("n", "enough"), "met")
    texts = lambda df, name, text: named(df, name).distinct().select(F.col("id").alias(f"{text}_id"), F.col("sum").alias(f"{text}_key"), F.col("text").alias(text))
    pairs = met.join(texts(items, "item_id", "asked"), F.col("item_id").eqNullSafe(F.col("asked_id")) & (F.col("item_sum") == F.col("asked_key")))
    rows = docs.select(F.col("doc_id").alias("said_id"), F.col("text").alias("said"), F.xxhash64("text").alias("said_key"))
    pairs = pairs.join(rows, F.col("doc_id").eqNullSafe(F.col("said_id")) & (F.col("doc_sum") == F.col("said_key"))).select("doc_id", "item_id", "asked", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = ta.column(batch.column(3))
            keep, found = [], []
            for k, asked in enumerate(batch.column(2).to_pylist()):
                hit = _judge(Index([(0, asked)]), Templates(buf[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])))
                keep += [k] * len(hit)
                found += [h[2:] for h in hit]
            at = pa.array(keep, pa.int64())
            yield _found(batch.column(0).take(at), batch.column(1).take(at), found)

    return pairs.mapInArrow(run, _SCHEMA)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, coverage, n_slots,
    consistency, kind (``verbatim``: all slots hold the item's own values, else ``reparameterised``).

    Null texts hold nothing and null items are held by nothing; items of one word are not looked for.
    Repeated documents give repeated rows; a repeated item (item_id and text) counts once, items of equal text
    and other ids are found each; extra columns are not read; an empty table on either side gives
    an empty result.
    """
    docs, items = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _items(benchmark)
    index = _index(items)
    if index is None:
        return _joined(docs, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a + r, *rest) for a, found in _batches(batch, 1, index) for r, *rest in found]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield _found(ids, pa.array([index.ids[r[1]] for r in rows], pa.int64()), [r[2:] for r in rows])

    return docs.mapInArrow(run, _SCHEMA)


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, over the whole documents and benchmark tables."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns stay as they are."""
    items = _items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    index = _index(items)
    if index is None:
        # named by their text, so that rows without doc_id go too
        texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
        gone = Scratch(spark, "contaminated").write(_joined(texts, items).select(F.col("doc_id").alias("gone_sum")).distinct(), "gone")
        return docs.join(gone, F.xxhash64(docs["text"].cast("string")) == gone["gone_sum"], "left_anti")
    text, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, found in _batches(batch, text, index):
                keep[[a + r[0] for r in found]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(ta.tidy(run), schema)
