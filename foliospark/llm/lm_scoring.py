"""Masked pseudo-likelihood of documents under a bidirectional window network.

Words become VOCABULARY token ids: the edge of a text, the corpus's most frequent words, and classes
of all other words by ending and length. The network predicts the token in a masked place from its
neighbours on both sides: embeddings of left and right are added, squashed, and give a softmax. Its
inputs are so few that the whole corpus is summed up, without loss, by how often each (left, token,
right) stands in it; the network is trained in numpy on these counts of all documents, all at once,
and a table of its log-probabilities scores every place of every document.

A class says little about the word in it, so a second softmax, over the words of the class, predicts
the word from the same neighbours. Its inputs are what the network has learned of both sides, its
biases the logs of the words' shares of the class, from the counts of all words of the corpus, however
many. The INNER most frequent words have weights of their own; the others of a class share one row of
weights, and each takes its share of them. Since the inputs stand fixed, the sum of them over all places
of a word is all that its weights can learn from: those sums, over all documents, and the counts of
(left, class, right) give the exact gradient over the corpus at each step.

The shares of the HEAD most frequent words are handed to each task; the others, which are too many for
that and none of which is frequent, are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta
from foliospark.storage import Scratch

WORDS, CLASSES = 63, 32
VOCABULARY = 1 + WORDS + CLASSES
HIDDEN, STEPS, RATE, SEED = 32, 150, 0.05, 5
#: Words of classes whose shares each task holds.
HEAD = 1 << 16
#: Words of classes that have weights of their own, steps they learn in, what holds them at 0 (in places), first rate.
INNER, TURNS, PRIOR, RATE_WITHIN = 1 << 13, 16, 2.0, 0.1
#: Inputs of the second softmax are whole multiples of 1 / UNIT, so that their sums do not depend on an order.
UNIT = 1 << 20
#: Words counted before a task hands its counts on.
FLUSH = 4_000_000

_U = np.uint64
_KINDS = ta.numbers(606, CLASSES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, ta.Words]]:
    for batch in batches:
        buf, offsets, _ = ta.column(batch.column(1))
        for a, b in ta.row_slices(offsets):
            part = buf[offsets[a] : offsets[b]]
            yield batch.column(0).slice(a, b - a), part, ta.Words(part, offsets[a : b + 1] - offsets[a], bare=True)


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_words(documents: DataFrame, count: int = WORDS) -> np.ndarray:
    """Hashes of the most frequent words over all documents; equal counts by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([ta.signed(h), pa.array(n.astype(np.int64))], ["word", "n"])

        for _, _, words in _blocks(batches):
            held.append(words.hashes)
            size += len(words.hashes)
            if size > FLUSH:
                yield out()
                size = 0
        if held:
            yield out()

    rows = _docs(documents).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(count)
    return np.array([r[0] for r in rows.collect()], np.int64).view(_U)


def kinds(words: ta.Words, part: np.ndarray) -> np.ndarray:
    """The class of each word, by ending and length."""
    last = part[words.ends - 1].astype(np.int64)
    before = part[np.maximum(words.ends - 2, words.starts)].astype(np.int64)
    return (last * 31 + before * 7 + np.minimum(3, (words.ends - words.starts) // 3)) % CLASSES


def member(hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A hash of each word in its class; a word with and without a comma can stand in two."""
    return ta.mix(hashes ^ _KINDS[kind])


def word_counts(documents: DataFrame) -> DataFrame:
    """member, word, kind, n of every word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, kind = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, first, n = np.unique(member(h, kind), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([ta.signed(key), ta.signed(h[first]), pa.array(kind[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["member", "word", "kind", "n"])

        for _, part, words in _blocks(batches):
            if len(words.hashes):
                held.append((words.hashes, kinds(words, part)))
                size += len(words.hashes)
            if size > FLUSH:
                yield out()
                size = 0
        if held:
            yield out()

    return _docs(documents).mapInArrow(run, "member long, word long, kind int, n long").groupBy("member", "word", "kind").agg(F.sum("n").alias("n"))


def word_shares(counted: DataFrame, frequent: np.ndarray) -> DataFrame:
    """member, log_share of every word that is not frequent: log p(word | class)."""
    rest = counted.where(~F.col("word").isin(frequent.view(np.int64).tolist())) if len(frequent) else counted
    total = {r[0]: r[1] for r in rest.groupBy("kind").agg(F.sum("n")).collect()}  # CLASSES rows at most
    if not total:
        return rest.select("member", F.lit(0.0).alias("log_share"))
    of = F.create_map(*[F.lit(x) for kind, n in sorted(total.items()) for x in (kind, float(n))])
    return rest.select("member", F.log(F.col("n") / F.element_at(of, F.col("kind"))).alias("log_share"))


def token_ids(words: ta.Words, part: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, token, right, row) of every place; edges of a text are token 0."""
    h, row = words.hashes, words.rows()
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    order = np.argsort(frequent)
    known = frequent[order]
    ids = 1 + WORDS + kinds(words, part)
    if len(known):
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        ids = np.where(known[at] == h, 1 + order[at], ids)
    left, right = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    same = row[1:] == row[:-1]
    left[1:] = np.where(same, ids[:-1], 0)
    right[:-1] = np.where(same, ids[1:], 0)
    return left, ids, right, row


def context_counts(documents: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """(left, token, right) counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(VOCABULARY**3, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for _, part, words in _blocks(batches):
            left, ids, right, _ = token_ids(words, part, frequent)
            held.append((left * VOCABULARY + ids) * VOCABULARY + right)
            size += len(ids)
            if size > FLUSH // 4:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["key", "n"])

    rows = _docs(documents).mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # VOCABULARY ** 3 rows at most
    out = np.zeros(VOCABULARY**3)
    out[np.asarray(rows.column("key").combine_chunks())] = np.asarray(rows.column("n").combine_chunks())
    return out.reshape(VOCABULARY, VOCABULARY, VOCABULARY)


class Network:
    """p(token | left, right) = softmax(tanh(L[left] + R[right] + b) W + c)."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        v, h = VOCABULARY, HIDDEN
        self.p = {"L": rng.normal(size=(v, h)) * 0.3, "R": rng.normal(size=(v, h)) * 0.3, "b": np.zeros(h), "W": rng.normal(size=(h, v)) * 0.1, "c": np.zeros(v)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def hidden(self) -> np.ndarray:
        return np.tanh(self.p["L"][:, None, :] + self.p["R"][None, :, :] + self.p["b"])

    def log_probabilities(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.p["W"] + self.p["c"]
        z -= z.max(-1, keepdims=True)
        return z - np.log(np.exp(z).sum(-1, keepdims=True))

    def train(self, counts: np.ndarray, steps: int = STEPS, rate: float = RATE) -> list[float]:
        """Adam on all counts at once; returns the loss of each step."""
        n = counts.transpose(0, 2, 1)
        n = (n / max(1.0, n.sum())).astype(np.float32)
        places = n.sum(-1, keepdims=True)
        m, v, losses = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, []
        self.p["c"] = np.log(n.sum((0, 1)) + 1e-6).astype(np.float32)
        for t in range(1, steps + 1):
            hidden = self.hidden()
            logs = self.log_probabilities(hidden)
            losses.append(float(-(n * logs).sum()))
            d = places * np.exp(logs) - n
            back = (d @ self.p["W"].T) * (1 - hidden**2)
            grad = {"W": hidden.reshape(-1, HIDDEN).T @ d.reshape(-1, VOCABULARY), "c": d.sum((0, 1)), "L": back.sum(1), "R": back.sum(0), "b": back.sum((0, 1))}
            for k, g in grad.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return losses

    def table(self) -> np.ndarray:
        """log p by [left, token, right]."""
        return self.log_probabilities(self.hidden()).transpose(0, 2, 1).astype(np.float32)


def trained(counts: np.ndarray) -> Network:
    """The network, trained on counts of all documents."""
    network = Network()
    if counts.sum():
        network.train(counts)
    return network


def learn(documents: DataFrame, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Frequent words (counted unless given) and the table of log-probabilities of a network trained on all documents."""
    frequent = frequent_words(documents) if frequent is None else frequent
    return frequent, np.ascontiguousarray(trained(context_counts(documents, frequent)).table())


class Within:
    """p(word | class, left, right) = softmax over the class's words of (log share + U[word] f(left, right)).

    Rows of U: the words of classes in ``inner`` (members, ascending, of class ``kind``), then for each class
    all its other words together. f are the network's hidden units and a constant, made uncorrelated over
    all places of classes. With U = 0 every word has its share, whatever stands beside it.
    """

    def __init__(self, network: Network, counts: np.ndarray, inner: np.ndarray, kind: np.ndarray, n: np.ndarray):
        """``n``: places of each word of ``inner``; ``counts``: of (left, token, right)."""
        self.inner, self.kind = inner, np.concatenate([kind, np.arange(CLASSES)]).astype(np.int64)
        self.contexts = counts[:, 1 + WORDS :, :].transpose(1, 0, 2).reshape(CLASSES, -1)
        places = self.contexts.sum(1)
        self.n = np.concatenate([n, np.maximum(0, places - np.bincount(kind, n, CLASSES))])
        with np.errstate(divide="ignore"):
            self.log_share = np.log(self.n / np.maximum(1, places)[self.kind])
        hidden = network.hidden().reshape(-1, HIDDEN)
        raw = np.concatenate([np.ones((len(hidden), 1)), hidden], 1)
        all_places = self.contexts.sum(0)
        square = (raw * all_places[:, None]).T @ raw / max(1.0, all_places.sum())
        f = np.linalg.solve(np.linalg.cholesky(square + 1e-3 * np.eye(len(square))), raw.T).T
        self.units = np.round(f * UNIT).astype(np.int64)
        self.f = (self.units / UNIT).astype(np.float32)
        self.u = np.zeros((len(self.kind), self.f.shape[1]), np.float32)
        self.z = np.zeros((CLASSES, len(self.f)), np.float32)

    def rows(self, key: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The row of weights of each word, by its member and class."""
        rest = len(self.inner) + kind
        if not len(self.inner) or not len(key):
            return rest
        at = np.searchsorted(self.inner, key)
        at[at == len(self.inner)] = 0
        return np.where(self.inner[at] == key, at, rest)

    def lift(self, rows: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log p(word | class, left, right) - log share, of words by their rows."""
        out = np.einsum("ij,ij->i", self.u[rows], self.f[context])
        return out - self.z[self.kind[rows], context]

    def train(self, sums: np.ndarray, turns: int = TURNS) -> list[float]:
        """Steps on all places at once; ``sums``: of f over the places of each word of ``inner``. Returns the mean
        loss of a place, with what PRIOR adds, before each step and after the last."""
        losses: list[float] = [0.0] * (turns + 1)
        total = max(1.0, float(self.contexts.sum()))
        for c in range(CLASSES):
            own = np.flatnonzero((self.kind == c) & (self.n > 0))
            at = np.flatnonzero(self.contexts[c])
            if not len(own) or not len(at):
                continue
            n, f = self.contexts[c, at].astype(np.float32), self.f[at]
            seen = (f * n[:, None]).sum(0, dtype=float)
            inside = own[own < len(self.inner)]
            target = np.concatenate([sums[inside], (seen - sums[inside].sum(0))[None]])[: len(own)]
            bias, size = self.log_share[own].astype(np.float32), self.n[own][:, None]
            u, rate, drift, last = np.zeros((len(own), f.shape[1])), RATE_WITHIN, 0, (np.inf,)
            for t in range(turns + 1):
                expected, loss = np.zeros_like(u), 0.0
                for a in range(0, len(at), 1024):
                    z = f[a : a + 1024] @ u.T.astype(np.float32) + bias
                    top = z.max(1, keepdims=True)
                    p = np.exp(z - top)
                    whole = p.sum(1, keepdims=True)
                    loss += float((n[a : a + 1024] * (top + np.log(whole))[:, 0]).sum(dtype=float))
                    p *= n[a : a + 1024, None] / whole
                    expected += p.T @ f[a : a + 1024]
                loss += float(PRIOR / 2 * (u**2).sum() - (u * target).sum() - (self.n[own] * bias).sum())
                if loss > last[0]:  # too far: back to the last weights, without the drift
                    loss, u, step = last
                    rate, drift = rate / 2, 0
                else:
                    step = (target - expected - PRIOR * u) / (size + PRIOR)
                    rate *= 1.1
                last = loss, u, step
                losses[t] += loss / total
                if t < turns:
                    drift = 0.8 * drift + rate * step
                    u = u + drift
            self.u[own] = u
        self.close()
        return losses

    def close(self) -> None:
        """The normaliser of each class and context."""
        for c in range(CLASSES):
            own = np.flatnonzero((self.kind == c) & (self.n > 0))
            for a in range(0, len(self.f) if len(own) else 0, 1024):
                z = self.f[a : a + 1024] @ self.u[own].T + self.log_share[own].astype(np.float32)
                top = z.max(1)
                self.z[c, a : a + 1024] = top + np.log(np.exp(z - top[:, None]).sum(1))


def input_sums(documents: DataFrame, frequent: np.ndarray, within: Within) -> np.ndarray:
    """The sum of the inputs over all places of each word with weights of its own, over all documents."""
    units, size = within.units, len(within.inner)
    names = [f"f{k}" for k in range(units.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, len(names)), np.int64)
        for _, part, words in _blocks(batches):
            left, token, right, _ = token_ids(words, part, frequent)
            classed = np.flatnonzero(token > WORDS)
            kind = token[classed] - 1 - WORDS
            of = within.rows(member(words.hashes[classed], kind).view(np.int64), kind)
            own = np.flatnonzero(of < size)
            if len(own):
                at = classed[own]
                order = np.argsort(of[own].astype(np.int32), kind="stable")
                of, at = of[own][order], at[order]
                first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                sums[of[first]] += np.add.reduceat(units[left[at] * VOCABULARY + right[at]], first, 0)
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x) for x in np.ascontiguousarray(sums[at].T))], ["at", *names])

    parts = _docs(documents).mapInArrow(run, ", ".join(["at int", *(f"{k} long" for k in names)]))
    rows = parts.groupBy("at").agg(*(F.sum(k).alias(k) for k in names)).toArrow()  # INNER rows at most
    out = np.zeros((size, len(names)))
    out[np.asarray(rows.column("at").combine_chunks())] = np.stack([np.asarray(rows.column(k).combine_chunks()) for k in names], 1) / UNIT
    return out


def score(documents: DataFrame, frequent: np.ndarray, table: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed over all places), mean_log_prob, for tokens: frequent words and classes.

    Null texts and texts without words have no places: 0 tokens, log_prob 0, mean null. Rows repeated
    give equal rows; extra columns are not read; an empty table gives an empty result.
    """
    flat = table.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part, words in _blocks(batches):
            left, token, right, row = token_ids(words, part, frequent)
            total = np.bincount(row, flat[(left * VOCABULARY + token) * VOCABULARY + right].astype(float), len(ids)).astype(float)
            n = words.counts
            mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(total), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return _docs(documents).mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


class Model:
    """All that scoring needs: frequent words, the network and its table, the words of classes and their shares.

    ``known`` and ``share``: members of the HEAD most frequent words of classes, ascending, and log p(word | class);
    ``shares``: the table of all of them.
    """

    def __init__(self, documents: DataFrame, scratch: Scratch):
        counted = scratch.write(word_counts(documents), "words")
        by_word = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(WORDS)
        self.frequent = np.array([r[0] for r in by_word.collect()], np.int64).view(_U)
        self.counts = context_counts(documents, self.frequent)
        self.network = trained(self.counts)
        self.table = np.ascontiguousarray(self.network.table())
        self.shares = scratch.write(word_shares(counted, self.frequent), "shares")
        # log_share has the class's size in it, so the most frequent words are taken by their counts
        head = counted.where(~F.col("word").isin(self.frequent.view(np.int64).tolist())) if len(self.frequent) else counted
        head = head.orderBy(F.desc("n"), "member").limit(HEAD).select("member", "kind", "n")
        top = head.join(self.shares, "member").orderBy("member").toArrow()  # HEAD rows at most
        self.known, kind, n, self.share = (np.asarray(top.column(k).combine_chunks()) for k in ("member", "kind", "n", "log_share"))
        most = np.sort(np.lexsort((self.known, -n))[:INNER])
        self.within = Within(self.network, self.counts, self.known[most], kind[most], n[most])
        self.losses = self.within.train(input_sums(documents, self.frequent, self.within)) if len(most) else []


def score_words(documents: DataFrame) -> DataFrame:
    """The columns of ``score``, with a network trained on all documents, and log p(word | class, left, right)
    added for every word that stands in a class, so that each place is scored for the very word in it. Null and empty texts, repeated rows,
    extra columns and empty tables: as in ``score``.
    """
    scratch = Scratch(documents.sparkSession, "lm-scoring")
    model = Model(documents, scratch)
    frequent, known, share, within, flat = model.frequent, model.known, model.share, model.within, model.table.reshape(-1)
    del within.units, within.contexts  # only training needs them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part, words in _blocks(batches):
            left, token, right, row = token_ids(words, part, frequent)
            logs = flat[(left * VOCABULARY + token) * VOCABULARY + right].astype(float)
            classed = np.flatnonzero(token > WORDS)
            kind = token[classed] - 1 - WORDS
            key = member(words.hashes[classed], kind).view(np.int64)
            at = np.searchsorted(known, key)
            at[at == len(known)] = 0
            here = known[at] == key if len(known) else np.zeros(len(key), bool)
            logs[classed[here]] += share[at[here]]
            logs[classed] += within.lift(within.rows(key, kind), left[classed] * VOCABULARY + right[classed])
            total = np.bincount(row, logs, len(ids)).astype(float)
            bounds = np.searchsorted(row[classed[~here]], np.arange(len(ids) + 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts.astype(np.int64)), pa.array(total), ta.lists(key[~here], bounds, pa.int64())], ["doc_id", "n_tokens", "log_prob", "rest"])

    scored = _docs(documents).mapInArrow(run, "doc_id long, n_tokens long, log_prob double, rest array<long>")
    scored = scratch.write(scored.withColumn("at", F.monotonically_increasing_id()), "scored")
    added = scored.select("at", F.explode("rest").alias("member")).join(model.shares, "member").groupBy(F.col("at").alias("at_")).agg(F.sum("log_share").alias("added"))
    whole = scored.drop("rest").join(added, F.col("at") == F.col("at_"), "left")
    total = F.col("log_prob") + F.coalesce("added", F.lit(0.0))
    return whole.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a network trained on all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_words(documents)
