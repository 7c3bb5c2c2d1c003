"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word enters as the sum of its own vector, if it is a word the training sample holds often, and the mean vector of its character n-grams with
the word's ends marked, so inflected and unknown forms of an abusive stem are seen too. Two recurrent layers, one in each direction, read
windows of ``WINDOW`` words that overlap by half; attention weighs the states; a logistic unit scores the window. A text's
score is that of its worst window, and every window of the whole text is scored.

The training sample is bounded: the ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled documents of the learning folds that come first by a
hash of the id. A label holds for a document, not for a window, so training first takes random windows, then in rounds the worst window of
each toxic document and the worst ones of clean documents. The model (a few MB whatever the corpus) is sent to all workers; scoring
is one pass over the texts without a shuffle.

Defined cases: a null text or one without words is one empty window, scored by the bias alone; labels that are null or without a
document are not used; if a class is missing from the sample, every score is 0; equal texts get equal scores; an empty table
gives no rows; other columns are passed through by :func:`scored`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import batches, id_remainder, mix, stage, table

WINDOW, STRIDE = 32, 16
DIM, HIDDEN, ATTENTION = 12, 8, 8
NGRAMS = (3, 4, 5)
NGRAM_ROWS = 1 << 16
MAX_WORDS, MIN_TEXTS = 20_000, 5
MAX_POSITIVE, MAX_NEGATIVE = 1000, 2500
ROUNDS, BATCH, RATE = 5, 256, 0.02
THRESHOLD = 0.7
REMEMBERED = 120_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case without ASCII punctuation; one that follows itself is read once."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(LOWER).split()
    return [w for w, before in zip(words, [b"", *words], strict=False) if w != before]


def ngram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all n-grams of each word, one after the other, and how many each word has."""
    marked = b"".join(b"^" + w + b"$" for w in words)
    data, size = np.frombuffer(marked, np.uint8).astype(np.uint64), np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(words)), size)
    rows, owner = [], []
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + data[j:len(data) - n + 1 + j]
        ok = np.arange(len(h)) + n <= ends[:len(h)]
        rows.append((mix(h[ok]) >> np.uint64(40)) % np.uint64(NGRAM_ROWS))
        owner.append(word[:len(h)][ok])
    rows, owner = np.concatenate(rows).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(words))


def windows(n_words: int) -> np.ndarray:
    """First words of the windows of a text: every word is in one, and neighbours overlap by half."""
    return np.arange(0, max(1, n_words - WINDOW + STRIDE), STRIDE)


def cut(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts given as word numbers (0 pads), and each window's text."""
    out, owner = [], []
    for k, own in enumerate(ids):
        first = windows(len(own))
        padded = np.zeros(first[-1] + WINDOW, np.int32)
        padded[:len(own)] = own
        out.append(padded[first[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(first), k))
    return np.concatenate(out), np.concatenate(owner)


class Network:
    """Parameters and passes. Both directions are one state: the backward half reads the window from its end."""

    def __init__(self, words: dict[bytes, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        f, h = np.float32, HIDDEN
        self.words = words  # word to row; row 0 stays zero for all others
        self.p = {
            "word": np.zeros((len(words) + 1, DIM), f), "ngram": np.zeros((NGRAM_ROWS, DIM), f),
            "w": rng.normal(0, DIM ** -0.5, (DIM, 6 * h)).astype(f), "b": np.zeros(6 * h, f),
            "u": np.stack([rng.normal(0, h ** -0.5, (h, 3 * h)) for _ in range(2)]).astype(f),
            "a": rng.normal(0, 0.3, (2 * h, ATTENTION)).astype(f), "v": rng.normal(0, 0.3, ATTENTION).astype(f),
            "o": rng.normal(0, 0.3, 2 * h).astype(f), "c": np.full(1, -1, f),
        }
        self.constant = None

    def vectors(self, word_rows: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        grams = self.p["ngram"][rows]
        starts = np.cumsum(counts) - counts
        return self.p["word"][word_rows] + (np.add.reduceat(grams, starts, axis=0) / counts[:, None]).astype(np.float32)

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.words.get(w, 0) for w in words], np.int64)

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the gates: for both directions reset, update and candidate."""
        return self.vectors(self.word_rows(words), *ngram_rows(words)) @ self.p["w"] + self.p["b"]

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows ``at`` (rows of ``gates``; row 0 pads). ``keep`` collects what the backward pass needs."""
        n, h = len(at), HIDDEN
        state = np.zeros((n, 2, h), np.float32)
        states = np.empty((WINDOW, n, 2, h), np.float32)
        g = gates.reshape(-1, 2, 3 * h)
        steps = []
        for t in range(WINDOW):
            now = np.stack([at[:, t], at[:, WINDOW - 1 - t]], axis=1)
            x = np.stack([g[now[:, 0], 0], g[now[:, 1], 1]], axis=1)
            hu = np.stack([state[:, 0] @ self.p["u"][0], state[:, 1] @ self.p["u"][1]], axis=1)
            rz = np.tanh((x[..., :2 * h] + hu[..., :2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            r, z = rz[..., :h], rz[..., h:]
            c = np.tanh(x[..., 2 * h:] + r * hu[..., 2 * h:])
            real = (now > 0)[..., None]
            new = np.where(real, c + z * (state - c), state)
            if keep is not None:
                steps.append((now, real, state, hu[..., 2 * h:], r, z, c))
            state = new
            states[t, :, 0] = new[:, 0]
            states[WINDOW - 1 - t, :, 1] = new[:, 1]
        flat = states.reshape(WINDOW, n, 2 * h)
        hidden = np.tanh(flat @ self.p["a"])
        weight = np.where(at.T > 0, hidden @ self.p["v"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight *= at.T > 0
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-20))
        pooled = np.einsum("tn,tnh->nh", weight, flat)
        if keep is not None:
            keep.update(steps=steps, flat=flat, hidden=hidden, weight=weight, pooled=pooled)
        return pooled @ self.p["o"] + self.p["c"][0]

    def gradients(self, keep: dict, d: np.ndarray, n_rows: int) -> dict[str, np.ndarray]:
        """Gradients of all dense parameters and, under ``gates``, of the rows of the gates, from those of the logits."""
        h, n = HIDDEN, len(d)
        flat, hidden, weight, pooled, p = keep["flat"], keep["hidden"], keep["weight"], keep["pooled"], self.p
        g = {"o": pooled.T @ d, "c": np.array([d.sum()])}
        dpool = d[:, None] * p["o"]
        dflat = weight[..., None] * dpool
        along = np.einsum("tnh,nh->tn", flat, dpool)
        dscore = weight * (along - (weight * along).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", dscore, hidden)
        dhid = dscore[..., None] * p["v"] * (1 - hidden ** 2)
        g["a"] = np.einsum("tnh,tna->ha", flat, dhid)
        dflat = (dflat + dhid @ p["a"].T).reshape(WINDOW, n, 2, h)
        g["u"], dx = np.zeros_like(p["u"]), np.zeros((WINDOW, n, 2, 3 * h), np.float32)
        down = np.zeros((n, 2, h), np.float32)
        for t in reversed(range(WINDOW)):
            now, real, before, hun, r, z, c = keep["steps"][t]
            down = down + np.stack([dflat[t, :, 0], dflat[WINDOW - 1 - t, :, 1]], axis=1)
            dc = down * (1 - z) * (1 - c ** 2)
            dz = down * (before - c) * z * (1 - z)
            dr = dc * hun * r * (1 - r)
            dx[t] = np.concatenate([dr, dz, dc], axis=2) * real
            dhu = np.concatenate([dr, dz, dc * r], axis=2) * real
            down = np.where(real, down * z, down)
            for k in range(2):
                g["u"][k] += before[:, k].T @ dhu[:, k]
                down[:, k] += dhu[:, k] @ p["u"][k].T
        g["gates"] = np.zeros((n_rows, 2, 3 * h), np.float32)
        for k in range(2):
            rows = np.concatenate([step[0][:, k] for step in keep["steps"]])
            order = np.argsort(rows, kind="stable")
            own, start = np.unique(rows[order], return_index=True)
            g["gates"][own, k] = np.add.reduceat(dx[:, :, k].reshape(-1, 3 * h)[order], start, axis=0)
        g["gates"] = g["gates"].reshape(n_rows, 6 * h)
        return g


def logits(net: Network, gates: np.ndarray, at: np.ndarray, some: int = 2048) -> np.ndarray:
    return np.concatenate([net.forward(gates, at[i:i + some]) for i in range(0, len(at), some)])


class Trainer:
    """Trains a network on texts with labels; everything is seeded, so a rerun gives the same network."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        number: dict[bytes, int] = {}
        ids = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(t or "")], np.int32) for t in texts]
        self.vocab = list(number)
        seen = np.bincount(np.concatenate([np.unique(own) for own in ids]), minlength=len(number) + 1)[1:]  # texts with each word
        often = sorted(np.flatnonzero(seen >= MIN_TEXTS).tolist(), key=lambda k: (-seen[k], self.vocab[k]))[:MAX_WORDS]
        self.net, self.toxic = Network({self.vocab[k]: i + 1 for i, k in enumerate(often)}), np.asarray(toxic, np.float32)
        self.rows, self.counts = ngram_rows(self.vocab) if self.vocab else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.first = np.cumsum(self.counts) - self.counts
        texts_with = np.bincount(self.rows, weights=np.repeat(seen, self.counts), minlength=NGRAM_ROWS)
        self.live = (texts_with >= 2 * MIN_TEXTS).astype(np.float32)[:, None]  # other n-grams keep a zero vector
        self.word_rows = self.net.word_rows(self.vocab)
        self.at, self.owner = cut(ids)
        self.rng = np.random.default_rng(11)
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.net.p.items() if k not in ("word", "ngram")}
        self.squares = {k: np.full((len(self.net.p[k]), 1), 1e-6, np.float32) for k in ("word", "ngram")}
        self.step, self.rate = 0, RATE

    def _grams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[some]
        start = np.repeat(self.first[some] - (np.cumsum(n) - n), n)
        return self.rows[start + np.arange(n.sum())], n

    def batch(self, at: np.ndarray, y: np.ndarray) -> None:
        net, p = self.net, self.net.p
        used, place = np.unique(at, return_inverse=True)
        if used[0] != 0:
            used, place = np.concatenate([[0], used]), place + 1
        some = used[1:] - 1
        if not len(some):
            return
        rows, n = self._grams(some)
        x = net.vectors(self.word_rows[some], rows, n)
        gates = np.vstack([np.zeros((1, 6 * HIDDEN), np.float32), x @ p["w"] + p["b"]])
        keep: dict = {}
        score = net.forward(gates, place.reshape(at.shape), keep)
        d = ((1 / (1 + np.exp(-score)) - y) / len(y)).astype(np.float32)
        g = net.gradients(keep, d, len(gates))
        dg = g.pop("gates")[1:]
        g["w"], g["b"] = x.T @ dg, dg.sum(axis=0)
        dx = dg @ p["w"].T
        self.step += 1
        for k, grad in g.items():
            m, v = self.moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad ** 2 - v)
            p[k] -= (self.rate * 0.25 * (m / (1 - 0.9 ** self.step)) / (np.sqrt(v / (1 - 0.999 ** self.step)) + 1e-8)).astype(np.float32)
        self._rows("word", self.word_rows[some], dx)
        self._rows("ngram", rows, np.repeat(dx / n[:, None], n, axis=0) * self.live[rows])
        p["word"][0] = 0

    def _rows(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        own, start = np.unique(rows[order], return_index=True)
        total = np.add.reduceat(grad[order], start, axis=0)
        self.squares[name][own] += (total ** 2).mean(axis=1, keepdims=True)
        self.net.p[name][own] -= 5 * self.rate * total / np.sqrt(self.squares[name][own])

    def gates(self) -> np.ndarray:
        out = [np.zeros((1, 6 * HIDDEN), np.float32)]
        for i in range(0, len(self.vocab), 20_000):
            some = np.arange(i, min(i + 20_000, len(self.vocab)))
            out.append(self.net.vectors(self.word_rows[some], *self._grams(some)) @ self.net.p["w"] + self.net.p["b"])
        return np.vstack(out)

    def worst(self, most: int) -> np.ndarray:
        """Windows with the highest scores of each text, ``most`` a text."""
        score = logits(self.net, self.gates(), self.at)
        order = np.lexsort((-score, self.owner))
        rank = np.arange(len(order)) - np.searchsorted(self.owner[order], self.owner[order])
        return order[rank < most]

    def train(self) -> Network:
        y = self.toxic[self.owner]
        for r in range(ROUNDS + 1):
            if r == 0:
                order = self.rng.permutation(len(y))
                rank = np.argsort(np.argsort(self.owner[order], kind="stable"), kind="stable")
                rank = rank - np.searchsorted(np.sort(self.owner), self.owner[order])
                chosen = order[rank < 2]
            else:
                hard = self.worst(2)
                top = self.worst(1)
                spare = self.rng.choice(np.flatnonzero(y == 0), min(len(self.toxic), int((y == 0).sum())), replace=False)
                chosen = np.unique(np.concatenate([top[y[top] == 1], hard[y[hard] == 0], spare]))
            for _ in range(3):
                order = self.rng.permutation(chosen)
                weight = np.flatnonzero(y[order] == 1)
                order = self.rng.permutation(np.concatenate([order, order[weight]]))  # toxic windows twice
                for i in range(0, len(order), BATCH):
                    self.batch(self.at[order[i:i + BATCH]], y[order[i:i + BATCH]])
            self.rate = RATE if r < ROUNDS - 2 else RATE / 4
        self.calibrate()
        return self.net

    def calibrate(self) -> None:
        """Move the bias so that THRESHOLD lies between the scores of nearly all clean and nearly all toxic texts of the sample.

        It lies nearer the toxic ones, as the network has seen the sample's clean words and others vary more."""
        score = np.maximum.reduceat(logits(self.net, self.gates(), self.at), np.searchsorted(self.owner, np.arange(len(self.toxic))))
        clean, toxic = np.quantile(score[self.toxic == 0], 0.995), np.quantile(score[self.toxic == 1], 0.01)
        self.net.p["c"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - (0.3 * clean + 0.7 * toxic))


class Scorer:
    """Applies a network in one worker; what words add to the gates is remembered for recent words."""

    def __init__(self, net: Network):
        self.net = net
        self.known: dict[bytes, int] = {}
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.net.constant is not None:
            return np.full(len(texts), self.net.constant)
        if len(self.known) > REMEMBERED:
            self.known, self.gates = {}, self.gates[:1]
        words, known = [words_of(t) for t in texts], self.known
        new = list({w for own in words for w in own if w not in known})
        if new:
            known.update(zip(new, range(len(self.gates), len(self.gates) + len(new)), strict=True))
            self.gates = np.vstack([self.gates, *(self.net.inputs(new[i:i + 20_000]) for i in range(0, len(new), 20_000))])
        at, owner = cut([np.array([known[w] for w in own], np.int32) for own in words])
        score = logits(self.net, self.gates, at)
        worst = np.maximum.reduceat(score, np.searchsorted(owner, np.arange(len(texts))))
        return 1 / (1 + np.exp(-worst.astype(np.float64)))


def training_sample(docs: DataFrame, labels: DataFrame, learn: Column) -> pd.DataFrame:
    """Texts and labels of the bounded sample; ``learn`` says which rows of ``docs`` may be learned from."""
    ids = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = docs.where(learn).select("doc_id").distinct().join(ids, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stage(known, "labelled").withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    some = [known.where(F.col("toxic") == t).orderBy("h").limit(n) for t, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    chosen = stage(some[0].union(some[1]), "chosen")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most MAX_POSITIVE + MAX_NEGATIVE ids
    pdf = texts.select("h", "toxic", F.coalesce("text", F.lit("")).alias("text")).toPandas()
    return pdf.sort_values(["h", "text"]).head(MAX_POSITIVE + MAX_NEGATIVE)


def trained(docs: DataFrame, labels: DataFrame, learn: Column) -> Network:
    pdf = training_sample(docs, labels, learn)
    toxic = pdf["toxic"].to_numpy(np.float32)
    if not 0 < toxic.sum() < len(toxic):
        net = Network({})
        net.constant = 0.0
        return net
    return Trainer(pdf["text"].tolist(), toxic).train()


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of ``docs`` and __score, the toxicity of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by MAX_WORDS and NGRAM_ROWS

    @F.pandas_udf("double")
    def score(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in series:
            parts = [scorer.scores(some) for some in batches(texts, 2_000_000)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))
    return docs.withColumn("__score", score("text"))


def learning_rows(doc_id: Column) -> Column:
    return id_remainder(doc_id, 3) != 1


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    net = trained(docs, table(spark, folder, "labels"), learning_rows(F.col("doc_id")))
    return scored(docs, net).select("doc_id", (~learning_rows(F.col("doc_id"))).alias("held_out"), F.col("__score").alias("score"),
                                    (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
