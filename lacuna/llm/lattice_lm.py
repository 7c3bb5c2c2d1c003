"""Language-model score of whole texts: a subword lattice whose segmentations are all weighed.

The pieces and their order of merit come from an existing vocabulary; their scores give the first probabilities (a Zipf law of the rank
that a score states). Expectation steps over the distinct words of the learning texts move them to the corpus, with the first
probabilities as prior. The probability that pieces give a word is the sum over all segmentations, by a forward recursion in log space.
A word of the learning texts is one more arc over its whole lattice, as likely as it is frequent; the share left to spelling by pieces is that
of new words in the learning texts (types over tokens and types). Words are independent, so a text's score is the sum over its
words and one end, which is a token too.

On Spark: distinct words are counted per task and summed by one shuffle, which grows with the corpus. Each distinct word passes the lattice
once per step, wherever it lies. Words are then sent back to the texts in two ways: those above a count that at most ``FREQUENT``
words reach go to every worker as a table (a proven bound), all others are matched by a join on a 64-bit hash; so neither a frequent
word nor the whole vocabulary ever gathers anywhere.

Defined cases: a null or blank text is one end; texts are scored whole, words of any length; unknown characters are spelled by the bytes
that the vocabulary has; rows that repeat are scored each; without learning texts the counts are 0 and the prior alone scores;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import batches, id_remainder, stage, table, word_hash

PIECES = "piece_bpe_32k.model"
STEPS = 2
SPELLED_END = 0.01
PRIOR = 2000.0
FREQUENT = 150_000
HELD = 250_000
LN10 = math.log(10)
START = "▁"


def words_of(text: str | None) -> list[bytes]:
    """The tokens of a text without the end: A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Pieces with probabilities, and the recursions over a word's segmentations.

    Pieces are a tree by characters; where one ends it has its number and log probability. A character that is no piece is
    spelled by bytes."""

    def __init__(self, pieces: list[str], byte_pieces: dict[int, int], logp: np.ndarray):
        self.byte_pieces, self.logp = byte_pieces, logp
        self.tree: dict = {}
        for i, piece in enumerate(pieces):
            if piece:
                node = self.tree
                for char in piece:
                    node = node.setdefault(char, {})
                node[""] = ((i,), float(logp[i]), math.exp(logp[i]))

    def spelled(self, char: str) -> tuple[tuple[int, ...], float, float]:
        ids = tuple(self.byte_pieces[b] for b in char.encode("utf-8", "surrogatepass"))
        lp = float(sum(self.logp[i] for i in ids))
        return ids, lp, math.exp(lp)

    def edges(self, s: str) -> list[list[tuple[int, tuple[int, ...], float, float]]]:
        """For each place the arcs that start there: end, piece numbers, log probability, probability."""
        tree, n, out = self.tree, len(s), []
        for i in range(n):
            here, node, j = [], tree, i
            while j < n and (node := node.get(s[j])) is not None:
                j += 1
                if (arc := node.get("")) is not None:
                    here.append((j, *arc))
            if not here or here[0][0] > i + 1:
                here.insert(0, (i + 1, *self.spelled(s[i])))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list, n: int) -> list[float]:
        exp, log1p = math.exp, math.log1p
        a: list[float | None] = [None] * (n + 1)
        a[0] = 0.0
        for i, here in enumerate(edges):
            ai = a[i]
            for j, _, lp, _ in here:
                x, y = a[j], ai + lp
                if x is None:
                    a[j] = y
                elif x >= y:
                    a[j] = x + log1p(exp(y - x))
                else:
                    a[j] = y + log1p(exp(x - y))
        return a

    @staticmethod
    def backward(edges: list, n: int) -> list[float]:
        exp, log1p = math.exp, math.log1p
        b: list[float] = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            t = None
            for j, _, lp, _ in edges[i]:
                y = lp + b[j]
                t = y if t is None else t + log1p(exp(y - t)) if t >= y else y + log1p(exp(t - y))
            b[i] = t
        return b

    def word(self, word: bytes) -> float:
        """Natural log of the probability of a word, over all its segmentations."""
        s = START + word.decode("utf-8", "surrogatepass")
        return self.forward(self.edges(s), len(s))[-1]

    def expect(self, word: bytes, n: float, into: list[float]) -> None:
        """Add the expected number of times that ``n`` occurrences of a word use each piece."""
        s = START + word.decode("utf-8", "surrogatepass")
        edges = self.edges(s)
        size = len(s)
        if size < 64:  # short words can't run out of range: plain products, unless a character is spelled
            a, b = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for i, here in enumerate(edges):
                x = a[i]
                for j, _, _, p in here:
                    a[j] += x * p
            for i in range(size - 1, -1, -1):
                b[i] = sum([p * b[j] for j, _, _, p in edges[i]])
            z = a[size]
            if z > 1e-250:
                n /= z
                for i, here in enumerate(edges):
                    x = n * a[i]
                    for j, ids, _, p in here:
                        share = x * p * b[j]
                        for k in ids:
                            into[k] += share
                return
        a, b = self.forward(edges, size), self.backward(edges, size)
        z, exp = a[-1], math.exp
        for i, here in enumerate(edges):
            for j, ids, lp, _ in here:
                share = n * exp(a[i] + lp + b[j] - z)
                for k in ids:
                    into[k] += share


class Vocabulary:
    """Pieces of a public model, the piece of each byte, and first probabilities from the scores."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
        n = sp.get_piece_size()
        ordinary = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) if ordinary[i] else "" for i in range(n)]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        weight = np.zeros(n)
        for i in range(n):
            if ordinary[i]:
                weight[i] = 1 / (10.0 - sp.get_score(i))
            elif sp.is_byte(i):
                weight[i] = 1 / (10.0 + n)
        self.first = weight / weight.sum()

    def lattice(self, p: np.ndarray) -> Lattice:
        with np.errstate(divide="ignore"):
            return Lattice(self.pieces, self.bytes, np.log(p))


def word_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """Every distinct word of all texts: n (all texts) and c (those that may be learned from)."""
    def count(it):
        held: list[Counter] = [Counter(), Counter()]

        def rows():
            keys = list(held[0].keys() | held[1].keys())
            out = pd.DataFrame({"word": keys, "c": [held[1][k] for k in keys], "n": [held[0][k] + held[1][k] for k in keys]})
            held[0].clear()
            held[1].clear()
            return out
        for pdf in it:
            for text, own in zip(pdf["text"], pdf["own"], strict=True):
                held[int(own)].update(words_of(text))
                if len(held[0]) + len(held[1]) > HELD:
                    yield rows()
        yield rows()
    parts = docs.select("text", F.coalesce(learn, F.lit(False)).alias("own")).mapInPandas(count, "word binary, c long, n long")
    return stage(parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "words")


def fitted(counts: DataFrame, vocabulary: Vocabulary, steps: int = STEPS) -> np.ndarray:
    """Probabilities of all pieces after ``steps`` expectation steps over the distinct words of the learning texts.

    Each distinct word counts once: pieces have to spell new words, and those are like types, not like tokens."""
    p = vocabulary.first
    for _ in range(steps):
        shared = counts.sparkSession.sparkContext.broadcast((vocabulary, p))

        def expected(it, shared=shared):
            voc, p = shared.value
            lattice, into = voc.lattice(p), [0.0] * len(p)
            for pdf in it:
                for word in pdf["word"]:
                    lattice.expect(bytes(word), 1.0, into)
            into = np.array(into)
            some = np.flatnonzero(into)
            yield pd.DataFrame({"piece": some, "e": into[some]})
        rows = counts.where("c > 0").select("word").mapInPandas(expected, "piece long, e double")
        total = np.zeros(len(p))
        for r in rows.groupBy("piece").agg(F.sum("e").alias("e")).collect():  # a row per piece at most
            total[r["piece"]] = r["e"]
        p = (total + PRIOR * vocabulary.first) / (total.sum() + PRIOR)
    return p


def mixed(c, spelled, n: int, v: int):
    """log10 of the probability of tokens: by count ``c`` of ``n`` tokens and ``v`` types, or spelled (natural log)."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.asarray(c, np.float64)) - math.log(n + v), np.asarray(spelled, np.float64) + math.log(v / (n + v))) / LN10 if n else np.asarray(spelled, np.float64) / LN10


def _scored_words(counts: DataFrame, vocabulary: Vocabulary, p: np.ndarray, n: int, v: int) -> DataFrame:
    """Each distinct word with its hash, its count and the log10 of its probability."""
    shared = counts.sparkSession.sparkContext.broadcast((vocabulary, p))

    def score(it):
        voc, p = shared.value
        lattice = voc.lattice(p)
        for pdf in it:
            words = list(map(bytes, pdf["word"]))
            spelled = np.array([lattice.word(w) for w in words]) + math.log(1 - SPELLED_END)
            yield pd.DataFrame({"h": np.array(list(map(word_hash, words)), np.int64), "word": words, "c": pdf["c"], "n": pdf["n"], "lp": mixed(pdf["c"], spelled, n, v)})
    return stage(counts.mapInPandas(score, "h long, word binary, c long, n long, lp double"), "scored_words")


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """Words whose count reaches the lowest power-of-two fraction that at most ``most`` words reach."""
    level = F.floor(F.log2("n") * 8).cast("int")
    reached, cut = 0, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a few hundred rows at most
        reached += r["count"]
        if reached > most:
            break
        cut = r["level"]
    return words.where(F.lit(False) if cut is None else level >= cut)


def score_texts(docs: DataFrame, learn: Column, vocabulary: Vocabulary | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, learned, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark, vocabulary = docs.sparkSession, vocabulary or Vocabulary()
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"))
    counts = word_counts(docs, F.col("learned"))
    ends = docs.where("learned").count()
    tokens, types = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    n, v = (tokens or 0) + ends, (types or 0) + (ends > 0)
    words = _scored_words(counts, vocabulary, fitted(counts, vocabulary), n, v)
    top = _frequent(words, frequent).select("word", "c", "lp").toPandas()  # ``frequent`` rows at most
    shared = spark.sparkContext.broadcast((dict(zip(map(bytes, top["word"]), range(len(top)), strict=True)), top["c"].to_numpy(np.float64), top["lp"].to_numpy()))
    end_base, end_lp = math.log10((ends + 1) / (n + 1 * (v + 1))), float(mixed(ends, math.log(SPELLED_END), n, v))
    denominator = math.log10(n + 1 * (v + 1))

    def match(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, c, lp = shared.value
        c, lp = np.append(c, 0.0), np.append(lp, 0.0)
        base = np.log10(c + 1) - denominator
        base[-1] = 0.0
        none = len(c) - 1
        for texts in series:
            rows = []
            for some in batches(texts):
                for text in some:
                    words = words_of(text)
                    at = np.array([index.get(w, none) for w in words], np.int64)
                    rare = np.array([word_hash(words[k]) for k in np.flatnonzero(at == none)], np.int64)
                    rows.append((len(words) + 1, int((c[at] > 0).sum()) + (ends > 0), base[at].sum() + end_base, lp[at].sum() + end_lp, rare))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "lp", "rare"])
    matched = F.pandas_udf(match, "n_tokens long, n_known long, base double, lp double, rare array<long>")
    texts = stage(docs.select("doc_id", "learned", matched("text").alias("m")).select("doc_id", "learned", "m.*"), "texts").withColumn("row", F.monotonically_increasing_id())
    rare = texts.select("row", F.explode("rare").alias("h"))
    known = (F.col("c") > 0).cast("long")
    sums = (rare.hint("merge").join(words.select("h", "c", "lp"), "h").groupBy("row")
            .agg(F.sum(known).alias("k"), F.sum(F.log10(F.col("c") + 1) - F.lit(denominator)).alias("b"), F.sum("lp").alias("l")))
    out = texts.drop("rare").hint("merge").join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select("doc_id", "learned", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("lp") + F.coalesce("l", zero)).alias("score"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = score_texts(table(spark, folder, "documents"), id_remainder(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
