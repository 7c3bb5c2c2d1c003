"""Quality rules: counts of every text, base rules, and robust outliers by minimum covariance determinant.

The counts come from one pass over the texts and are written once; everything after reads that narrow table. A text that passes the base
rules has a vector of transformed statistics (shares by arc sine of the root, lengths by logarithm). Per language, and from there
per language and source, location and scatter are those of the half with the smallest determinant, found by concentration steps on
Spark: distances under the present estimate are counted in fine classes per group, together with the moments of each class;
the classes that hold the nearest ``SHARE`` of a group give the next estimate, the class that crosses that mark in proportion, so that
junk of up to nearly half a group is left out. A step is one aggregation that is combined map side, so
a hot source is never gathered; medians that start the search come from histograms in the same way. All rows count, and the
result does not depend on partitioning beyond the last bits of sums.

A last step takes location and scatter again from all texts within the 97.5 % quantile of chi-square (reweighted MCD), so that a statistic
that is zero in most texts gets the scatter of those where it is not. Scatter is shrunk toward that of the language as far as a
group is small, and the square of ``FLOOR``, a small regulariser, is added. Squared distances are divided by their group's median over that of
chi-square where this is above one; a text is rejected beyond the 99.99 % quantile ``CUT``.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of their own; equal rows get equal
verdicts; a group of one text takes its language's estimate; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.llm.common import SPACE, WordCodes, batches, mix, stage, table

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
BLANK = SPACE.encode()
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_punct", "n_upper", "n_digits", "n_adjacent"]
FEATURES = ["length", "symbols", "punct", "upper", "digits", "adjacent", "repeats"]
P = len(FEATURES)
STEPS = 5
SHARE = 0.5
CONSISTENCY = 1.696  # what the nearest half of P normal variables shows of their variance, inverted: 0.5 / P(chi2[P + 2] <= median of chi2[P])
FLOOR = np.array([0.05, 0.03, 0.04, 0.04, 0.06, 0.04, 0.1])  # digits: numbers in a short clean text reach a tenth; repeats: clean texts repeat a passage
BORROW = 30.0
CHI_MEDIAN, CHI_NEAR, CUT = 6.346, 16.013, 29.88  # quantiles 0.5, 0.975 and 0.9999 of chi-square with P degrees
NEAR_CONSISTENCY = 1.045  # as CONSISTENCY, for the quantile 0.975


def repeated_words(codes: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window of words found twice or more in that text. ``ends``: where each text's codes end."""
    n, starts = len(codes), np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - starts)
    out = np.zeros(len(ends), np.int64)
    if n < window:
        return out
    h = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j:n - window + 1 + j].view(np.uint64)
    at = np.flatnonzero(np.arange(n - window + 1) + window <= ends[text[:n - window + 1]])
    h = mix(mix(h[at]) + text[at].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = at[order[np.append(same, False) | np.append(False, same)]] if len(at) else at
    edge = np.zeros(n + 1, np.int32)
    edge[twice] += 1
    np.subtract.at(edge, twice + window, 1)
    return np.bincount(text[np.cumsum(edge[:n]) > 0], minlength=len(ends)).astype(np.int64)


def text_counts(texts: list[str], codes: WordCodes) -> pd.DataFrame:
    """The counts of each text, one row per text."""
    rows, words = [], []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        dense = data.translate(None, BLANK)
        own = list(map(codes.__getitem__, data.split()))
        words.append(np.array(own, np.int64))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        plain = dense.translate(None, PUNCT)
        upper = sum(map(str.isupper, text)) if not text.isascii() else len(plain) - len(plain.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        rows.append((len(own), len(text) - len(data) + len(dense), len(dense) - len(dense.translate(None, SYMBOLS)), len(lines) - len(set(lines)), 0,
                     len(dense) - len(plain), upper, len(plain) - len(plain.translate(None, b"0123456789")), sum(map(eq, own[1:], own))))
    out = pd.DataFrame(rows, columns=COUNTS)
    ends = np.cumsum([len(w) for w in words])
    out["n_repeat_words"] = repeated_words(np.concatenate(words), ends) if words else 0
    return out


def _counts(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    codes = WordCodes()
    for texts in series:
        parts = [text_counts(some, codes) for some in batches(texts)]
        yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=COUNTS)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text, written once."""
    counts = F.pandas_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))
    return stage(docs.select("doc_id", "lang", "source", counts("text").alias("c")).select("doc_id", "lang", "source", "c.*"), "counts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features() -> list[Column]:
    """The transformed statistics, in the order of FEATURES."""
    def share(part: str, whole: str) -> Column:
        return F.asin(F.sqrt(F.least(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(1.0))))
    chars = "word_chars"
    return [F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", chars), share("n_punct", chars), share("n_upper", chars),
            share("n_digits", chars), share("n_adjacent", "n_words"), share("n_repeat_words", "n_words")]


def _starts(vectors: DataFrame) -> DataFrame:
    """Median and spread of each statistic per language, from histograms."""
    cells = vectors.select("lang", F.posexplode(F.array(*[F.round(F.col(f"x{j}") * 2000) for j in range(P)])).alias("j", "v")).groupBy("lang", "j", "v").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang", "j")
    share = F.sum("n").over(by.orderBy("v")) / F.sum("n").over(by)
    at = [F.min(F.when(F.col("share") >= q, F.col("v"))).alias(name) for q, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high"))]
    quart = cells.withColumn("share", share).groupBy("lang", "j").agg(*at)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        mid = pdf["mid"].to_numpy()
        spread = np.maximum(2 * np.minimum(pdf["high"] - mid, mid - pdf["low"]).to_numpy() / 2000 / 1.349, FLOOR)  # the side without junk
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "mu": [mid / 2000], "cov": [np.diag(spread ** 2).ravel()], "n": [0.0]})
    return quart.groupBy("lang").applyInPandas(start, "lang string, mu array<double>, cov array<double>, n double")


def _whiten(cov: np.ndarray) -> np.ndarray:
    """Rows that turn a deviation into independent units."""
    return np.linalg.inv(np.linalg.cholesky(cov))


def _whitening(covs: pd.Series) -> pd.Series:
    return pd.Series([_whiten(np.asarray(c).reshape(P, P)).ravel() for c in covs], dtype=object)


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. under mu and w (the whitening rows)."""
    dev = [F.col(f"x{j}") - F.element_at("mu", j + 1) for j in range(P)]
    rows = [sum((F.element_at("w", i * P + j + 1) * dev[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def _with_estimates(vectors: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    e = estimates.select(*[F.col(k).alias(f"of_{k}") for k in keys], "mu", F.pandas_udf(_whitening, "array<double>")("cov").alias("w"), *[c for c in estimates.columns if c not in (*keys, "mu", "cov", "n")])
    e = stage(e, "estimates")  # a row per group, whose size the planner then knows
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return vectors.join(e, on).drop(*[f"of_{k}" for k in keys])


def _nearest(n: np.ndarray, share: float = SHARE) -> np.ndarray:
    """How much of each class, nearest first, belongs to the nearest ``share`` of all rows."""
    return np.clip((share * n.sum() - (np.cumsum(n) - n)) / n, 0.0, 1.0)


def _within(level: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which classes lie within the quantile CHI_NEAR once distances are scaled by their median."""
    d = 2.0 ** ((level + 0.5) / 8)
    middle = d[np.searchsorted(np.cumsum(n), 0.5 * n.sum())]
    return (d <= CHI_NEAR * max(middle / CHI_MEDIAN, 1.0)).astype(float)


def _concentrate(vectors: DataFrame, estimates: DataFrame, keys: list[str], target: DataFrame | None, last: bool = False) -> DataFrame:
    """One concentration step for all groups at once; the last one takes all texts within a quantile."""
    near = _with_estimates(vectors, estimates, keys).withColumn("d", _distance()).withColumn("class", F.floor(8 * F.log2(F.col("d") + 1e-3)).cast("int"))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)]
    classes = near.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("n"), *sums)
    shrink = ["t_mu", "t_cov"] if target is not None else []
    if target is not None:
        t = stage(target.select(F.col("lang").alias("t_lang"), F.col("mu").alias("t_mu"), F.col("cov").alias("t_cov")), "target")
        classes = classes.join(t, F.col("lang").eqNullSafe(F.col("t_lang")), "left").drop("t_lang")

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        part = pdf["n"].to_numpy(float)
        part = _within(pdf["class"].to_numpy(float), part) if last else _nearest(part)
        n = float(part @ pdf["n"])
        mean = np.array([part @ pdf[f"s{i}"] for i in range(P)]) / n
        second = np.array([[part @ pdf[f"s{max(i, j)}_{min(i, j)}"] for j in range(P)] for i in range(P)]) / n
        cov = (second - np.outer(mean, mean)) * (NEAR_CONSISTENCY if last else CONSISTENCY)
        if shrink:
            own = n / (n + BORROW)
            mean = own * mean + (1 - own) * np.asarray(pdf["t_mu"].iloc[0])
            cov = own * cov + (1 - own) * np.asarray(pdf["t_cov"].iloc[0]).reshape(P, P)
        cov = cov + np.diag(FLOOR ** 2)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "mu": [mean], "cov": [cov.ravel()], "n": [n]})
    schema = ", ".join(f"{k} string" for k in keys) + ", mu array<double>, cov array<double>, n double"
    return stage(classes.groupBy(*keys).applyInPandas(estimate, schema), "estimates")


def _medians(vectors: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates with the median squared distance of their group, from classes of distance."""
    d = _with_estimates(vectors, estimates, keys).select(*keys, F.round(F.log2(_distance() + 1e-6) * 64).cast("int").alias("class"))
    by = Window.partitionBy(*keys)
    n = d.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("m"))
    n = n.withColumn("share", F.sum("m").over(by.orderBy("class")) / F.sum("m").over(by))
    mid = n.groupBy(*keys).agg(F.pow(F.lit(2.0), F.min(F.when(F.col("share") >= 0.5, F.col("class"))) / 64).alias("middle"))
    on = F.lit(True)
    for k in keys:
        mid = mid.withColumnRenamed(k, f"m_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    return estimates.join(mid, on).drop(*[f"m_{k}" for k in keys])


def judged(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The counts of every document with base_failed, distance2 (on the scale of chi-square) and kept."""
    counts = counted(docs).withColumn("base_failed", base_failed())
    vectors = stage(counts.where(~F.col("base_failed")).select("lang", "source", *[x.alias(f"x{j}") for j, x in enumerate(features())]), "vectors")
    by_lang = stage(_starts(vectors), "starts")
    for k in range(STEPS + 1):
        by_lang = _concentrate(vectors, by_lang, ["lang"], None, k == STEPS)
    pairs = vectors.select("lang", "source").distinct()
    both = pairs.join(by_lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", "mu", "cov", "n")
    both = stage(both, "estimates")
    for k in range(STEPS + 1):
        both = _concentrate(vectors, both, ["lang", "source"], by_lang, k == STEPS)
    both = _medians(vectors, both, ["lang", "source"])
    all_ = counts.select("*", *[x.alias(f"x{j}") for j, x in enumerate(features())])
    e = stage(both.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "mu", F.pandas_udf(_whitening, "array<double>")("cov").alias("w"), "middle"), "estimates")
    found = all_.join(e, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    scale = F.greatest(F.col("middle") / CHI_MEDIAN, F.lit(1.0))
    found = found.withColumn("distance2", F.when(~F.col("base_failed"), _distance() / scale))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("distance2") <= cut)).select(*counts.columns, "distance2", "kept")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "documents")).select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance2")
