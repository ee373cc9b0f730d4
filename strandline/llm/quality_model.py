"""Document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (``FEATURES``). A class is a Gaussian whose
covariance is shrunk towards its diagonal and towards the pooled covariance; its Cholesky factor is
computed once, inverted and sent with the scoring tasks. The score is the posterior of label 1 from
the difference of Mahalanobis log-densities and the log ratio of the priors.

The moments are sums over the labelled rows, taken by Spark; only they reach the driver. Beyond a
stated number of labelled rows a share of them, chosen by hashed id, is used. A score is a function of
the text alone, so scoring and filtering are one projection of each row, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import textkernel as tk
from strandline.llm.common import hashed_share, held_out, trimmed

#: Statistics of a text, each a logarithm or a log-odds, so that classes are nearer to Gaussians.
FEATURES = ("log_words", "log_word_bytes", "symbols", "capitals", "exclamations", "bars", "digits", "same_word", "repeated_windows", "repeated_lines", "spread")

_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in "#*$%&<>"]] = 1
_CLASS[65:91] = 2
_CLASS[ord("!")] = 3
_CLASS[ord("|")] = 4
_CLASS[48:58] = 5
_SCHEMA = ", ".join(f"{f} double" for f in FEATURES)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of part in whole, smoothed by half a count."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _repeats(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Of each row, how many values are equal to another value before them."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    return np.bincount(r[1:][(r[1:] == r[:-1]) & (v[1:] == v[:-1])], minlength=n)


def statistics(texts: tk.Texts) -> np.ndarray:
    """One row of FEATURES per text; an empty text has the values of counts that are all 0."""
    n = texts.n
    starts, ends, row = tk.words(texts)
    n_words = np.bincount(row, minlength=n)
    word_bytes = np.bincount(row, ends - starts, minlength=n)
    sizes = np.diff(texts.offsets)
    kinds = _CLASS[texts.data]
    at = np.flatnonzero(kinds)
    of = np.searchsorted(texts.offsets, at, "right") - 1
    counts = np.bincount(of * 8 + kinds[at], minlength=8 * n).reshape(n, 8)
    h = tk.hashes(texts.data, starts, ends)
    same = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=n)
    windows_row, windows = tk.shingles(texts, 3, lower=False)
    repeated = _repeats(windows_row, windows, n)
    n_windows = np.bincount(windows_row, minlength=n)
    a, b, lines_row = tk.runs(texts, texts.data != 10)
    lines = tk.hashes(texts.data, a, b)
    distinct = n_words - _repeats(row, h, n)
    out = np.empty((n, len(FEATURES)))
    out[:, 0] = np.log1p(n_words)
    out[:, 1] = np.log1p(word_bytes / np.maximum(n_words, 1))
    for j, kind in enumerate(range(1, 6)):
        out[:, 2 + j] = _share(counts[:, kind], sizes)
    out[:, 7] = _share(same, n_words)
    out[:, 8] = _share(repeated, n_windows)
    out[:, 9] = _share(_repeats(lines_row, lines, n), np.bincount(lines_row, minlength=n))
    out[:, 10] = np.log1p(distinct) - 0.8 * np.log1p(n_words)
    return out


def _columns(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text of an Arrow column."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    return np.concatenate([np.empty((0, len(FEATURES))), *(statistics(own) for _, own in tk.slices(batch, 0))])


def features(text: Column) -> Column:
    """A struct of FEATURES; null and empty texts have the same."""

    @F.arrow_udf(f"struct<{_SCHEMA.replace(' double', ':double')}>")
    @trimmed
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = _columns(texts)
            yield pa.StructArray.from_arrays([pa.array(x[:, j]) for j in range(x.shape[1])], names=list(FEATURES))

    return of(text)


class Discriminant:
    """Two Gaussians and their priors. means, factors: per class; factors are inverted Cholesky factors."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_diagonal: float = 0.15, to_pooled: float = 0.15, floor: float = 0.2):
        """Moments per class 0 and 1: rows, sums of x, sums of x x'."""
        self.counts = counts
        if counts.min() < 2:
            return
        self.means = sums / counts[:, None]
        covs = products / counts[:, None, None] - self.means[:, :, None] * self.means[:, None, :]
        pooled = (covs * counts[:, None, None]).sum(0) / counts.sum()
        self.factors, self.offsets = [], []
        for k in (0, 1):
            c = (1 - to_pooled) * covs[k] + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + floor * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.factors.append(np.linalg.inv(low))
            self.offsets.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1. Without two rows of each class: the share of class 1, or 0.5 without labels."""
        if self.counts.min() < 2:
            return np.full(len(x), self.counts[1] / self.counts.sum() if self.counts.sum() else 0.5)
        log = [self.offsets[k] - 0.5 * np.square((x - self.means[k]) @ self.factors[k].T).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 200_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """The discriminant of labels (doc_id, label_col of 0 or 1), joined with docs by id.

    Null labels and labels of absent rows don't count; of labels that repeat an id the smallest counts,
    and every row of docs with that id. max_rows bounds the fit: with more labels those are used whose
    hashed id falls in the share max_rows / labels, so that about max_rows small rows are broadcast.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y"))
    marked = marked.where(hashed_share(F.col("__id"), max_rows, marked.count())).groupBy("__id").agg(F.min("__y").alias("__y"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    x = texts.join(F.broadcast(marked), F.col("doc_id") == F.col("__id")).select("__y", features(F.col("text")).alias("x"))
    rows = (
        x.select("__y", "x.*")
        .groupBy("__y")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs])
        .collect()
    )
    counts, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in rows:
        k = r["__y"]
        counts[k] = r["n"]
        sums[k] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            products[k, i, j] = products[k, j, i] = r[f"p{i}_{j}"]
    return Discriminant(counts, sums, products)


def score_of(text: Column, model: Discriminant) -> Column:
    """The score of a text under a fitted model."""

    @F.arrow_udf("double")
    @trimmed
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(_columns(texts)))

    return of(text)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 from threshold on).

    Learns from labels whose id isn't held out. Null and empty texts are scored alike, by their
    statistics. Labels, language, source and id are no inputs of a score; other columns aren't read.
    """
    model = _fitted(docs, labels, id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_of(F.col(text_col), model).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Discriminant:
    return fit(docs.where(~held_out(F.col(id_col).cast("long"))), labels.where(~held_out(F.col("doc_id").cast("long"))), id_col=id_col, text_col=text_col)


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that quality_scores predicts 0; all their columns. Each row is judged by its own text.

    Without two labelled rows of each class there is no verdict, and all rows stay.
    """
    model = _fitted(docs, labels, id_col, text_col)
    return docs.where(score_of(F.col(text_col), model) >= threshold) if model.counts.min() >= 2 else docs
