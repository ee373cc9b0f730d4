"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, a function of the letter and the seed alone. An n-gram
is bound from its letters: each letter's vector is rotated by its place in the n-gram and the vectors
are multiplied element by element. A text is the sum (bundle) of its n-grams' vectors, a language the
sum of its training texts' normalised vectors. A text is compared with the languages by cosine.

Words are runs of letters, lower-cased, with a blank on either side; other characters only separate.
A text's vectors are multiplied and summed a slice of distinct n-grams at a time, so memory doesn't grow
with one text's variety.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import textkernel as tk
from strandline.llm.common import fresh, hashed_share, held_out, trimmed
from strandline.session import materialize

UNKNOWN = "und"
#: Softmax sharpness of the score.
_SHARP = 20.0
#: drop_unknown's border as a share of a language's median, and its correction for length, in n-grams.
SHARE, WIDTH = 0.35, 150
#: Distinct n-grams of a text that are multiplied at a time.
_STEP = 2048


class Space:
    """Letter and n-gram vectors of one dimension, n and seed. Up to most n-gram vectors are kept as they are met."""

    def __init__(self, dimension: int = 512, n: int = 3, seed: int = 7, most: int = 20_000):
        self.dimension, self.n, self.seed, self.most = dimension, n, seed, most
        self._letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        self._reset()

    def _reset(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.vectors = np.zeros((1024, self.dimension), np.int8)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """Vectors of code points: bit j of a hash chain on (seed, code point) gives the sign at j."""
        words = self.dimension // 64
        at = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(words, dtype=np.uint64)[None, :] + np.uint64(self.seed << 32)
        bits = np.unpackbits(tk.mix(tk.mix(at)).view(np.uint8), axis=1)
        return (bits.astype(np.int8) * 2 - 1)[:, : self.dimension]

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        vector = np.ones((len(codes), self.dimension), np.int8)
        rest = codes.copy()
        for place in range(self.n):
            points, inverse = np.unique(rest & 0x1FFFFF, return_inverse=True)
            vector *= np.roll(self._letters(points), place, axis=1)[inverse]
            rest >>= 21
        return vector

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of sorted distinct n-gram codes; new ones are bound, and kept while there is room."""
        if len(self.codes) + len(codes) > self.most:
            self._reset()
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        new = codes[~known]
        if len(new):
            have, need = len(self.codes), len(self.codes) + len(new)
            if need > len(self.vectors):
                grown = np.zeros((min(max(2 * len(self.vectors), need), max(self.most, need)), self.dimension), np.int8)
                grown[:have] = self.vectors[:have]
                self.vectors = grown
            self.vectors[have:need] = self._bind(new)
            merged = np.concatenate([self.codes, new])
            rows = np.concatenate([self.rows, np.arange(have, need)])
            order = np.argsort(merged, kind="stable")
            self.codes, self.rows = merged[order], rows[order]
        return self.vectors[self.rows[np.searchsorted(self.codes, codes)]]

    def bundles(self, texts: list[str | None], sizes: list[int] | None = None) -> np.ndarray:
        """One vector per text, float32; texts without a letter are 0. sizes: gets the n-grams of each text."""
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            codes, counts = self.grams(text)
            if sizes is not None:
                sizes.append(int(counts.sum()))
            for start in range(0, len(codes), _STEP):
                part = slice(start, start + _STEP)
                out[i] += counts[part].astype(np.float32) @ self.bound(codes[part]).astype(np.float32)
        return out

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-gram codes (sorted, at most three 21-bit letters) and their counts."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self._letter[points]
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        value = np.zeros(len(points) + 2, np.int64)
        value[1:-1][letter] = points[letter]
        if self.n > 1:  # one blank between words
            keep = np.ones(len(value), bool)
            keep[1:] = (value[1:] != 0) | (value[:-1] != 0)
            value = value[keep]
        m = len(value) - self.n + 1
        if m < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.zeros(m, np.int64)
        for place in range(self.n):
            code = (code << 21) | value[place : place + m]
        return np.unique(code, return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def prototypes(docs: DataFrame, max_rows: int = 20_000, dimension: int = 512, n: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> vector, from rows with a language and a text.

    max_rows bounds the fit: with more labelled rows, those are used whose hashed id falls in the share
    max_rows / rows. Each task bundles what it reads; languages x dimension sums reach the driver.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text"))
    rows = docs.where(F.col(lang_col).isNotNull()).select(id_col).count()  # without reading the texts
    labelled = labelled.where(hashed_share(F.col("__id"), max_rows, rows))

    @trimmed
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimension, n, seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                sums[lang] = sums.get(lang, 0) + _unit(space.bundles([text.as_py()]))[0].astype(np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimension), pa.array(np.arange(dimension, dtype=np.int32)), pa.array(total)], names=["lang", "at", "x"])

    parts = labelled.select("__lang", "__text").mapInArrow(bundle, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in parts:
        out.setdefault(r["lang"], np.zeros(dimension))[r["at"]] = r["x"]
    return {lang: _unit(v).astype(np.float32) for lang, v in sorted(out.items()) if np.abs(v).max() > 0}


def judged(text: Column, profiles: dict[str, np.ndarray], n: int = 3, seed: int = 7, label: Column | None = None) -> Column:
    """A struct of lang_pred, score, cosine, n_grams and, of a labelled row, own: the cosine to its label's language.

    A null text, a text without a letter, or no profile at all gives 'und' and score 0. The score is the
    best language's share of exp(_SHARP * cosine); ties go to the first language by name. own is null for
    a language without a profile, without a label, and for such texts.
    """
    names = list(profiles)
    place = {k: i for i, k in enumerate(names)}
    matrix = np.stack([profiles[k] for k in names]) if names else np.zeros((0, 64), np.float32)

    @F.arrow_udf("struct<lang_pred:string,score:double,cosine:double,n_grams:long,own:double>")
    @trimmed
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        space = Space(matrix.shape[1], n, seed)
        for texts, labels in batches:
            parts = []
            for at in range(0, len(texts), 256):
                sizes: list[int] = []
                x = _unit(space.bundles(texts[at : at + 256].to_pylist(), sizes))
                known = np.abs(x).max(1) > 0 if names else np.zeros(len(x), bool)
                cosine = x @ matrix.T if names else np.zeros((len(x), 1), np.float32)
                best = cosine.argmax(1)
                weight = np.exp(_SHARP * (cosine - cosine.max(1, keepdims=True)))
                score = np.where(known, 1 / weight.sum(1), 0.0)
                lang = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                top = np.where(known, cosine.max(1), 0.0)
                own = [float(c[place[label]]) if k and label in place else None for c, k, label in zip(cosine, known, labels[at : at + 256].to_pylist(), strict=True)]
                columns = [pa.array(lang, pa.string()), pa.array(score.astype(np.float64)), pa.array(top.astype(np.float64)), pa.array(sizes, pa.int64()), pa.array(own, pa.float64())]
                parts.append(pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "cosine", "n_grams", "own"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], _JUDGED)

    return of(text, F.lit(None).cast("string") if label is None else label.cast("string"))


_JUDGED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("cosine", pa.float64()), ("n_grams", pa.int64()), ("own", pa.float64())])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], n: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cosine and n_grams of each row (``judged``). Repeated rows are judged each."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), judged(F.col(text_col), profiles, n, seed).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score", "found.cosine", "found.n_grams")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """predict with profiles learnt from the rows of docs that aren't held out, with held_out. Empty docs give no rows.

    Rows that repeat an id are each learnt from and judged. Null ids aren't held out.
    """
    learn = docs.where(~held_out(F.col(id_col)))
    profiles = prototypes(learn, id_col=id_col, text_col=text_col, lang_col=lang_col, **fit)
    found = predict(docs, profiles, fit.get("n", 3), fit.get("seed", 7), id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cosine", "n_grams")


def drop_unknown(docs: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> DataFrame:
    """docs without the rows in no learnt language: without a letter, or too unlike the nearest; all their columns.

    A text's cosine to its language grows with its n-grams m, as that of a sample of m from a wide
    distribution does: like sqrt(m / (m + WIDTH)). So the cosine divided by that is compared, and texts of
    every length are judged. A language's border is share of the median that its learning rows have to it:
    chance resemblance doesn't set it, as texts of random letters reach 0.25 where letters and word lengths
    are shared. A cosine below it by no more than the deviation of unrelated bundles, 1 / sqrt(dimension),
    passes, so a short text isn't rejected for chance alone. Each row is judged by its own text. Without a learnt language there is no verdict, and all
    rows stay.
    """
    learnt = ~held_out(F.col(id_col))
    profiles = prototypes(docs.where(learnt), id_col=id_col, text_col=text_col, lang_col=lang_col, **fit)
    if not profiles:
        return docs
    found, own = fresh(docs, "__found"), fresh(docs, "__own")
    label = F.when(learnt, F.col(lang_col).cast("string"))
    scored = docs.withColumn(own, label).withColumn(found, judged(F.col(text_col), profiles, fit.get("n", 3), fit.get("seed", 7), F.col(own)))
    scored = materialize(scored, "languages")
    medians = scored.where(F.col(f"{found}.own").isNotNull()).groupBy(own).agg(F.percentile_approx(_scaled(found, "own"), 0.5).alias("median")).collect()
    border = F.lit(None).cast("double")
    for r in medians:  # one row a learnt language
        border = F.when(F.col(f"{found}.lang_pred") == r[own], F.lit(share * r["median"])).otherwise(border)
    chance = fit.get("dimension", 512) ** -0.5
    return scored.where(F.col(f"{found}.cosine") + chance >= border * _growth(found)).drop(found, own)


def _growth(name: str) -> Column:
    m = F.col(f"{name}.n_grams")
    return F.sqrt(m / (m + WIDTH))


def _scaled(name: str, field: str) -> Column:
    return F.col(f"{name}.{field}") / F.nullif(_growth(name), F.lit(0.0))
