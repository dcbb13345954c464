"""A quality classifier learnt from trusted positives and unlabelled text.

Positive-unlabelled learning: with the share of good text (the class prior) known, the risk on
bad text is the risk of unlabelled text less the prior times that of good text. Training
minimises this unbiased risk and keeps its estimate for bad text from going below zero,
so that the positives can't be fitted by heart. No negative label is used.

The scorer is linear in fixed functions of a text's features and the loss is the square, so both risks are quadratic forms of
second moments: one pass over all good and all unlabelled rows sums those, and the least risk is solved from them exactly. The prior
comes from the same moments. They give the ratio of the densities of good and of unlabelled text; where it is highest nearly all text is good,
and there the share of unlabelled rows by that of good rows is the prior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import kernels as K
from tidelog.llm.runtime import batched, cut, discard

#: Random functions of the features, what holds the weights small, and halvings in search of the bound's share.
FUNCTIONS, RIDGE, HALVINGS = 128, 1e-4, 40
#: How far below zero the estimate for bad text may be: what chance and the prior's own error account for (its scale is 0 to 4).
BETA = 0.4
#: Bins of the density ratio, and the least share of good rows that an estimate of the prior rests on.
BINS, TAIL = 512, 0.3
N_FEATURES = 18

_KIND = np.zeros(256, np.uint8)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text: shares of bytes and words, lengths and repetition."""
    n = np.diff(off)
    safe = np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    kind = _KIND[raw]
    by_kind = [share(kind == k) / safe for k in range(7)]
    same = np.zeros(len(raw), bool)
    same[1:] = (raw[1:] == raw[:-1]) & (kind[1:] != 4)
    runs = share(same & ((kind == 0) | (kind == 5))) / safe
    word, bounds = K.words(raw, off, K.SPACED)
    m = np.diff(bounds)
    some = np.maximum(m, 1)
    twice = np.zeros(len(word), bool)
    twice[1:] = word[1:] == word[:-1]
    echo = np.diff(np.concatenate([[0], np.cumsum(twice)])[bounds]) / some
    pair, pairs = K.grams(word, bounds, 3)
    kinds = np.array([len(np.unique(word[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    threes = np.array([len(np.unique(pair[a:b])) for a, b in zip(pairs[:-1], pairs[1:], strict=True)])
    line = share(raw == 10)
    out = [np.log1p(n), np.log1p(m), (n - share(kind == 4)) / some / 8, *by_kind, runs * 4, echo, kinds / some, threes / np.maximum(np.diff(pairs), 1), np.log1p(line), n / (line + 1) / 500, by_kind[2] / np.maximum(by_kind[1] + by_kind[6] + by_kind[2], 1e-9), (by_kind[0] * n) / some]
    return np.stack(out, 1).astype(np.float64)


class Basis:
    """Fixed functions of standardised features: a constant, the features, and random ones of all of them."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        rnd = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turn, self.shift = rnd.normal(0, 0.3, (len(mean), FUNCTIONS)), rnd.uniform(-1.5, 1.5, FUNCTIONS)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(z), 1)), z / 3, np.tanh(z @ self.turn + self.shift)], 1)


class Model:
    def __init__(self, prior: float, basis: Basis, weights: np.ndarray):
        self.prior, self.basis, self.weights = prior, basis, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((1 + self.basis(x) @ self.weights) / 2, 0, 1)


class Moments:
    """Means of the functions and of their products over good rows and over unlabelled rows."""

    def __init__(self, good: tuple[np.ndarray, np.ndarray], every: tuple[np.ndarray, np.ndarray]):
        (self.good, self.good2), (self.every, self.every2) = good, every
        self.solid = np.linalg.inv(self.every2 + RIDGE * np.eye(len(self.every)))

    def ratio(self, good: np.ndarray) -> np.ndarray:
        """Weights of the density ratio of good to unlabelled rows, fitted by least squares to a mean of good rows."""
        return self.solid @ good


def least_risk(m: Moments, prior: float, beta: float = BETA) -> np.ndarray:
    """Weights of least non-negative risk, prior * E_good (1 - g)^2 + max(-BETA, bad), bad = E_every (1 + g)^2 - prior * E_good (1 + g)^2.

    Without the bound the sum is a convex quadratic form and has one solution. If its bad is below -BETA, the least sum under the bound is that of
    prior * E_good (1 - g)^2 + share * bad for the share below 1 at which bad is -BETA, as more weight on it only makes it less (without such a share, at none).
    """

    def solved(share: float) -> tuple[np.ndarray, float]:
        square = prior * (1 - share) * m.good2 + share * m.every2 + RIDGE * np.eye(len(m.every))
        w = np.linalg.solve(square, prior * (1 + share) * m.good - share * m.every)
        return w, (1 + 2 * m.every @ w + w @ m.every2 @ w) - prior * (1 + 2 * m.good @ w + w @ m.good2 @ w)

    w, bad = solved(1.0)
    low, high = 0.0, 1.0
    for _ in range(HALVINGS if bad < -beta else 0):
        middle = (low + high) / 2
        w, bad = solved(middle)
        low, high = (low, middle) if bad < -beta else (middle, high)
    return w


def _half(x: np.ndarray) -> np.ndarray:
    """Half of the rows, by a hash of their features: the ratio is fitted to good rows of this half and looked at on those of the other."""
    return K.mix(x.view(K.U).sum(1, dtype=K.U)) >> np.uint64(63) > 0


def prior_of(good: np.ndarray, every: np.ndarray) -> float:
    """The prior from histograms of the density ratio over good and over unlabelled rows.

    Above any bound the unlabelled share is at least prior * the good share, and near the top no more than that. Only bounds
    above which a share TAIL of the good rows lies are looked at, as smaller tails are chance. Without good rows it is a half.
    """
    if not good.sum():
        return 0.5
    good, every = np.cumsum(good[::-1]) / good.sum(), np.cumsum(every[::-1]) / every.sum()
    some = good >= min(TAIL, good.max())
    return float(np.clip((every[some] / good[some]).min(), 0.01, 0.99))


def _featured(df: DataFrame) -> DataFrame:
    """df (any columns, text last) with the text replaced by its features."""

    def scan(batches):
        for b in batches:
            rows = [features(raw, off) for _, _, raw, off in K.chunks(b.column(b.num_columns - 1))]
            x = np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], [*b.schema.names[:-1], "features"])

    schema = df.drop("text").schema.add("features", T.ArrayType(T.DoubleType()))
    return batched(df).mapInArrow(scan, schema)


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows (good, features) of vectors that `of` gives for a batch: partial sums by task, then by place."""

    def scan(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)
                total += of(x, b.column(0).to_numpy(zero_copy_only=False))
        yield pa.record_batch({"place": pa.array(np.arange(size)), "part": pa.array(total)})

    table = batched(rows.select("good", "features")).mapInArrow(scan, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros(size)
    out[table.column("place").to_numpy()] = table.column("part").to_numpy()
    return out


def fit(rows: DataFrame) -> Model | None:
    """A model from all rows (good, features): every row is unlabelled text, those marked good are trusted as well.

    None without a good row. The driver gets sums only, whose number depends on the functions alone.
    """
    n = N_FEATURES
    sums = _summed(rows, lambda x, good: np.concatenate([[len(x), good.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * n)
    if not sums[1]:
        return None
    mean = sums[2 : 2 + n] / sums[0]
    basis = Basis(mean, np.sqrt(np.maximum(sums[2 + n :] / sums[0] - mean**2, 0)) + 1e-6)
    k = 1 + n + FUNCTIONS

    def products(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        f = basis(x)
        half = good & _half(x)
        return np.concatenate([f[good].sum(0), (f[good].T @ f[good]).ravel(), f.sum(0), (f.T @ f).ravel(), f[half].sum(0), [half.sum()]])

    found = np.split(_summed(rows, products, 2 * (k + k * k) + k + 1), np.cumsum([k, k * k, k, k * k, k]))
    m = Moments((found[0] / sums[1], found[1].reshape(k, k) / sums[1]), (found[2] / sums[0], found[3].reshape(k, k) / sums[0]))
    some = found[4] / max(found[5][0], 1)
    ratio = m.ratio(some)
    top = float(max(ratio @ some * 2, 1e-9))

    def histograms(x: np.ndarray, good: np.ndarray) -> np.ndarray:
        at = np.clip((basis(x) @ ratio / top * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(at[good & ~_half(x)], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(float)

    prior = prior_of(*np.split(_summed(rows, histograms, 2 * BINS), 2))
    return Model(prior, basis, least_risk(m, prior))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from docs (doc_id, text), which are the unlabelled text, and labels (doc_id, quality).

    Trusted positives are texts labelled 1; no other label is read. All rows count, none is sampled: their features are written once and
    summed three times. None without a positive or without a text. Null keys, texts and labels are left out; a text whose
    key comes twice among the labels counts once.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    found = _featured(docs.select("doc_id", "text").where("text is not null"))
    rows = cut(found.join(good, "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "features"))
    model = fit(rows)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(all columns of docs but text, score): likelihood of good quality from 0 to 1.

    Only the whole text counts; null is scored as empty. Without a model every score is 0.5.
    """
    rest = [c for c in docs.columns if c not in ("text", "score")]
    if model is None:
        return docs.select(*rest, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        m = shared.value
        for b in batches:
            rows = [m.score(features(raw, off)) for _, _, raw, off in K.chunks(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(rows) if rows else [], pa.float64())], [*b.schema.names[:-1], "score"])

    df = docs.select(*rest, "text")
    return batched(df).mapInArrow(scan, df.drop("text").schema.add("score", "double"))
