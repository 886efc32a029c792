"""Quality classifier learned from positive and unlabelled texts with the non-negative risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import as_text, in_slices, read_documents, stored

#: Texts at most that the network is fitted on, trusted positives and unlabelled ones, and labelled ones of each kind that set the scale of scores.
POSITIVES, UNLABELLED, SCALING = 6000, 9000, 3000
#: One in so many documents labelled 1 is not trusted but kept for the scale.
SCALING_SHARE = 3
#: Newton steps of the classifier that the class prior is read from.
NEWTON = 12
#: Hidden units, passes, step.
HIDDEN, STEPS, RATE = 12, 400, 0.02
#: Score from which on a text counts as good.
THRESHOLD = 0.7

FEATURES = 15


def features(text: str) -> list[float]:
    """Statistics of the whole text: lengths, kinds of characters, repetition of words, word pairs, lines and sentences."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, other = counts[65:91].sum(), counts[97:123].sum(), counts[128:].sum()
    size = len(raw)
    symbols = counts[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    kinds = set(words)
    pairs = len(set(zip(words, words[1:])))
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sentences = [x for x in raw.split(b". ") if x]
    return [
        np.log1p(n), size / n, symbols / n, counts[33] / n, (marks - symbols) / n, upper / max(1, upper + lower), counts[48:58].sum() / size, len(kinds) / n**0.9, same / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(sentences)) / max(1, len(sentences)), other / size, sum(len(w) == 1 for w in words) / n, counts[10] / n,
    ]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        h, g = newton_sums(x, y, np.ones(len(x)), w)
        w -= np.linalg.solve(h + ridge * np.eye(len(w)), g + ridge * w)
    return w


def newton_sums(x: np.ndarray, y: float | np.ndarray, mass: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(x @ w)
    return x.T @ (x * (mass * p * (1 - p))[:, None]), x.T @ (mass * (p - y))


def standard(model: dict, x: np.ndarray) -> np.ndarray:
    return np.clip((x - model["mean"]) / model["scale"], -8, 8)


def rows_of(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), FEATURES)


def class_prior(pos: np.ndarray, sums_over_unlabelled, ridge: float = 1e-2) -> float:
    """Share of positives among the unlabelled texts.

    A classifier of positives against unlabelled texts, both of equal weight together, tends, where
    no negatives are, to r = 1 / (1 + prior); r is read off positives that it didn't see. Two are
    fitted, on half of the positives each. sums_over_unlabelled gives, for a list of weights, the
    mean of newton_sums over all unlabelled texts for each of them.
    """
    half = len(pos) // 2
    folds = [(pos[:half], pos[half:]), (pos[half:], pos[:half])]
    ones = lambda a: np.c_[a, np.ones(len(a))]
    ws = [np.zeros(pos.shape[1] + 1) for _ in folds]
    for _ in range(NEWTON):
        for k, ((fit, _), (h_u, g_u)) in enumerate(zip(folds, sums_over_unlabelled(ws))):
            h_p, g_p = newton_sums(ones(fit), 1.0, np.full(len(fit), 1 / len(fit)), ws[k])
            small = ridge / len(fit)
            ws[k] = ws[k] - np.linalg.solve(h_p + h_u + small * np.eye(len(ws[k])), g_p + g_u + small * ws[k])
    r = [np.median(sigmoid(ones(see) @ w)) for (_, see), w in zip(folds, ws)]
    return float(np.clip(np.mean([1 / max(x, 1e-6) - 1 for x in r]), 0.05, 0.98))


def risk_and_gradient(theta: list[np.ndarray], x: np.ndarray, is_pos: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) of a network with one hidden layer, l being the sigmoid loss, and the step's direction.

    Where the estimate of the negatives' risk falls below zero, the direction is up along it, which
    keeps the network from fitting positives among the unlabelled as negatives.
    """
    hidden = np.tanh(x @ theta[0] + theta[1])
    s = sigmoid(hidden @ theta[2] + theta[3])  # the loss of a negative; 1 - s is that of a positive
    slope = s * (1 - s)
    positive, negative = prior * (1 - s[is_pos]).mean(), s[~is_pos].mean() - prior * s[is_pos].mean()
    g = np.where(is_pos, -prior * slope / is_pos.sum(), slope / (~is_pos).sum())  # of the negatives' risk
    g = g - np.where(is_pos, prior * slope / is_pos.sum(), 0) if negative >= 0 else -g
    back = g[:, None] * theta[2][None, :] * (1 - hidden**2)
    return positive + max(0.0, negative), [x.T @ back, back.sum(0), hidden.T @ g, np.array([g.sum()])]


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float) -> dict:
    """The network that minimises the non-negative risk, by adaptive steps with a little decay of its weights."""
    r = np.random.default_rng(11)
    d = pos.shape[1]
    theta = [r.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    x = np.r_[pos, unl]
    is_pos = np.r_[np.ones(len(pos), bool), np.zeros(len(unl), bool)]
    for step in range(1, STEPS + 1):
        _, grads = risk_and_gradient(theta, x, is_pos, prior)
        for k, decay in enumerate((1e-4, 0, 1e-4, 0)):
            grad = grads[k] + decay * theta[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            theta[k] = theta[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {"theta": theta, "prior": prior}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    a, b, c, d = model["theta"]
    return np.tanh(standard(model, x) @ a + b) @ c + d[0]


def score(model: dict, x: np.ndarray) -> np.ndarray:
    return sigmoid(model["slope"] * margin(model, x) + model["shift"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). Per row doc_id and x, its features."""

    @in_slices
    def measure(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()])
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel(), pa.float64()))], names=["doc_id", "x"])

    return docs.mapInArrow(measure, "doc_id long, x array<double>")


def train(measured: DataFrame, labels: DataFrame) -> dict | None:
    """measured: (doc_id, x); labels: (doc_id, quality). Fits on rows that aren't held out; None with fewer than 4 trusted or unlabelled ones.

    Unlabelled texts are those that labels don't name, so they are the web's mixture. Mean and scale of
    the features and the class prior are aggregated over all of them. The network is fitted on POSITIVES
    trusted and UNLABELLED unlabelled rows, and slope and shift of the final score on SCALING rows of
    either label, of which those of label 1 are never trusted ones; all with the smallest hashes of
    doc_id. Only these bounded samples and sums reach the driver, as features.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rated = stored(measured.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).join(known, "doc_id", "left"), "training")
    first = lambda df, n: np.array([r["x"] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(n).collect()]).reshape(-1, FEATURES)
    scaling = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SCALING_SHARE)) == 0
    unlabelled = rated.filter("quality IS NULL")
    pos, unl = first(rated.filter((F.col("quality") == 1) & ~scaling), POSITIVES), first(unlabelled, UNLABELLED)
    if len(pos) < 4 or len(unl) < 4:
        return None
    parts = F.posexplode("x").alias("k", "v")
    moments = unlabelled.select(parts).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale"), F.count("*").alias("n")).orderBy("k").collect()
    model = {"mean": np.array([r["mean"] for r in moments]), "scale": np.maximum([r["scale"] for r in moments], 1e-3), "slope": 1.0, "shift": 0.0}

    def mean_sums(ws):
        def add(batches):
            sums = 0
            for batch in batches:
                if batch.num_rows:
                    x = standard(model, rows_of(batch.column("x")))
                    x = np.c_[x, np.ones(len(x))]
                    sums = sums + np.concatenate([np.r_[h.ravel(), g] for h, g in (newton_sums(x, 0.0, np.ones(len(x)), w) for w in ws)])
            if np.ndim(sums):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int64()), pa.array(sums)], names=["k", "v"])

        total = unlabelled.select("x").mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        d = FEATURES + 1
        whole = np.array([r["v"] for r in total]).reshape(len(ws), d * d + d) / moments[0]["n"]
        return [(row[: d * d].reshape(d, d), row[d * d :]) for row in whole]

    order = np.random.default_rng(3).permutation(len(pos))
    model |= fit_pu(standard(model, pos), standard(model, unl), class_prior(standard(model, pos)[order], mean_sums))
    good, bad = first(rated.filter((F.col("quality") == 1) & scaling), SCALING), first(rated.filter("quality = 0"), SCALING)
    if len(good) and len(bad):
        slope, shift = logistic(margin(model, np.r_[good, bad])[:, None], np.r_[np.ones(len(good)), np.zeros(len(bad))])
        if slope > 0:
            model |= {"slope": float(slope), "shift": float(shift)}
    return model


def scored(model: dict | None, spark: SparkSession, of: str):
    """A column function to the score of a text, or of the features x of one; 0.5 without a model."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def rate(values: pa.Array) -> pa.Array:
        if not shared.value or not len(values):
            return pa.array(np.full(len(values), 0.5))
        return pa.array(score(shared.value, rows_of(values) if of == "x" else np.array([features(t) for t in values.to_pylist()])))

    return rate


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: better), predicted (1 from `threshold` on).

    labels has doc_id and quality. Rows with crc32(doc_id as text) mod 4 = 2 are held out: their
    labels and texts aren't learned from. Inputs of a score are statistics of the text alone. All whole
    texts are read once; their features, a few numbers each, are written and then aggregated, sampled
    and scored.

    Defined cases: null text counts as empty, which has all features 0 and a score like any
    other text; very long texts are measured whole; null labels are ignored, and of a document's
    several labels the lowest holds; rows without doc_id are scored and not learned from, repeated
    rows are learned from and scored like others; with fewer than 4 trusted or 4 unlabelled texts
    every score is 0.5; an empty table gives no rows; further columns are ignored.
    """
    measured = stored(feature_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), as_text(F.col(text_col)).alias("text"))), "features")
    rate = scored(train(measured, labels), docs.sparkSession, "x")
    rated = measured.select("doc_id", rate("x").alias("score"))
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose score reaches the threshold. Defined cases are those of quality_scores."""
    text = as_text(F.col(text_col))
    measured = stored(feature_table(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))), "features")
    return docs.filter(scored(train(measured, labels), docs.sparkSession, "text")(text) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = None
