"""Quality scores by positive-unlabelled learning.

Trusted positives (rows labelled 1) and unlabelled web text are all the learner sees; the class prior, the share of
good text in the unlabelled, is estimated beforehand. With that prior the risk of a classifier can be written without
any negative example: the risk on positives, plus what the unlabelled say about negatives after the positives' part of
them is taken off. That second part cannot really be below zero; whenever a step would push it there, the model steps
back from it instead (non-negative risk), which keeps it from over-fitting the positives.

A text is described by which kinds of characters follow each other, and by lengths and repetitions, so the language
and the words themselves hardly matter. The model is logistic in these features and is fitted on bounded samples of
both kinds; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterlens.llm.tables import small_batches
from meterlens.session import cut

#: Kinds of bytes; every mark of ASCII that text piles up has a kind of its own.
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".",
         b",", b"!?", b"|", b"#", b"*", b"$%&", b"-_=+~^", b"()[]{}<>/\\", b"'\"`:;@"]
OTHER = len(KINDS)
N_KINDS = OTHER + 1
N_FEATURES = N_KINDS + N_KINDS * N_KINDS + 6
FOLDS, HELD_OUT = 3, 1
#: Texts whose features are held at a time.
CHUNK = 256


@dataclass(frozen=True)
class QualityParams:
    #: Most positives and most unlabelled texts in the fit: those with the smallest hashes.
    max_positive: int = 3_000
    max_unlabelled: int = 9_000
    epochs: int = 60
    batch: int = 2_000
    rate: float = 0.02
    decay: float = 1e-2
    #: The class prior, where it is known; else it is estimated from the labels.
    prior: float | None = None
    seed: int = 7


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -CLIP, CLIP) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


#: Features are held within this many deviations.
CLIP = 6.0


def kind_table() -> np.ndarray:
    table = np.full(256, OTHER, dtype=np.uint8)
    for kind, members in enumerate(KINDS):
        table[np.frombuffer(members, dtype=np.uint8)] = kind
    return table


def features_of(text: str | None, table: np.ndarray) -> np.ndarray:
    """One text's features; an empty text has all zeros."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES)
    if not raw:
        return out
    kinds = table[np.frombuffer(raw, dtype=np.uint8)]
    counts = np.bincount(kinds, minlength=N_KINDS)
    pairs = np.bincount(kinds[:-1].astype(np.intp) * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
    # Roots of shares: rare pairs stay visible beside common ones.
    out[:N_KINDS] = np.sqrt(counts / len(raw))
    out[N_KINDS : N_KINDS + N_KINDS * N_KINDS] = np.sqrt(pairs / max(1, len(raw) - 1))
    words, lines = raw.split(), raw.split(b"\n")
    rest = out[-6:]
    rest[0] = np.log1p(len(raw))
    rest[1] = np.log1p(len(words))
    rest[2] = np.log1p(len(raw) / max(1, len(words)))
    rest[3] = len(set(words)) / max(1, len(words))
    rest[4] = len(set(lines)) / len(lines)
    rest[5] = sum(map(eq, words, words[1:])) / max(1, len(words) - 1)
    return out


def features_of_all(texts: Iterable, table: np.ndarray) -> np.ndarray:
    """A row of features for each text of an Arrow array or a pandas series."""
    plain = (t.as_py() if isinstance(t, pa.Scalar) else t for t in texts)
    return np.array([features_of(t, table) for t in plain]).reshape(-1, N_FEATURES)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def with_features(rows: DataFrame, text_col: str) -> DataFrame:
    """All columns but the text, and ``features``."""
    kept = [c for c in rows.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kind_table()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                texts = some.column(some.schema.get_field_index(text_col))
                flat = pa.array(features_of_all(texts, table).ravel().astype(np.float32))
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, N_FEATURES, dtype=np.int32), flat)
                columns = [some.column(some.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, lists], [*kept, "features"])

    return rows.mapInArrow(run, f"{schema}, features array<float>")


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, p: QualityParams) -> QualityModel:
    """Minimises the non-negative risk with the logistic loss by stochastic steps with momentum and step scaling."""
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / n
    pos, unl = (x - mean.astype(np.float32) for x in (positive.astype(np.float32), unlabelled.astype(np.float32)))
    scale = np.sqrt((np.einsum("ij,ij->j", pos, pos) + np.einsum("ij,ij->j", unl, unl)) / n).astype(np.float64)
    scale = np.where(scale > 1e-6, scale, 1.0)
    for x in (pos, unl):
        x /= scale.astype(np.float32)
        np.clip(x, -CLIP, CLIP, out=x)
    rng = np.random.default_rng(p.seed)
    w, b = np.zeros(pos.shape[1]), float(np.log(prior / (1 - prior)))
    moment, square, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
    softplus = lambda z: np.logaddexp(0.0, z)
    rounds = max(1, -(-len(unl) // p.batch))
    for epoch in range(p.epochs):
        order_p, order_u = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(rounds):
            u = unl[order_u[k::rounds]]
            q = pos[order_p[k::rounds]] if len(pos) >= rounds else pos
            zu, zq = u @ w + b, q @ w + b
            negative_risk = softplus(zu).mean() - prior * softplus(zq).mean()
            gu, gq = sigmoid(zu) / len(u), prior * sigmoid(zq) / len(q)
            negative = np.append(u.T @ gu - q.T @ gq, gu.sum() - gq.sum())
            if negative_risk >= 0:
                pull = prior * (sigmoid(zq) - 1) / len(q)
                grad = np.append(q.T @ pull, pull.sum()) + negative
            else:
                grad = -negative
            grad[:-1] += p.decay * w
            step += 1
            moment = 0.9 * moment + 0.1 * grad
            square = 0.999 * square + 0.001 * grad**2
            move = (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            rate = p.rate * (1 - epoch / p.epochs)
            w, b = w - rate * move[:-1], b - rate * move[-1]
    return QualityModel(mean, scale, w, b - _cut(pos @ w + b, unl @ w + b, prior), prior)


def _cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Where the classes part: above it lies the prior's share of the unlabelled, within its sampling error.

    In that range the widest gap between neighbouring scores is taken, but nothing that would reject more than one
    trusted positive in a thousand.
    """
    scores, n = np.sort(unlabelled), len(unlabelled)
    error = 3 * np.sqrt(prior * (1 - prior) / n) + 1 / n
    low, high = (int(np.clip(n * (1 - prior + e), 0, n - 1)) for e in (-error, error))
    near, most = scores[low : high + 1], float(np.quantile(positive, 0.001))
    middles = (near[:-1] + near[1:]) / 2
    allowed = middles <= most
    if not allowed.any():
        return min(float(near[0]), most)
    return float(middles[np.argmax(np.where(allowed, np.diff(near), -1.0))])


def train(
    documents: DataFrame,
    labels: DataFrame,
    params: QualityParams = QualityParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> QualityModel:
    """Fits on the documents whose labels may be learned.

    Positives are documents labelled 1; the unlabelled sample is drawn from all documents outside the held-out fold,
    without regard to labels. The prior is the share of label 1 among the labels that may be learned, over all of
    them, unless it is given. Contradicting labels of a document count as 0; null labels as none. Without positives
    every score is the prior (0.5 if that is unknown too).
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
        .where(F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    row = known.agg(F.avg(F.col("label").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")).first()
    prior = params.prior if params.prior is not None else row["rate"] if row["n"] else 0.5
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(
        ~held_out(F.col("id"))
    )
    # The samples are chosen by hashes of ids alone; only their texts are read into features.
    chosen = lambda ids, salt, most: (
        ids.select("id", F.xxhash64("id", F.lit(salt)).alias("h")).distinct().orderBy("h", "id").limit(most)
    )
    ids = texts.select("id")
    good = ids.join(known.where("label = 1"), "id").select("id")
    picked = cut(
        chosen(good, 1, params.max_positive)
        .select("id", F.lit(1).alias("kind"))
        .unionByName(chosen(ids, 2, params.max_unlabelled).select("id", F.lit(0).alias("kind")))
    )
    with small_batches(documents.sparkSession):
        rows = with_features(texts.join(F.broadcast(picked), "id"), "text").toArrow()
    rows = rows.sort_by([("kind", "ascending"), ("id", "ascending")])
    features = rows["features"].combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    samples = {k: features[rows["kind"].to_numpy() == k] for k in (0, 1)}
    prior = float(min(max(prior, 0.01), 0.99))
    if not len(samples[1]) or not len(samples[0]):
        zero = np.zeros(N_FEATURES)
        return QualityModel(zero, zero + 1, zero, float(np.log(prior / (1 - prior))), prior)
    return fit(samples[1], samples[0], prior, params)


def score(
    documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts have a score too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kind_table()
        for batch in batches:
            text = batch.column(2)
            parts = [model.scores(features_of_all(text.slice(at, CHUNK), table)) for at in range(0, len(text), CHUNK)]
            scores = np.concatenate([np.zeros(0), *parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col)
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that the model predicts as good, all columns unchanged."""
    predict = _predictor(model)
    return documents.where(predict(F.col(text_col)) >= 0.5)


def _predictor(model: QualityModel):
    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        table = kind_table()
        parts = [model.scores(features_of_all(texts[at : at + CHUNK], table)) for at in range(0, len(texts), CHUNK)]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    return predict
