"""A quality classifier by positive-unlabelled learning: non-negative risk of trusted positives, unlabelled text and an estimated prior.

With squared loss the risks of a linear score depend on the texts by their second moments alone. So one pass sums x x' over all unlabelled
texts, and the driver minimises the exact non-negative risk of the whole corpus from a few hundred squared numbers. The class prior is the
best-bin estimate: a score of positives against unlabelled, and the least ratio of both classes' shares above a threshold, by histograms
over all texts. Only the trusted positives are drawn, MOST_POSITIVES of them at most.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, per_batch, stored
from .linear import nn_pu_weights

#: Trusted positives that are used, those first by a hash of doc_id.
MOST_POSITIVES = 20_000
THRESHOLD = 0.3
BINS = 1000
#: Bytes by kind: lower case, upper case, digit, space, line end, stop, comma and the like, quote, mark of emphasis, bar, symbol, other ASCII, not ASCII.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".?", ",;:", "'\"()[]", "!", "|", "#$%&*+<=>@^_`~{}\\/-"]
_KIND = np.full(256, len(KINDS), np.uint8)
_KIND[128:] = len(KINDS) + 1
for _i, _chars in enumerate(KINDS):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _i
N_KINDS = len(KINDS) + 2
N_FEATURES = N_KINDS + N_KINDS * N_KINDS + 9
_LINE = re.compile(rb"[^\n]+")


def features(text: bytes) -> np.ndarray:
    """Shares of kinds of bytes and of their pairs (square roots), repetition, and length. The last is 1."""
    kinds = _KIND[np.frombuffer(text, np.uint8)]
    one = np.bincount(kinds, minlength=N_KINDS)
    two = np.zeros(N_KINDS * N_KINDS)
    for i in range(0, len(kinds) - 1, 1 << 20):
        part = kinds[i : i + (1 << 20) + 1]
        two += np.bincount(part[:-1] * np.uint8(N_KINDS) + part[1:], minlength=len(two))
    words = text.split()
    lines = _LINE.findall(text)
    n = max(1, len(words))
    distinct = len(set(words)) / n
    packed = len(zlib.compress(text, 1)) / (len(text) + 12)
    more = [
        distinct,
        distinct * np.log1p(n) / 5,
        sum(a == b for a, b in pairwise(words)) / n,
        len(set(lines)) / max(1, len(lines)),
        packed,
        max(0.0, 0.3 - packed) * 3,
        np.log1p(n) / 8,
        min(1.0, len(text) / n / 20),
        1.0,
    ]
    return np.concatenate((np.sqrt(one / max(1, len(text))), np.sqrt(two / max(1, len(text) - 1)), more)).astype(np.float32)


HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0, false)"


def trusted_positives(labels: DataFrame, most: int = MOST_POSITIVES) -> DataFrame:
    """(doc_id) of documents with quality 1, and no other quality, that are not held out: most of them at most, the first by hash."""
    sure = labels.where(f"doc_id is not null and quality is not null and not {HELD_OUT}").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    return sure.where("least = 1 and most = 1").select(F.col("doc_id").cast("long")).orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(most)


def featured(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """(doc_id, held_out, positive, x) of every row; positives is bounded, so it is broadcast."""
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(positives.select(F.col("doc_id").alias("_p"))), F.col("doc_id") == F.col("_p"), "left")
    marked = marked.select("doc_id", "text", F.col("_p").isNotNull().alias("positive"))
    schema = pa.schema([("doc_id", pa.int64()), ("positive", pa.bool_()), ("x", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "positive": batch.column("positive"), "x": [features(t).tobytes() for t in as_bytes(batch.column("text"))]}

    out = marked.mapInArrow(per_batch(work, schema), "doc_id long, positive boolean, x binary")
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "positive", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_FEATURES)


def _moments(rows: DataFrame) -> dict[bool, tuple[int, np.ndarray]]:
    """For all rows (False) and for positives (True): their number and the sum of x x'. Tasks send one row a feature, which are summed by feature."""

    def partial(batches):
        sums = {kind: np.zeros((N_FEATURES, N_FEATURES)) for kind in (False, True)}
        for batch in batches:
            x, positive = _matrix(batch.column("x")).astype(np.float64), np.array(batch.column("positive"))
            sums[False] += x.T @ x
            sums[True] += x[positive].T @ x[positive]
        for kind, total in sums.items():
            yield pa.record_batch({"kind": [kind] * N_FEATURES, "i": list(range(N_FEATURES)), "v": [r.tobytes() for r in total]})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        v = np.sum([np.frombuffer(v, np.float64) for v in group["v"]], axis=0)
        return pd.DataFrame({"kind": group["kind"][:1], "i": group["i"][:1], "v": [v.tobytes()]})

    sent = rows.select("positive", "x").mapInArrow(partial, "kind boolean, i long, v binary")
    got = sent.groupBy("kind", "i").applyInPandas(total, "kind boolean, i long, v binary").collect()
    out = {}
    for kind in (False, True):
        gram = np.zeros((N_FEATURES, N_FEATURES))
        for r in got:
            if r["kind"] == kind:
                gram[r["i"]] = np.frombuffer(r["v"], np.float64)
        out[kind] = (round(gram[-1, -1]), np.round(gram, 6))
    return out


def class_prior(bins: np.ndarray, delta: float = 0.1) -> float:
    """Best bin: the least, over thresholds, of the unlabelled's share above one over the positives', with a margin for chance.

    bins: the numbers of unlabelled and of positives by bin of score, two rows.
    """
    above = bins[:, ::-1].cumsum(axis=1)
    n = np.maximum(above[:, -1:], 1)
    share = above / n
    slack = np.sqrt(np.log(4 / delta) / 2 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(share[1] > 0, (share[0] + slack[0] + slack[1]) / share[1], np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(share[0, at] / max(share[1, at], 1e-9), 0.01, 0.99))


@dataclass
class QualityModel:
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """With squared loss w.x is about 2 P - 1. The curve keeps order beyond 0 and 1, and meets P at a half and at the threshold."""
        at = np.log(THRESHOLD / (1 - THRESHOLD)) / (2 * THRESHOLD - 1)
        return 1 / (1 + np.exp(-np.clip(at * (x.astype(np.float64) @ self.weights), -40, 40)))


def fit_quality_model(rows: DataFrame) -> QualityModel:
    """From featured() rows that are not held out. Without a positive or any text every score is a half."""
    learn = rows.where("not held_out")
    moments = _moments(learn)
    (n_u, gram_u), (n_p, gram_p) = moments[False], moments[True]
    if not n_p or not n_u:
        return QualityModel(np.zeros(N_FEATURES), 0.5)
    gram_u, gram_p = gram_u / n_u, gram_p / n_p
    mean_u, mean_p = gram_u[-1], gram_p[-1]
    apart = np.linalg.solve(gram_u + gram_p + 2e-3 * np.eye(N_FEATURES), mean_p - mean_u)
    centre, spread = mean_p @ apart, np.sqrt(max(1e-12, apart @ gram_u @ apart - (mean_u @ apart) ** 2))

    def counted(batches):
        for batch in batches:
            z = (_matrix(batch.column("x")).astype(np.float64) @ apart - centre) / spread
            bins = np.clip((z + 3) / 6 * BINS, 0, BINS - 1).astype(np.int64)
            for kind, chosen in ((False, bins), (True, bins[np.array(batch.column("positive"))])):
                at, n = np.unique(chosen, return_counts=True)
                yield pa.record_batch({"kind": pa.array([kind] * len(at), pa.bool_()), "bin": pa.array(at, pa.int64()), "n": pa.array(n, pa.int64())})

    sent = learn.select("positive", "x").mapInArrow(counted, "kind boolean, bin long, n long")
    bins = np.zeros((2, BINS))
    for r in sent.groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        bins[int(r["kind"]), r["bin"]] = r["n"]
    prior = class_prior(bins)
    return QualityModel(nn_pu_weights(gram_u, mean_p, gram_p, prior), prior)


def scored(docs: DataFrame, labels: DataFrame, most_positives: int = MOST_POSITIVES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs: score is the chance of label 1, predicted is 1 from THRESHOLD on.

    Null and empty texts are scored by the same features; rows without doc_id are scored, and count as unlabelled; repeated rows count
    each; without labels every score is a half.
    """
    rows = stored(featured(docs, trusted_positives(labels, most_positives)), "quality")
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality_model(rows))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": sent.value.score(_matrix(batch.column("x")))}

    out = rows.select("doc_id", "held_out", "x").mapInArrow(per_batch(work, schema), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
