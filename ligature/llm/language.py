"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Texts are counts of hashed byte trigrams of their letters. The machines learn from PER_LANGUAGE documents of a language at most, those first
by a hash of doc_id and text, and from MOST_SAMPLED in all, which are sent to the tasks: each machine is trained in a task of its own.
Everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import per_batch
from .linear import margin_scale, train_svm

UNKNOWN = "und"
#: Documents of a language, and of all, that the machines learn from at most; languages, the most frequent, that are learned.
PER_LANGUAGE, MOST_SAMPLED, MOST_LANGUAGES = 800, 8000, 128
BUCKETS = 2048
#: Language families by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk pl cs sk bg hr sr sl",
    "indic": "hi bn mr gu pa ur",
    "turkic": "tr az kk uz",
    "uralic": "fi et hu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of trigrams, so that the length is 1."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS)
    for i in range(0, max(1, len(a) - 2), 1 << 20):
        x = a[i : i + (1 << 20) + 2]
        mixed = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)
        counts += np.bincount(mixed >> 21, minlength=BUCKETS)
    return np.sqrt(counts / max(1.0, counts.sum())).astype(np.float32)


@dataclass
class Machines:
    """One-versus-one machines among names: weights and the scale of margins for each pair."""

    names: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BUCKETS + 1), np.float32))
    scales: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the place of its name, by votes and then by margins, and the least probability of its pairs."""
        n = len(self.names)
        margins = (x @ self.weights[:, :-1].T + self.weights[:, -1]) * self.scales
        chances = 1 / (1 + np.exp(-np.clip(margins, -50, 50)))
        won, least = np.zeros((len(x), n)), np.ones((len(x), n))
        for k, (i, j) in enumerate(combinations(range(n), 2)):
            won[:, i] += (margins[:, k] >= 0) + 1e-3 * chances[:, k]
            won[:, j] += (margins[:, k] < 0) + 1e-3 * (1 - chances[:, k])
            least[:, i] = np.minimum(least[:, i], chances[:, k])
            least[:, j] = np.minimum(least[:, j], 1 - chances[:, k])
        best = won.argmax(axis=1)
        return best, least[np.arange(len(x)), best]


@dataclass
class LanguageModel:
    families: Machines
    within: dict[str, Machines]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(x), np.zeros(len(x))
        if not self.families.names or not len(x):
            return names, scores
        families, sure = self.families.predict(x)
        for k, family in enumerate(self.families.names):
            rows = np.nonzero(families == k)[0]
            if len(rows):
                inner = self.within[family]
                langs, surer = inner.predict(x[rows])
                scores[rows] = sure[rows] * surer
                for row, lang in zip(rows.tolist(), langs.tolist(), strict=True):
                    names[row] = inner.names[lang]
        return names, scores


HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1, false)"


def _sample(docs: DataFrame, per_language: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and languages of the documents that are learned from."""
    learn = docs.where(f"doc_id is not null and lang is not null and not {HELD_OUT}")
    frequent = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not frequent:
        return np.zeros((0, BUCKETS), np.float32), np.zeros(0, object)
    per = max(1, min(per_language, MOST_SAMPLED // len(frequent)))
    # a few more by hash than are wanted, then exactly the first; rows that repeat count once
    shares = F.create_map(*[F.lit(x) for r in frequent for x in (r["lang"], min(1.0, (per + 5 * per**0.5 + 10) / r["count"]))])
    h = F.xxhash64(F.lit("language"), "doc_id", "text")
    near = learn.where(F.coalesce(F.pmod(h, F.lit(1_000_000)) < F.element_at(shares, F.col("lang")) * 1_000_000, F.lit(False)))
    drawn = near.groupBy("lang", h.alias("h")).agg(F.min("text").alias("text"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    drawn = drawn.withColumn("turn", first).where(F.col("turn") <= per)
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def work(batch: pa.RecordBatch) -> dict:
        rows = [(lang, features(text).tobytes()) for lang, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True) if has_letter(text)]
        return {"lang": [r[0] for r in rows], "x": [r[1] for r in rows]}

    rows = drawn.select("lang", "text").mapInArrow(per_batch(work, schema), "lang string, x binary").collect()
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    return np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, BUCKETS), np.array([r[0] for r in rows], object)


def _trained(spark: SparkSession, x: np.ndarray, kinds: np.ndarray, pairs: list[tuple[str, str]]) -> list[tuple[np.ndarray, float]]:
    """Weights and the scale of margins of a machine for each pair of kinds, one task a machine."""
    if not pairs:
        return []
    sent = spark.sparkContext.broadcast((x, kinds, pairs))
    schema = pa.schema([("id", pa.int64()), ("weights", pa.binary()), ("scale", pa.float64())])

    def work(batch: pa.RecordBatch) -> dict:
        x, kinds, pairs = sent.value
        weights, scales = [], []
        for i in batch.column("id").to_pylist():
            a, b = pairs[i]
            rows = (kinds == a) | (kinds == b)
            y = np.where(kinds[rows] == a, 1.0, -1.0)
            w = train_svm(x[rows], y)
            weights.append(w.astype(np.float32).tobytes())
            scales.append(margin_scale(x[rows] @ w[:-1] + w[-1], y))
        return {"id": batch.column("id"), "weights": weights, "scale": scales}

    ids = spark.range(0, len(pairs), 1, len(pairs))
    rows = sorted(ids.mapInArrow(per_batch(work, schema), "id long, weights binary, scale double").collect())
    return [(np.frombuffer(r["weights"], np.float32), r["scale"]) for r in rows]


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from text and non-null lang of documents whose crc32(doc_id as text) mod 3 is not 1 and whose text has a letter."""
    x, langs = _sample(docs, per_language)
    known = sorted(set(langs.tolist()))
    members: dict[str, list[str]] = {}
    for code in known:
        members.setdefault(_FAMILY.get(code, code), []).append(code)
    family = np.array([_FAMILY.get(code, code) for code in langs.tolist()], object)
    machines = {}
    for kinds, groups in ((family, {None: sorted(members)}), (langs, members)):
        pairs = [pair for names in groups.values() for pair in combinations(names, 2)]
        found = iter(_trained(docs.sparkSession, x, kinds, pairs))
        for name, names in groups.items():
            own = [next(found) for _ in combinations(names, 2)]
            machines[name] = Machines(names, np.array([w for w, _ in own], np.float32).reshape(-1, BUCKETS + 1), np.array([s for _, s in own]))
    return LanguageModel(machines.pop(None), machines)


def predicted(texts: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """(row, lang_pred, score) for every row: row is a struct of the columns keep."""
    chosen = texts.select(F.struct(*[texts[c] for c in keep]).alias("row"), "text")
    schema = pa.schema([to_arrow_schema(chosen.schema).field("row"), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict:
        names, scores = [], []
        for i in range(0, len(batch), 1024):
            part = batch.column("text").slice(i, 1024).to_pylist()
            known = [has_letter(t) for t in part]
            x = np.array([features(t) for t, k in zip(part, known, strict=True) if k], np.float32).reshape(-1, BUCKETS)
            found = iter(zip(*sent.value.predict(x), strict=True))
            for k in known:
                name, score = next(found) if k else (UNKNOWN, 0.0)
                names.append(name)
                scores.append(float(score))
        return {"row": batch.column("row"), "lang_pred": names, "score": scores}

    return chosen.mapInArrow(per_batch(work, schema), f"row {chosen.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, keep: list[str] | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(row, held_out, lang_pred, score) for every row of docs: row is a struct of the columns keep, doc_id among them, lang_pred a learned
    language, score the product of the least chances of its family and of itself against each other.

    A null text, and one without a letter, is `und` with score 0; so is every text where no language could be learned. Rows without
    doc_id are predicted, not learned from. lang, source and doc_id are no input of a prediction.
    """
    out = predicted(docs, fit_language_model(docs, per_language), keep or ["doc_id"])
    return out.withColumn("held_out", F.expr(HELD_OUT.replace("doc_id", "row.doc_id")))


def drop_unidentified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs without the rows that are `und` or score below least; the others stay as they are."""
    found = identify(docs, docs.columns).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select("row.*")
