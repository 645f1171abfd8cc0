"""Near copies by shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Signatures of minima under BANDS * ROWS multipliers are cut into bands; texts with an equal band meet. At similarity 0.8 a pair has no equal
band with chance (1 - 0.8 ** ROWS) ** BANDS = 7e-5, at 0.9 less than 1e-9. Texts that meet are compared by their whole shingle sets, so
no link is below SIMILARITY. Texts alike but for case and white space collapse before; bands with the same members are compared once.

A band with more members than a task should hold is crowded: each of its texts is compared with one of them, in a join whose rows Spark can
split. Texts like that one are linked to it. If all are, as where a template has many variants, the band is done; else those that may still
have partners apart from it (the triangle inequality of the Jaccard distance tells) meet again by the shingles of their prefixes: as many of
each text's rarest in the band that two similar texts must have one of them in common. What is crowded still, after a star of its own, is
compared in pieces of the band, each with each. No text of a band stands in for another, and no similar pair of a band is lost.

The groups of SimHash fingerprints within its radius are candidates like the bands. Alone they find too few: texts of a shingle similarity of
0.8 differ in some ten of 64 bits.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, per_batch, small, stored
from .components import components
from .simhash import ball_links, fingerprint

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts, and shingles, up to which a band's members are compared in one task.
CROWD, CROWD_SHINGLES = 2048, 4_000_000
_FACTORS = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Identity of a text among the rows.
TEXT_HASH = "xxhash64(coalesce(text, ''))"


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; a text of fewer words is one shingle, and no word gives none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        parts = [b" ".join(found)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        parts = [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, 42) for x in parts), np.uint64, len(parts)))


def bands(found: np.ndarray) -> np.ndarray:
    """BANDS hashes as signed longs, of ROWS minima each."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 512):
        mixed = found[i : i + 512, None] * _FACTORS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64).view(np.int64)


def _signed(batch: pa.RecordBatch) -> dict:
    texts = as_bytes(batch.column(2))
    found, sizes = [], []
    for x in texts:
        parts = shingles(x)
        found.append(bands(parts))
        sizes.append(len(parts))
    flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
    offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
    words = [xxhash.xxh64_intdigest(b" ".join(x.lower().split())) for x in texts]
    prints = [int.from_bytes(fingerprint(x), "big", signed=True) for x in texts]
    own = {"h": np.array(words, np.uint64).view(np.int64), "fp": prints, "size": sizes}
    return {"doc_id": batch.column(0), "t": batch.column(1), **own, "bands": pa.ListArray.from_arrays(offsets, flat)}


def _linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets, enough to connect all that similar pairs of them connect."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    groups: list[list[int]] = []
    pairs = []
    for i in order:
        joined, apart = [i], []
        for group in groups:
            # the largest come last, and shorter ones than SIMILARITY of this one can't be similar
            for j in reversed(group):
                if len(sets[j]) < SIMILARITY * len(sets[i]):
                    apart.append(group)
                    break
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common >= SIMILARITY * (len(sets[i]) + len(sets[j]) - common):
                    pairs.append((i, j))
                    joined = group + joined
                    break
            else:
                apart.append(group)
        joined.sort(key=lambda k: len(sets[k]))
        groups = [*apart, joined]
    return pairs


def _met(keys: DataFrame) -> DataFrame:
    """(key, t, crowded) of the keys (key, t, size) that two texts or more share; of keys with the same members one."""
    met = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all_size"), F.min("t").alias("low"), F.bit_xor(F.xxhash64("t")).alias("all"))
    once = met.where("n > 1").groupBy("n", "all_size", "low", "all").agg(F.min("key").alias("_key"))
    crowded = (F.col("n") > CROWD) | (F.col("all_size") > CROWD_SHINGLES)
    chosen = small(stored(once.select("_key", crowded.alias("crowded")), "shingle-keys"))
    return stored(keys.join(chosen, F.col("key") == F.col("_key")).select("key", "t", "crowded"), "shingle-members")


def _compared(batch: pa.RecordBatch) -> dict:
    texts, cores = as_bytes(batch.column(3)), as_bytes(batch.column(4))
    near, core, found = [], None, np.zeros(0, np.uint64)
    for x, y in zip(texts, cores, strict=True):
        if y != core:
            core, found = y, shingles(y)
        own = shingles(x)
        common = len(np.intersect1d(own, found, assume_unique=True))
        near.append(common / max(1, len(own) + len(found) - common))
    return {"key": batch.column(0), "u": batch.column(1), "v": batch.column(2), "near": near}


def _stars(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, u, v, near): the similarity of each member u of a key to one member v of it, the same for all."""
    heads = crowd.groupBy("key").agg(F.min_by("t", F.xxhash64("t", "key")).alias("v"))
    cores = heads.join(texts, heads.v == texts.t).select(F.col("key").alias("_key"), "v", F.col("text").alias("core"))
    rows = crowd.join(texts, "t").join(cores, F.col("key") == F.col("_key")).where("t <> v")
    schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("near", pa.float64())])
    rows = rows.select("key", F.col("t").alias("u"), "v", "text", "core")
    return rows.mapInArrow(per_batch(_compared, schema), "key long, u long, v long, near double")


def _rest(stars: DataFrame, crowd: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, t, size) for the texts of crowded bands that may have partners apart from those that the star links.

    u apart from v by more than 1 - SIMILARITY, and w, have no link if w is nearer to v by more than 1 - SIMILARITY than u is."""
    nearest = stars.where(F.col("near") < SIMILARITY).groupBy("key").agg(F.max("near").alias("most")).withColumnRenamed("key", "_key")
    rest = stars.join(nearest, F.col("key") == F.col("_key")).where(F.col("near") <= F.col("most") + (1 - SIMILARITY) + 1e-9)
    return rest.select("key", F.col("u").alias("t")).join(reps.select("t", "size"), "t").select("key", "t", "size")


def _spelt(batch: pa.RecordBatch) -> dict:
    found = [shingles(x) for x in as_bytes(batch.column(2))]
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32))
    flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))
    return {"key": batch.column(0), "t": batch.column(1), "parts": pa.ListArray.from_arrays(offsets, flat)}


def _prefixed(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, t, size): a key for each shingle of a text's prefix, the rarest in its band first. Of n shingles n - SIMILARITY * n, and one
    more, stand in it: two similar texts have one of these in common."""
    schema = pa.schema([("key", pa.int64()), ("t", pa.int64()), ("parts", pa.list_(pa.int64()))])
    parts = rest.join(texts, "t").select("key", "t", "text").mapInArrow(per_batch(_spelt, schema), "key long, t long, parts array<long>")
    parts = stored(parts.select("key", "t", F.explode("parts").alias("part")), "shingle-parts")
    ranked = parts.join(parts.groupBy("key", "part").agg(F.count("*").alias("n")), ["key", "part"]).groupBy("key", "t").agg(F.sort_array(F.collect_list(F.struct("n", "part"))).alias("all"))
    size = F.size("all")
    prefix = F.slice("all", F.lit(1), size - F.ceil(SIMILARITY * size - F.lit(1e-9)).cast("int") + 1)
    return ranked.select(F.explode(prefix["part"]).alias("part"), "key", "t", size.cast("long").alias("size")).select(F.xxhash64("key", "part").alias("key"), "t", "size")


def _pieces(rest: DataFrame) -> DataFrame:
    """(key, t, size): a key for each two pieces of a band, so that each pair of its texts meets. A piece is half of what a task should hold."""
    wanted = F.greatest(F.ceil(2 * F.count("*") / CROWD), F.ceil(2 * F.sum("size") / CROWD_SHINGLES), F.lit(1))
    sizes = rest.groupBy(F.col("key").alias("_key")).agg(wanted.cast("int").alias("n"))
    own = F.pmod(F.xxhash64("t", "key"), F.col("n")).cast("int")
    dealt = rest.join(sizes, F.col("key") == F.col("_key")).withColumn("own", own)
    dealt = dealt.select("key", "t", "size", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "t", "size")


def shingle_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v) text hashes of similar texts among reps (t, fp, size, bands), whose texts docs has."""
    balls = components(ball_links(reps.select("fp").distinct()))
    ball = F.xxhash64(F.lit("ball"), F.coalesce("root", "fp"))
    balls = reps.join(balls, reps.fp == balls.node, "left").select(ball.alias("key"), "t", "size")
    keys = reps.select(F.explode("bands").alias("key"), "t", "size").unionByName(balls)
    texts = docs.select(F.expr(TEXT_HASH).alias("t"), F.coalesce("text", F.lit("")).alias("text"))

    def links(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["t"].to_numpy()
        pairs = _linked([shingles(x.encode()) for x in group["text"]])
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": ids[at[:, 0]], "v": ids[at[:, 1]]})

    found = []
    # bands, then prefixes within those that are crowded, then pieces, which are compared however many texts they have
    for meet in (_prefixed, lambda rest, _: _pieces(rest), None):
        members = _met(keys)
        if meet is None:
            members = members.withColumn("crowded", F.lit(False))
        wanted = small(members.select(F.col("t").alias("_t")).distinct())
        own = texts.join(wanted, F.col("t") == F.col("_t"), "left_semi").groupBy("t").agg(F.first("text").alias("text"))
        crowd = members.where("crowded")
        few = members.where("not crowded").join(own, "t").groupBy("key").applyInPandas(links, "u long, v long")
        if meet is None or crowd.isEmpty():
            found.append(few)
            break
        found.append(stored(few, "shingle-links"))
        stars = stored(_stars(crowd, own), "shingle-stars")
        found.append(stars.where(F.col("near") >= SIMILARITY).select("u", "v"))
        rest = stored(_rest(stars, crowd, reps), "shingle-rest")
        if rest.isEmpty():
            break
        keys = stored(meet(rest, own), "shingle-finer")
    return functools.reduce(DataFrame.unionByName, found)


def shingle_groups(docs: DataFrame) -> DataFrame:
    """(h, least, root) for each text of docs that differs from others by more than case and white space: h is a hash of its words, least the
    (none, doc_id, t) of its first row, by doc_id, null last, and then by t, the hash of its text; root is the same for all texts that links
    of similar texts connect. Texts without a word are alike; null counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("h", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))])
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(TEXT_HASH).alias("t"), "text")
    prints = stored(chosen.mapInArrow(per_batch(_signed, schema), "doc_id long, t long, h long, fp long, size long, bands array<long>"), "shingles")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
    reps = stored(prints.groupBy("h").agg(least.alias("least"), F.min_by("bands", "t").alias("bands"), F.min("t").alias("t"), F.min("fp").alias("fp"), F.min("size").alias("size")), "shingle-reps")
    roots = components(shingle_links(docs, reps))
    return reps.join(roots, reps.t == roots.node, "left").select("h", "least", F.coalesce("root", "t").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without near copies: of all rows whose texts links connect one stays, that with the smallest doc_id, null last; of those that share
    it the one with the smallest hash of its text, and of rows alike in both that with the smallest hash of all columns."""
    kept = shingle_groups(docs).groupBy("root").agg(F.min("least").alias("x")).select(F.col("x.none").alias("none"), F.coalesce("x.doc_id", F.lit(0)).alias("id"), F.col("x.t").alias("t"))
    told = [c for c, kind in docs.dtypes if "map<" not in kind]
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("none"), own.alias("id"), F.expr(TEXT_HASH).alias("t"), F.xxhash64(*told).alias("all"))
    met = rows.join(kept, ["none", "id", "t"], "left_semi")
    first = F.row_number().over(W.partitionBy("none", "id", "t").orderBy("all"))
    return met.withColumn("turn", first).where("turn = 1").select("row.*")
