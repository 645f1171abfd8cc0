"""Near-duplicate documents: SimHash fingerprints joined by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 3 bits have a value between them, at most 1 bit from one and at most 2 bits from the other. So
every fingerprint emits its variants: all those within 1 bit (near), and those at 2 bits (far). Of three differing bits one side has at
least two set, so it is enough that far variants clear two set bits: some 500 instead of 2,016. Fingerprints with a common variant, near
for one of them, differ in at most 1 + 2 bits, and each pair within the radius has such a variant.

The shuffle on variants ships no variant by itself: it deals by K of the 64 bits of the variant, so a fingerprint travels once for each
value of these bits that one of its variants has (1 + K + about K * K / 8 rows), and the task of that value makes the variants. K follows
from the number of distinct fingerprints, and the bits are those set nearest to half of the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, per_batch, stored
from .components import components

RADIUS = 3
#: Distinct fingerprints for each value of the dealing bits, on average.
GROUP = 2048


def fingerprint(text: bytes, words: int = 3) -> bytes:
    """Eight bytes, most significant first: a bit is set if more than half of the shingles' XXH64 have it. No word: zero."""
    found = text.lower().split()
    if len(found) <= words:
        parts = [b" ".join(found)] if found else []
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:-words])).tolist()
        parts = [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    if not parts:
        return bytes(8)
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(parts), 65536):
        hashes = np.frombuffer(b"".join([digest(x, 42) for x in parts[i : i + 65536]]), np.uint8)
        counts += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(parts)).tobytes()


def _fingerprints(batch: pa.RecordBatch, words: int) -> dict:
    return {"doc_id": batch.column(0), "fp": [int.from_bytes(fingerprint(x, words), "big", signed=True) for x in as_bytes(batch.column(1))]}


def simhash_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    chosen = docs.select(F.col("doc_id").cast("long"), "text")
    return chosen.mapInArrow(per_batch(lambda batch: _fingerprints(batch, words), schema), "doc_id long, fp long")


def _bit(i: int) -> int:
    """Bit i as a signed long."""
    return (1 << i) - (1 << 64) * (i == 63)


def _dealing_bits(fps: DataFrame) -> list[int]:
    counts = fps.agg(F.count("*"), *[F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))) for i in range(64)]).first()
    n = counts[0]
    k = min(20, max(0, (n // GROUP).bit_length()))
    return sorted(range(64), key=lambda i: abs(2 * (counts[i + 1] or 0) - n))[:k]


def _least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label != label[label]).any():
            label = label[label]


def _forest(fps: np.ndarray, dealt: int, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the variants with this value of the dealing bits connect: one for each fingerprint at most."""
    one = np.uint64(1)
    inner = [one << np.uint64(b) for b in bits]
    outer = [one << np.uint64(b) for b in range(64) if b not in set(bits)]
    mask = np.bitwise_or.reduce(np.array(inner, np.uint64)) if inner else np.uint64(0)
    moved = (fps & mask) ^ np.uint64(dealt & (2**64 - 1))
    apart = np.bitwise_count(moved)
    rows = np.arange(len(fps))
    home, next_, cleared = rows[apart == 0], rows[apart == 1], rows[(moved & ~fps) == 0]
    values = [fps[home], fps[next_] ^ moved[next_]] + [fps[home] ^ b for b in outer]
    owners = [home, next_] + [home] * len(outer)
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    first = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    keys, heads = values[first], owners[first]
    u, v = [heads[np.cumsum(first) - 1]], [owners]
    seen = np.zeros(1 << 22, bool)
    spread = np.uint64(0x9E3779B97F4A7C15)
    seen[(keys * spread) >> np.uint64(42)] = True

    def probe(variants: np.ndarray, of: np.ndarray) -> None:
        likely = seen[(variants * spread) >> np.uint64(42)]
        variants, of = variants[likely], of[likely]
        at = np.searchsorted(keys, variants)
        at[at == len(keys)] = 0
        hit = keys[at] == variants
        both = np.unique(np.stack((heads[at[hit]], of[hit])), axis=1)
        u.append(both[0])
        v.append(both[1])

    if len(keys):
        pairs = np.array([a | b for a, b in combinations(outer, 2)], np.uint64)
        for i in range(0, len(home), 256):
            own = home[i : i + 256]
            at, pair = np.nonzero((fps[own][:, None] & pairs) == pairs)
            probe(fps[own][at] ^ pairs[pair], own[at])
        single = np.array(outer, np.uint64)
        far = cleared[apart[cleared] == 1]
        for i in range(0, len(far), 8192):
            own = far[i : i + 8192]
            base = fps[own] ^ moved[own]
            at, bit = np.nonzero((base[:, None] & single) == single)
            probe(base[at] ^ single[bit], own[at])
        own = cleared[apart[cleared] == 2]
        probe(fps[own] ^ moved[own], own)
    u, v = np.concatenate(u), np.concatenate(v)
    label = _least_labels(len(fps), u, v)
    linked = rows[label != rows]
    return fps[linked], fps[label[linked]]


def ball_links(fps: DataFrame) -> DataFrame:
    """(u, v) fingerprints within RADIUS bits: enough true links to connect all that such links connect. fps: distinct (fp long)."""
    bits = _dealing_bits(fps)
    mask = sum(_bit(b) for b in bits)
    routes = [F.array(F.lit(0).cast("long"), *[F.lit(_bit(b)).cast("long") for b in bits])]
    if len(bits) > 1:
        two = F.array(*[F.lit(_bit(a) + _bit(b)).cast("long") for a, b in combinations(bits, 2)])
        routes.append(F.filter(two, lambda m: F.col("fp").bitwiseAND(m) == m))
    rows = fps.select("fp", F.explode(F.concat(*routes)).alias("route"))
    rows = rows.select(F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.col("route")).alias("dealt"), "fp")

    def links(key: tuple, group: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        found = np.sort(group["fp"].to_numpy().astype(np.int64).view(np.uint64))
        u, v = _forest(found, int(key[0]), bits)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return rows.groupBy("dealt").applyInPandas(links, "u long, v long")


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: texts whose fingerprints differ in at most RADIUS bits are linked, and component_id is the
    smallest doc_id reachable by links.

    Texts without a word have fingerprint zero and are linked like any other; null counts as empty. Rows with one doc_id each get a row;
    a null doc_id gets a row, and stands as component_id only where a component has no other. No row: no row. Other columns are not read.
    """
    prints = stored(simhash_fingerprints(docs, words), "simhash")
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    roots = components(ball_links(reps.select("fp")))
    least = (
        reps.join(roots, reps.fp == roots.node, "left")
        .select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    )
    linked = stored(least, "simhash-roots")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = linked.join(smallest, "root").select(F.col("fp").alias("k"), "component_id")
    return prints.join(by_print, prints.fp == by_print.k).select("doc_id", "fp", "component_id")
