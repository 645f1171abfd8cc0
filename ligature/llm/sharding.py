"""Sharding by extendible hashing: a directory indexed by prefix bits of a hash; only buckets over the byte limit split on another bit.

The directory is built in levels of LEVEL_BITS bits. A level aggregates bytes by prefix (partial sums before the shuffle) and rolls the
prefixes up to find the shortest that fits; only prefixes that are still too large at its last bit go on to the next level. Each of these
holds more than the limit, so a level has at most 2 ** LEVEL_BITS * all bytes / limit rows, and the driver reads their number only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

HASH_BITS, LEVEL_BITS = 60, 12
SHARD_BYTES = 8 << 20
#: Directory rows up to which a level is broadcast, some 100 bytes each.
BROADCAST_ROWS = 200_000

HASH = "CAST(conv(substring(md5(concat(coalesce(CAST(doc_id AS string), ''), ':', md5(coalesce(text, '')))), 1, 15), 16, 10) AS bigint)"
BYTES = "CAST(coalesce(octet_length(text), 0) AS bigint)"


def directory(rows: DataFrame, limit: int) -> list[DataFrame]:
    """Levels of (prefix, depth, shard_bytes) from rows of (h, n_bytes): depth is null where the next level decides."""
    levels: list[DataFrame] = []
    for last in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        prefix = F.shiftright("h", HASH_BITS - last)
        if levels:
            open_ = levels[-1].where("depth is null").select("prefix")
            rows = rows.join(open_, F.shiftright(rows["h"], HASH_BITS - last + LEVEL_BITS) == open_["prefix"], "left_semi")
        sums = [F.sum("n_bytes").alias("n_bytes"), F.min("low").alias("low"), F.max("high").alias("high")]
        bins = rows.select(prefix.alias("prefix"), "n_bytes", F.col("h").alias("low"), F.col("h").alias("high")).groupBy("prefix").agg(*sums)
        depths = F.explode(F.array(*[F.lit(d) for d in range(last - LEVEL_BITS + (1 if levels else 0), last + 1)]))
        rolled = bins.select("*", depths.alias("d")).withColumn("p", F.expr(f"shiftright(prefix, {last} - d)"))
        whole = rolled.groupBy("d", "p").agg(*sums).where(f"n_bytes <= {limit} or low = high")
        fit = rolled.select("prefix", "d", "p").join(whole.select("d", "p", "n_bytes"), ["d", "p"])
        least = fit.groupBy("prefix").agg(F.min(F.struct("d", "n_bytes")).alias("x")).select(F.col("prefix").alias("of"), "x")
        level = bins.select("prefix").join(least, F.col("prefix") == F.col("of"), "left").select("prefix", F.col("x.d").alias("depth"), F.col("x.n_bytes").alias("shard_bytes"))
        levels.append(stored(level, "directory"))
        if not levels[-1].where("depth is null").limit(1).count():
            break
    return levels


def assigned(rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """rows (with a column h) with shard, the bits of its prefix, and shard_bytes; h goes."""
    depth, size = [], []
    out = rows
    for i, level in enumerate(levels, 1):
        level = level.select(F.col("prefix").alias(f"_prefix{i}"), F.col("depth").alias(f"_depth{i}"), F.col("shard_bytes").alias(f"_bytes{i}"))
        depth.append(f"_depth{i}")
        size.append(f"_bytes{i}")
        if i == 1 or level.count() <= BROADCAST_ROWS:
            level = F.broadcast(level)
        out = out.join(level, F.expr(f"shiftright(_h, {HASH_BITS - i * LEVEL_BITS}) = _prefix{i}"), "left")
    bits = F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), HASH_BITS, "0")
    depth_, size_ = F.coalesce(*depth, F.lit(HASH_BITS)), F.coalesce(*size)
    return out.withColumn("_shard", F.substring(bits, F.lit(1), depth_)).withColumn("_shard_bytes", size_)


def sharded(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """docs with shard (bits of a hash prefix; '' if one shard holds all) and shard_bytes, at most limit UTF-8 bytes of text.

    The hash is of doc_id and text, null or not. A text over the limit gets a shard of its own; rows alike in doc_id and text can't be
    told apart and share theirs, whatever their size. Columns of docs by these two names are replaced. No rows: no shards.
    """
    narrow = stored(docs.select(F.expr(HASH).alias("h"), F.expr(BYTES).alias("n_bytes")), "hashes")
    levels = directory(narrow, limit)
    names = [c for c in docs.columns if c not in ("shard", "shard_bytes")]
    out = assigned(docs.select(*names, F.expr(HASH).alias("_h")), levels)
    return out.select(*names, F.col("_shard").alias("shard"), F.col("_shard_bytes").alias("shard_bytes"))
