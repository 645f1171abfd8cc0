"""Document fingerprints by consistent weighted sampling, all in SQL functions.

A term is a word, its weight the number of times it stands in the text. For each sample a term has two gamma(2, 1) variates r and c and a
uniform beta, drawn by a hash of the term; with t = floor(ln(weight) / r + beta) the term with the least ln c - r * (t - beta + 1) is
taken. Two texts take the same (term, t) with a chance of their generalised Jaccard similarity: the sum of least weights over that of most.
The least value stands for the (term, t) that has it: other ones have another value. A signature keeps 16 bits of a hash of each, so
unlike samples agree by chance once in 65,536.

The variates are read from tables of quantiles. That of ln c goes down in three steps of 4,096 quantiles each, as the least of many terms
lies far down. A table is one subquery, passed on as a column: each use of its own would make the plan too large for the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored

SAMPLES = 32
#: Rows in a bucket of consecutive doc_ids, and in a task, as far as doc_ids are spread evenly between quantiles, CELLS of them at most.
BUCKET_ROWS, TASK_ROWS, FAN = 500, 2000, 32
#: Bits of the number of buckets in a group.
GROUP_BITS = 12
CELLS = FAN * FAN
_TRIMMED = "trim(BOTH '\\t\\n\\u000b\\f\\r ' FROM {0})"
TERMS = f"transform(split({_TRIMMED}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> xxhash64(w))"


def _gamma_quantile(p: np.ndarray) -> np.ndarray:
    """Of gamma(2, 1): 1 - (1 + x) exp(-x) = p, by bisection."""
    low, high = np.full(len(p), 1e-12), np.full(len(p), 60.0)
    for _ in range(80):
        mid = np.sqrt(low * high)
        below = -np.expm1(-mid) - mid * np.exp(-mid)
        below = np.where(mid < 1e-3, mid * mid / 2 - mid**3 / 3, below)
        low, high = np.where(below < p, mid, low), np.where(below < p, high, mid)
    return (low + high) / 2


def _tables(docs: DataFrame) -> dict[str, Column]:
    """The tables as scalar subqueries: constants of the plan that its text doesn't spell out."""
    p = (np.arange(4096) + 0.5) / 4096
    rows = {"_r": _gamma_quantile(p), "_c": np.log(np.concatenate([_gamma_quantile(p / 4096**i) for i in range(3)]))}
    one = docs.sparkSession.createDataFrame([tuple(v.tolist() for v in rows.values())], ", ".join(f"{k} array<double>" for k in rows))
    return {k: one.select(k).scalar() for k in rows}


def _sample(h: Column) -> Column:
    """The value of a term, of a hash of the term and the sample's number."""
    bits = [F.shiftrightunsigned(h, 12 * i).bitwiseAND(F.lit(4095)).cast("int") for i in range(5)]
    r, beta = F.get("_r", bits[0]), bits[1] / F.lit(4096.0)
    c = F.get("_c", F.when(bits[2] > 0, bits[2]).when(bits[3] > 0, bits[3] + 4096).otherwise(bits[4] + 8192))
    return c - r * (F.floor(F.col("log_weight") / r + beta) - beta + 1)


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys and signature, an array of samples strings of four hex digits, for each row of texts; keys name a row.

    Where texts are dealt by some of keys, no row is shuffled. A text without a word has one term, the empty one.
    """
    terms = texts.select(*keys, F.explode(F.expr(TERMS.format(text))).alias("term"))
    weights = terms.groupBy(*keys, "term").agg(F.ln(F.count("*").cast("double")).alias("log_weight"))
    hashes = [F.xxhash64("term", F.lit(k)).alias(f"_h{k}") for k in range(samples)]
    drawn = weights.select(*keys, "log_weight", *[table.alias(k) for k, table in _tables(texts).items()], *hashes)
    least = drawn.groupBy(*keys).agg(*[F.min(_sample(F.col(f"_h{k}"))).alias(f"_{k}") for k in range(samples)])
    short = [F.lpad(F.lower(F.hex(F.xxhash64(f"_{k}", F.lit(k)).bitwiseAND(F.lit(0xFFFF)))), 4, "0") for k in range(samples)]
    return least.select(*keys, F.array(*short).alias("signature"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of samples that are alike: an estimate of the generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))


def _quantiles(values: Column, n: int) -> tuple[Column, int]:
    """Bounds of cells of like numbers of values, CELLS of them at most, and into how many parts a cell is to be cut."""
    cells = max(1, min(CELLS, n // BUCKET_ROWS))
    return F.percentile_approx(values, [i / cells for i in range(cells + 1)], 20 * CELLS), max(1, -(-n // (cells * BUCKET_ROWS)))


def _bucketed(docs: DataFrame) -> DataFrame:
    """bucket, doc_id, text ('' for null): ranges of rows in order, of like numbers of rows. Of rows with a doc_id they are ranges of it,
    from 0; of those without ranges of their texts, by the first seven bytes, from -1 downwards.

    Quantiles divide the values into cells, which a search of two steps finds; where these would hold too many rows they are cut evenly.
    """
    spark = docs.sparkSession
    n, with_id = docs.agg(F.count("*"), F.count("doc_id")).first()
    # seven bytes as a number, in the order of texts
    start = F.conv(F.rpad(F.hex(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    (ids, id_parts), (texts, text_parts) = _quantiles(F.col("doc_id"), with_id), _quantiles(F.when(F.col("doc_id").isNull(), start), n - with_id)
    found = [sorted(set(x or [0])) for x in docs.select(ids, texts).first()]
    one = spark.createDataFrame([(*found, *[x[::FAN] for x in found])], "ids array<long>, texts array<long>, id_heads array<long>, text_heads array<long>")
    table = {k: one.select(k).scalar() for k in one.columns}
    below = lambda values, v: F.size(F.filter(values, lambda b: F.col(v) >= b))
    none = F.col("doc_id").isNull()
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", start).alias("value"))
    placed = placed.select("*", F.when(none, table["texts"]).otherwise(table["ids"]).alias("bounds"), F.when(none, table["text_heads"]).otherwise(table["id_heads"]).alias("heads"))
    placed = placed.withColumn("outer", F.greatest(below(F.col("heads"), "value") - 1, F.lit(0)))
    placed = placed.withColumn("cell", F.greatest(F.col("outer") * FAN + below(F.slice("bounds", F.col("outer") * FAN + 1, FAN), "value") - 1, F.lit(0)))
    if max(id_parts, text_parts) > 1:
        parts = F.when(none, text_parts).otherwise(id_parts)
        low = F.get("bounds", F.col("cell"))
        wide = F.coalesce(F.get("bounds", F.col("cell") + 1) - low, F.lit(1))
        inner = F.floor((F.col("value") - low) / wide * parts)
        placed = placed.withColumn("cell", F.col("cell") * parts + F.least(F.greatest(inner, F.lit(0)), parts - 1))
    cell = F.col("cell").cast("long")
    return placed.select(F.when(none, -1 - cell).otherwise(cell).alias("bucket"), "doc_id", "text")


def _next_buckets(buckets: DataFrame) -> DataFrame:
    """(bucket, then) for each bucket: the bucket whose rows follow its own when descending; the first follows the last. Neighbours are
    found within GROUP buckets first, so that one task sees a row a group only."""
    groups = buckets.select("bucket", F.shiftright("bucket", GROUP_BITS).alias("g"))
    tops = groups.groupBy("g").agg(F.max("bucket").alias("top"))
    down = W.partitionBy().orderBy(F.desc("g"))
    after = tops.select(F.col("g").alias("_g"), F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("top"))
    own = groups.withColumn("then", F.lead("bucket").over(W.partitionBy("g").orderBy(F.desc("bucket"))))
    return own.join(after, F.col("g") == F.col("_g")).select("bucket", F.coalesce("then", "top").alias("then"))


def fingerprinted(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next) for every row of docs.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document's:
    next in descending doc_id, null last and equal doc_ids by text; after the last comes the first. Null texts count as empty, and all texts
    without a word are alike. A text travels once, to the task of its bucket of doc_ids; the terms are counted and sampled there.
    """
    chosen = docs.select(F.col("doc_id").cast("long"), "text")
    dealt = _bucketed(chosen)
    heads = stored(dealt.groupBy("bucket").agg(F.max("doc_id").alias("head"), F.count("*").alias("n")), "heads")
    then = stored(_next_buckets(heads.select("bucket")), "next-buckets")
    named = small(heads.select(F.col("bucket").alias("_bucket"), F.col("head")))
    first = dealt.join(named, (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("bucket").agg(F.min("text").alias("first_text"))
    follow = stored(then.join(first.withColumnRenamed("bucket", "then"), "then").select("bucket", "first_text"), "first-texts")

    n = heads.agg(F.sum("n")).first()[0] or 0
    rows = dealt.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_ROWS), "bucket")
    order = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    placed = rows.withColumn("pos", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    placed = placed.join(follow, "bucket", "left").withColumn("next_text", F.coalesce("next_text", "first_text"))
    cut = F.expr("CAST(floor(length(text) / 3) AS int)")
    edited = F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS int))"), F.substring("next_text", F.lit(1), cut))
    both = placed.select("bucket", "pos", "doc_id", "text", edited.alias("edited"))
    facts = both.select("bucket", "pos", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    versions = both.select("bucket", "pos", F.explode(F.array(F.struct(F.lit(0).alias("version"), "text"), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("x"))
    found = signatures(versions.select("bucket", "pos", "x.version", "x.text"), ["bucket", "pos", "version"], "text", samples)
    pair = found.groupBy("bucket", "pos").agg(F.max(F.when(F.col("version") == 0, F.col("signature"))).alias("signature"), F.max(F.when(F.col("version") == 1, F.col("signature"))).alias("edited_signature"))
    out = stored(facts.join(pair, ["bucket", "pos"]), "signatures")

    first = out.where("pos = 1").select(F.col("bucket").alias("then"), F.col("signature").alias("first_signature"))
    follow = then.join(first, "then").select("bucket", "first_signature")
    order = W.partitionBy("bucket").orderBy("pos")
    near = out.withColumn("next_signature", F.lead("signature").over(order)).join(follow, "bucket", "left")
    near = near.withColumn("next_signature", F.coalesce("next_signature", "first_signature"))
    return near.select("doc_id", "n_chars", "edited_sha256", "signature", "edited_signature", likeness("signature", "edited_signature", samples).alias("near_edited"), likeness("signature", "next_signature", samples).alias("near_next"))
