"""Line dedup: a segment-partition join by edit distance, all in SQL functions.

Within THRESHOLD edits at least one of THRESHOLD + 1 segments of a line stands unchanged in the other, near its place. So each line is
listed by its own segments, and looked up by the substrings that a segment of a line of its length, or of up to THRESHOLD less, can have
become (multi-match-aware positions). Candidates are verified by the edit distance in a band of THRESHOLD.

Lines of up to SHORT code points would have segments that say next to nothing. They, and those up to THRESHOLD longer, meet by patterns: a
pattern of a line lacks some of its letters and has a gap in place of others. Lines that reach the same pattern by deletions d and t and by
its s gaps are within s + d + t edits, and lines within that many edits have such a pattern. So the earliest line of each pattern tells
which lines have an earlier one near them, and no pair of lines is formed.

The same serves keys that more than HOT lines have, such as those of a template: without what all of them begin and end with, which does
not count for their distances, they meet by patterns if MOST_CORE code points or fewer are left.

Lines travel as hashes, and keys that one line alone has go no further. Copies of a line collapse before: lines with more than USUAL
copies come from their first place only. The others meet with their texts; in the join, counts of common letters (an edit changes them by
two at most) are compared before the edit distance, and only lines within it make a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored

THRESHOLD = 2
#: Code points up to which lines meet by patterns.
SHORT = 8
#: Lines of a key above which they are looked at together, and letters in which they may differ then.
HOT, MOST_CORE = 256, 24
USUAL = 32
LETTERS = "etnairso"
_PLACE = "CAST(coalesce(doc_id, 9223372036854775807) AS decimal(38,0)) * 4294967296 + n"


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, line): n counts from 0; null is one empty line."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("n", "line"))


def _spoken(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, with their hash."""
    return lines.where("trim(line) <> ''").withColumn("h", F.xxhash64("line"))


def _segment(length: Column, i: int, threshold: int) -> tuple[Column, Column]:
    """Start, from 1, and size of segment i, from 0, of a line of that length: the last ones are longer by one where it doesn't divide."""
    parts = threshold + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(F.lit(i - parts) + longer, F.lit(0))
    return F.lit(i) * base + extra + 1, base + F.when(F.lit(i) >= F.lit(parts) - longer, 1).otherwise(0)


def _keys(threshold: int, least: int) -> tuple[list[Column], list[Column]]:
    """Of a line (its bytes raw, its length, and whether it is ascii): the hashes under which it is listed, and the others under which it
    looks for lines as long or shorter. In ASCII places are bytes, which need no counting of characters from the start."""
    length = F.col("length")
    keys = {}
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            start, size = _segment(length - less, i, threshold)
            for move in range(max(-i, less - (threshold - i)), min(i, less + threshold - i) + 1):
                own = F.when(F.col("ascii"), F.substring("raw", start + move, size)).otherwise(F.substring("line", start + move, size).cast("binary"))
                key = F.xxhash64((length - less) * (threshold + 1) + i, own)
                keys[less, i, move] = F.when(length - less >= least, key) if less else key
    listed = [keys.pop((0, i, 0)) for i in range(threshold + 1)]
    return listed, list(keys.values())


def _letters() -> Column:
    """Counts of LETTERS, seven bits each."""
    packed = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.length("line") - F.length(F.replace("line", F.lit(letter)))
        packed = packed.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(127)).cast("long"), 7 * i))
    return packed


def _apart(a: str, b: str) -> Column:
    """By how much two counts differ at least: modulo 128 either way round."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        one, other = (F.shiftright(x, 7 * i).bitwiseAND(F.lit(127)).cast("int") for x in (a, b))
        gap = F.abs(one - other)
        total = total + F.least(gap, F.lit(128) - gap)
    return total


def _one_less(patterns: Column) -> Column:
    """The patterns, and each with one of its letters gone or a gap in its place. No line has a line end, so that marks a gap."""
    none = F.array().cast("array<string>")

    def changed(p: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(p))
        head, tail = lambda i: F.substring(p, F.lit(1), i - 1), lambda i: F.substring(p, i + 1, F.length(p))
        gone = F.transform(places, lambda i: F.concat(head(i), tail(i)))
        gaps = F.transform(places, lambda i: F.concat(head(i), F.lit("\n"), tail(i)))
        return F.concat(F.array(p), F.when(F.length(p) > 0, F.concat(gone, gaps)).otherwise(none))

    return F.array_distinct(F.flatten(F.transform(patterns, changed)))


def _near_by_patterns(rows: DataFrame, group: list[str], threshold: int) -> DataFrame:
    """(h, g) of rows (group, h, g, first, text) that have an earlier one within threshold edits in their group. Each row makes some
    length ** threshold patterns; no pair of rows is formed."""
    own = [*group, "h", "g", "first"]
    all_ = F.array("text")
    for _ in range(threshold):
        all_ = _one_less(all_)
    patterns = rows.select(*own, F.length("text").alias("size"), F.explode(all_).alias("pattern"))
    gaps = F.length("pattern") - F.length(F.replace("pattern", F.lit("\n")))
    patterns = patterns.select(*own, F.xxhash64("pattern").alias("p"), F.xxhash64(F.lit(1), "pattern").alias("q"), gaps.alias("gaps"), (F.col("size") - F.length("pattern")).alias("gone"))
    patterns = stored(patterns, "line-patterns")
    on = [*group, "p", "q"]
    earliest = patterns.groupBy(*[F.col(c).alias(f"_{c}") for c in on]).agg(*[F.min(F.when(F.col("gone") == t, F.col("first"))).alias(f"first_{t}") for t in range(threshold + 1)])
    met = patterns.join(earliest, reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in on]))
    earlier = [(F.col("gaps") + F.col("gone") + t <= threshold) & F.coalesce(F.col(f"first_{t}") < F.col("first"), F.lit(False)) for t in range(threshold + 1)]
    return met.where(reduce(Column.__or__, earlier)).select("h", "g").distinct()


def short_near(docs: DataFrame, threshold: int = THRESHOLD, short: int = SHORT) -> DataFrame:
    """(h, g) of lines of up to short + threshold code points that have an earlier one within threshold edits, as far as short ones go."""
    lines = _spoken(lines_of(docs)).where(F.length("line") <= short + threshold)
    lines = lines.groupBy("h", "line").agg(F.min(F.expr(_PLACE)).alias("first"))
    return _near_by_patterns(lines.select("h", F.xxhash64(F.lit(1), "line").alias("g"), "first", F.col("line").alias("text")), [], threshold)


def _shared_start(low: str, high: str) -> Column:
    """Number of code points with which both texts, and so all texts between them, begin."""
    differ = F.array_position(F.zip_with(F.split(low, ""), F.split(high, ""), lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ.cast("int") - 1).otherwise(F.length(low))


def common_cores(met: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, line, id, core, most) of the lines that meet under the keys of hot: core is a line without the start and the end that all lines
    of its key share, which leaves their edit distances as they are, and most the length of the key's longest core."""
    own = met.join(hot.select(F.col("key").alias("_key")), F.col("key") == F.col("_key")).select("key", "id", "line").distinct()
    ends = own.groupBy(F.col("key").alias("_key")).agg(
        F.min("line").alias("low"), F.max("line").alias("high"), F.min(F.reverse("line")).alias("low_end"), F.max(F.reverse("line")).alias("high_end"), F.min(F.length("line")).alias("least"), F.max(F.length("line")).alias("longest")
    )
    ends = ends.select("_key", "least", "longest", _shared_start("low", "high").alias("start"), _shared_start("low_end", "high_end").alias("tail"))
    ends = ends.select("_key", "longest", "start", F.least(F.col("tail"), F.col("least") - F.col("start")).alias("tail"))
    core = F.substring(F.col("line"), F.col("start") + 1, F.length("line") - F.col("start") - F.col("tail"))
    return own.join(ends, F.col("key") == F.col("_key")).select("key", "id", "line", core.alias("core"), (F.col("longest") - F.col("start") - F.col("tail")).alias("most"))


def shared_keys(docs: DataFrame, firsts: DataFrame, threshold: int, least: int) -> DataFrame:
    """(key, id, sought) of all lines with a key that another line has too: id is a hash of the line, sought whether it only looks for it."""
    lines = _spoken(lines_of(docs)).where(F.length("line") >= least).withColumn("place", F.expr(_PLACE))
    hot = small(firsts.where(f"copies > {USUAL}").select(F.col("h").alias("_h"), F.col("first").alias("_first")))
    lines = lines.join(hot, F.col("h") == F.col("_h"), "left").where("_first is null or place = _first")
    listed, sought = _keys(threshold, least)
    measured = lines.select("h", "line", F.col("line").cast("binary").alias("raw"), F.length("line").alias("length"), (F.length("line") == F.octet_length("line")).alias("ascii"))
    rows = measured.select("h", F.posexplode(F.array(*listed, *sought)).alias("at", "key")).where("key is not null")
    # the last bit of h gives way to the kind of key, so that a row is two numbers
    rows = rows.select("key", F.shiftleft(F.shiftrightunsigned("h", 1), 1).bitwiseOR((F.col("at") >= len(listed)).cast("long")).alias("h"))
    group = W.partitionBy("key")
    several = rows.select("key", "h", F.min("h").over(group).alias("low"), F.max("h").over(group).alias("high"), F.min(F.expr("h & 1")).over(group).alias("listed"))
    several = several.where("shiftrightunsigned(low, 1) <> shiftrightunsigned(high, 1) and listed = 0")
    return several.select("key", F.shiftrightunsigned("h", 1).alias("id"), F.expr("h & 1 = 1").alias("sought")).distinct()


def near_lines(docs: DataFrame, firsts: DataFrame, threshold: int, least: int) -> DataFrame:
    """(h, g) of lines of least code points or more that have an earlier one within threshold edits."""
    keys = stored(shared_keys(docs, firsts, threshold, least), "line-keys")
    wanted = small(keys.select(F.col("id").alias("_id")).distinct())
    lines = _spoken(lines_of(docs)).where(F.length("line") >= least).withColumn("id", F.shiftrightunsigned("h", 1))
    texts = lines.join(wanted, F.col("id") == F.col("_id"), "left_semi").groupBy("id", "line").agg(F.lit(1).alias("_one"))
    met = stored(keys.join(texts.select("id", "line", _letters().alias("letters")), "id"), "line-texts")
    found = []
    hot = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {HOT}"), "hot-keys")
    if hot.limit(1).count():
        cores = stored(common_cores(met, small(hot)).where(f"most <= {MOST_CORE}"), "line-cores")
        told = cores.select("key", F.col("core").alias("text"), F.xxhash64("line").alias("_h"), F.xxhash64(F.lit(1), "line").alias("_g"))
        told = told.join(firsts, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")))
        found.append(_near_by_patterns(told.select("key", "h", "g", "first", "text"), ["key"], threshold))
        done = small(cores.select(F.col("key").alias("_key")).distinct())
        met = met.join(done, F.col("key") == F.col("_key"), "left_anti")
    a = met.where("not sought").select("key", F.col("line").alias("line_a"), F.col("letters").alias("letters_a"))
    b = met.select(F.col("key").alias("key_b"), "sought", F.col("line").alias("line_b"), F.col("letters").alias("letters_b"))
    # two lines that are both listed meet once
    once = F.col("sought") & (F.col("line_a") != F.col("line_b")) | (F.col("line_a") < F.col("line_b"))
    alike = (F.col("key") == F.col("key_b")) & once & (_apart("letters_a", "letters_b") <= 2 * threshold)
    pairs = a.join(b, alike & (F.levenshtein("line_a", "line_b", threshold) >= 0))
    hashes = [F.xxhash64(f"line_{k}").alias(f"h_{k}") for k in "ab"] + [F.xxhash64(F.lit(1), f"line_{k}").alias(f"g_{k}") for k in "ab"]
    pairs = stored(pairs.select(*hashes).distinct(), "near-lines")
    for k in "ab":
        pairs = pairs.join(firsts.select(F.col("h").alias(f"h_{k}"), F.col("g").alias(f"g_{k}"), F.col("first").alias(f"first_{k}")), [f"h_{k}", f"g_{k}"])
    later = F.when(F.col("first_a") > F.col("first_b"), F.struct(F.col("h_a").alias("h"), F.col("g_a").alias("g"))).otherwise(F.struct(F.col("h_b").alias("h"), F.col("g_b").alias("g")))
    return reduce(DataFrame.unionByName, found, pairs.select(later.alias("x")).select("x.h", "x.g"))


def judged_lines(docs: DataFrame, threshold: int = THRESHOLD, short: int = SHORT) -> DataFrame:
    """(doc_id, text_hash, n, removed, near) for every line of docs. A line goes if its text, or one within threshold edits (near), has its
    first place earlier: by doc_id, null last, then by number. Blank lines stay. short is threshold or more, as each segment has a letter."""
    narrow = _spoken_or_not(lines_of(docs))
    narrow = stored(narrow, "lines")
    firsts = narrow.where("h is not null").groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    firsts = stored(firsts, "first-lines")
    near = near_lines(docs, firsts, threshold, short + 1).unionByName(short_near(docs, threshold, short))
    near = near.distinct().withColumn("near", F.lit(True))
    marked = firsts.join(near, ["h", "g"], "left").select(F.col("h").alias("_h"), F.col("g").alias("_g"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    found = narrow.join(marked, (narrow["h"] == marked["_h"]) & (narrow["g"] == marked["_g"]), "left")
    return found.select("doc_id", "text_hash", "n", F.expr("h is not null and (near or place <> first)").alias("removed"), F.expr("h is not null and near").alias("near"))


def _spoken_or_not(lines: DataFrame) -> DataFrame:
    told = F.expr("trim(line) <> ''")
    return lines.select("doc_id", "text_hash", "n", F.when(told, F.xxhash64("line")).alias("h"), F.when(told, F.xxhash64(F.lit(1), "line")).alias("g"), F.expr(_PLACE).alias("place"))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, short: int = SHORT) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_removed, n_near, removed) for every row of docs: removed has the numbers of the lines that go, in order.

    Null and empty texts are one blank line. Rows alike in doc_id and text can't be told apart: each gets the result of one of them.
    """
    by_line = judged_lines(docs, threshold, short).groupBy("doc_id", "text_hash", "n").agg(F.max("removed").alias("removed"), F.max("near").alias("near"), F.count("*").alias("copies"))
    numbers = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("n"))))
    by_doc = by_line.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.count_if("near").alias("n_near"), numbers.alias("removed"), F.max("copies").alias("copies")
    )
    return by_doc.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("copies", "_copy")


def without_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs with the lines that go cut out of text; a null text stays null."""
    found = deduplicated(docs, threshold).where("n_removed > 0").select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_hash"), "removed").dropDuplicates(["_doc_id", "_hash"])
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_doc_id"]) & (F.xxhash64(text) == found["_hash"]), "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(found["removed"], i)), "\n")
    kept = F.when(found["removed"].isNull(), docs["text"]).otherwise(left)
    return joined.select(*[kept.alias(c) if c == "text" else docs[c] for c in docs.columns])
