"""String similarities of pairs. Token sorting and sets are SQL functions; the kernels run once a pair over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import tokens


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / both lengths; 100 for two empty strings."""
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    head = 0
    most = min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    shared = head + tail + (common_subsequence(x, y) if x and y else 0)
    return 200.0 * shared / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer of its length, or a shorter one at either end.

    A step of the window changes what is common by one at most, so windows that can't beat the best are passed over.
    """
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    n, most, at = len(short), 0, 0
    while at <= len(long) - n:
        common = common_subsequence(short, long[at : at + n])
        at += max(1, most - common)
        most = max(most, common)
    best = 100.0 * most / n
    for end in (False, True):
        size = n - 1
        while size > 0 and 200.0 * size / (n + size) > best:
            common = common_subsequence(short, long[-size:] if end else long[:size])
            best = max(best, 200.0 * common / (n + size))
            # a smaller window has no more in common: the next that could do better
            size = min(size - 1, int(200.0 * common / best - n) if best else 0)
    return best


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """From 0 to 1, with a bonus for up to four letters of common prefix; 1 for equal strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    ours = []
    for i, c in enumerate(a):
        start = max(0, i - reach)
        while (at := b.find(c, start, i + reach + 1)) >= 0 and taken[at]:
            start = at + 1
        if at >= 0:
            taken[at] = True
            ours.append(c)
    if not ours:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(ours, theirs, strict=True)) // 2
    m = len(ours)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * prefix_weight * (1 - jaro) if jaro > 0.7 else jaro


def _scored(score, a: pa.Array, b: pa.Array) -> pa.Array:
    """Pairs that repeat in a batch are scored once."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a.to_pylist(), b.to_pylist(), strict=True):
        if pair not in known:
            known[pair] = score(pair[0] or "", pair[1] or "")
        out.append(known[pair])
    return pa.array(out, pa.float64())


def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    return _scored(indel_ratio, a, b)


def _partials(a: pa.Array, b: pa.Array) -> pa.Array:
    return _scored(partial_ratio, a, b)


def _winklers(a: pa.Array, b: pa.Array) -> pa.Array:
    return _scored(jaro_winkler, a, b)


def ratio(a: Column, b: Column) -> Column:
    return F.arrow_udf(_ratios, DoubleType())(a, b)


def partial(a: Column, b: Column) -> Column:
    return F.arrow_udf(_partials, DoubleType())(a, b)


def winkler(a: Column, b: Column) -> Column:
    return F.arrow_udf(_winklers, DoubleType())(a, b)


def _sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(tokens(text)), " ")


def token_sort(a: Column, b: Column) -> Column:
    return ratio(_sorted(a), _sorted(b))


def token_set(a: Column, b: Column) -> Column:
    """100 if all words of one are among the other's; else the best ratio among common words, and these with either's others; 0 without words."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both, left, right = (F.array_join(F.array_sort(s), " ") for s in (F.array_intersect(x, y), F.array_except(x, y), F.array_except(y, x)))
    with_left, with_right = F.trim(F.concat(both, F.lit(" "), left)), F.trim(F.concat(both, F.lit(" "), right))
    # common words against either whole need no kernel: all of the shorter is common
    shared = F.length(both)
    alone = lambda whole: F.when(shared > 0, 200.0 * shared / (shared + F.length(whole))).otherwise(0.0)
    best = F.greatest(ratio(with_left, with_right), alone(with_left), alone(with_right))
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(empty, 0.0).when((shared > 0) & ((left == "") | (right == "")), 100.0).otherwise(best)


def word_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct words of each text as ascending numbers, one text after the other; how many each has; and a bound of the numbers."""
    lists = pc.split_pattern(texts.fill_null(""), " ")
    words = lists.flatten().dictionary_encode()
    bound = max(1, len(words.dictionary))
    met = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()) * bound + words.indices.to_numpy()
    empty = pc.index(words.dictionary, "").as_py()
    met = met[words.indices.to_numpy() != empty]
    met.sort()
    met = met[np.concatenate((np.ones(min(1, len(met)), bool), met[1:] != met[:-1]))]
    return met % bound, np.bincount(met // bound, minlength=len(lists)), bound


def _jaccards(a: pa.Array, b: pa.Array) -> pa.Array:
    """Texts that repeat in a batch are cut into words once."""
    texts = pa.chunked_array([a, b]).combine_chunks().dictionary_encode(null_encoding="encode")
    words, counts, bound = word_sets(texts.dictionary)
    starts = np.cumsum(counts) - counts
    at = texts.indices.to_numpy()
    sides = []
    for own in (at[: len(a)], at[len(a) :]):
        n = counts[own]
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(own)), n)
        sides.append((n, row * bound + words[np.repeat(starts[own] - (ends - n), n) + np.arange(len(row))]))
    (x, left), (y, right) = sides
    met = np.concatenate((left, right))
    met.sort(kind="stable")  # of two ascending runs
    both = np.bincount(met[1:][met[1:] == met[:-1]] // bound, minlength=len(a))
    return pa.array(both / np.maximum(x + y - both, 1), pa.float64(), mask=(x == 0) | (y == 0))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of words; null if either has none."""
    return F.arrow_udf(_jaccards, DoubleType())(a, b)
