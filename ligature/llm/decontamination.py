"""Benchmark decontamination: an FM-index for each shard of the training documents, searched for the windows of the test items.

Words are symbols. A word that no item has can be in no window, so a shard's text holds only those runs of item words that are long
enough for some window of theirs. The test items are the patterns; they are sent to the tasks in blocks of bounded size, and each block
passes over all documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import as_bytes, drop_stored, stored
from .fmindex import END, FMIndex

WINDOW = 13
#: Item words sent to the tasks at once.
BLOCK_WORDS = 1_000_000
#: Symbols, or documents, of a shard that close it.
SHARD_SYMBOLS, SHARD_DOCS = 1_000_000, 20_000

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
RESULT = "n_words long, starts array<long>, ends array<long>, items array<string>"
_FIELDS = [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased; ASCII other than letters and digits divides words."""
    return text.translate(_WORD).split()


class Windows:
    """The windows of a block of items as rows of symbols, each with its items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, own in items:
            for i in range(max(1, len(own) - width + 1) if own else 0):
                found[tuple(own[i : i + width])] |= {item} - {None}
        self.symbols = {w: i for i, w in enumerate(sorted({w for x in found for w in x}), END + 1)}
        self.sigma = len(self.symbols) + 1
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.rows = np.zeros((len(found), width), np.int32)
        self.least = np.full(self.sigma, width + 1, np.int64)
        for i, x in enumerate(found):
            self.rows[i, width - len(x) :] = own = [self.symbols[w] for w in x]
            self.least[own] = np.minimum(self.least[own], len(x))
        self.items = [sorted(x) for x in found.values()]

    def long_runs(self, text: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words; starts and ends of the runs that can hold a window."""
        symbols = np.fromiter(map(self.symbols.get, text, repeat(END)), np.int32, len(text))
        step = np.diff(np.concatenate(([False], symbols != END, [False])).astype(np.int8))
        starts, ends = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
        if len(starts):
            fit = np.minimum.reduceat(np.append(self.least[symbols], 0), np.stack((starts, ends), 1).ravel())[::2] <= ends - starts
            starts, ends = starts[fit], ends[fit]
        return symbols, starts, ends


class Shard:
    def __init__(self, windows: Windows):
        self.windows, self.rows = windows, []
        self.parts: list[np.ndarray] = []
        self.runs: list[tuple[int, int, int]] = []  # place in the text, document, word
        self.size = 0

    def add(self, row: tuple, text: bytes) -> None:
        found = words(text)
        symbols, starts, ends = self.windows.long_runs(found)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            self.runs.append((self.size, len(self.rows), a))
            self.parts += [symbols[a:b], np.array([END], np.int32)]
            self.size += b - a + 1
        self.rows.append((*row, len(found)))

    def full(self) -> bool:
        return self.size >= SHARD_SYMBOLS or len(self.rows) >= SHARD_DOCS

    def close(self) -> list[tuple]:
        """Each row with its words, merged spans of hit words, and items."""
        spans: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        items: dict[int, set[str]] = defaultdict(set)
        if self.size:
            w = self.windows
            index = FMIndex(np.concatenate(self.parts), w.sigma)
            low, high = index.search(w.rows, w.lengths)
            times = np.maximum(high - low, 0)
            pattern = np.repeat(np.arange(len(times)), times)
            places = index.locate(np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times))
            runs = np.array(self.runs, np.int64)
            step = np.zeros(self.size + 1, np.int64)
            np.add.at(step, places, 1)
            np.add.at(step, places + w.lengths[pattern], -1)
            edge = np.diff(np.concatenate(([0], np.cumsum(step[:-1]) > 0, [0])).astype(np.int8))
            starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
            run = np.searchsorted(runs[:, 0], starts, side="right") - 1
            for a, b, (at, doc, word) in zip(starts.tolist(), ends.tolist(), runs[run].tolist(), strict=True):
                spans[doc][0].append(word + a - at)
                spans[doc][1].append(word + b - at)
            doc = runs[np.searchsorted(runs[:, 0], places, side="right") - 1, 1]
            for d, p in np.unique(np.stack((doc, pattern), 1), axis=0).tolist():
                items[d].update(w.items[p])
        return [(*row, *spans.get(i, ([], [])), sorted(items.get(i, ()))) for i, row in enumerate(self.rows)]


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Windows]:
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        own = words(bytes(text or b""))
        block.append((item, own))
        size += len(own)
        if size >= BLOCK_WORDS:
            yield Windows(block, width)
            block, size = [], 0
    if block:
        yield Windows(block, width)


def _merged(a: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _search(sent, schema: pa.Schema):
    """For mapInArrow: row, text, and the results of earlier blocks if any."""
    texts = "text" in schema.names

    def rows(shard: Shard, earlier: list) -> pa.RecordBatch:
        found = shard.close()
        if not texts:
            found = [(x[0], *x[2:]) for x in found]
        for i, old in enumerate(earlier):
            if old:
                *own, n, starts, ends, items = found[i]
                spans = _merged([*zip(starts, ends, strict=True), *zip(*old[:2], strict=True)])
                found[i] = (*own, n, [a for a, _ in spans], [b for _, b in spans], sorted({*items, *old[2]}))
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sent.value
        shard, earlier = Shard(windows), []
        for batch in batches:
            own = [batch.column("row").to_pylist(), batch.column("text").to_pylist() if texts else [None] * len(batch)]
            old = list(zip(*[batch.column(k).to_pylist() for k in ("starts", "ends", "items")], strict=True)) if "starts" in batch.schema.names else [None] * len(batch)
            for row, text, o in zip(zip(*own, strict=True), as_bytes(batch.column("text")), old, strict=True):
                shard.add(row, text)
                earlier.append(o)
                if shard.full():
                    yield rows(shard, earlier)
                    shard, earlier = Shard(windows), []
        if shard.rows:
            yield rows(shard, earlier)

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """(row, n_words, starts, ends, items) for every row of docs: row is a struct of the columns keep (doc_id unless given); starts and ends
    (excluded) are the spans of words that stand in some occurrence of a window, items the sorted ids of the items with such windows.

    A window is width consecutive words of an item, or all words of an item that has fewer, but not none. Null and empty texts have no
    words; an item without an id hits words but adds no id; repeated rows each get a row; without items or rows nothing is hit.
    """
    spark = docs.sparkSession
    plan = docs.select(F.struct(*[docs[c] for c in keep or ["doc_id"]]).alias("row"), "text")
    row, kind = to_arrow_schema(plan.schema).field("row"), plan.schema["row"].dataType.simpleString()
    blocks = _blocks(benchmark, width)
    windows, last, hits = next(blocks, Windows([], width)), False, None
    while not last:
        after = next(blocks, None)
        last = after is None
        schema = pa.schema([row, *[("text", pa.string())] * (not last), *_FIELDS])
        sent = spark.sparkContext.broadcast(windows)
        plan = plan.mapInArrow(_search(sent, schema), f"row {kind}, {'' if last else 'text string, '}{RESULT}")
        if not last:
            # one block is in memory at a time, beside the next: what it found is written before that is sent
            plan = stored(plan, "hits")
            sent.unpersist()
            if hits is not None:
                drop_stored(hits)
            hits = plan
        windows = after
    return plan


def judged(hits: DataFrame) -> DataFrame:
    """benchmark_hits with n_hit, and contaminated: hit words are at least a twentieth of all."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs without the contaminated rows; all others stay as they are."""
    return judged(benchmark_hits(docs, benchmark, width, docs.columns)).where("not contaminated").select("row.*")
