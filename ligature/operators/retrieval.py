"""Candidates by rare keys: an inverted index with a cap on how often a key stands, weighted by rarity, the best k of each entity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.staging import BROADCAST_ROWS, if_small, staged

TOP_K, DF_CAP = 30, 1000
#: Entities that a task sums the pairs of, and rows of a batch that it returns.
BLOCK, OUT_ROWS = 65_536, 200_000
#: Keys of a row on its way to a block; meetings that are summed at a time, unless one entity has more.
DEALT_ROWS, AT_ONCE = 20_000, 20_000
#: Bytes of records that are indexed at a time; records, of both sides, whose keys meet in a task.
INDEX_BYTES, INDEX_RECORDS = 8_000_000, 40_000
#: A bucket of a country's keys of a field: hashes of the keys, 16 bits more of each, in how many records each is, and these.
INDEX = "country string, field string, key int, of_corpus boolean, keys binary, checks binary, counts binary, lists binary"
#: Keys of a block: their weights, how many entities ask for each, which; how many records have each, which.
MET = "block int, named boolean, idf binary, asks binary, s1s binary, holds binary, cs binary"
_INDEX_NAMES, _MET_NAMES = ([x.split()[0] for x in columns.split(", ")] for columns in (INDEX, MET))
_INDEX_TYPES = [pa.string(), pa.string(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]
_MET_TYPES = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def record_keys(records: DataFrame) -> DataFrame:
    """(country, field, key, entity_id), each once: the keys of names (n) and addresses (a)."""
    both = F.concat(
        F.transform(F.array_distinct(text.name_keys(F.col("name_core"))), lambda k: F.struct(F.lit("n").alias("field"), k.alias("key"))),
        F.transform(F.array_distinct(text.address_keys(F.col("addr_norm"))), lambda k: F.struct(F.lit("a").alias("field"), k.alias("key"))),
    )
    return records.select("country", "entity_id", F.explode(both).alias("x")).select("country", "x.field", "x.key", "entity_id")


def key_weights(corpus: DataFrame, df_cap: int = DF_CAP) -> DataFrame:
    """(country, field, key, df, idf) of the corpus keys in up to df_cap records of a country; idf = ln(1 + records of the country / df)."""
    sizes = corpus.groupBy(F.col("country").alias("_country")).agg(F.count("*").alias("n"))
    df = record_keys(corpus).groupBy("country", "field", "key").agg(F.count("*").alias("df")).where(F.col("df") <= df_cap)
    return df.join(sizes, F.col("country") == F.col("_country")).select("country", "field", "key", "df", F.log1p(F.col("n") / F.col("df")).alias("idf"))


def _numbered(records: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(entity_id, n), n counting ids from 0 in their order, and how many there are. It is written, so that a lost task can't number them anew."""
    ids = records.select("entity_id").distinct().orderBy("entity_id")
    own = staged(ids.select("entity_id", F.monotonically_increasing_id().alias("n")), name)
    counts = own.groupBy(F.shiftright("n", 33).alias("part")).agg(F.count("*").alias("rows")).orderBy("part").collect()
    before = [(r["part"], sum(x["rows"] for x in counts[:i])) for i, r in enumerate(counts)]
    total = sum(r["rows"] for r in counts)
    offsets = F.broadcast(own.sparkSession.createDataFrame(before, "part long, before long"))
    dense = own.join(offsets, F.shiftright("n", 33) == F.col("part"))
    number = F.col("before") + F.col("n").bitwiseAND((1 << 33) - 1)
    return dense.select("entity_id", number.cast("int" if total < 2**31 else "long").alias("n")), total


def _written(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes, seven bits a byte, the last byte of each below 128; and where each ends."""
    size = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[(ends - size)[has] + k] = (values[has] >> 7 * k) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def _read(data: np.ndarray) -> np.ndarray:
    """The numbers of _written."""
    ends = np.flatnonzero(data < 128)
    begin = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - begin).max(initial=-1)) + 1):
        has = ends - begin >= k
        out[has] += (data[begin[has] + k] & 127).astype(np.int64) << 7 * k
    return out


def _gaps(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of ascending lists, the first number of each and then the steps."""
    gaps = np.diff(values, prepend=values[:1])
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    gaps[starts] = values[starts]
    return gaps


def _summed(gaps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of lists of _gaps."""
    total, lengths = np.cumsum(gaps), lengths[lengths > 0]
    starts = np.cumsum(lengths) - lengths
    return total - np.repeat((total - gaps)[starts], lengths)


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Ascending lists of numbers, none empty, each as the bytes of its gaps."""
    out, ends = _written(_gaps(values, lengths))
    offsets = np.concatenate(([0], ends[np.cumsum(lengths) - 1])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(packed: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and the length of each."""
    at = np.frombuffer(packed.buffers()[1], np.int64 if pa.types.is_large_binary(packed.type) else np.int32)[packed.offset : packed.offset + len(packed) + 1]
    data = np.frombuffer(packed.buffers()[2], np.uint8)[at[0] : at[-1]]
    n = np.diff(np.concatenate(([0], np.cumsum(data < 128)))[at - at[0]])
    return _summed(_read(data), n).astype(kind), n


def _bytes(values: np.ndarray) -> bytes:
    return _written(values)[0].tobytes()


def _list_bytes(values: np.ndarray, lengths: np.ndarray) -> bytes:
    return _bytes(_gaps(values, lengths))


def _column(batch: pa.RecordBatch, i: int, kind: type) -> list[np.ndarray]:
    """Of each row the bytes of column i, as numbers."""
    return [np.frombuffer(x.as_buffer(), kind) for x in batch.column(i)]


def _block_of(asking: np.ndarray, blocks: int) -> np.ndarray:
    return ((asking.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % blocks


def _words(text: pa.Array, single: Callable[[str], bool]) -> tuple[pa.Array, np.ndarray]:
    """Words of texts by spaces, of two letters at least or such that single holds; and the row of each."""
    lists = pc.split_pattern(text.fill_null(""), " ")
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    words = lists.flatten().dictionary_encode()
    serves = np.array([len(w) > 1 or single(w) for w in words.dictionary.to_pylist()], bool)
    kept = serves[words.indices.to_numpy()] if len(words) else np.zeros(0, bool)
    return words.filter(pa.array(kept)), row[kept]


def _hashed_keys(text: pa.Array, single: Callable[[str], bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts the keys of their words and of pairs of neighbours, each once a row: 64 bits of hash, 16 more, and the row."""
    words, row = _words(text, single)
    digests = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words.dictionary.to_pylist()), np.uint64).reshape(-1, 2)
    at = words.indices.to_numpy()
    first, second = digests[at, 0], digests[at, 1]
    follows = row[1:] == row[:-1]
    # of random bits of two words, so that sums differ unless both words agree; one word has a constant for the next
    pairs = first[:-1][follows] * _ODD + first[1:][follows], second[:-1][follows] * _ODD + second[1:][follows]
    key = np.concatenate((first * _ODD + np.uint64(1), pairs[0]))
    check = (np.concatenate((second * _ODD + np.uint64(1), pairs[1])) >> np.uint64(48)).astype(np.uint16)
    return key, check, np.concatenate((row, row[1:][follows]))


def _runs(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key and its check, and in it whether a row's key is another than that of the row before."""
    by = np.argsort(key, kind="stable")
    same, alike = key[by][1:] == key[by][:-1], check[by][1:] == check[by][:-1]
    if (same & ~alike).any():  # keys that agree in 64 bits alone
        by = np.lexsort((check, key))
        same, alike = key[by][1:] == key[by][:-1], check[by][1:] == check[by][:-1]
    return by, np.concatenate((np.ones(min(1, len(by)), bool), ~(same & alike)))


def _indexed(of_corpus: bool, buckets: int, df_cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (country, name_core, addr_norm, n) rows of INDEX: for a bucket of a country's keys of a field, all that this task has of it. Keys
    lie once each, in order, with the numbers of their records; of a key in more corpus records than the cap only how many."""

    def rows(records: pa.Table) -> Iterator[pa.RecordBatch]:
        records = records.take(np.argsort(records.column(3).to_numpy(), kind="stable"))
        country = records.column(0).combine_chunks().dictionary_encode()
        place, number = country.indices.to_numpy(), records.column(3).to_numpy().astype(np.int64)
        for field, column, single in (("n", 1, lambda w: False), ("a", 2, str.isdecimal)):
            key, check, row = _hashed_keys(records.column(column).combine_chunks(), single)
            of = place[row]
            by_country = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[by_country], np.arange(len(country.dictionary) + 1)).tolist()
            for name, own in zip(country.dictionary.to_pylist(), (by_country[x:y] for x, y in pairwise(bounds)), strict=True):
                k, c, r = key[own], check[own], row[own]
                by, new = _runs(k, c)  # the rows of a key ascend as they are
                k, c, r = k[by], c[by], r[by]
                once = new | np.concatenate((np.ones(min(1, len(r)), bool), r[1:] != r[:-1]))
                k, c, r, new = k[once], c[once], r[once], new[once]
                starts = np.flatnonzero(new)
                counts = np.diff(np.append(starts, len(k)))
                k, c = k[starts], c[starts]
                listed = counts <= df_cap if of_corpus else np.ones(len(counts), bool)
                values, lengths = number[r[np.repeat(listed, counts)]], counts * listed
                ends = np.cumsum(lengths)
                # sorted as they are, the keys of a bucket lie together
                cuts = np.searchsorted(_bucket(k, buckets), np.arange(buckets + 1))
                for b, (x, y) in enumerate(pairwise(cuts.tolist())):
                    if x < y:
                        own = _list_bytes(values[ends[x] - lengths[x] : ends[y - 1]], lengths[x:y])
                        cells = [name, field, b, of_corpus, k[x:y].tobytes(), c[x:y].tobytes(), _bytes(counts[x:y]), own]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, _INDEX_TYPES, strict=True)], _INDEX_NAMES)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters = [], 0
        for batch in batches:
            held.append(batch)
            letters += batch.nbytes
            if letters >= INDEX_BYTES:
                yield from rows(pa.Table.from_batches(held))
                held, letters = [], 0
        if held:
            yield from rows(pa.Table.from_batches(held))

    return indexed


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that agree in the first n columns and lie together."""
    now, held = None, []
    for batch in batches:
        for i, own in enumerate(zip(*[batch.column(j).to_pylist() for j in range(n)], strict=True)):
            if own != now and held:
                yield held
                held = []
            now = own
            held.append(batch.slice(i, 1))
    if held:
        yield held


def _dealt(blocks: int, df_cap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of INDEX and the country's number of records, a bucket's lying together, a row of MET for each block of entities: the keys
    that its entities ask for and that have records, df_cap at most."""

    def rows(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_corpus = [p.column(3)[0].as_py() for p in parts]
        key, check = (np.concatenate([_column(p, i, kind)[0] for p in parts]) for i, kind in ((4, np.uint64), (5, np.uint16)))
        counts = [_read(_column(p, 6, np.uint8)[0]) for p in parts]
        lengths = [n * (n <= df_cap) if held else n for n, held in zip(counts, of_corpus, strict=True)]
        values = np.concatenate([_summed(_read(_column(p, 7, np.uint8)[0]), n) for p, n in zip(parts, lengths, strict=True)])
        side = np.repeat(of_corpus, [len(n) for n in counts])
        counts, lengths = np.concatenate(counts), np.concatenate(lengths)
        by, new = _runs(key, check)
        of = np.empty(len(key), np.int64)
        of[by] = np.cumsum(new) - 1
        df = np.bincount(of, counts * side)
        serves = (df > 0) & (df <= df_cap) & (np.bincount(of, counts * ~side) > 0)
        of_value, held = np.repeat(of, lengths), np.repeat(side, lengths)
        good = serves[of_value]
        values, of_value, held = values[good], of_value[good], held[good]
        cs, c_of = values[held], of_value[held]
        by = np.lexsort((cs, c_of))
        cs, n_held = cs[by], np.bincount(c_of, minlength=len(df))
        starts = np.cumsum(n_held) - n_held
        asking, asks = values[~held], of_value[~held]
        block = _block_of(asking, blocks)
        by = np.lexsort((asking, asks, block))
        asking, asks, block = asking[by], asks[by], block[by]
        idf = np.log1p(parts[0].column(8)[0].as_py() / np.maximum(df, 1))
        named = parts[0].column(1)[0].as_py() == "n"
        for x, y in pairwise(np.searchsorted(block, np.arange(blocks + 1)).tolist()):
            first = x + np.flatnonzero(np.diff(asks[x:y], prepend=-1))
            for i in range(0, len(first), DEALT_ROWS):
                at = np.append(first[i : i + DEALT_ROWS], first[i + DEALT_ROWS] if i + DEALT_ROWS < len(first) else y)
                keys, n_asked = asks[at[:-1]], np.diff(at)
                n = n_held[keys]
                own = cs[np.repeat(starts[keys] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                cells = [int(block[x]), named, idf[keys].tobytes(), _bytes(n_asked), _list_bytes(asking[at[0] : at[-1]], n_asked), _bytes(n), _list_bytes(own, n)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, _MET_TYPES, strict=True)], _MET_NAMES)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _grouped(batches, 3):
            yield from rows(parts)

    return dealt


def _dealt_names(blocks: int, of_corpus: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (entity_id, n) rows beside those of _dealt, with no `named`: those of the corpus for every block, those of an entity for its own.
    idf tells the side, s1s the numbers in gaps, cs the ids: the length of each, then all letters."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy().astype(np.int64)
            block = np.zeros(len(n), np.int64) if of_corpus else _block_of(n, blocks)
            by = np.lexsort((n, block))
            cuts = [0, *(np.flatnonzero(np.diff(block[by])) + 1).tolist(), len(by)] if len(by) else [0]
            for a, b in pairwise(cuts):
                ids = batch.column(0).take(pa.array(by[a:b])).cast(pa.large_string())
                ends = np.frombuffer(ids.buffers()[1], np.int64)[: b - a + 1]
                letters = np.diff(ends).astype(np.int32).tobytes() + (ids.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[: ends[-1]]
                numbers = _list_bytes(n[by[a:b]], np.array([b - a]))
                for to in range(blocks) if of_corpus else block[by[a : a + 1]].tolist():
                    cells = [to, None, np.array([float(of_corpus)]).tobytes(), b"", numbers, b"", letters]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(cells, _MET_TYPES, strict=True)], _MET_NAMES)

    return rows


class _Names:
    """The ids of numbers, of rows of _dealt_names."""

    def __init__(self, parts: list[pa.RecordBatch]):
        found = [np.cumsum(_read(x)) for p in parts for x in _column(p, 4, np.uint8)]
        numbers = np.concatenate(found)
        ids = [self._ids(held, len(n)) for held, n in zip((x for p in parts for x in p.column(6)), found, strict=True)]
        by = np.argsort(numbers)
        self.numbers, self.ids = numbers[by], pa.concat_arrays(ids).take(pa.array(by))

    @staticmethod
    def _ids(held: pa.Scalar, n: int) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(np.frombuffer(held.as_buffer(), np.int32, n), dtype=np.int64)))
        return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), held.as_buffer().slice(4 * n)])

    def of(self, numbers: pa.Array) -> pa.Array:
        return self.ids.take(pa.array(np.searchsorted(self.numbers, numbers.to_numpy()))).cast(pa.string())


class _Block:
    """Sums the weights of all pairs of a block's entities, some entities at a time: meetings are sorted as numbers, of the entity, the record
    and the key. The sums' order doesn't depend on that of the rows."""

    def __init__(self, corpus: int, k: int | None, kinds: tuple[type, type]):
        self.bits, self.k, self.kinds = max(1, int(corpus).bit_length()), k, kinds

    def _ranked(self, score: np.ndarray) -> np.ndarray:
        """The k best, the first of equals; found lie in the order of their numbers."""
        rounded = np.floor(score * 1e6 + 0.5)
        at = np.arange(len(score))
        if len(score) > self.k:
            at = np.flatnonzero(rounded >= np.partition(rounded, len(score) - self.k)[len(score) - self.k])
        return at[np.argsort(-rounded[at], kind="stable")][: self.k]

    def pairs(self, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idfs = [x for p in parts for x in _column(p, 2, np.float64)]
        named = np.repeat(np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts]), [len(x) for x in idfs])
        idf = np.concatenate(idfs)
        n_asked, n_held = ([_read(x) for p in parts for x in _column(p, i, np.uint8)] for i in (3, 5))
        asked = np.concatenate([_summed(_read(x), n).astype(self.kinds[0]) for x, n in zip((x for p in parts for x in _column(p, 4, np.uint8)), n_asked, strict=True)])
        held = np.concatenate([_summed(_read(x), n).astype(self.kinds[1]) for x, n in zip((x for p in parts for x in _column(p, 6, np.uint8)), n_held, strict=True)])
        n_asked, n_held = np.concatenate(n_asked), np.concatenate(n_held)
        starts = np.cumsum(n_held) - n_held
        weights = np.where(named, idf, 0) + 1j * np.where(named, 0, idf)
        order = np.empty(len(idf), np.int64)
        order[np.lexsort((named, idf))] = np.arange(len(idf))
        row = np.repeat(np.arange(len(idf)), n_asked)
        by = np.lexsort((order[row], asked))
        asked, row = asked[by], row[by]
        bounds = np.flatnonzero(np.concatenate(([True], asked[1:] != asked[:-1], [True])))
        ends = np.concatenate(([0], np.cumsum(n_held[row])))[bounds]
        out, rows, a = [], 0, 0
        while a < len(bounds) - 1:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE, "right")) - 1)
            own = slice(bounds[a], bounds[b])
            for found in self._summed_pairs(asked[bounds[a:b]], bounds[a : b + 1] - bounds[a], starts[row[own]], n_held[row[own]], weights[row[own]], held):
                out.append(found)
                rows += len(found[0])
                if rows >= OUT_ROWS:
                    yield self._batch(out)
                    out, rows = [], 0
            a = b
        if out:
            yield self._batch(out)

    def _summed_pairs(self, entities: np.ndarray, bounds: np.ndarray, starts: np.ndarray, n: np.ndarray, weights: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
        """The pairs of entities: those between two bounds of the lists (starts, n) are one's."""
        slot_bits = int(len(n)).bit_length()
        assert int(len(entities)).bit_length() + self.bits + slot_bits < 64
        ends = np.cumsum(n)
        at = np.repeat(starts - (ends - n), n)
        at += np.arange(len(at))
        met = held[at].astype(np.int64)
        met <<= slot_bits
        met += np.repeat((np.repeat(np.arange(len(entities)), np.diff(bounds)) << self.bits + slot_bits) + np.arange(len(n)), n)
        met.sort()
        pair = met >> slot_bits
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        total = np.add.reduceat(weights[met & (1 << slot_bits) - 1], first)
        pair = pair[first]
        found, score = pair & (1 << self.bits) - 1, total.real + total.imag
        for i, (x, y) in enumerate(pairwise(np.searchsorted(pair >> self.bits, np.arange(len(entities) + 1)).tolist())):
            at = slice(x, y) if self.k is None else x + self._ranked(score[x:y])
            of_at = found[at].astype(self.kinds[1])
            yield np.full(len(of_at), entities[i], self.kinds[0]), of_at, score[at], total.real[at], total.imag[at], np.arange(len(of_at), dtype=np.int32)

    @staticmethod
    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["s1", "c", "blk_score", "blk_name", "blk_addr", "blk_rank"])


def _met(corpus: int, k: int | None, kinds: tuple[type, type]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of blocks, each of whose rows lie together: by numbers, or by ids if rows of _dealt_names lead those of each."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now = _Block(corpus, k, kinds), None
        names, held = ([], []), []

        def pairs() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sides = [_Names(parts) if parts else None for parts in names]
            for batch in sums.pairs(held):
                if all(sides):
                    batch = pa.RecordBatch.from_arrays([side.of(batch.column(i)) for i, side in enumerate(sides)] + batch.columns[2:], batch.schema.names)
                yield batch

        for batch in batches:
            at, is_names = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            side = np.array([x[0] for x in _column(batch, 2, np.float64)]) * is_names
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (is_names[1:] != is_names[:-1]) | (np.diff(side) != 0)) + 1).tolist(), len(at)] if len(at) else [0]
            for a, b in pairwise(cuts):
                if at[a] != now:
                    yield from pairs()
                    now, names, held = at[a], ([], []), []
                (names[int(side[a])] if is_names[a] else held).append(batch.slice(a, b - a))
        yield from pairs()

    return met


def _number_pairs(queries: DataFrame, corpus: DataFrame, df_cap: int, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s1, c, blk_score, blk_name, blk_addr, blk_rank) and the numbers of both sides: the k best of each s1, or all with no rank, by
    numbers. Pairs of sides too large to be broadcast are too many to be joined to ids: these go to the blocks, the corpus's to each, and
    pairs are by ids.

    Each task indexes its records in arrays: keys as 80 bits of hash, sorted, with the numbers of their records packed as gaps; of a key above
    the cap in one task only its count. A country's keys of a field are dealt to buckets, and what all tasks have of one meets once; there
    keys above the cap and those of one side go. Entities are dealt to blocks; a key's list goes once to each block that asks for it. Pairs are
    summed and ranked there: neither keys nor pairs are rows before that.
    """
    sides = []
    for records, name in ((queries, "query-numbers"), (corpus, "corpus-numbers")):
        numbers, total = _numbered(records, name)
        sides.append((records.select("entity_id", "country", "name_core", "addr_norm").join(if_small(numbers), "entity_id").select("country", "name_core", "addr_norm", "n"), numbers, total))
    (queries, names, asking), (corpus, corpus_names, known) = sides
    sizes = if_small(corpus.groupBy("country").agg(F.count("*").alias("of_country")))
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-(asking + known) // INDEX_RECORDS))
    index = queries.mapInArrow(_indexed(False, tasks, df_cap), INDEX).unionByName(corpus.mapInArrow(_indexed(True, tasks, df_cap), INDEX))
    met = index.join(sizes, "country").select(*_INDEX_NAMES, "of_country").repartition(tasks, "country", "field", "key")
    blocks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-asking // BLOCK))
    met = met.sortWithinPartitions("country", "field", "key").mapInArrow(_dealt(blocks, df_cap), MET)
    by_ids = max(asking, known) > BROADCAST_ROWS
    if by_ids:
        for of_corpus, ids in enumerate((names, corpus_names)):
            met = met.unionByName(ids.select("entity_id", "n").mapInArrow(_dealt_names(blocks, bool(of_corpus)), MET))
    met = met.repartitionById(blocks, "block").sortWithinPartitions("block", F.asc_nulls_first("named"))
    named = [dict(df.dtypes)["n"].replace("bigint", "long") for df in (names, corpus_names)]
    kinds = tuple(np.int32 if x == "int" else np.int64 for x in named)
    if by_ids:
        named = ["string", "string"]
    pairs = met.mapInArrow(_met(known, k, kinds), f"s1 {named[0]}, c {named[1]}, blk_score double, blk_name double, blk_addr double, blk_rank int")
    return pairs, names, corpus_names


def _named(pairs: DataFrame, names: DataFrame, corpus_names: DataFrame) -> DataFrame:
    """pairs by ids in place of numbers."""
    if dict(pairs.dtypes)["s1"] == "string":
        return pairs
    s1 = if_small(names.select(F.col("n").alias("s1"), F.col("entity_id").alias("_s1")))
    c = if_small(corpus_names.select(F.col("n").alias("c"), F.col("entity_id").alias("_c")))
    return pairs.join(s1, "s1").join(c, "c").withColumns({"s1": F.col("_s1"), "c": F.col("_c")}).drop("_s1", "_c").select(*pairs.columns)


def scored_pairs(queries: DataFrame, corpus: DataFrame, df_cap: int = DF_CAP) -> DataFrame:
    """(s1, c, blk_score, blk_name, blk_addr): summed idf of the keys that both have, within a country. Pairs without a key don't exist."""
    pairs, *names = _number_pairs(queries, corpus, df_cap)
    return _named(pairs.drop("blk_rank"), *names)


def retrieve(queries: DataFrame, corpus: DataFrame, top_k: int = TOP_K, df_cap: int = DF_CAP) -> DataFrame:
    """Of scored_pairs the top_k best of each entity, with blk_rank from 0; scores that agree to six places tie, and go by c."""
    return _named(*_number_pairs(queries, corpus, df_cap, top_k))
