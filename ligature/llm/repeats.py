"""Suffix-array dedup by a run-length index: bytes covered by a string of LENGTH bytes that also starts earlier are removed.

Equal windows of LENGTH bytes have the same least gram (by a hash, the first of equals) at the same place, so windows are dealt by it: a
piece of a document is a stretch of consecutive windows with one least gram, its anchor. Equal pieces are settled by their hashes: all but
the first repeat it wholly. The bytes of a piece travel only if its anchor has other pieces too; then the first of each are put into a
run-length index, shard by shard, whose matching statistics tell which windows stand in an earlier piece.

Copies within a batch of documents never leave it, so a piece with many copies costs a row a batch. Anchors are read in sorted order with
one row of state. Anchors with more than CROWD pieces are cut again by grams of FINE bytes, which tell pieces apart by nearly all of a
window, before they are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stored
from .runindex import RunIndex

LENGTH = 100
GRAM, FINE = 32, 96
CROWD = 20_000
#: Windows worked on at once; bytes of pieces in an index.
BLOCK, SHARD_BYTES = 1 << 22, 2 << 20
#: Bytes of text for each task that settles anchors, and for each that builds indexes (of the pieces' bytes).
SETTLE_BYTES, INDEX_BYTES = 16 << 20, 8 << 20
_LAST = 9223372036854775807
_BASE, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _BASE
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


_BYTE = _scrambled(np.arange(1, 257, dtype=np.uint64) * _MIX)


def _grams(text: np.ndarray, size: int) -> np.ndarray:
    """A hash of each size bytes, from hashes of one, two, four, ...; where size is no power of two, two of the next smaller overlap."""
    part, power, have = _BYTE[text], int(_BASE), 1
    while 2 * have <= size:
        part = part[:-have] * np.uint64(power) + part[have:]
        power, have = power * power % 2**64, 2 * have
    if have < size:
        n = len(text) - size + 1
        part = _scrambled(part[:n]) * _MIX + part[size - have : size - have + n]
    return _scrambled(part)


def pieces(text: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of a text: its anchor's hash, a hash of its bytes, its first window, and its number of windows."""
    out = []
    for i in range(0, len(text) - LENGTH + 1, BLOCK):
        part = text[i : i + BLOCK + LENGTH - 1]
        h = _grams(part, gram)
        value, place, wide = h, np.arange(len(h), dtype=np.int32), 1
        most = LENGTH - gram + 1
        while wide < most:
            step = min(wide, most - wide)
            right = value[step:] < value[:-step]
            value, place = np.where(right, value[step:], value[:-step]), np.where(right, place[step:], place[:-step])
            wide += step
        starts = np.nonzero(np.concatenate(([True], place[1:] != place[:-1])))[0]
        n = np.diff(np.append(starts, len(place)))
        end = starts + n + LENGTH - 1 - gram
        whole = n.astype(np.uint64)
        for step in range(0, 2 * LENGTH, gram):
            whole = whole * _BASE + h[np.minimum(starts + step, end)]
            whole ^= whole >> np.uint64(31)
        out.append((value[starts].view(np.int64), whole.view(np.int64), starts + i, n))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by owner and start, those that touch in one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    # ends so far, of the same owner: a new owner's count from above all before
    lift = np.cumsum(np.concatenate(([0], owner[1:] != owner[:-1]))) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    first = np.concatenate(([True], start[1:] + lift[1:] > reach[:-1]))
    at = np.nonzero(first)[0]
    return owner[at], start[at], (reach - lift)[np.append(at[1:] - 1, len(end) - 1)]


PIECE = "anchor long, hash long, doc long, part long, start long, n long"
_PIECE = pa.schema([(k, pa.int64()) for k in ("anchor", "hash", "doc", "part", "start", "n")])
#: n is negative in a span to be removed, of -n bytes; its anchor is any.
NAMES = _PIECE.names


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.asarray(c, np.int64)) for c in columns], schema=_PIECE)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc, part, text): the first of equal pieces in each batch, and merged spans of the others."""
    for batch in batches:
        doc, part = (np.array(batch.column(k)) for k in ("doc", "part"))
        texts = as_bytes(batch.column("text"))
        order = np.lexsort((part, doc))
        found = [pieces(np.frombuffer(texts[i], np.uint8)) for i in order]
        owner = np.repeat(order, [len(x[0]) for x in found])
        if not len(owner):
            continue
        anchor, whole, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
        key = anchor ^ np.bitwise_xor(whole << 1, whole >> 7)
        by_key = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        near = by_key[:-1], by_key[1:]
        again[near[1]] = (anchor[near[0]] == anchor[near[1]]) & (whole[near[0]] == whole[near[1]])
        # rows alike in doc and part are one document: a piece does not repeat itself
        first = ~again
        heads = np.maximum.accumulate(np.where(first[by_key], np.arange(len(key)), 0))
        head = np.empty(len(key), np.int64)
        head[by_key] = by_key[heads]
        itself = again & (doc[owner] == doc[owner[head]]) & (part[owner] == part[owner[head]]) & (start == start[head])
        yield _rows(anchor[first], whole[first], doc[owner[first]], part[owner[first]], start[first], n[first])
        gone = again & ~itself
        o, a, b = _merged(owner[gone], start[gone], start[gone] + n[gone] + LENGTH - 1)
        if len(o):
            yield _rows(_scrambled((doc[o] + a).view(np.uint64)).view(np.int64), np.zeros(len(o)), doc[o], part[o], a, a - b)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by anchor, hash and place: spans of pieces that repeat an earlier one, and the first of equal pieces where an anchor
    has several. State: the last row, and the first piece of its anchor as long as it is the only one."""
    last = waiting = None
    for batch in batches:
        rows = np.stack([np.array(batch.column(k)) for k in NAMES])
        gone = rows[5] < 0
        if gone.any():
            yield _rows(*rows[:, gone])
            rows = rows[:, ~gone]
        if not rows.shape[1]:
            continue
        same = np.zeros((2, rows.shape[1]), bool)
        same[:, 1:] = rows[:2, 1:] == rows[:2, :-1]
        if last is not None:
            same[:, 0] = rows[:2, 0] == last[:2]
        before = np.concatenate((rows[2:5, :1] if last is None else last[2:5, None], rows[2:5, :-1]), axis=1)
        equal = same[0] & same[1]
        itself = equal & (rows[2:5] == before).all(axis=0)  # rows alike in doc and part
        again = equal & ~itself
        if again.any():
            yield _rows(rows[0, again], np.zeros(again.sum()), *rows[2:5, again], -(rows[5, again] + LENGTH - 1))
        group = np.cumsum(~same[0])
        firsts = np.nonzero(~equal)[0]
        counts = np.bincount(group[firsts], minlength=int(group[-1]) + 1)
        several = counts > 1
        if counts[0]:
            several[0] = True
            if waiting is not None:
                yield _rows(*waiting[:, None])
                waiting = None
        chosen = firsts[several[group[firsts]]]
        if len(chosen):
            yield _rows(*rows[:, chosen])
        if group[-1]:
            alone = firsts[group[firsts] == group[-1]]
            waiting = rows[:, alone[0]] if len(alone) == 1 else None
        last = rows[:, -1]


_STRING = pa.schema([(k, pa.int64()) for k in ("anchor", "doc", "part", "start")] + [("bytes", pa.binary())])
STRING = "anchor long, doc long, part long, start long, bytes binary"


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc, part, text, wanted): the bytes of the wanted pieces; those of crowded anchors cut again."""
    for batch in batches:
        for i, (doc, part, text) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("part").to_pylist(), as_bytes(batch.column("text")), strict=True)):
            rows = []
            for w in batch.column("wanted")[i].as_py():
                own = text[w["start"] : w["start"] + w["n"] + LENGTH - 1]
                if not w["crowded"]:
                    rows.append((w["anchor"], doc, part, w["start"], own))
                    continue
                anchor, _, start, n = pieces(np.frombuffer(own, np.uint8), FINE)
                rows += [(a, doc, part, w["start"] + s, own[s : s + k + LENGTH - 1]) for a, s, k in zip(anchor.tolist(), start.tolist(), n.tolist(), strict=True)]
            if rows:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _STRING, strict=True)], schema=_STRING)


def _indexed(rows: list[tuple]) -> pa.RecordBatch:
    """Spans of (anchor, doc, part, start, bytes) that an earlier row has too."""
    rows = sorted(rows, key=lambda r: r[1:4])
    first: dict[tuple[int, bytes], int] = {}
    strings, own, spans = [], [], []
    for i, (anchor, _, _, start, text) in enumerate(rows):
        at = first.setdefault((anchor, text), i)
        if at == i:
            strings.append(text)
            own.append(i)
        elif rows[at][1:4] != rows[i][1:4]:
            spans.append((i, start, start + len(text)))
    index = RunIndex(strings)
    repeated = np.append(index.repeated(LENGTH), False)
    edge = np.diff(np.concatenate(([0], repeated)).astype(np.int8))
    a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    of = np.searchsorted(index.starts, a, side="right") - 1
    base = np.array([rows[i][3] for i in own], np.int64)
    owner = np.concatenate((np.array([s[0] for s in spans], np.int64), np.array(own, np.int64)[of]))
    start = np.concatenate((np.array([s[1] for s in spans], np.int64), base[of] + a - index.starts[of]))
    end = np.concatenate((np.array([s[2] for s in spans], np.int64), base[of] + b - index.starts[of] + LENGTH - 1))
    keys = np.array([r[1:3] for r in rows], np.int64).reshape(-1, 2)
    return _rows(np.zeros(len(owner)), np.zeros(len(owner)), keys[owner, 0], keys[owner, 1], start, start - end)


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by anchor: the spans that stand in an earlier piece; an index holds whole anchors."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in _STRING.names), strict=True):
            if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                yield _indexed(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield _indexed(rows)


_RESULT = pa.schema([("doc", pa.int64()), ("part", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string())])


def _finish(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            starts, ends, hashes, kept = [], [], [], []
            for text, spans in zip(texts, batch.column("spans"), strict=True):
                spans = spans.as_py() or []
                a = np.array([s["start"] for s in spans], np.int64)
                b = a + np.array([s["size"] for s in spans], np.int64)
                _, a, b = _merged(np.zeros(len(a), np.int64), a, b)
                left = b"".join(text[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True))
                starts.append(a.tolist())
                ends.append(b.tolist())
                hashes.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = [batch.column("doc"), batch.column("part"), pa.array(list(map(len, texts)), pa.int64()), pa.array(starts, _RESULT.field("starts").type), pa.array(ends, _RESULT.field("ends").type), pa.array(hashes)]
            schema = _RESULT.append(pa.field("kept", pa.binary())) if with_kept else _RESULT
            yield pa.record_batch([*columns, pa.array(kept, pa.binary())] if with_kept else columns, schema=schema)

    return run


def keyed(docs: DataFrame, unique: bool) -> DataFrame:
    """(doc, part, text): doc_id, null last; part tells rows of one doc_id apart by their texts."""
    part: Column = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), part.alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def repeated_bytes(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept_sha256, and kept if asked for) for every row of docs: the maximal spans of UTF-8 bytes (ends
    excluded) that are covered by a string of LENGTH bytes that also starts earlier, in a smaller doc_id or further up in the text.

    Null texts are empty; null doc_ids come last. Of rows with one doc_id the order is by a hash of their texts; rows alike in doc_id and
    text stand for one document, and get the same result. Texts under LENGTH bytes keep all.
    """
    spark = docs.sparkSession
    facts = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).agg(F.max("n"), F.count_if(F.col("doc_id").isNull()), F.sum("size")).first()
    unique, size = (facts[0] or 1) == 1 and not facts[1], facts[2] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs, unique)

    cut_ = rows.mapInArrow(cut, PIECE)
    dealt = cut_.repartition(max(least, int(size // SETTLE_BYTES)), "anchor").sortWithinPartitions("anchor", "hash", "doc", "part", "start")
    settled = stored(dealt.mapInArrow(settle, PIECE), "pieces")

    wanted = settled.where("n > 0")
    crowds = stored(wanted.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select(F.col("anchor").alias("_anchor")), "crowds")
    marked = wanted.join(crowds, F.col("anchor") == F.col("_anchor"), "left").withColumn("crowded", F.col("_anchor").isNotNull())
    by_doc = marked.groupBy("doc", "part").agg(F.collect_list(F.struct("anchor", "start", "n", "crowded")).alias("wanted"))
    strings = rows.dropDuplicates(["doc", "part"]) if not unique else rows
    strings = strings.join(by_doc, ["doc", "part"]).select("doc", "part", "text", "wanted").mapInArrow(fetch, STRING)
    bytes_ = wanted.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    dealt = strings.repartition(max(least, int(bytes_ // INDEX_BYTES)), "anchor").sortWithinPartitions("anchor")
    matched = dealt.mapInArrow(match, PIECE)

    spans = settled.where("n < 0").unionByName(matched).groupBy("doc", "part").agg(F.collect_list(F.struct("start", (-F.col("n")).alias("size"))).alias("spans"))
    out = rows.join(spans, ["doc", "part"], "left").select("doc", "part", "text", "spans")
    kind = "doc long, part long, n_bytes long, starts array<long>, ends array<long>, kept_sha256 string" + ", kept binary" * with_kept
    done = out.mapInArrow(_finish(with_kept), kind)
    doc_id = F.when((F.col("doc") == _LAST) & F.lit(bool(facts[1])), None).otherwise(F.col("doc")).alias("doc_id")
    return done.select(doc_id, "n_bytes", "starts", "ends", "kept_sha256", *["kept"] * with_kept)
