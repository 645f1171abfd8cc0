import hashlib
import random

import numpy as np
import pytest

from ligature.llm import repeats
from ligature.llm.runindex import RunIndex

from .conftest import SCHEMA


def brute(rows, length):
    """(n_bytes, starts, ends, kept) by (doc, text), from rows in the order of documents."""
    seen, out = {}, {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if seen.setdefault(window, (key, i)) != (key, i):
                gone[i : i + length] = b"\1" * length
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.frombuffer(bytes(gone), np.uint8), [0])).astype(int)))
        out[key] = (len(data), edges[::2].tolist(), edges[1::2].tolist(), hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("letters", ["ab", "a", "abcdefgh"])
def test_index_finds_what_starts_earlier(letters):
    draw = random.Random(letters)
    for _ in range(60):
        length = draw.randrange(1, 6)
        strings = [bytes(ord(draw.choice(letters)) for _ in range(draw.randrange(1, 20))) for _ in range(draw.randrange(1, 12))]
        seen, want = set(), []
        for s in strings:
            for i in range(len(s) + 1):
                w = s[i : i + length]
                want.append(len(w) == length and w in seen)
                seen |= {w} if len(w) == length else set()
        assert RunIndex(strings).repeated(length).tolist() == want
    assert RunIndex([]).repeated(3).tolist() == []


def test_pieces_cover_each_window_once(monkeypatch):
    draw = random.Random(1)
    for block in (1 << 22, 64):
        monkeypatch.setattr(repeats, "BLOCK", block)
        for text in (b"", b"a" * 99, b"a" * 400, bytes(draw.choice(b"ab") for _ in range(700)), bytes(draw.randrange(256) for _ in range(700))):
            for gram in (repeats.GRAM, repeats.FINE):
                anchor, _, start, n = repeats.pieces(np.frombuffer(text, np.uint8), gram)
                covered = [i for s, k in zip(start, n, strict=True) for i in range(s, s + k)]
                assert covered == list(range(max(0, len(text) - 99)))
                # one window, one anchor, wherever it stands
                by_window = {}
                for a, s, k in zip(anchor, start, n, strict=True):
                    for i in range(s, s + k):
                        assert by_window.setdefault(text[i : i + 100], a) == a


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_against_all_windows(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    draw = random.Random(4)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(180))
    periodic = "abc" * 120
    rows = []
    for i in range(40):
        text = "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(150)))
        if draw.random() < 0.6:
            a, b = sorted(draw.randrange(181) for _ in range(2))
            text += passage[a:b] + "".join(draw.choice("xyzü") for _ in range(draw.randrange(4))) + passage[: draw.randrange(181)]
        if draw.random() < 0.3:
            text += periodic[draw.randrange(50) :]
        rows.append((i, text, None, None, None))
    rows += [(50, rows[3][1], "x", "y", 1), (51, None, None, None, None), (52, "", None, None, None)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.starts, r.ends, r.kept_sha256) for r in repeats.repeated_bytes(docs).collect()}
    assert got == brute([(r[0], r[1]) for r in sorted(rows)], 100)


def test_any_rows(docs, no_docs):
    rows = repeats.repeated_bytes(docs, with_kept=True).collect()
    assert len(rows) == docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[103][0].starts == [0] and by_id[103][0].ends == [by_id[103][0].n_bytes] and by_id[103][0].kept == b""
    assert len({(r.n_bytes, r.kept_sha256) for r in by_id[104]}) == 1 and by_id[104][0].starts == []
    assert sorted(r.n_bytes for r in by_id[None]) == [0, 22] and by_id[105][0].kept != b""
    assert repeats.repeated_bytes(no_docs).count() == 0
