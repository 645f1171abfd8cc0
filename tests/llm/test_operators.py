"""Each operator against a plain version, and over rows of every odd kind."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ligature.llm import decontamination, fingerprints, language, lines, mixing, quality, queries, sharding, urls
from ligature.llm.linear import nn_pu_weights

from .conftest import SCHEMA, SF

SPACES = re.compile("[\x20\x09-\x0d]+")


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


# --- quality


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op1_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.quality for r in labels)
    assert right / len(labels) > 0.95
    good = [got[r.doc_id].score for r in labels if r.quality == 1]
    bad = [got[r.doc_id].score for r in labels if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_quality_of_any_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (2, 1, 1), (7, None, None), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(no_docs, labels).count() == 0
    assert sorted(r.doc_id for r in quality.trusted_positives(labels).collect()) == [1, 3]


def test_non_negative_risk():
    draw = np.random.default_rng(2)
    x = np.hstack((draw.normal(size=(4000, 3)) + np.where(draw.random((4000, 1)) < 0.7, 1.0, -1.0), np.ones((4000, 1))))
    positive = np.hstack((draw.normal(size=(500, 3)) + 1.0, np.ones((500, 1))))
    w = nn_pu_weights(x.T @ x / len(x), positive.mean(axis=0), positive.T @ positive / len(positive), 0.7)
    assert (positive @ w).mean() > 0.5 and abs((x @ w > 0).mean() - 0.7) < 0.1


def test_class_prior_of_a_mixture():
    draw = np.random.default_rng(3)
    u = np.concatenate((draw.normal(2, 1, 60_000), draw.normal(-2, 1, 40_000)))
    p = draw.normal(2, 1, 20_000)
    bins = np.stack([np.histogram(v, 200, (-6, 6))[0] for v in (u, p)])
    assert abs(quality.class_prior(bins) - 0.6) < 0.03


# --- language


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, ["doc_id", "lang"]).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and sum(r.row.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_of_any_rows(docs, no_docs):
    rows = language.identify(docs).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.row.doc_id in (100, 101)} == {"und"}
    assert {r.lang_pred for r in rows} <= {"en", "fr", "de", "es", "und"} and all(0 <= r.score <= 1 for r in rows)
    kept = language.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where("text rlike '\\\\p{L}'").count()
    assert language.identify(no_docs).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_votes_of_machines():
    """Families first, then languages, by the pairs they win."""
    draw = np.random.default_rng(5)
    machine = lambda names: language.Machines(names, draw.normal(size=(len(names) * (len(names) - 1) // 2, language.BUCKETS + 1)).astype(np.float32), draw.uniform(1, 20, len(names) * (len(names) - 1) // 2))
    model = language.LanguageModel(machine(["f", "g", "h"]), {"f": machine(["a", "b", "c", "d"]), "g": machine(["e"]), "h": machine(["i", "j"])})
    x = draw.normal(size=(60, language.BUCKETS)).astype(np.float32) / 40

    def plain(m, row):
        wins, least, k = Counter({n: 0 for n in m.names}), dict.fromkeys(m.names, 1.0), 0
        for i, a in enumerate(m.names):
            for b in m.names[i + 1 :]:
                margin = float(m.weights[k, :-1].astype(float) @ row + m.weights[k, -1]) * m.scales[k]
                chance = 1 / (1 + math.exp(-max(-50, min(50, margin))))
                wins[a if margin >= 0 else b] += 1
                wins[a] += chance * 1e-3
                wins[b] += (1 - chance) * 1e-3
                least[a], least[b], k = min(least[a], chance), min(least[b], 1 - chance), k + 1
        best = max(m.names, key=lambda n: wins[n])
        return best, least[best]

    names, scores = model.predict(x)
    for name, score, row in zip(names, scores, x.astype(float), strict=True):
        family, sure = plain(model.families, row)
        lang, surer = plain(model.within[family], row)
        assert name == lang and math.isclose(score, sure * surer, rel_tol=1e-3, abs_tol=1e-6)
    assert len(set(names)) > 4


def test_the_sample_is_bounded(spark):
    """Rows that repeat count once, and no language gives more than its part."""
    rows = [(i % 50, f"text {i % 50} of it", "en") for i in range(400)] + [(1000 + i, f"otro {i} más", "es") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    x, langs = language._sample(docs, 20)
    n = Counter(langs.tolist())
    assert n["es"] == 20 and 0 < n["en"] <= 20 and x.shape == (len(langs), language.BUCKETS)


@pytest.mark.parametrize(("text", "want"), [(None, False), ("", False), ("12 34 -- ²", False), ("42 é", True), ("漢", True), ("_", False)])
def test_letters(text, want):
    assert language.has_letter(text) is want


# --- sharding


@pytest.mark.parametrize("limit", [500, 5_000, 1 << 40])
def test_sharding_against_splitting_bit_by_bit(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding, "LEVEL_BITS", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.shard, r.shard_bytes) for r in sharding.sharded(docs, limit).collect()}
    units = {}
    for r in docs.collect():
        key = f"{r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}"
        units[r.doc_id] = (f"{int(hashlib.md5(key.encode()).hexdigest()[:15], 16):060b}", len(r.text.encode()))

    def split(prefix, members):
        size = sum(units[m][1] for m in members)
        if size <= limit or len({units[m][0] for m in members}) == 1:
            return {m: (prefix, size) for m in members}
        halves = [[m for m in members if units[m][0][len(prefix)] == b] for b in "01"]
        return {k: v for b, half in zip("01", halves, strict=True) if half for k, v in split(prefix + b, half).items()}

    assert got == split("", list(units))


def test_sharding_of_any_rows(docs, no_docs):
    out = sharding.sharded(docs, 1000)
    assert {*out.columns} == {*docs.columns} and out.count() == docs.count()
    sizes = defaultdict(list)
    for r in out.collect():
        sizes[r.shard].append((len((r.text or "").encode()), r.shard_bytes))
    for members in sizes.values():
        assert {b for _, b in members} == {sum(n for n, _ in members)} and (len(members) == 1 or members[0][1] <= 1000)
    assert sharding.sharded(no_docs).count() == 0


# --- fingerprints


def test_fingerprints_of_any_rows(docs, no_docs):
    rows = fingerprints.fingerprinted(docs).collect()
    given = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    assert len(rows) == len(given)
    want = Counter()
    for r, after in zip(given, given[1:] + given[:1], strict=True):
        text, other = r.text or "", after.text or ""
        m = len(text) // 3
        want[r.doc_id, len(text), hashlib.sha256((text[: len(text) - m] + other[:m]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    by_id = {r.doc_id: r for r in rows}
    assert by_id[102].signature == by_id[103].signature and by_id[103].near_next == 1.0
    assert by_id[100].signature == by_id[101].signature
    assert fingerprints.fingerprinted(no_docs).count() == 0


def test_buckets_do_not_show(spark, docs, monkeypatch):
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    whole = key(fingerprints.fingerprinted(docs).collect())
    for cells, fan in ((3, 2), (64, 4)):
        monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 2)
        monkeypatch.setattr(fingerprints, "CELLS", cells)
        monkeypatch.setattr(fingerprints, "FAN", fan)
        assert key(fingerprints.fingerprinted(docs).collect()) == whole


def spark_hash(number, k, kind="<q"):
    """xxhash64 of a long or double and an int, as SQL has it."""
    return xxhash.xxh64_intdigest(struct.pack("<i", k), xxhash.xxh64_intdigest(struct.pack(kind, number), 42))


def brute_signature(text, samples):
    """Consistent weighted sampling, term by term."""
    p = (np.arange(4096) + 0.5) / 4096
    rs, cs = fingerprints._gamma_quantile(p), [np.log(fingerprints._gamma_quantile(p / 4096**i)) for i in range(3)]
    weights = Counter(w for w in SPACES.split(text) if w) or Counter([""])
    out = []
    for k in range(samples):
        least = math.inf
        for word, n in weights.items():
            term = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(word.encode(), 42)))[0]
            h = spark_hash(term, k)
            bits = [h >> 12 * i & 4095 for i in range(5)]
            r, beta = rs[bits[0]], bits[1] / 4096
            c = cs[0][bits[2]] if bits[2] else cs[1][bits[3]] if bits[3] else cs[2][bits[4]]
            least = min(least, c - r * (math.floor(math.log(n) / r + beta) - beta + 1))
        out.append(f"{spark_hash(least, k, '<d') & 0xFFFF:04x}")
    return out


def test_signatures_against_every_term(spark):
    draw = random.Random(4)
    texts = ["", " \t\n", "one", "one one one two", " ünï  çödé\x0bünï "] + [" ".join(f"w{draw.randrange(9)}" for _ in range(draw.randrange(1, 300))) for _ in range(15)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.signature for r in fingerprints.signatures(rows, ["i"], "text", 12).collect()}
    assert got == {i: brute_signature(t, 12) for i, t in enumerate(texts)}


def test_likeness_is_the_generalised_jaccard_similarity(spark):
    rows = queries.op5_fingerprints(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))

    def similarity(a, b):
        a, b = (Counter(w for w in SPACES.split(t) if w) for t in (a, b))
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    off = []
    for r in rows:
        text = texts[r.doc_id]
        m = len(text) // 3
        off.append(r.near_edited - similarity(text, text[: len(text) - m] + texts[after[r.doc_id]][:m]))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.12


# --- mixing


def sql(name, docs):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow()
    con.register("documents", documents)
    return con.execute(queries.ORACLE_SQL[name]).fetchall()


def test_mixing_of_any_rows(docs, no_docs):
    found = mixing.repetitions(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, sql("op6_mixing", docs)))
    copies = mixing.repetitions(docs).agg(F.sum("copies")).first()[0]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == copies
    assert mixing.repetitions(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_targets_stop_and_the_rest_is_shared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 400), (None, 90), ("d", 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["d"] == 0 and math.isclose(sum(got.values()), 2250)
    assert all(t <= 2 * s for t, s in zip((got[k] for k in ("b", "c", None)), (1000, 400, 90), strict=True))


# --- decontamination


def windows_of(text):
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return w, [tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))] if w else []


@pytest.mark.parametrize(("block", "shard"), [(1_000_000, 1_000_000), (40, 50)])
def test_decontamination_against_all_windows(spark, docs, no_docs, monkeypatch, block, shard):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "SHARD_SYMBOLS", shard)
    given = docs.collect()
    shared = next(r.text for r in given if r.doc_id == 104)
    long = next(r.text for r in given if r.doc_id == 102)
    items = [(1, shared[40:200]), (2, "w1 w2"), (3, None), (4, ""), (5, "W7"), (None, shared[:150]), (10, long[5000:5300]), (1, "çödé 漢字 ünï")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n_words")
    known = defaultdict(set)
    for item, text in items:
        for w in windows_of(text)[1]:
            known[w] |= {str(item)} - {"None"}
    want = Counter()
    for r in given:
        w = windows_of(r.text)[0]
        hit, found = set(), set()
        for i in range(len(w)):
            for n in range(1, 14):
                own = tuple(w[i : i + n])
                if len(own) == n and own in known:
                    hit |= set(range(i, i + n))
                    found |= known[own]
        want[r.doc_id, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    got = decontamination.judged(decontamination.benchmark_hits(docs, bench)).collect()
    assert Counter((r.row.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got) == want
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == len(given)
    assert decontamination.benchmark_hits(no_docs, bench).count() == 0


# --- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("threshold", "usual", "hot"), [(1, 32, 256), (2, 0, 1), (3, 1, 2)])
def test_lines_against_all_pairs(spark, monkeypatch, threshold, usual, hot):
    monkeypatch.setattr(lines, "USUAL", usual)
    monkeypatch.setattr(lines, "HOT", hot)
    draw = random.Random(8)
    base = ["".join(draw.choice("etnairso xü") for _ in range(draw.randrange(28, 45))) for _ in range(12)]

    def edited(line):
        line = list(line)
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(line))
            line[at : at + draw.randrange(2)] = draw.choice(["", "q", "é"])
        return "".join(line)

    rows = [(draw.randrange(60) if i % 9 else None, "\n".join(draw.choice([edited(draw.choice(base)), "short", "", "  "]) for _ in range(draw.randrange(1, 7)))) for i in range(50)]
    rows = list(dict(rows).items()) + [(200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((r[0] is None, r[0] or 0), n, line) for r in rows for n, line in enumerate((r[1] or "").split("\n")))
    first = {}
    for doc, n, line in order:
        first.setdefault(line, (doc, n))
    told = [x for x in first if x.strip(" ")]
    near = {b for b in told for a in told if first[a] < first[b] and distance(a, b) <= threshold}
    want = {}
    for doc, n, line in order:
        gone = want.setdefault(None if doc[0] else doc[1], [])
        if line.strip(" ") and (line in near or first[line] != (doc, n)):
            gone.append(n)
    got = {r.doc_id: r.removed for r in lines.deduplicated(docs, threshold).collect()}
    assert near and got == want


def test_lines_of_any_rows(docs, no_docs):
    rows = lines.deduplicated(docs).collect()
    assert ids(rows) == ids(docs.collect())
    out = lines.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.where("doc_id = 103").collect()} == {""}
    assert lines.deduplicated(no_docs).count() == 0 and lines.without_repeated_lines(no_docs).count() == 0


# --- urls


def all_splits(word):
    return [[word]] + [[word[:i], *rest] for i in range(1, len(word)) for rest in all_splits(word[i:])]


def test_segments_against_all_splits(spark):
    counts = {"the": 900, "cat": 50, "at": 300, "he": 200, "spa": 20, "ma": 5}
    total = sum(counts.values())
    cost = lambda words: sum(math.log(total / counts[w]) if w in counts else math.log(total) + math.log(10) * len(w) for w in words)
    given = ["thecat", "atthespa", "zzq", "x", "hehehema", "qqthezz", "thecat"]
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = urls.segmented(spark.createDataFrame([(w,) for w in dict.fromkeys(given)], "run string"), table).collect()
    assert {r.run for r in rows} == set(given)
    for r in rows:
        assert "".join(r.tokens) == r.run and math.isclose(cost(r.tokens), min(map(cost, all_splits(r.run))))
    assert {r.run: r.tokens for r in rows}["thecat"] == ["the", "cat"]
    assert urls.segmented(spark.createDataFrame([("abc",)], "run string"), table.limit(0)).collect()[0].tokens == ["abc"]


def test_words_of_hosts_that_no_rule_names(spark):
    """Hosts that share a word, but no host, with those that a rule decides."""
    fruit = ["apple", "pear", "plum", "cherry", "melon", "grape", "lemon", "mango", "olive", "peach"]
    html = "<p>" + " ".join([*fruit, "bitter", "sweet"] * 3) + "</p>"
    rows = [(f"http://bitter{f}.example.net/fr/1", html) for f in fruit[:8]] + [(f"https://sweet{f}.example.org/fr/2", html) for f in fruit[:8]]
    rows += [(f"http://{w}{f}.example.com/en/3", html) for w in ("bitter", "sweet") for f in fruit[8:]]
    # a host with many pages is one example
    rows += [(f"https://sweetapple.example.org/fr/{i}", "") for i in range(200)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in urls.judged(pages).collect()}
    for f in fruit[8:]:
        assert got[f"bitter{f}.example.com"].verdict == "block" and got[f"sweet{f}.example.com"].verdict == "allow"
    learned = urls.judged(pages, learn=F.lit(False)).collect()
    assert {round(r.score, 6) for r in learned} == {urls.BLOCK_PRIOR}


def test_urls_of_any_rows(spark):
    given = [
        "http://a.net/x", "https://b.example.net/en/1", "http://example.net/en", "http://example.com/de/", "http://sub.example.com/de/x?q#f", "http://example.com/fr/y", "x.org/fr/", "http://x.org/fr/?a",
        None, "", "http://", "http://NET/A", "http://netnet/", "http://a.net", "ftp://u@Dark-WOOD.example.com:80/en/#z", "a://b://c/d", "http://darkwood.example.com/en/", "http://darkwood.example.com/en/", "http://é.org\n/fr/x",
        "http://" + "longhost" * 3000 + ".net/" + "path/" * 3000, "http://darkwood.net/",
    ]
    pages = spark.createDataFrame([(i, u, None if i % 2 else "<p>the dark &amp; wood</p><script>x y</script>") for i, u in enumerate(given)], "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as score", "3 as rule")
    rows = {r.page_id: r for r in urls.judged(pages).collect()}
    assert len(rows) == len(given)
    for i, url in enumerate(given):
        _, mark, rest = (url or "").partition("://")
        host = re.match("[^/?#]*", rest)[0] if mark else ""
        path = re.match("[^?#]*", rest[len(host) :])[0] if mark else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = (0, None, None)
        for what, rule in urls.RULES:
            own, _, start = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
                best = max(best, (len(rule), rule, what))
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best[1])
        assert rows[i].verdict == (best[2] or ("block" if rows[i].score >= 0.5 else "allow"))
    assert rows[8].verdict == rows[12].verdict == "allow" and rows[16].score == rows[17].score
    assert urls.judged(pages.limit(0)).count() == 0


# --- digests


def test_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, text in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        want = con.execute(text)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns), name
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall())), name
