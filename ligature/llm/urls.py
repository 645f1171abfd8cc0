"""URL filters: rules by host and path first; where none fits, unigram Viterbi splits host and path into words, and a multinomial naive
Bayes model of block and allow scores them.

The unigram model counts the words of all pages, whole. Naive Bayes learns from the addresses that a rule decides, by what a rule does not
name: the host without the rule's, the path without the rule's. A word counts once for each host, or each path, so a host with many pages
is one example. Both models are tables that meet the addresses in joins: each distinct run of letters asks for the counts of its own
substrings, so no vocabulary is cut or sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_batch, stored

LONGEST_WORD = 24
#: Letters of the shortest words that naive Bayes counts: shorter ones are codes of languages, countries and the like, which rules speak of.
SHORTEST_TOKEN = 3
#: Share of addresses that are to be blocked where the words say nothing.
BLOCK_PRIOR = 0.2
#: (action, host/path): the longest that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A unit of the odds' logarithms: sums of whole numbers don't depend on their order.
UNIT = 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; '' if there is none."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does. A rule fits its host and all subdomains, if the path starts with the rule's."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def runs_of(text: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """The distinct runs of letters, lower-cased, but for the words that a rule names."""
    named = sorted({w for _, rule in rules for w in rule.lower().replace("/", ".").split(".") if w})
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), F.array(*map(F.lit, named)).cast("array<string>"))


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) of all pages' visible text, of words of 2 to LONGEST_WORD letters."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where(f"length(word) between 2 and {LONGEST_WORD}")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_split(letters: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable split into words by counts of (start, end): unknown ones cost by their length."""
    best, cut, unknown = [0.0], [0], math.log(max(1, total))
    for end in range(1, len(letters) + 1):
        cost, start = math.inf, 0
        for i in range(max(0, end - LONGEST_WORD), end):
            n = counts.get((i, end))
            c = best[i] + (math.log(total / n) if n else unknown + math.log(10) * (end - i))
            if c < cost:
                cost, start = c, i
        best.append(cost)
        cut.append(start)
    words, end = [], len(letters)
    while end:
        words.append(letters[cut[end] : end])
        end = cut[end]
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, tokens): each distinct run of runs (run string), split into words by counts (word, n) of its substrings."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = F.sequence(F.lit(1), F.length("run") - 1)
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(LONGEST_WORD), F.length("run") - i + 1)), lambda n: F.struct(i.alias("start"), F.substring(F.col("run"), i, n).alias("part")))))
    asked = runs.where("length(run) > 1").select("run", F.explode(parts).alias("x")).select("run", "x.start", "x.part")
    met = asked.join(counts, F.col("part") == F.col("word")).groupBy("run").agg(F.collect_list(F.struct("start", F.length("part").alias("size"), "n")).alias("known"))
    both = runs.join(met.withColumnRenamed("run", "_run"), F.col("run") == F.col("_run"), "left").select("run", "known")
    schema = pa.schema([("run", pa.string()), ("tokens", pa.list_(pa.string()))])

    def work(batch: pa.RecordBatch) -> dict:
        tokens = [best_split(run, {(k["start"] - 1, k["start"] - 1 + k["size"]): k["n"] for k in known or ()}, total) for run, known in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist(), strict=True)]
        return {"run": batch.column("run"), "tokens": tokens}

    return both.mapInArrow(per_batch(work, schema), "run string, tokens array<string>")


def addressed(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, action) for every row; rule and action are null where none fits."""
    url = F.coalesce("url", F.lit(""))
    parts = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return parts.withColumns({"rule": rule, "action": action})


def labelled_runs(parts: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """(run, action, n): in how many hosts and paths that a rule decides a run stands, beside what the rule names."""
    # host and path lose what the rule names of them
    host = F.expr("substring(host, 1, greatest(0, length(host) - length(substring_index(rule, '/', 1))))")
    path = F.expr("substring(path, length(rule) - length(substring_index(rule, '/', 1)) + 1, length(path))")
    decided = parts.where("action is not null")
    sides = [decided.select("action", side.alias("text")).distinct() for side in (host, path)]
    rows = reduce(DataFrame.unionAll, [x.select("action", F.explode(runs_of(F.col("text"), rules)).alias("run")) for x in sides])
    return rows.groupBy("run", "action").agg(F.count("*").alias("n"))


def token_odds(tokens: DataFrame) -> DataFrame:
    """(token, odds) of tokens (token, block, allow): ln of P(token | block) / P(token | allow) in UNITs, with add-one smoothing."""
    counts = tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).where("block + allow > 0")
    n, block, allow = counts.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    odds = F.ln((F.col("block") + 1) / F.lit(float((block or 0) + n + 1))) - F.ln((F.col("allow") + 1) / F.lit(float((allow or 0) + n + 1)))
    return counts.select("token", F.round(odds / UNIT).cast("long").alias("odds"))


def run_odds(parts: DataFrame, counts: DataFrame, rules: Iterable[tuple[str, str]] = RULES, learn: Column | None = None) -> DataFrame:
    """(run, odds) of the runs of all addresses, those without odds left out; learn limits the rows that naive Bayes learns from."""
    runs = parts.select("host", "path").distinct().select(F.explode(runs_of(F.concat_ws(" ", "host", "path"), rules)).alias("run")).distinct()
    split = stored(segmented(runs, counts), "url-runs")
    labels = labelled_runs(parts if learn is None else parts.where(learn), rules)
    kinds = labels.groupBy(F.col("run").alias("_run")).agg(*[F.sum(F.when(F.col("action") == k, F.col("n")).otherwise(0)).alias(k) for k in ("block", "allow")])
    # a token's tallies are those of the runs that have it
    tokens = split.select("run", F.explode("tokens").alias("token")).where(F.length("token") >= SHORTEST_TOKEN)
    odds = stored(token_odds(tokens.join(kinds, F.col("run") == F.col("_run"))), "url-odds")
    met = tokens.join(odds.withColumnRenamed("token", "_token"), F.col("token") == F.col("_token"))
    return met.groupBy("run").agg(F.sum("odds").alias("odds")).where("odds <> 0")


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, prior: float = BLOCK_PRIOR, learn: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row: verdict is the rule's action, else block if the model's score is a half or
    more, else allow.

    A null url and one without :// have an empty host and path, fit no rule, and score the prior; so does an address none of whose words
    was learned, and every one where no rule decides any. A null html adds no words; repeated rows each get a row; very long addresses are
    split like others. learn, a condition on host and path, limits the decided rows that are learned from.
    """
    parts = addressed(pages, rules)
    counts = stored(word_counts(pages), "words")
    odds = stored(run_odds(parts, counts, rules, learn), "run-odds")
    text = F.concat_ws(" ", "host", "path")
    addresses = parts.select("host", "path").distinct()
    asked = addresses.select("host", "path", F.explode(runs_of(text, rules)).alias("run"))
    scores = asked.join(odds.withColumnRenamed("run", "_run"), F.col("run") == F.col("_run")).groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    named = scores.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "odds")
    found = parts.join(named, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    x = F.lit(math.log(prior / (1 - prior))) + F.coalesce("odds", F.lit(0)) * F.lit(UNIT)
    scored = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x)))))
    verdict = F.coalesce("action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
