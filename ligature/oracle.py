"""What the linkage queries ask, in SQL."""

from __future__ import annotations

from .functions.vocabulary import ABBREVIATIONS, ADDRESS_WORDS, ADDRESS_WORDS_BY_COUNTRY, LEGAL_SUFFIXES, NAME_STOPWORDS, NAME_WORDS
from .operators.decisions import EMPTY_GRID, MISSING_GRID, PLAIN_ALPHA_GRID, PLAIN_T_GRID, PREFILTER_GRID, threshold_grid
from .queries import CAP, NAME, RULE, K


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _crc32(x: str) -> str:
    """Of ASCII: each byte is joined by exclusive or, and eight times the lowest bit is shifted out (steps of -1)."""
    steps = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: [ascii({x}[i])::BIGINT{', -1' * 8}]))"
    return f"xor(list_reduce({steps}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295), 4294967295)"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[''’]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _replaced(x: str, table: dict[str, str]) -> str:
    return f"list_transform({_words(x)}, lambda t: coalesce({_map(table)}[t], t))"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(strip_accents({x})), '[&+]', ' and ', 'g'), '''', ''), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _bigrams(w: str, one: str, two: str) -> str:
    return f"list_distinct(list_concat(list_transform({w}, lambda t: '{one}' || t), CASE WHEN len({w}) > 1 THEN list_transform(range(1, len({w})), lambda i: '{two}' || {w}[i] || '_' || {w}[i + 1]) ELSE [] END))"


_STOP = "[" + ", ".join(f"'{w}'" for w in NAME_STOPWORDS) + "]"

#: Common table expressions, each with those that it needs.
CTE: dict[str, tuple[str, str]] = {}


def _with(*names: str) -> str:
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = CTE[name]
        for n in needs.split():
            add(n)
        seen.setdefault(name, sql)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in seen.items()) + " "


CTE["rec"] = (
    "",
    f"""SELECT printf('S%d-%010d-%05d', doc_id % 3 + 1, doc_id, n - 1) AS entity_id, regexp_extract(line, '{NAME}', 0) AS business_name,
        CAST(length(line) % 1000 AS VARCHAR) || ' ' || substr(line, length(regexp_extract(line, '{NAME}', 0)) + 1) || ' ' || CAST(10000 + length(line) % 1000 AS VARCHAR) AS business_address, coalesce(lang, '') AS country
        FROM (SELECT doc_id, lang, n, parts[n] AS line FROM (SELECT doc_id, lang, parts, unnest(generate_series(1, len(parts))) AS n FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))""",
)
CTE["norm"] = ("rec", f"SELECT *, array_to_string({_replaced(_clean('business_name'), ABBREVIATIONS)}, ' ') AS name, array_to_string({_replaced(_clean('business_address'), ABBREVIATIONS)}, ' ') AS address FROM rec")
CTE["prep"] = (
    "norm",
    f"""SELECT entity_id, lower(trim(country)) AS country, array_to_string(list_filter({_words('name')}, lambda t: NOT list_contains({_STOP}, t)), ' ') AS name_core, address AS addr_norm,
        array_to_string(list_sort(list_distinct(regexp_extract_all(address, '[0-9]+'))), ' ') AS addr_nums,
        coalesce(TRY_CAST(substr(regexp_extract(address, '[0-9]+'), 1, 15) AS BIGINT), -1) AS addr_first_num,
        CASE WHEN business_name = '' THEN 0.0 ELSE length(regexp_replace(business_name, '[\\x00-\\x7F]', '', 'g')) / length(business_name) END AS name_non_ascii FROM norm""",
)
CTE["toks"] = (
    "prep",
    f"SELECT entity_id, country, list_filter({_words('name_core')}, lambda t: length(t) > 1) AS nw, list_filter({_words('addr_norm')}, lambda t: length(t) > 1 OR regexp_full_match(t, '[0-9]+')) AS aw FROM prep",
)
CTE["rkeys"] = ("toks", f"SELECT entity_id, country, 'n' AS field, unnest({_bigrams('nw', 'n:', 'nb:')}) AS key FROM toks UNION ALL SELECT entity_id, country, 'a', unnest({_bigrams('aw', 'a:', 'ab:')}) FROM toks")
CTE["idf"] = (
    "prep rkeys",
    f"""SELECT k.country, field, key, count(*) AS df, ln(1 + any_value(n) / count(*)) AS idf FROM rkeys k JOIN (SELECT country, count(*) AS n FROM prep WHERE entity_id[1:2] <> 'S1' GROUP BY 1) z ON z.country = k.country
        WHERE entity_id[1:2] <> 'S1' GROUP BY k.country, field, key HAVING count(*) <= {CAP}""",
)
CTE["scores"] = (
    "idf",
    """SELECT q.entity_id AS s1, c.entity_id AS c, sum(idf) AS blk_score, sum(CASE WHEN field = 'n' THEN idf ELSE 0 END) AS blk_name, sum(CASE WHEN field = 'a' THEN idf ELSE 0 END) AS blk_addr
        FROM idf JOIN rkeys q USING (country, field, key) JOIN rkeys c USING (country, field, key) WHERE q.entity_id[1:2] = 'S1' AND c.entity_id[1:2] <> 'S1' GROUP BY 1, 2""",
)
CTE["topk"] = ("scores", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(blk_score, 6) DESC, c) - 1 AS blk_rank FROM scores) WHERE blk_rank < {K}")
CTE["cand"] = (
    "topk prep",
    "SELECT t.*, c[1:2] = 'S3' AS c_is_s3, q.name_core AS qn, p.name_core AS cn, q.addr_norm AS qa, p.addr_norm AS ca, q.addr_first_num AS qf, p.addr_first_num AS cf, q.name_non_ascii AS q_non_ascii FROM topk t JOIN prep q ON q.entity_id = s1 JOIN prep p ON p.entity_id = c",
)


def _jaccard(a: str, b: str) -> str:
    x, y = _words(a), _words(b)
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect(list_distinct({x}), list_distinct({y}))) / len(list_distinct(list_concat({x}, {y}))) END"


CTE["dec"] = ("cand", f"SELECT s1, c, blk_rank, blk_score, c_is_s3, round(0.7::DOUBLE * coalesce({_jaccard('qn', 'cn')}, 0) + 0.3::DOUBLE * coalesce({_jaccard('qa', 'ca')}, 0) + 1e-9::DOUBLE, 6) AS p, qn = cn AND qa = ca AND qn <> '' AS label FROM cand")
CTE["ntrue"] = (
    "prep",
    """SELECT q.entity_id AS s1, coalesce(n, 0) AS n_true FROM prep q LEFT JOIN (SELECT country, name_core, addr_norm, count(*) AS n FROM prep WHERE entity_id[1:2] <> 'S1' AND name_core <> '' GROUP BY 1, 2, 3) x
        USING (country, name_core, addr_norm) WHERE q.entity_id[1:2] = 'S1'""",
)
CTE["top"] = ("dec", "SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, blk_rank) AS j FROM dec")
CTE["thr"] = ("top", f"SELECT *, p >= {RULE['t_all']} OR (j = 1 AND p >= {RULE['t_top']}) AS pred FROM top")


def _f05(n_true: str, n_pred: str, tp: str) -> str:
    precision, recall = f"({tp} / {n_pred})", f"({tp} / {n_true})"
    return f"CASE WHEN {n_true} = 0 THEN CASE WHEN {n_pred} = 0 THEN 1.0 ELSE 0.0 END WHEN {n_pred} = 0 OR {tp} = 0 THEN 0.0 ELSE 1.25::DOUBLE * {precision} * {recall} / (0.25::DOUBLE * {precision} + {recall}) END"


CTE["ent"] = (
    "thr ntrue",
    f"""SELECT s1, n_true, n_pred, tp, CAST({_f05('n_true', 'n_pred', 'tp')} AS DOUBLE) AS f05 FROM (SELECT n.s1, n_true, count(*) FILTER (pred) AS n_pred, count(*) FILTER (pred AND label) AS tp FROM ntrue n LEFT JOIN thr ON thr.s1 = n.s1 GROUP BY 1, 2)""",
)
_FORMS = _map(LEGAL_SUFFIXES)
CTE["parts"] = (
    "rec",
    f"""SELECT *, w[:kept] AS head, w[kept + 1:] AS tail FROM (SELECT *, coalesce(list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN {_FORMS}[w[i]] IS NULL THEN i ELSE 0 END)), 0) AS kept
        FROM (SELECT *, {_replaced(_plain('business_name'), NAME_WORDS)} AS w FROM rec))""",
)
CTE["names"] = (
    "parts",
    f"""SELECT *, array_to_string(w, ' ') AS "full", coalesce(nullif(array_to_string(CASE WHEN head[1] = 'the' THEN head[2:] ELSE head END, ' '), ''), array_to_string(w, ' ')) AS core,
        array_to_string(list_sort(list_distinct(list_transform(tail, lambda t: {_FORMS}[t]))), ' ') AS legal FROM parts""",
)
_TABLES = {k: ADDRESS_WORDS | ADDRESS_WORDS_BY_COUNTRY[k] for k in ("india", "france")}
_INITIALS = "list_filter({0}, lambda t: t NOT IN ('and', 'of', 'the'))"


def _acronym(x: str) -> str:
    w = _INITIALS.format(_words(x))
    return f"CASE WHEN len({w}) >= 2 THEN array_to_string(list_transform({w}, lambda t: t[1:1]), '') ELSE '' END"


def _postal(x: str) -> str:
    return f"coalesce(substr(replace(list_extract(regexp_extract_all({x}, '\\b(\\d{{6}}|\\d{{5}}(?:\\s?\\d{{4}})?)\\b'), -1), ' ', ''), 1, 6), '')"


CTE["side"] = (
    "names",
    f"""SELECT entity_id, entity_id[1:2] AS source, core AS name_core, legal, array_to_string({_replaced(_plain('business_address'), ADDRESS_WORDS)}, ' ') AS addr, {_postal('business_address')} AS postal,
        {_acronym('core')} AS acronym, coalesce(nullif({_plain('country')}, ''), 'unknown') AS ckey, coalesce({_words('core')}[1], '') AS first_tok FROM names""",
)
CTE["grams"] = (
    "side",
    """SELECT entity_id, gram, count(*) AS tf FROM (
            SELECT entity_id, unnest(list_concat(CASE WHEN length(w) < 3 THEN [w] ELSE [] END, list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)), list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)))) AS gram
            FROM (SELECT entity_id, ' ' || unnest(list_filter(string_split(lower(name_core), ' '), lambda t: t <> '')) || ' ' AS w FROM side)) GROUP BY 1, 2""",
)
CTE["weights"] = (
    "grams",
    """SELECT entity_id, gram, raw / sqrt(sum(raw * raw) OVER (PARTITION BY entity_id)) AS weight FROM (
            SELECT entity_id, g.gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM side)) / (1 + df)) + 1) AS raw FROM grams g JOIN (SELECT gram, count(*) AS df FROM grams GROUP BY 1) d ON d.gram = g.gram)""",
)
CTE["wide"] = (
    "topk side",
    """SELECT s1, cand, coalesce(max(score) FILTER (r = 'n'), 0.0) AS blk_name_cos, coalesce(max(score) FILTER (r = 'f'), 0.0) AS blk_full_cos, coalesce(max(score) FILTER (r = 'k'), 0.0) AS key_acronym FROM (
            SELECT s1, c AS cand, round(blk_name / max(blk_score) OVER (PARTITION BY s1), 6) AS score, 'n' AS r FROM topk
            UNION ALL SELECT s1, c, round(blk_score / max(blk_score) OVER (PARTITION BY s1), 6), 'f' FROM topk
            UNION ALL SELECT a.entity_id, b.entity_id, 1.0, 'k' FROM side a JOIN side b ON a.acronym = b.acronym AND a.ckey = b.ckey WHERE a.source = 'S1' AND b.source <> 'S1' AND a.acronym <> '' AND a.ckey <> '')
        WHERE score > 0 GROUP BY 1, 2""",
)
_COUNT = "CAST(CAST(blk_name_cos > 0 AS INT) + CAST(blk_full_cos > 0 AS INT) + CAST(key_acronym > 0 AS INT) AS BIGINT)"
CTE["best"] = (
    "wide",
    f"SELECT s1, cand, blk_name_cos, blk_full_cos, n_retrievers FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(greatest(blk_name_cos, blk_full_cos) + 0.1::DOUBLE * n_retrievers, 6) DESC, cand) AS r FROM (SELECT *, {_COUNT} AS n_retrievers FROM wide)) WHERE r <= 60",
)
CTE["faulty"] = (
    "",
    """SELECT 'S1-' || CAST(doc_id // 2 AS VARCHAR) AS s1, concat_ws(',', printf('S%d-%d', doc_id % 4, doc_id), 'S2-' || CAST(n_chars AS VARCHAR), printf('S%d-%d', n_chars % 3 + 1, n_chars), CASE WHEN doc_id % 10 = 0 THEN 'X9-1' END) AS ids FROM documents""",
)
CTE["ids"] = ("faulty", "SELECT s1, unnest(string_split(ids, ',')) AS id FROM faulty")


def _macro(counts: str, by: str) -> str:
    """counts: (by, s1, n_true, n_pred, tp) of entities that have pairs."""
    return f"""SELECT {by}, round((f + (SELECT count(*) FROM ntrue WHERE n_true = 0) - met_empty) / (SELECT count(*) FROM ntrue), 6) AS macro_f05
        FROM (SELECT {by}, sum({_f05('n_true', 'n_pred', 'tp')}) AS f, count(*) FILTER (n_true = 0) AS met_empty FROM {counts} GROUP BY {by})"""


def _pred(source: str, by: str) -> str:
    return f"(SELECT {by}, s1, n_true, count(*) FILTER (pred) AS n_pred, count(*) FILTER (pred AND label) AS tp FROM {source} JOIN ntrue USING (s1) GROUP BY {by}, s1, n_true)"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def _expected(source: str, by: str, c: str, s: str) -> str:
    """pred by expected F over the entities of source."""
    part = f"PARTITION BY {by}s1"
    return f"""SELECT *, j <= stop AND best > none AS pred FROM (SELECT *, min(CASE WHEN ef >= best - 1e-12 THEN j END) OVER ({part}) AS stop FROM (SELECT *, max(ef) OVER ({part}) AS best FROM (
        SELECT *, 1.25::DOUBLE * sum(q) OVER ({part} ORDER BY p DESC, blk_rank ROWS UNBOUNDED PRECEDING) / (j + 0.25::DOUBLE * (sum(q) OVER ({part}) + {c})) AS ef, {s} * exp(sum(ln(1 - q)) OVER ({part})) AS none
        FROM (SELECT *, least(greatest(p, 0), 1 - 1e-7::DOUBLE) AS q FROM {source}))))"""


def _ratio(pairs: str) -> str:
    """(a, b, ratio) of the pairs: 200 * common subsequence / both lengths, by the row of bits that each letter of b changes, one for each
    letter of a. Up to 120 letters."""
    mask = "list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] = ch THEN 1::HUGEINT << CAST(i - 1 AS HUGEINT) ELSE 0::HUGEINT END))"
    return f"""SELECT a, b, CASE WHEN a = b THEN 100.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * (len(x) - bit_count(list_reduce(masks, lambda v, m: ((v + (v & m)) | (v - (v & m))) & whole, whole))) / (len(x) + len(y)) END AS ratio
        FROM (SELECT *, list_transform(y, lambda ch: {mask}) AS masks, (1::HUGEINT << CAST(len(x) AS HUGEINT)) - 1 AS whole
              FROM (SELECT a, b, string_split(a, '') AS x, string_split(b, '') AS y FROM (SELECT DISTINCT a, b FROM ({pairs}))))"""


def _in_order(words: str) -> str:
    return f"array_to_string(list_sort({words}), ' ')"


def _token_set(pairs: str) -> str:
    """(s, t, score) of the distinct (s, t) of pairs."""
    both = "list_filter(x, lambda w: list_contains(y, w))"
    left, right = "list_filter(x, lambda w: NOT list_contains(y, w))", "list_filter(y, lambda w: NOT list_contains(x, w))"
    sets = f"SELECT s, t, {_in_order(both)} AS i, {_in_order(left)} AS l, {_in_order(right)} AS r, len(x) AS nx, len(y) AS ny FROM (SELECT s, t, list_distinct({_words('s')}) AS x, list_distinct({_words('t')}) AS y FROM (SELECT DISTINCT s, t FROM ({pairs})))"
    sides = f"SELECT *, trim(i || ' ' || l) AS a, trim(i || ' ' || r) AS b FROM ({sets})"
    alone = lambda w: f"CASE WHEN i = '' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * length(i) / (length(i) + length({w})) END"
    return f"""SELECT s, t, CASE WHEN nx = 0 OR ny = 0 THEN 0.0::DOUBLE WHEN i <> '' AND (l = '' OR r = '') THEN 100.0::DOUBLE ELSE greatest(ratio, {alone('z.a')}, {alone('z.b')}) END AS score
        FROM ({sides}) z JOIN ({_ratio(f"SELECT a, b FROM ({sides})")}) k ON k.a = z.a AND k.b = z.b"""


def _simple(cte: str, columns: str) -> str:
    return _with(cte) + f"SELECT {columns} FROM {cte}"


_LEN = lambda x: f"CAST(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END AS DOUBLE)"

_BYTES = "regexp_replace({0}, '[^\\x00-\\x7F]', '#', 'g')"
SQL: dict[str, str] = {
    "norm_clean": _simple("rec", f"entity_id, {_clean('business_name')} AS name, {_clean('business_address')} AS address"),
    "norm_expand": _simple("norm", "entity_id, name, address"),
    "norm_core": _simple("prep", "entity_id, name_core"),
    "norm_numbers": _simple("prep", "entity_id, addr_nums"),
    "norm_first_number": _simple("prep", "entity_id, addr_first_num"),
    "norm_non_ascii": _simple("prep", "entity_id, round(name_non_ascii, 6) AS share"),
    "norm_tokens": _simple("prep", "entity_id, CAST(CASE WHEN name_core = '' THEN 0 ELSE len(string_split(name_core, ' ')) END AS INT) AS name_ntok"),
    "norm_country": _simple("prep", "entity_id, country"),
    "plain_clean": _simple("rec", f"entity_id, {_plain('business_name')} AS name, coalesce(nullif({_plain('country')}, ''), 'unknown') AS country_key"),
    "plain_name_parts": _simple("names", 'entity_id, "full", core, legal'),
    "plain_address": _simple("rec", f"entity_id, array_to_string(CASE WHEN country = 'fr' THEN {_replaced(_plain('business_address'), _TABLES['france'])} ELSE {_replaced(_plain('business_address'), _TABLES['india'])} END, ' ') AS address"),
    "plain_postal": _simple("rec", f"entity_id, {_postal("business_address || ' ' || substr(entity_id, 6, 8)")} AS postal"),
    "plain_acronym": _simple("rec", f"entity_id, {_acronym(_plain('business_name'))} AS acronym, coalesce({_words(_plain('business_name'))}[1], '') AS first_tok"),
    "keys_name": _with("rkeys") + "SELECT entity_id, key FROM rkeys WHERE field = 'n'",
    "keys_addr": _with("rkeys") + "SELECT entity_id, key FROM rkeys WHERE field = 'a'",
    "block_df_idf": _simple("idf", "country, field, key, df, round(idf, 6) AS idf"),
    "block_scores": _simple("scores", "s1, c, round(blk_score, 6) AS blk_score, round(blk_name, 6) AS blk_name, round(blk_addr, 6) AS blk_addr"),
    "block_topk": _simple("topk", "s1, c, round(blk_score, 6) AS blk_score, blk_rank"),
    "block_recall": _with("dec", "ntrue") + "SELECT round(coalesce((SELECT count(*) FILTER (label) FROM dec) / nullif(sum(n_true), 0), 0), 6) AS recall, round((SELECT count(*) FROM dec) / count(*), 6) AS pairs_per_entity, round(avg(CAST(n_true = 0 AS INT)), 6) AS singleton_rate FROM ntrue",
    "tfidf_weights": _simple("weights", "entity_id, gram, round(weight, 6) AS weight"),
    "tfidf_topk": _with("weights") + """, a AS (SELECT gram, ckey, entity_id, weight, source FROM weights JOIN side USING (entity_id))
        SELECT s1, cand, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 6) DESC, cand) AS r FROM (
            SELECT x.entity_id AS s1, y.entity_id AS cand, sum(x.weight * y.weight) AS score FROM a x JOIN a y ON x.gram = y.gram AND x.ckey = y.ckey WHERE x.source = 'S1' AND y.source <> 'S1' GROUP BY 1, 2)) WHERE r <= 30""",
    "key_join_postal": _with("side") + "SELECT a.entity_id AS s1, b.entity_id AS cand FROM side a JOIN side b ON a.postal = b.postal AND a.first_tok = b.first_tok AND a.ckey = b.ckey WHERE a.source = 'S1' AND b.source <> 'S1' AND a.postal <> '' AND a.first_tok <> ''",
    "key_join_acronym": _with("side") + "SELECT a.entity_id AS s1, b.entity_id AS cand FROM side a JOIN side b ON a.acronym = b.acronym AND a.ckey = b.ckey WHERE a.source = 'S1' AND b.source <> 'S1' AND a.acronym <> ''",
    "retriever_pivot": _simple("wide", f"*, {_COUNT} AS n_retrievers"),
    "retriever_topk": _simple("best", "*"),
    "sim_jaro_winkler": _simple("cand", f"s1, c, round(CASE WHEN {_BYTES.format('qn')} = {_BYTES.format('cn')} THEN 1.0 ELSE jaro_winkler_similarity({_BYTES.format('qn')}, {_BYTES.format('cn')}) END, 6) AS name_jw"),
    "sim_jaccard": _simple("cand", f"s1, c, round({_jaccard('qn', 'cn')}, 6) AS name_jacc, round({_jaccard('qa', 'ca')}, 6) AS addr_jacc"),
    "sim_indel": _with("cand") + f"SELECT s1, c, round(ratio, 6) AS name_ratio FROM cand JOIN ({_ratio('SELECT qn AS a, cn AS b FROM cand')}) k ON k.a = qn AND k.b = cn",
    "sim_token_sort": _with("cand") + f", z AS (SELECT s1, c, {_in_order(_words('qn'))} AS a, {_in_order(_words('cn'))} AS b FROM cand) SELECT s1, c, round(ratio, 6) AS name_token_sort FROM z JOIN ({_ratio('SELECT a, b FROM z')}) k ON k.a = z.a AND k.b = z.b",
    "sim_token_set": _with("cand", "prep") + f"""SELECT s1, c, round(n.score, 6) AS name_token_set, round(m.score, 6) AS num_token_set FROM (SELECT cand.*, q.addr_nums AS qm, p.addr_nums AS cm FROM cand JOIN prep q ON q.entity_id = s1 JOIN prep p ON p.entity_id = c) z
        JOIN ({_token_set('SELECT qn AS s, cn AS t FROM cand')}) n ON n.s = qn AND n.t = cn
        JOIN ({_token_set('SELECT q.addr_nums AS s, p.addr_nums AS t FROM cand JOIN prep q ON q.entity_id = s1 JOIN prep p ON p.entity_id = c')}) m ON m.s = qm AND m.t = cm""",
    "feat_gaps": _with("cand") + f"""SELECT s1, c, round(max(blk_score) OVER w - blk_score, 6) AS blk_score_gap, round(blk_score / max(blk_score) OVER w, 6) AS blk_score_rel, CAST(count(*) OVER w AS DOUBLE) AS n_cands,
        CAST(qn = '' OR cn = '' AS DOUBLE) AS name_either_empty, CAST(qf = cf AND qf >= 0 AS DOUBLE) AS first_num_eq, CAST(qf < 0 OR cf < 0 AS DOUBLE) AS first_num_missing, {_LEN('qn')} AS q_name_ntok, {_LEN('cn')} AS c_name_ntok,
        round(CAST(CAST(q_non_ascii AS FLOAT) AS DOUBLE), 6) AS q_name_non_ascii, CAST(c_is_s3 AS DOUBLE) AS c_is_s3 FROM cand WINDOW w AS (PARTITION BY s1)""",
    "feat_group": _with("top") + """, r AS (SELECT *, max(p) FILTER (j = 1) OVER w AS p_1, max(p) FILTER (j = 2) OVER w AS p_2, bool_or(c_is_s3) FILTER (j = 1) OVER w AS s_1, bool_or(c_is_s3) FILTER (j = 2) OVER w AS s_2 FROM top WINDOW w AS (PARTITION BY s1))
        SELECT s1, c, p AS p1, CAST(j - 1 AS DOUBLE) AS p1_rank, round(p_1 - p, 6) AS p1_gap, coalesce(CASE WHEN j = 1 THEN p_2 ELSE p_1 END, 0.0) AS p1_max_other, round(sum(p) OVER w - p, 6) AS p1_sum_other,
            CAST(count(*) FILTER (p >= 0.5) OVER w AS DOUBLE) AS n_p1_05, round(sum(p) OVER (PARTITION BY s1, c_is_s3) - p, 6) AS same_src_p1_sum_other, CASE WHEN j = 1 THEN p_2 ELSE p_1 END AS ref_p1,
            CAST((CASE WHEN j = 1 THEN s_2 ELSE s_1 END) = c_is_s3 AS DOUBLE) AS ref_same_src FROM r WINDOW w AS (PARTITION BY s1)""",
    "feat_plain_context": _with("best", "side") + f""", f AS (
            SELECT b.s1, b.cand, CAST(l.name_core = r.name_core AS DOUBLE) AS core_exact, CASE WHEN l.legal = '' OR r.legal = '' THEN 0.5 ELSE CAST(l.legal = r.legal AS DOUBLE) END AS legal_match,
                CAST(l.acronym <> '' AND (l.acronym = replace(r.name_core, ' ', '') OR r.acronym = replace(l.name_core, ' ', '')) AS DOUBLE) AS acr_match, CAST(l.first_tok = r.first_tok AS DOUBLE) AS first_tok_eq,
                round(least(length(l.name_core), length(r.name_core)) / greatest(length(l.name_core), length(r.name_core), 1), 6) AS len_ratio,
                CASE WHEN l.postal = '' OR r.postal = '' THEN 0.5 ELSE CAST(l.postal = r.postal AS DOUBLE) END AS postal_state, {_jaccard('l.nums', 'r.nums')} AS num_jacc,
                CAST(l.addr = '' AS DOUBLE) + CAST(r.addr = '' AS DOUBLE) AS addr_missing, CAST(r.source = 'S3' AS DOUBLE) AS is_s3, blk_name_cos
            FROM best b JOIN (SELECT *, array_to_string(list_sort(list_distinct(regexp_extract_all(addr, '[0-9]+'))), ' ') AS nums FROM side) l ON l.entity_id = b.s1
            JOIN (SELECT *, array_to_string(list_sort(list_distinct(regexp_extract_all(addr, '[0-9]+'))), ' ') AS nums FROM side) r ON r.entity_id = b.cand
        ), g AS (SELECT *, round(0.7::DOUBLE * coalesce(num_jacc, 0) + 0.3::DOUBLE * blk_name_cos + 1e-9::DOUBLE, 6) AS ctx_base FROM f)
        SELECT s1, cand, core_exact, legal_match, acr_match, first_tok_eq, len_ratio, postal_state, round(num_jacc, 6) AS num_jacc, addr_missing, is_s3, ctx_base, CAST(rank() OVER (PARTITION BY s1 ORDER BY ctx_base DESC) AS DOUBLE) AS ctx_rank_in_s1,
            round(max(ctx_base) OVER (PARTITION BY s1) - ctx_base, 6) AS ctx_gap_to_best, CAST(count(*) FILTER (ctx_base > 0.8) OVER (PARTITION BY s1) AS DOUBLE) AS ctx_n_strong,
            CAST(rank() OVER (PARTITION BY cand ORDER BY ctx_base DESC) AS DOUBLE) AS ctx_rank_in_cand, round(max(ctx_base) OVER (PARTITION BY cand) - ctx_base, 6) AS ctx_gap_cand_best FROM g""",
    "label_pairs": _simple("dec", "s1, c, label"),
    "truth_counts": _simple("ntrue", "s1, n_true"),
    "holdout": _with("rec") + f"SELECT entity_id, {_crc32('entity_id')} % 10 = 0 AS held_out FROM rec",
    "split_roles": _with("rec") + "SELECT entity_id, CASE WHEN k < 80 THEN 'fit' WHEN k < 90 THEN 'tune' ELSE 'report' END AS role FROM (SELECT entity_id, CAST(substr(entity_id, 4, 10) AS BIGINT) % 100 AS k FROM rec WHERE entity_id[1:2] = 'S1')",
    "top_candidate": _with("top") + "SELECT s1, c, p FROM top WHERE j = 1",
    "decide_threshold": _simple("thr", "s1, c, p, pred"),
    "decide_expected_f": _with("top") + f"SELECT s1, c, p, pred FROM ({_expected('top', '', '0.3::DOUBLE', '0.9::DOUBLE')})",
    "decide_one_to_one": _with("dec") + "SELECT s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM (SELECT s1, c AS cand, p, max(p) OVER (PARTITION BY s1) AS best FROM dec WHERE p >= 0.5) WHERE p >= 0.8::DOUBLE * best) WHERE r = 1",
    "tune_thresholds": _with("top", "ntrue") + f", g AS (SELECT *, p >= t_all OR (j = 1 AND p >= t_top) AS pred FROM top, (VALUES {_values(threshold_grid())}) v(t_all, t_top)) " + _macro(_pred("g", "t_all, t_top"), "t_all, t_top"),
    "tune_expected_f": _with("top", "ntrue") + f", m AS (SELECT * FROM top, (VALUES {_values([(c, s) for c in MISSING_GRID for s in EMPTY_GRID])}) v(c_missing, s_empty)), g AS ({_expected('m', 'c_missing, s_empty, ', 'c_missing', 's_empty')}) " + _macro(_pred("g", "c_missing, s_empty"), "c_missing, s_empty"),
    "tune_one_to_one": _with("dec", "ntrue") + f""", m AS (SELECT *, p >= t AS a FROM dec, (VALUES {_values([(t, a, o) for t in PLAIN_T_GRID for a in PLAIN_ALPHA_GRID for o in ('true', 'false')])}) v(t, alpha, one_to_one)),
        n AS (SELECT *, a AND p >= alpha * max(CASE WHEN a THEN p END) OVER (PARTITION BY t, alpha, one_to_one, s1) AS b FROM m),
        g AS (SELECT *, coalesce(b, false) AND (NOT one_to_one OR row_number() OVER (PARTITION BY t, alpha, one_to_one, c ORDER BY coalesce(b, false) DESC, p DESC, s1) = 1) AS pred FROM n) """ + _macro(_pred("g", "t, alpha, one_to_one"), "t, alpha, one_to_one"),
    "score_macro": _simple("ent", "round(avg(f05), 6) AS macro_f05"),
    "score_breakdown": _simple("ent", "round(avg(f05), 6) AS macro_all, round(avg(f05) FILTER (n_true = 0), 6) AS macro_singletons, round(avg(f05) FILTER (n_true > 0), 6) AS macro_matched, count(*) FILTER (n_true = 0) AS n_singletons, count(*) FILTER (n_true > 0) AS n_matched"),
    "score_lists": _simple("ent", "count(*) AS entities, round(avg(f05), 6) AS macro_f05, round(coalesce(sum(tp) / nullif(sum(n_pred), 0), 0), 6) AS pair_precision, round(coalesce(sum(tp) / nullif(sum(n_true), 0), 0), 6) AS pair_recall"),
    "id_lists": _with("thr", "ntrue") + "SELECT n.s1 AS entity_id, coalesce(string_agg(c, ',' ORDER BY blk_rank) FILTER (pred), '') AS ids FROM ntrue n LEFT JOIN thr ON thr.s1 = n.s1 GROUP BY 1",
    "validate_duplicates": _with("faulty") + "SELECT s1 FROM faulty GROUP BY s1 HAVING count(*) > 1",
    "validate_repeated": _with("faulty") + "SELECT DISTINCT s1, id FROM (SELECT s1, r, unnest(string_split(ids, ',')) AS id FROM (SELECT s1, ids, row_number() OVER () AS r FROM faulty)) GROUP BY s1, r, id HAVING count(*) > 1",
    "validate_self": _with("ids") + "SELECT DISTINCT s1, id FROM ids WHERE id LIKE 'S1-%'",
    "validate_foreign": _with("ids") + "SELECT DISTINCT s1, id FROM ids WHERE NOT regexp_matches(id, '^S[123]-')",
    "validate_unknown": _with("ids") + "SELECT DISTINCT s1, id FROM ids WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT 'S2-' || CAST(doc_id AS VARCHAR) FROM labels UNION ALL SELECT 'S3-' || CAST(doc_id AS VARCHAR) FROM labels)",
    "validate_missing": _with("faulty") + "SELECT DISTINCT 'S1-' || CAST(doc_id AS VARCHAR) AS s1 FROM labels WHERE 'S1-' || CAST(doc_id AS VARCHAR) NOT IN (SELECT s1 FROM faulty)",
    "validate_extra": _with("faulty") + "SELECT DISTINCT s1 FROM faulty WHERE s1 NOT IN (SELECT 'S1-' || CAST(doc_id AS VARCHAR) FROM labels)",
    "validate_outside": _with("ids") + "SELECT DISTINCT s1, id FROM ids EXCEPT SELECT s1, string_split(ids, ',')[1] FROM faulty",
}
_PREFILTER = _with("dec", "ntrue") + f""", m AS (SELECT * FROM dec, (VALUES {_values([(t,) for t in PREFILTER_GRID])}) v(p1_cutoff) WHERE p >= p1_cutoff),
    g AS (SELECT *, p >= {RULE['t_all']} OR (row_number() OVER (PARTITION BY p1_cutoff, s1 ORDER BY p DESC, blk_rank) = 1 AND p >= {RULE['t_top']}) AS pred FROM m),
    f AS ({_macro(_pred('g', 'p1_cutoff'), 'p1_cutoff').replace(', 6) AS macro_f05', ', 12) AS macro_f05')}),
    t AS (SELECT p1_cutoff, round(count(*) / (SELECT count(*) FROM ntrue), 3) AS candidates_per_entity, round(count(*) FILTER (label) / greatest((SELECT sum(n_true) FROM ntrue), 1), 4) AS recall_ceiling FROM m GROUP BY 1),
    u AS (SELECT p1_cutoff, candidates_per_entity, recall_ceiling, round(macro_f05, 4) AS macro_f05 FROM t JOIN f USING (p1_cutoff)) """
SQL["prefilter_table"] = _PREFILTER + "SELECT * FROM u"
SQL["choose_prefilter"] = _PREFILTER + "SELECT max(p1_cutoff) AS p1_cutoff FROM u WHERE macro_f05 >= (SELECT macro_f05 FROM u WHERE p1_cutoff = 0) - 0.0001::DOUBLE"
