"""DuckDB SQL for the registered queries, made of shared common table expressions."""

from __future__ import annotations

import math

from ..functions.tokens import ABBREVIATIONS, MAX_PARAGRAPH
from ..operators.dictionary import CONNECTORS, SIGNS
from ..operators.signatures import CAP

_ALNUM = "(({0} BETWEEN '0' AND '9') OR ({0} BETWEEN 'A' AND 'Z') OR ({0} BETWEEN 'a' AND 'z'))"
_DIGIT = "({0} BETWEEN '0' AND '9')"


def _a(c: str) -> str:
    return _ALNUM.format(c)


def _d(c: str) -> str:
    return _DIGIT.format(c)


_LETTER = f"({_a('l1')} AND NOT {_d('l1')})"
_CONNECT = "{0} IN ('-', '&', '''')"

#: tokens(doc_id, idx, type, value): a character table, its neighbours and running counts give each token's characters.
TOKENS = f"""
chars AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS p, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''),
near AS (SELECT *, coalesce(lag(c, 1) OVER w, '') AS l1, coalesce(lag(c, 2) OVER w, '') AS l2, coalesce(lag(c, 3) OVER w, '') AS l3, coalesce(lead(c, 1) OVER w, '') AS r1, coalesce(lead(c, 2) OVER w, '') AS r2
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
marked AS (SELECT *,
  ({_CONNECT.format('c')} AND {_a('l1')} AND {_a('r1')}) OR (c IN (',', '.') AND {_d('l1')} AND {_d('r1')})
    OR (c = '.' AND {_LETTER} AND {_a('r1')} AND (l2 = '.' OR NOT ({_a('l2')} OR ({_CONNECT.format('l2')} AND {_a('l3')})))) AS inner_,
  NOT {_a('l1')} AND ((c IN ('+', '-') AND ({_d('r1')} OR (r1 = '$' AND {_d('r2')}))) OR (c = '$' AND {_d('r1')})) AS np,
  c = '''' AND NOT ({_a('l1')} AND {_a('r1')}) AND {_a('l1')} AS t, c = '''' AND NOT {_a('l1')} AS q FROM near),
quoted AS (SELECT *, coalesce(count(*) FILTER (t) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block,
  last_value(CASE WHEN c <> '-' THEN p END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS solid FROM marked),
absorbed AS (SELECT *, t AND coalesce(sum(q::INT) OVER (PARTITION BY doc_id, block ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS ab FROM quoted),
before AS (SELECT a.*, b.c AS sc, coalesce(b.inner_ OR b.ab OR {_a('b.c')} OR b.c IN (' ', chr(9), chr(10), chr(13)), true) AS open_ FROM absorbed a LEFT JOIN absorbed b ON a.doc_id = b.doc_id AND a.solid = b.p),
prefixed AS (SELECT *, np AND NOT (c = '-' AND l1 = '-' AND open_) AS np2 FROM before),
pre AS (SELECT *, np2 AND NOT coalesce(c = '$' AND lag(np2) OVER (PARTITION BY doc_id ORDER BY p) AND l1 IN ('+', '-'), false) AS first_ FROM prefixed),
classed AS (SELECT *, CASE WHEN {_a('c')} OR inner_ OR ab OR np2 THEN 'W' WHEN c IN (' ', chr(9), chr(10), chr(13)) THEN 'S' ELSE 'P' END AS k FROM pre),
starts AS (SELECT *, (lag(k) OVER w IS DISTINCT FROM k OR first_ OR coalesce(lag(ab) OVER w, false))::INT AS s FROM classed WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
named AS (SELECT doc_id, p, c, k, sum(s) OVER (PARTITION BY doc_id ORDER BY p) - 1 AS idx FROM starts),
raw AS (SELECT doc_id, idx, min(k) AS k, string_agg(c, '' ORDER BY p) AS v FROM named GROUP BY 1, 2),
tokens AS (SELECT doc_id, idx::INT AS idx, CASE k WHEN 'W' THEN 'W' ELSE 'D' END AS type,
  CASE WHEN k = 'W' THEN translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    WHEN k = 'S' THEN CASE length(v) - length(replace(v, chr(10), '')) WHEN 0 THEN CASE WHEN v = ' ' THEN ' ' ELSE chr(9) END WHEN 1 THEN chr(10) ELSE chr(10) || chr(10) END
    WHEN regexp_full_match(v, '\\.{{3,}}') THEN '...' WHEN regexp_full_match(v, '-{{2,}}') THEN '--' ELSE v END AS value FROM raw)"""

_SPACE = "regexp_matches(value, '[ \\t\\r\\n]')"
SEGMENTS = f"""{TOKENS},
around AS (SELECT *, lag(type) OVER w AS pt, lag(value) OVER w AS pv, lead(type) OVER w AS nt, lead(value) OVER w AS nv,
  last_value(CASE WHEN type = 'D' AND {_SPACE} THEN idx END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap,
  last_value(CASE WHEN type = 'D' AND NOT {_SPACE} AND (value = '@' OR contains(value, '://')) THEN idx END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS url
  FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
ended AS (SELECT *, coalesce(CASE WHEN type <> 'D' OR NOT regexp_matches(value, '[.!?]') OR regexp_matches(value, '[.!?].*[,;]', 's') THEN false
  WHEN pt = 'W' AND pv IN ({", ".join(f"'{a}'" for a in sorted(ABBREVIATIONS))}) THEN false
  WHEN pt = 'W' AND contains(pv, '.') THEN nt IS NULL OR (nt = 'D' AND contains(nv, chr(10)))
  WHEN nt = 'W' AND url IS NOT NULL AND (gap IS NULL OR url > gap) THEN false ELSE true END, false) AS ends FROM around),
breaks AS (SELECT *, coalesce(sum(ends::INT) OVER w, 0)::INT AS sentence, coalesce(count(*) FILTER (type = 'D' AND value = chr(10) || chr(10)) OVER w, 0) AS natural_ FROM ended
  WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pieces AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, natural_ ORDER BY idx) - 1) // {MAX_PARAGRAPH} AS piece FROM breaks),
segments AS (SELECT doc_id, idx, type, value, ends, sentence, (dense_rank() OVER (PARTITION BY doc_id ORDER BY natural_, piece) - 1)::INT AS paragraph FROM pieces)"""

_WORDS = "words AS (SELECT value, count(*) AS n FROM tokens WHERE type = 'W' GROUP BY value)"


def cut_off_sql(source: str, keys: list[str], name: str = "cut", min_gap: float = 1.5) -> str:
    """CTEs that end in `name`: keys, n, entropy, gap_ratio, elbow, scaled_mm, adaptive, adaptive_threshold. source: keys, v."""
    k, part = "".join(f"{x}, " for x in keys), "PARTITION BY " + ", ".join(keys) if keys else ""
    by = f"GROUP BY {', '.join(keys)}" if keys else "GROUP BY ALL"
    using = f"JOIN {name}_a USING ({', '.join(keys)})" if keys else f"CROSS JOIN {name}_a"
    return f"""
{name}_r AS (SELECT {k} v::DOUBLE AS v, row_number() OVER o - 1 AS i, lag(v::DOUBLE) OVER o AS earlier, sum(v::DOUBLE) OVER (o ROWS UNBOUNDED PRECEDING) AS mass, count(*) OVER g AS n, max(v::DOUBLE) OVER g AS y0, min(v::DOUBLE) OVER g AS yn, sum(v::DOUBLE) OVER g AS total
  FROM {source} WHERE v IS NOT NULL WINDOW o AS ({part} ORDER BY v DESC), g AS ({part})),
{name}_d AS (SELECT *, CASE WHEN i > 0 AND i < n - 1 AND y0 + (i / greatest(n - 1, 1)) * (yn - y0) - v > 0 THEN y0 + (i / greatest(n - 1, 1)) * (yn - y0) - v END AS d,
  CASE WHEN i > 0 AND earlier > 1e-10 THEN CASE WHEN v <= 0 THEN 'inf'::DOUBLE ELSE earlier / v END END AS g FROM {name}_r),
{name}_m AS (SELECT {k} max(n) AS n, max(y0) AS y0, max(yn) AS yn, max(total) AS total, avg(v) FILTER (i = (n - 1) // 2 OR i = n // 2) AS median, max(d) AS d, min(i + 1) FILTER (mass >= total * 0.5) AS mm, max(g) AS g,
  count(*) FILTER (v > 1e-10) AS over_, count(*) FILTER (v > 0) AS l, sum(v) FILTER (v > 0) AS s, sum(-v * ln(CASE WHEN v > 0 THEN v END)) FILTER (v > 0) AS h FROM {name}_d {by}),
{name}_i AS (SELECT {", ".join(["m." + x for x in keys] + ["min(r.i) FILTER (r.d = m.d) AS di", "min(r.i) FILTER (r.g = m.g) AS gi"])} FROM {name}_d r JOIN {name}_m m {"USING (" + ", ".join(keys) + ")" if keys else "ON true"} {"GROUP BY " + ", ".join("m." + x for x in keys) if keys else ""}),
{name}_c AS (SELECT {k} n::BIGINT AS n, CASE WHEN l = 0 THEN 0 WHEN round(exp(ln(s) + h / s), 9) <= 1 THEN 1 ELSE least(ceil(round(exp(ln(s) + h / s), 9)), l) END::BIGINT AS entropy,
  CASE WHEN n < 2 THEN n ELSE greatest(least(CASE WHEN g IS NULL OR g < {min_gap!r} THEN n ELSE gi END, n, over_ + 1), 1) END::BIGINT AS gap_ratio,
  CASE WHEN n < 3 OR y0 - yn <= 1e-12 OR d IS NULL OR d < 0.01::DOUBLE * median THEN n ELSE di END::BIGINT AS elbow,
  CASE WHEN total <= 0 THEN n ELSE least(ceil(2.2::DOUBLE * coalesce(mm, n)), n) END::BIGINT AS scaled_mm FROM {name}_m {"JOIN " + name + "_i USING (" + ", ".join(keys) + ")" if keys else "CROSS JOIN " + name + "_i"}),
{name}_a AS (SELECT *, CASE WHEN elbow < n THEN elbow ELSE scaled_mm END AS adaptive FROM {name}_c),
{name} AS (SELECT {"".join(f"{name}_a.{x}, " for x in keys)} {name}_a.* EXCLUDE ({", ".join(keys)}) , coalesce((SELECT max(v) FROM {name}_r r WHERE r.i = {name}_a.adaptive {"".join(f"AND r.{x} = {name}_a.{x} " for x in keys)}), 0.0) AS adaptive_threshold FROM {name}_a)""".replace(" EXCLUDE ()", "")


_ATOMS = f"""
signs AS (SELECT unnest(range(0, {len(SIGNS)})) AS k, unnest(string_split('{SIGNS.replace("'", "''")}', '')) AS c),
atoms AS (SELECT k AS part_id, 'Whole' AS kind, c AS value FROM signs
  UNION ALL SELECT {len(SIGNS)} + 3 * k + j, 'Letter', CASE j WHEN 0 THEN c || '##' WHEN 1 THEN '##' || c || '##' ELSE '##' || c END FROM signs, (SELECT unnest([0, 1, 2]) AS j)
  UNION ALL SELECT {4 * len(SIGNS)} + k - {len(SIGNS) - len(CONNECTORS)}, 'Delimiter', c FROM signs WHERE k >= {len(SIGNS) - len(CONNECTORS)})"""

_WHOLES = f"""{_WORDS}, candidates AS (SELECT value, n, n AS v FROM words WHERE length(value) BETWEEN 2 AND 16), {cut_off_sql("candidates", [])},
ranked AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM candidates),
wholes AS (SELECT value, ranked.n AS n, rank FROM ranked, cut WHERE rank <= adaptive)"""



def bins_sql(runs: str, name: str) -> str:
    """CTEs that end in `name`: length, kind, value, weight of the pieces of runs (w, n, a, b)."""
    return f"""
{name}_p AS (SELECT w, n, a, b, len AS length, p FROM (SELECT *, unnest(range(a, b - len + 1)) AS p FROM (SELECT *, unnest(range(2, least(7, b - a) + 1)) AS len FROM {runs} WHERE b - a >= 2))),
{name} AS (SELECT length, kind, value, sum(n)::BIGINT AS weight FROM (
  SELECT length, 'Mid' AS kind, substr(w, p + 1, length) AS value, n FROM {name}_p
  UNION ALL SELECT length, 'Start', substr(w, p + 1, length), n FROM {name}_p WHERE p = 0
  UNION ALL SELECT length, 'End', substr(w, p + 1, length), n FROM {name}_p WHERE p + length = length(w)) GROUP BY 1, 2, 3)"""


def peel_sql(bins: str, name: str) -> str:
    """CTEs that end in `name`: length, kind, value, weight, rank of the bins that are promoted."""
    return f"""
{name}_v AS (SELECT *, weight AS v FROM {bins}), {cut_off_sql(name + "_v", ["length", "kind"], name + "_c")},
{name} AS (SELECT length, kind, value, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY length, kind ORDER BY weight DESC, value) AS rank FROM {bins}) JOIN {name}_c USING (length, kind) WHERE rank <= adaptive)"""


#: words, and parts: the dictionary of one round of peeling.
_DICT = f"""{_WHOLES}, {_ATOMS},
loose AS (SELECT value AS w, n, 0 AS a, length(value) AS b FROM words WHERE value NOT IN (SELECT value FROM wholes) AND value NOT IN (SELECT value FROM atoms WHERE kind = 'Whole')),
{bins_sql("loose", "bins")}, {peel_sql("bins", "promoted")},
delims AS (SELECT value, count(*) AS n FROM tokens WHERE type = 'D' GROUP BY value),
listed AS (SELECT 0 AS g, rank AS a, 0 AS b, 0 AS c, 'Whole' AS kind, value FROM wholes
  UNION ALL SELECT 1, part_id, 0, 0, kind, value FROM atoms WHERE part_id < {4 * len(SIGNS)}
  UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, value), 0, 0, 'Delimiter', value FROM delims
  UNION ALL SELECT 3, part_id, 0, 0, kind, value FROM atoms WHERE kind = 'Delimiter'
  UNION ALL SELECT 4, -length, CASE kind WHEN 'Start' THEN 0 WHEN 'Mid' THEN 1 ELSE 2 END, rank, kind, value FROM promoted),
parts AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY g, a, b, c) - 1)::INT AS part_id, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY g, a, b, c) AS nth FROM listed) WHERE nth = 1)"""


def spelt_sql(parts: str = "parts", name: str = "s") -> str:
    """CTEs that end in {name}_spelt: w, place, part; {name}_open: w, got (the claims) of words that are no part; {name}_runs: w, a, b that no part claims."""
    inside = "len(list_filter(got, lambda g: g.a <= p AND p < g.b)) > 0"
    has = "len(list_filter(got, lambda g: g.kind = '{0}')) > 0"
    return f"""
{name}_whole AS (SELECT words.value AS w, part_id FROM words JOIN {parts} p ON p.kind = 'Whole' AND p.value = words.value),
{name}_subs AS (SELECT w, len, unnest(range(0, length(w) - len + 1)) AS a FROM (SELECT value AS w, unnest(range(2, least(7, length(value)) + 1)) AS len FROM words WHERE value NOT IN (SELECT w FROM {name}_whole))),
{name}_cand AS MATERIALIZED (SELECT w, part_id, a, a + len AS b, kind, row_number() OVER (PARTITION BY w ORDER BY part_id, a) AS k FROM {name}_subs JOIN {parts} p ON p.value = substr(w, a + 1, len)
  WHERE kind = 'Mid' OR (kind = 'Start' AND a = 0) OR (kind = 'End' AND a + len = length(w))),
{name}_fold AS (SELECT value AS w, 0::BIGINT AS k, []::STRUCT(a BIGINT, b BIGINT, id INT, kind VARCHAR)[] AS got FROM words WHERE value NOT IN (SELECT w FROM {name}_whole)
  UNION ALL SELECT f.w, o.k, CASE WHEN len(list_filter(f.got, lambda g: (g.kind = o.kind AND o.kind <> 'Mid') OR (g.a < o.b AND o.a < g.b))) > 0 THEN f.got
    ELSE list_append(f.got, struct_pack(a := o.a::BIGINT, b := o.b::BIGINT, id := o.part_id::INT, kind := o.kind)) END FROM {name}_fold f JOIN {name}_cand o ON o.w = f.w AND o.k = f.k + 1),
{name}_open AS MATERIALIZED (SELECT w, arg_max(got, k) AS got FROM {name}_fold GROUP BY w),
{name}_free AS (SELECT w, p, got FROM (SELECT w, got, unnest(range(0, length(w))) AS p FROM {name}_open) WHERE NOT {inside}),
{name}_runs AS (SELECT w, min(p) AS a, max(p) + 1 AS b FROM (SELECT w, p, p - row_number() OVER (PARTITION BY w ORDER BY p) AS g FROM {name}_free) GROUP BY w, g),
{name}_spelt AS MATERIALIZED (SELECT w, 0 AS place, part_id AS part FROM {name}_whole
  UNION ALL SELECT w, g.a, g.id FROM (SELECT w, unnest(got) AS g FROM {name}_open)
  UNION ALL SELECT w, p, part_id FROM {name}_free JOIN {parts} q ON q.kind = 'Letter' AND q.value = CASE WHEN p = 0 AND NOT {has.format("Start")} THEN substr(w, p + 1, 1) || '##'
    WHEN p = length(w) - 1 AND NOT {has.format("End")} THEN '##' || substr(w, p + 1, 1) ELSE '##' || substr(w, p + 1, 1) || '##' END)"""


def bags_sql(name: str = "s") -> str:
    return f"(SELECT w, string_agg(part, ',' ORDER BY part) AS bag, count(*) AS size FROM (SELECT DISTINCT w, part FROM {name}_spelt) GROUP BY w)"


def collisions_sql(bags: str, keys: str = "") -> str:
    """keys: columns of bags, each with a comma."""
    by = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"SELECT {keys} coalesce(sum(k), 0)::BIGINT AS words, count(*) AS bags, count(*) FILTER (k > 1) AS colliding_bags, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS colliding_words, coalesce(round(100 * coalesce(sum(k) FILTER (k > 1), 0) / nullif(sum(k), 0)::DOUBLE, 6), 0.0) AS rate FROM (SELECT {keys} bag, count(*) AS k FROM {bags} GROUP BY ALL) {by}"


_SPELT = f"{_DICT}, {spelt_sql()}"
#: Words as bags of the fixed signs alone, where many words share one.
_SIGNED = f"""{TOKENS}, {_WORDS}, {_ATOMS},
lettered AS (SELECT x.value AS w, part_id AS part FROM (SELECT value, unnest(range(1, length(value) + 1)) AS p FROM words) x JOIN atoms a ON a.kind = CASE WHEN length(x.value) = 1 THEN 'Whole' ELSE 'Letter' END
  AND a.value = CASE WHEN length(x.value) = 1 THEN x.value WHEN p = 1 THEN substr(x.value, p, 1) || '##' WHEN p = length(x.value) THEN '##' || substr(x.value, p, 1) ELSE '##' || substr(x.value, p, 1) || '##' END),
signed AS (SELECT w, string_agg(part, ',' ORDER BY part) AS bag FROM (SELECT DISTINCT w, part FROM lettered) GROUP BY w)"""


def _placed(bagged: str) -> str:
    """held: doc_id, sentence, idx, part; places and spans of words and of parts in sentences."""
    return f"""
held AS (SELECT DISTINCT doc_id, sentence, idx, part FROM segments JOIN {bagged} ON value = w WHERE type = 'W'),
places AS (SELECT doc_id, sentence, idx, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY idx) AS ord, count(*) OVER (PARTITION BY doc_id, sentence) AS words FROM segments WHERE type = 'W'),
spans AS (SELECT doc_id, sentence, part, min(ord) AS first_, max(ord) AS last_, count(*) AS n, max(words) AS words FROM held JOIN places USING (doc_id, sentence, idx) GROUP BY 1, 2, 3)"""


def _sigs(f: str) -> str:
    return f"""
sig AS (SELECT doc_id, sentence, idx, bit FROM (
  SELECT doc_id, sentence, idx, part AS bit FROM places JOIN spans USING (doc_id, sentence) WHERE first_ < ord
  UNION ALL SELECT doc_id, sentence, idx, part + {f} FROM held
  UNION ALL SELECT doc_id, sentence, idx, part + 2 * {f} FROM places JOIN spans USING (doc_id, sentence) WHERE last_ > ord))"""


_F = "(SELECT count(*) FROM parts)"
_ATOMS_SPELT = f"{_SIGNED.removeprefix(TOKENS + ', ' + _WORDS + ', ')}, {_placed('lettered')}, {_sigs(str(4 * len(SIGNS) + len(CONNECTORS)))}"
_BAGS = f"{SEGMENTS}, {_SPELT}, {_placed('s_spelt')}"
_DF = f"""{_BAGS},
df AS (SELECT bit::INT AS bit, sum(n)::BIGINT AS df FROM (SELECT part AS bit, words - first_ AS n FROM spans UNION ALL SELECT part + {_F}, n FROM spans UNION ALL SELECT part + 2 * {_F}, last_ - 1 FROM spans) GROUP BY 1 HAVING sum(n) > 0),
weights AS (SELECT bit, df, CASE WHEN max(s) OVER () <= 0 THEN 1 ELSE least(greatest(floor(1.5 + {CAP - 1}.0 * (s / max(s) OVER ())), 1), {CAP}) END::INT AS w
  FROM (SELECT bit, df, round(ln((SELECT count(*) FROM places)::DOUBLE / df), 12) AS s FROM df))"""
_SIGS = f"{_DF}, {_sigs(_F)}"
_BAND_SUMS = "WITH RECURSIVE {0} SELECT doc_id, sentence, idx, count(bit) AS n_bits, coalesce(sum(bit), 0)::BIGINT AS bit_sum FROM places LEFT JOIN (SELECT * FROM sig WHERE bit // {1} = {2}) USING (doc_id, sentence, idx) GROUP BY 1, 2, 3"
_ROUND = "SELECT {0} FROM orders GROUP BY o_orderpriority, o_custkey"

SQL: dict[str, str] = {
    "scan_documents": "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes FROM documents",
    "ascii_lower": "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents",
    "tokenize": f"WITH {TOKENS} SELECT doc_id, idx, type, value FROM tokens",
    "word_freq": f"WITH {TOKENS} SELECT value, count(*) AS n FROM tokens WHERE type = 'W' GROUP BY value",
    "delim_freq": f"WITH {TOKENS} SELECT value, count(*) AS n FROM tokens WHERE type = 'D' GROUP BY value",
    "token_totals": f"WITH {TOKENS} SELECT doc_id, count(*) AS tokens, count(*) FILTER (type = 'W') AS words, count(*) FILTER (type = 'D') AS delims, count(DISTINCT value) FILTER (type = 'W') AS distinct_words FROM tokens GROUP BY doc_id",
    "sentence_ends": f"WITH {SEGMENTS} SELECT doc_id, idx FROM segments WHERE ends",
    "sentences": f"WITH {SEGMENTS} SELECT doc_id, sentence, min(idx) AS start_tok, max(idx) + 1 AS end_tok FROM segments GROUP BY 1, 2",
    "paragraphs": f"WITH {SEGMENTS} SELECT doc_id, paragraph, min(idx) AS start_tok, max(idx) + 1 AS end_tok FROM segments GROUP BY 1, 2",
    "candidate_count": f"WITH {TOKENS} SELECT doc_id, 2 * count(*) FILTER (type = 'W') AS candidates FROM tokens GROUP BY doc_id",
    "multiscale_candidates": f"WITH {SEGMENTS} SELECT scale, doc_id, span, count(*) AS signatures FROM (SELECT 'sentence' AS scale, doc_id, sentence AS span FROM segments WHERE type = 'W' UNION ALL SELECT 'paragraph', doc_id, paragraph FROM segments WHERE type = 'W') GROUP BY ALL",
    "cut_offs": f"WITH o AS ({_ROUND.format('o_orderpriority, count(*) AS v')}), {cut_off_sql('o', ['o_orderpriority'])} SELECT o_orderpriority, n, entropy, gap_ratio, elbow, scaled_mm, adaptive, adaptive_threshold FROM cut",
    "top_k_indices": "SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 10",
    "whole_atoms": f"WITH {TOKENS}, {_WHOLES} SELECT value, n, rank FROM wholes",
    "vocab_ranked": f"WITH {TOKENS}, {_WORDS} SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM words",
    "augment_set": f"WITH {_ATOMS} SELECT part_id::INT AS part_id, kind, value FROM atoms",
    "render_parts": f"WITH {TOKENS}, {_DICT} SELECT part_id, CASE kind WHEN 'Delimiter' THEN '[delim:' || value || ']' WHEN 'Start' THEN value || '##' WHEN 'End' THEN '##' || value WHEN 'Mid' THEN '##' || value || '##' ELSE value END AS text FROM parts",
    "kind_counts": f"WITH {TOKENS}, {_DICT} SELECT kind, count(*) AS n FROM parts GROUP BY kind",
    "dict_ids": f"WITH {TOKENS}, {_DICT} SELECT part_id, kind, value FROM parts",
    "words_only": f"WITH {SEGMENTS} SELECT doc_id, sentence, idx, value FROM segments WHERE type = 'W'",
    "token_totals_all": f"WITH {TOKENS} SELECT count(*) AS tokens, count(*) FILTER (type = 'W') AS words, count(*) FILTER (type = 'D') AS delims, count(DISTINCT value) FILTER (type = 'W') AS distinct_words FROM tokens",
    "peel_bins": f"WITH {TOKENS}, {_DICT} SELECT length::INT AS length, kind, value, weight FROM bins",
    "decompose_words": f"WITH RECURSIVE {TOKENS}, {_SPELT} SELECT words.value, n, part_ids, bag FROM words JOIN (SELECT w, string_agg(part, ',' ORDER BY place, part) AS part_ids FROM s_spelt GROUP BY w) x ON x.w = words.value JOIN {bags_sql()} y ON y.w = words.value",
    "singleton_runs": f"WITH RECURSIVE {TOKENS}, {_SPELT} SELECT w AS value, a::INT AS a, b::INT AS b FROM s_runs",
    "peel_iteration_2": f"WITH RECURSIVE {TOKENS}, {_SPELT}, again AS (SELECT w, n, a, b FROM s_runs JOIN words ON value = w), {bins_sql('again', 'bins2')}, {peel_sql('bins2', 'promoted2')} SELECT length::INT AS length, kind, value, weight, rank FROM promoted2",
    "decompose_delims": f"WITH {TOKENS}, {_ATOMS}, d AS (SELECT value, count(*) AS n FROM tokens WHERE type = 'D' GROUP BY value), k AS (SELECT part_id, value AS c FROM atoms WHERE kind = 'Delimiter'), x AS (SELECT value, unnest(range(1, length(value) + 1)) AS p FROM d WHERE value NOT IN (SELECT c FROM k)), y AS (SELECT value, string_agg(part_id, ',' ORDER BY p) AS ids FROM x JOIN k ON c = substr(value, p, 1) GROUP BY value) SELECT d.value, n, coalesce(part_id::VARCHAR, ids, '') AS part_ids FROM d LEFT JOIN k ON c = d.value LEFT JOIN y ON y.value = d.value",
    "bag_size_percentiles": f"WITH RECURSIVE {TOKENS}, {_SPELT}, x AS (SELECT list_sort(list(size)) AS k, count(*) AS n, round(avg(size), 6) AS mean FROM {bags_sql()}) SELECT n AS words, k[1]::INT AS least, mean, k[least(n * 50 // 100, n - 1) + 1]::INT AS p50, k[least(n * 90 // 100, n - 1) + 1]::INT AS p90, k[least(n * 99 // 100, n - 1) + 1]::INT AS p99, k[n]::INT AS most FROM x WHERE n > 0",
    "top_collisions": f"WITH RECURSIVE {TOKENS}, {_SPELT}, g AS (SELECT bag, count(*) AS k, list_sort(list(w))[:8] AS ws FROM {bags_sql()} GROUP BY bag HAVING count(*) > 1) SELECT row_number() OVER (ORDER BY k DESC, bag) AS rank, bag, k, array_to_string(ws, ' ') AS words FROM g ORDER BY rank LIMIT 20",
    "bag_collisions_by_lang": f"WITH RECURSIVE {TOKENS}, {_SPELT}, b AS {bags_sql()}, lw AS (SELECT DISTINCT coalesce(lang, '') AS lang, value AS w FROM tokens JOIN documents USING (doc_id) WHERE type = 'W') {collisions_sql('(SELECT lang, bag FROM lw JOIN b USING (w))', 'lang, ')}",
    "peel_iteration_1": f"WITH {TOKENS}, {_DICT} SELECT length::INT AS length, kind, value, weight, rank FROM promoted",
    "word_bags": f"WITH RECURSIVE {_BAGS} SELECT doc_id, sentence, idx, string_agg(part, ',' ORDER BY part) AS bag FROM held GROUP BY 1, 2, 3",
    "bag_collisions": f"WITH {_SIGNED} SELECT words, bags, colliding_bags, colliding_words FROM ({collisions_sql('signed')})",
    "encode_3f": f"WITH RECURSIVE {_SIGS} SELECT doc_id, sentence, idx, count(*) AS n_bits, sum(bit)::BIGINT AS bit_sum, sum(bit::BIGINT * bit)::BIGINT AS bit_squares FROM sig GROUP BY 1, 2, 3",
    "bit_df": f"WITH RECURSIVE {_DF} SELECT bit, df FROM df",
    "surprisal_weights": f"WITH RECURSIVE {_DF} SELECT bit, df, w FROM weights",
    "info_content": f"WITH RECURSIVE {_SIGS} SELECT doc_id, sentence, idx, sum(w)::BIGINT AS ic FROM sig JOIN weights USING (bit) GROUP BY 1, 2, 3",
    "gram": "WITH c AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT (a.k - 1)::INT AS i, (b.k - 1)::INT AS j, round(sum(a.x * b.x), 4) AS x FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2",
}

for _k, _name in enumerate(("sig_before", "sig_current", "sig_after")):
    SQL[_name] = _BAND_SUMS.format(_SIGS, _F, _k)
_ORDERS = {"original": "part_id", "type": "movable, kind_, part_id", "type_level": "movable, kind_, level_, part_id", "level_type": "movable, level_, kind_, part_id"}
_KEYED = "keyed AS (SELECT *, kind IN ('Start', 'Mid', 'End') AS movable, CASE kind WHEN 'Start' THEN 0 WHEN 'End' THEN 1 WHEN 'Mid' THEN 2 ELSE 0 END AS kind_, CASE WHEN kind IN ('Start', 'Mid', 'End') THEN -length(value) ELSE 0 END AS level_ FROM parts)"
SQL["strategy_summary"] = f"WITH RECURSIVE {TOKENS}, {_DICT}, {_KEYED}, " + ", ".join(f"{n}_parts AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY {o}) - 1)::INT AS part_id, kind, value FROM keyed), {spelt_sql(n + '_parts', n)}" for n, o in _ORDERS.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, * FROM ({collisions_sql(bags_sql(n))})" for n in _ORDERS)

_MIXED = """
kinds AS (SELECT DISTINCT unnest(['Whole', 'Start', 'End', 'Mid']) AS kind, unnest([t, substr(t, 1, 3), right(t, 3), substr(t, 4, 2 + length(t) % 3)]) AS value FROM (SELECT DISTINCT lower(p_type) AS t FROM part)),
parts AS (SELECT (row_number() OVER (ORDER BY md5(kind || ' ' || value)) - 1)::INT AS part_id, kind, value FROM kinds WHERE value <> '')"""
_KIND = "CASE kind WHEN 'Start' THEN 0 WHEN 'End' THEN 1 WHEN 'Mid' THEN 2 ELSE 0 END"
_LEVEL = "CASE WHEN kind = 'Whole' THEN 0 ELSE -length(value) END"
for _name, _keys in (("type", _KIND), ("type_level", f"{_KIND}, {_LEVEL}"), ("level_type", f"{_LEVEL}, {_KIND}")):
    SQL[f"reorder_{_name}"] = f"WITH {_MIXED} SELECT (row_number() OVER (ORDER BY kind <> 'Whole', {_keys}, part_id) - 1)::INT AS part_id, kind, value, part_id AS old_id FROM parts"
SQL["part_candidates"] = f"""WITH {_MIXED}, w AS (SELECT DISTINCT lower(p_type) AS word FROM part), l AS (SELECT word, unnest(range(2, least(7, length(word)) + 1)) AS len FROM w), p AS (SELECT word, len, unnest(range(0, length(word) - len + 1)) AS place FROM l)
SELECT word, part_id, kind, place::INT AS place, len::INT AS length FROM p JOIN parts ON parts.value = substr(word, place + 1, len) WHERE kind = 'Mid' OR (kind = 'Start' AND place = 0) OR (kind = 'End' AND place + len = length(word))"""
SQL["dict_lookup"] = f"WITH {_MIXED}, w AS (SELECT lower(substr(p_type, 1, 3)) AS value, 'Start' AS kind FROM part UNION SELECT lower(n_name), 'Whole' FROM nation) SELECT kind, value, coalesce(part_id, -1) AS part_id FROM w LEFT JOIN parts USING (kind, value)"

_TALK = """
s AS (SELECT conv_id * 1000 + turn AS id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: (length(w) * 26 + ascii(w) - 97)::INT))) AS bits FROM conversations),
book AS (SELECT item_id::INT AS atom_id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: (length(w) * 26 + ascii(w) - 97)::INT)))[:24] AS bits FROM benchmark),
sb AS (SELECT id, unnest(bits) AS bit FROM s), bb AS (SELECT atom_id, unnest(bits) AS bit FROM book),
sdf AS (SELECT bit, count(*) AS df FROM sb GROUP BY bit),
sw AS (SELECT bit, df, CASE WHEN max(x) OVER () <= 0 THEN 1 ELSE least(greatest(floor(1.5 + 7.0 * (x / max(x) OVER ())), 1), 8) END::INT AS w FROM (SELECT bit, df, round(ln((SELECT count(*) FROM s)::DOUBLE / df), 12) AS x FROM sdf)),
ics AS (SELECT atom_id, sum(w) AS ic FROM bb JOIN sw USING (bit) GROUP BY 1),
scored AS (SELECT id, atom_id, sum(w)::BIGINT AS wdot, any_value(ic)::BIGINT AS ic FROM sb JOIN bb USING (bit) JOIN sw USING (bit) JOIN ics USING (atom_id) GROUP BY 1, 2 HAVING sum(w) > 0),
best AS (SELECT id, arg_max(wdot, wdot / ic) AS bw, arg_max(ic, wdot / ic) AS bi FROM scored GROUP BY 1),
fired AS (SELECT id, atom_id FROM scored JOIN best USING (id) WHERE wdot * 10 * bi >= 9 * bw * ic),
dec AS (SELECT DISTINCT id, bit FROM fired JOIN bb USING (atom_id))"""
_BAND = "{0}(CASE WHEN {1} THEN w ELSE 0 END)"


def _metric(band: str, side: str) -> str:
    return f"round(coalesce(sum(CASE WHEN {band} AND t AND r THEN w ELSE 0 END) / nullif(sum(CASE WHEN {band} AND {side} THEN w ELSE 0 END), 0), 1.0), 9)"


_METRICS = ", ".join(f"{_metric(cond, side)} AS {what}_{name}" for name, cond in (("left", "bit < 150"), ("current", "bit >= 150 AND bit < 300"), ("right", "bit >= 300"), ("all", "true")) for what, side in (("recall", "t"), ("precision", "r")))
SQL |= {
    "atom_normalize": f"WITH {_TALK} SELECT atom_id, array_to_string(bits, ',') AS bits FROM book",
    "bit_degree": f"WITH {_TALK} SELECT bit, count(*) AS atoms FROM bb GROUP BY bit",
    "pursuit_candidates": f"WITH {_TALK} SELECT id, atom_id, wdot, ic FROM scored",
    "pursuit_round1": f"WITH {_TALK} SELECT id, atom_id FROM fired",
    "union_decode": f"WITH {_TALK} SELECT id, string_agg(bit, ',' ORDER BY bit) AS bits FROM dec GROUP BY id",
    "residual_bits": f"WITH {_TALK} SELECT id, bit FROM sb ANTI JOIN dec USING (id, bit)",
    "recon_metrics": f"WITH {_TALK}, both_ AS (SELECT id, bit, t IS NOT NULL AS t, r IS NOT NULL AS r, coalesce(w, 0) AS w FROM (SELECT id, bit, true AS t FROM sb) FULL JOIN (SELECT id, bit, true AS r FROM dec) USING (id, bit) LEFT JOIN sw USING (bit)) SELECT id, {_METRICS} FROM both_ GROUP BY id",
    "info_jaccard": f"WITH {_TALK}, pairs AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON y.id = x.id + 1), c AS (SELECT a, b, sum(w)::BIGINT AS wdot FROM pairs JOIN sb x ON x.id = a JOIN sb y ON y.id = b AND y.bit = x.bit JOIN sw ON sw.bit = x.bit GROUP BY 1, 2), i AS (SELECT id, sum(w) AS ic FROM sb JOIN sw USING (bit) GROUP BY 1) SELECT a, b, coalesce(wdot, 0) AS wdot, round(CASE WHEN wdot > 0 THEN wdot / (x.ic + y.ic - wdot) ELSE 0.0 END, 9)::DOUBLE AS jaccard FROM pairs LEFT JOIN c USING (a, b) LEFT JOIN i x ON x.id = a LEFT JOIN i y ON y.id = b",
    "top_d_bits": f"WITH {_TALK} SELECT id, bit, rank FROM (SELECT id, bit, row_number() OVER (PARTITION BY id ORDER BY w DESC, bit) AS rank FROM sb JOIN sw USING (bit)) WHERE rank <= 8",
    "weights_rescaled": f"WITH {_TALK} SELECT bit, round(w / max(w) OVER (), 9)::DOUBLE AS scaled FROM sw",
    "surprisal": "SELECT DISTINCT l_discount::DOUBLE AS p, CASE WHEN l_discount > 0 THEN round(-ln(l_discount::DOUBLE), 9) ELSE 'inf'::DOUBLE END AS bits FROM lineitem",
    "bit_cooccurrence": f"WITH {_TALK} SELECT a.bit AS i, b.bit AS j, count(*) AS n FROM sb a JOIN sb b ON a.id = b.id AND a.bit <= b.bit GROUP BY 1, 2",
    "context_jaccard": f"WITH {SEGMENTS}, {_WORDS}, {_ATOMS_SPELT}, first_ AS (SELECT doc_id, value, sentence, min(idx) AS idx FROM segments WHERE type = 'W' GROUP BY 1, 2, 3), f AS (SELECT first_.*, list(bit) AS bits FROM first_ JOIN sig USING (doc_id, sentence, idx) GROUP BY ALL) SELECT x.doc_id AS item_id, x.value, x.sentence AS a, y.sentence AS b, round(len(list_intersect(x.bits, y.bits)) / (len(x.bits) + len(y.bits) - len(list_intersect(x.bits, y.bits)))::DOUBLE, 9) AS jaccard FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.value = y.value AND x.sentence < y.sentence".replace("FROM documents WHERE text <> ''", "FROM (SELECT item_id AS doc_id, text FROM benchmark) WHERE text <> ''"),
}
_CUT = "SELECT o_orderpriority, coalesce((SELECT max(v) FROM cut_r r WHERE r.i = c.{0} AND r.o_orderpriority = c.o_orderpriority), 0.0) AS threshold FROM cut c"
_COUNTS = _ROUND.format("o_orderpriority, count(*) AS v")
_LIMITED = "o AS (SELECT o_orderpriority, v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY v DESC) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS every FROM ({0})), few AS (SELECT o_orderpriority, v FROM o WHERE k <= 5)"
_FACTOR = "f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, embedding FROM embeddings), cells AS (SELECT r, unnest(range(0, len(embedding))) AS bit, unnest(embedding)::DOUBLE AS x FROM f)"
_DELIMS = f"{TOKENS}, d AS (SELECT value, count(*) AS n FROM tokens WHERE type = 'D' GROUP BY value)"
_SPACES = "(' ', chr(9), chr(10), chr(10) || chr(10))"
_NEXT = "pairs AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON y.id = x.id + 1)"
_OWN = "own AS (SELECT * FROM parts p WHERE kind <> 'Letter' AND NOT EXISTS (SELECT 1 FROM atoms a WHERE a.kind = p.kind AND a.value = p.value))"
_ESCAPED = "replace(replace(replace(replace(value, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r')"
_RELOADED = f"WITH {TOKENS}, {_DICT}, {_OWN}, l AS (<own> UNION ALL SELECT 3, part_id, kind, value FROM atoms) SELECT (row_number() OVER (ORDER BY g, part_id) - 1)::INT AS part_id, kind, value FROM l"
_MASS = "mass AS (SELECT atom_id, bit, sum(w)::DOUBLE AS mass FROM fired JOIN sb USING (id) JOIN sw USING (bit) GROUP BY 1, 2)"
SQL |= {
    "entropy_threshold": f"WITH o AS ({_COUNTS}), {cut_off_sql('o', ['o_orderpriority'])} {_CUT.format('entropy')}",
    "log_gap_threshold": f"WITH o AS ({_COUNTS}), {cut_off_sql('o', ['o_orderpriority'], min_gap=math.exp(0.25))} {_CUT.format('gap_ratio')}",
    "cut_offs_limited": f"WITH {_LIMITED.format(_COUNTS)}, {cut_off_sql('few', ['o_orderpriority'])} SELECT o_orderpriority, max(every) AS n, any_value(entropy) AS entropy, any_value(gap_ratio) AS gap_ratio FROM cut JOIN (SELECT DISTINCT o_orderpriority, every FROM o) USING (o_orderpriority) GROUP BY 1",
    "scan_words": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS word FROM l) SELECT doc_id, line::INT AS line, rtrim(word, chr(13)) AS word FROM x WHERE rtrim(word, chr(13)) <> ''",
    "tok_ws_class": f"WITH {_DELIMS} SELECT value, n FROM d WHERE value IN {_SPACES}",
    "tok_punct_class": f"WITH {_DELIMS} SELECT value, n FROM d WHERE value NOT IN {_SPACES}",
    "tok_number_prefix": f"WITH {TOKENS} SELECT doc_id, idx, value FROM tokens WHERE type = 'W' AND substr(value, 1, 1) IN ('+', '-', '$')",
    "dict_trained_only": f"WITH {TOKENS}, {_DICT} SELECT part_id, kind, value FROM parts p WHERE NOT EXISTS (SELECT 1 FROM atoms a WHERE a.kind = p.kind AND a.value = p.value)",
    "dict_text_lines": f"WITH {TOKENS}, {_DICT}, {_OWN}, l AS (SELECT 0 AS g, part_id, CASE kind WHEN 'Start' THEN value || '##' WHEN 'Mid' THEN '##' || value || '##' WHEN 'End' THEN '##' || value ELSE value END AS text FROM own WHERE kind <> 'Delimiter' UNION ALL SELECT 1, 0, '[delim]' UNION ALL SELECT 2, part_id, {_ESCAPED} FROM own WHERE kind = 'Delimiter') SELECT row_number() OVER (ORDER BY g, part_id) - 1 AS line, text FROM l",
    "dict_text_roundtrip": _RELOADED.replace("<own>", "SELECT CASE WHEN kind = 'Delimiter' THEN 2 ELSE 0 END AS g, part_id, kind, value FROM own"),
    "dict_binary_roundtrip": _RELOADED.replace("<own>", "SELECT 0 AS g, part_id, kind, value FROM own"),
    "dict_tsv_roundtrip": f"WITH {TOKENS}, {_DICT} SELECT part_id, kind, value FROM parts",
    "context_range_join": f"WITH RECURSIVE {_BAGS} SELECT doc_id, sentence, part, (first_ - 1)::INT AS first, (last_ - 1)::INT AS last, n FROM spans",
    "inspect_sentence": f"WITH {SEGMENTS}, {_WORDS}, {_ATOMS_SPELT}, signs_of AS (SELECT w, string_agg(v, ' ' ORDER BY p) AS shown FROM (SELECT w, p, CASE WHEN length(w) = 1 THEN w WHEN p = 1 THEN substr(w, p, 1) || '##' WHEN p = length(w) THEN '##' || substr(w, p, 1) ELSE '##' || substr(w, p, 1) || '##' END AS v FROM (SELECT value AS w, unnest(range(1, length(value) + 1)) AS p FROM words)) x WHERE v IN (SELECT value FROM atoms) GROUP BY w), n AS (SELECT doc_id, sentence, idx, count(*) FILTER (bit < {4 * len(SIGNS) + len(CONNECTORS)}) AS n_before, count(*) FILTER (bit // {4 * len(SIGNS) + len(CONNECTORS)} = 1) AS n_current, count(*) FILTER (bit // {4 * len(SIGNS) + len(CONNECTORS)} = 2) AS n_after FROM sig GROUP BY 1, 2, 3) SELECT doc_id AS item_id, sentence, idx, value, coalesce(shown, '') AS shown, coalesce(n_before, 0) AS n_before, coalesce(n_current, 0) AS n_current, coalesce(n_after, 0) AS n_after FROM segments LEFT JOIN signs_of ON w = value LEFT JOIN n USING (doc_id, sentence, idx) WHERE type = 'W'".replace("FROM documents WHERE text <> ''", "FROM (SELECT item_id AS doc_id, text FROM benchmark) WHERE text <> ''"),
    "bit_intersection": f"WITH {_TALK}, {_NEXT} SELECT a, b, len(list_intersect(x.bits, y.bits))::INT AS n FROM pairs JOIN s x ON x.id = a JOIN s y ON y.id = b",
    "weighted_dot": f"WITH {_TALK}, {_NEXT} SELECT a, b, coalesce(sum(w), 0)::BIGINT AS wdot FROM pairs LEFT JOIN (SELECT x.id AS a, y.id AS b, w FROM sb x JOIN sb y ON y.id = x.id + 1 AND y.bit = x.bit JOIN sw ON sw.bit = x.bit) USING (a, b) GROUP BY 1, 2",
    "containment_match": f"WITH {_TALK} SELECT id, atom_id, round(wdot / ic::DOUBLE, 9) AS match FROM scored",
    "atom_accumulate": f"WITH {_TALK}, {_MASS} SELECT atom_id, bit, mass FROM mass",
    "atom_refresh": f"WITH {_TALK}, {_MASS}, deg AS (SELECT bit, count(*) AS atoms FROM bb GROUP BY bit), sc AS (SELECT m.atom_id, m.bit, mass - 2.0::DOUBLE * (coalesce(atoms, 0) - (o.bit IS NOT NULL)::INT) * w AS score FROM mass m LEFT JOIN deg ON deg.bit = m.bit LEFT JOIN bb o ON o.atom_id = m.atom_id AND o.bit = m.bit JOIN sw ON sw.bit = m.bit), top AS (SELECT atom_id, bit FROM (SELECT *, row_number() OVER (PARTITION BY atom_id ORDER BY score DESC, bit) AS rank FROM sc WHERE score > 0) WHERE rank <= 24), new AS (SELECT atom_id, string_agg(bit, ',' ORDER BY bit) AS bits FROM top GROUP BY 1) SELECT b.atom_id, CASE WHEN b.atom_id IN (SELECT atom_id FROM mass) THEN coalesce(new.bits, '') ELSE array_to_string(b.bits, ',') END AS bits FROM book b LEFT JOIN new ON new.atom_id = b.atom_id",
    "codebook_quality": f"WITH {_TALK}, r AS (SELECT sb.id, sum(w) AS ic, sum(CASE WHEN dec.bit IS NOT NULL THEN w ELSE 0 END) AS wd FROM sb JOIN sw USING (bit) LEFT JOIN dec ON dec.id = sb.id AND dec.bit = sb.bit GROUP BY 1) SELECT (SELECT count(*) FROM book) AS atoms, (SELECT count(DISTINCT atom_id) FROM fired) AS used, round((SELECT count(DISTINCT atom_id) FROM fired) / (SELECT count(*) FROM book)::DOUBLE, 9) AS utilisation, round(avg(wd / ic::DOUBLE), 9) AS mean_recall FROM r WHERE ic > 0",
    "recon_average": "SELECT " + ", ".join(f"round(avg({w}_{b}), 6) AS {w}_{b}" for b in ("left", "current", "right", "all") for w in ("recall", "precision")) + f" FROM ({SQL['recon_metrics']})",
    "dense_bits": f"WITH {_TALK}, x AS (SELECT id, (bit // 64)::INT AS word, sum(1::HUGEINT << (bit % 64)) AS h, count(*) AS n, max((bit % 64 = 3)::INT) AS fourth FROM sb GROUP BY 1, 2) SELECT id, word, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS bits, n::INT AS n, fourth FROM x",
    "fd_leverage": f"WITH {_TALK}, {_FACTOR}, e AS (SELECT r, sum(x * x) AS s2 FROM cells GROUP BY r), c AS (SELECT r, 1 / (s2 * (s2 + (SELECT avg(s2) FROM e))) AS c FROM e WHERE s2 > 0), t AS (SELECT DISTINCT id, bit % 64 AS bit FROM sb), p AS (SELECT id, r, sum(x) AS p FROM t JOIN cells USING (bit) GROUP BY 1, 2), l AS (SELECT id, sum(p * p * c) AS leverage FROM p JOIN c USING (r) GROUP BY 1) SELECT s.id, round(coalesce(leverage, 0.0), 6) AS leverage FROM s LEFT JOIN l USING (id)",
    "bit_promiscuity": f"WITH {_FACTOR} SELECT bit::INT AS bit, round(sum(x * x), 6) AS energy, round(coalesce(sum(x * x) FILTER (r = 0), 0.0) / sum(x * x), 9) AS promiscuity FROM cells GROUP BY 1 HAVING sum(x * x) > 0",
    "hub_bits": f"WITH {_FACTOR}, p AS (SELECT bit, round(coalesce(sum(x * x) FILTER (r = 0), 0.0) / sum(x * x), 9) AS promiscuity FROM cells GROUP BY 1 HAVING sum(x * x) > 0) SELECT bit::INT AS bit FROM (SELECT bit, row_number() OVER (ORDER BY promiscuity DESC, bit) AS rank FROM p) WHERE rank <= floor(0.25 * (SELECT count(*) FROM p))",
    "bit_correlation": f"WITH {_FACTOR} SELECT a.bit::INT AS i, b.bit::INT AS j, round(sum(a.x * b.x), 5) + 0.0::DOUBLE AS x FROM cells a JOIN cells b ON a.r = b.r AND a.bit <= b.bit GROUP BY 1, 2",
}
_PAIRED = f"WITH {_TALK}, {_NEXT} SELECT a, b, round(coalesce(len(list_intersect(x.bits, y.bits)) / nullif(len(x.bits) + len(y.bits) - len(list_intersect(x.bits, y.bits)), 0), 0.0)::DOUBLE, 9) AS jaccard FROM pairs JOIN s x ON x.id = a JOIN s y ON y.id = b"
_CELLS = "c AS (SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"
SQL |= {
    "jaccard_sparse": _PAIRED,
    "jaccard_dense": _PAIRED + " WHERE len(x.bits) > 0 AND len(y.bits) > 0",
    "matmul": f"WITH {_CELLS}, g AS (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS x FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2) SELECT vec_id AS row, j::INT AS col, round(sum(c.x * g.x), 3) + 0.0::DOUBLE AS x FROM c JOIN g ON i = k GROUP BY 1, 2",
    "gram_rows": f"WITH {_CELLS} SELECT a.vec_id AS row, b.vec_id AS col, round(sum(a.x * b.x), 5) + 0.0::DOUBLE AS x FROM c a JOIN c b USING (k) GROUP BY 1, 2",
}
