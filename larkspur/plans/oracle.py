"""DuckDB SQL that gives the same rows as the queries of the same name."""

from __future__ import annotations

from larkspur.functions.text import STOP_WORDS, TOPIC_WORDS
from larkspur.operators.mail import ENCODED_CHARS, FRAME_PREFIXES, SPAM_NGRAMS
from larkspur.plans.queries import BIGRAM, LOOKED_UP, SCORES, SOUGHT


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


STOP, TOPIC = _list(STOP_WORDS), _list(sorted(set(STOP_WORDS) | set(TOPIC_WORDS)))
TOKEN = r"\w+(?:\.\w+)*"


def _tokens(name: str, keep: str, source: str = "SELECT doc_id AS id, text AS t FROM documents") -> str:
    return f"""{name}_l AS MATERIALIZED (
  SELECT id, list_filter(list_transform(regexp_extract_all(coalesce(t, ''), '{TOKEN}'), lambda x: lower(x)), lambda x: {keep}) AS l FROM ({source})
), {name} AS MATERIALIZED (SELECT id AS doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS term FROM {name}_l)"""


NOSTOP = _tokens("tok", f"x NOT IN {STOP}")
ORIGINAL = _tokens("tok", "x <> 's'")

_INDEX = """,
docs AS MATERIALIZED (SELECT id AS doc_id, CAST(len(l) AS BIGINT) AS len FROM tok_l),
post AS MATERIALIZED (SELECT term, tok.doc_id, count(*) AS tf, any_value(len) AS len FROM tok JOIN docs USING (doc_id) GROUP BY term, tok.doc_id),
terms AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf, CAST(sum(len) AS BIGINT) AS tlen FROM post GROUP BY term),
stats AS MATERIALIZED (SELECT (SELECT count(*) FROM docs) AS d, (SELECT avg(len) FROM docs) AS al, (SELECT count(*) FROM terms) AS v)"""

INDEX = NOSTOP + _INDEX

ASKED = f"""asked_l AS (SELECT query_no, list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda x: lower(x))[4:] AS l FROM topics),
asked AS MATERIALIZED (SELECT query_no, term, count(*) AS qtf FROM (SELECT query_no, unnest(l) AS term FROM asked_l) WHERE term NOT IN {TOPIC} GROUP BY query_no, term)"""

_SCORED = f"""{ASKED},
known AS MATERIALIZED (SELECT asked.*, df, ttf, tlen FROM asked JOIN terms USING (term)),
hit AS MATERIALIZED (SELECT query_no, term, qtf, doc_id, tf, len, df, ttf, tlen, d, al, v FROM known JOIN post USING (term), stats),
base AS (
  SELECT *, tf / (tf + 0.5e0 + 1.5e0 * len / al) AS ok,
    CASE WHEN tlen - len > 0 THEN CAST(ttf - tf AS DOUBLE) / (tlen - len) ELSE 0e0 END AS bg FROM hit
),
present AS (
  SELECT query_no, doc_id, any_value(len) AS len, any_value(v) AS v, count(*) AS n_terms, sum(ok) AS okapi, sum(ok * log10(CAST(d // df AS DOUBLE))) AS tfidf,
    sum(log10((d + 0.5e0) / (df + 0.5e0)) * (tf + 1.2e0 * tf) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / al)) * (qtf + 1.5e0 * qtf) / (qtf + 1.5e0)) AS bm25,
    sum(log10((tf + 1) / CAST(len + v AS DOUBLE)) - log10(1e0 / (len + v))) AS lap,
    sum(log10(0.99e0 * tf / len + (1 - 0.99e0) * bg) - CASE WHEN tlen - len > 0 THEN log10((1 - 0.99e0) * ttf / (tlen - len)) ELSE 0e0 END) AS jm
  FROM base GROUP BY query_no, doc_id
),
grid AS (
  SELECT query_no, p.doc_id, count(*) AS asked, sum(CASE WHEN tlen - len > 0 THEN log10((1 - 0.99e0) * ttf / CASE WHEN tlen - len > 0 THEN tlen - len END) ELSE 0e0 END) AS absent
  FROM present p JOIN known USING (query_no) GROUP BY query_no, p.doc_id
),
scores AS MATERIALIZED (
  SELECT query_no, doc_id, round(okapi, 6) AS okapi, round(tfidf, 6) AS tfidf, round(bm25, 6) AS bm25,
    round(lap + asked * log10(1e0 / (len + v)), 6) AS laplace, round(jm + absent, 6) AS jm
  FROM present JOIN grid USING (query_no, doc_id)
)"""


SCORED = f"WITH {INDEX}, {_SCORED}"


def _rank(model: str, scored: str = SCORED) -> str:
    return f"""{scored}, r AS (SELECT query_no, doc_id, {model} AS score, row_number() OVER (PARTITION BY query_no ORDER BY {model} DESC, doc_id) AS rank FROM scores)
SELECT query_no, doc_id, docno, CAST(rank AS INTEGER) AS rank, score FROM r JOIN documents USING (doc_id) WHERE rank <= 1000"""


WINDOWS = f"""WITH {INDEX}, {ASKED},
occ AS MATERIALIZED (SELECT query_no, doc_id, term, pos FROM asked JOIN tok USING (term)),
many AS (SELECT query_no, doc_id, count(DISTINCT term) AS n_terms FROM occ GROUP BY query_no, doc_id HAVING count(DISTINCT term) >= 2),
lst AS (
  SELECT a.query_no, a.doc_id, a.pos AS hi, b.term, max(b.pos) AS lo FROM occ a JOIN occ b ON a.query_no = b.query_no AND a.doc_id = b.doc_id AND b.pos <= a.pos
  GROUP BY a.query_no, a.doc_id, a.pos, b.term
),
span AS (SELECT query_no, doc_id, hi, count(*) AS n, hi - min(lo) AS w FROM lst GROUP BY query_no, doc_id, hi),
win AS MATERIALIZED (SELECT query_no, doc_id, n_terms, min(w) AS min_window FROM span JOIN many USING (query_no, doc_id) WHERE n = n_terms GROUP BY query_no, doc_id, n_terms)"""

_LAST = f"""last AS MATERIALIZED (
  SELECT queryno, docno, {", ".join(f"CASE WHEN {s} IS NULL OR isnan({s}) THEN 0e0 ELSE {s} END AS {s}" for s in SCORES)}, relevance FROM (
    SELECT *, row_number() OVER (PARTITION BY queryno, docno ORDER BY scored_at DESC NULLS LAST, {", ".join(f"{s} DESC NULLS LAST" for s in SCORES)}, relevance DESC NULLS LAST) AS k
    FROM data_matrix_with_queryno_docno) WHERE k = 1
)"""

JUDGED = f"""WITH {_LAST},
rated AS (SELECT query_no, docno, max(coalesce(rel, 0)) AS grade FROM qrels GROUP BY query_no, docno),
counts AS (SELECT query_no, count(*) FILTER (WHERE grade > 0) AS n_rel FROM rated GROUP BY query_no),
run AS (SELECT queryno AS query_no, docno, row_number() OVER (PARTITION BY queryno ORDER BY bm25_score DESC, docno) AS rank FROM last WHERE bm25_score <> 0),
judged AS MATERIALIZED (
  SELECT query_no, docno, rank, CASE WHEN grade > 0 THEN 1 ELSE 0 END AS rel, n_rel,
    sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_no ORDER BY rank ROWS UNBOUNDED PRECEDING) AS rel_ret
  FROM run JOIN counts USING (query_no) LEFT JOIN rated USING (query_no, docno) WHERE rank <= 1000 AND n_rel > 0
),
cuts AS (SELECT unnest([5, 10, 15, 20, 30, 100, 200, 500, 1000]) AS cutoff),
at_k AS (SELECT query_no, cutoff, count(*) FILTER (WHERE rank <= cutoff AND rel = 1) / CAST(cutoff AS DOUBLE) AS p, count(*) FILTER (WHERE rank <= cutoff AND rel = 1) / CAST(max(n_rel) AS DOUBLE) AS r FROM judged, cuts GROUP BY query_no, cutoff),
ap AS (SELECT query_no, sum(CASE WHEN rel = 1 THEN rel_ret / CAST(rank AS DOUBLE) ELSE 0 END) / max(n_rel) AS avg_prec FROM judged GROUP BY query_no),
rp AS (SELECT query_no, count(*) FILTER (WHERE rel = 1 AND rank <= n_rel) / CAST(max(n_rel) AS DOUBLE) AS r_prec FROM judged GROUP BY query_no),
gain AS (
  SELECT query_no, CAST(sum(rel) AS INTEGER) AS found, sum(CASE WHEN rel = 0 THEN 0 WHEN rank = 1 THEN 1 ELSE 1 / log10(rank) END) AS dcg, sum(CASE WHEN rel = 0 THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg2
  FROM judged GROUP BY query_no
),
nd AS (
  SELECT query_no, CASE WHEN found > 0 THEN dcg / list_sum(list_transform(range(1, found + 1), lambda k: CASE WHEN k = 1 THEN 1e0 ELSE 1 / log10(k) END)) ELSE 0 END AS ndcg,
    CASE WHEN found > 0 THEN dcg2 / list_sum(list_transform(range(1, found + 1), lambda k: 1 / log2(k + 1))) ELSE 0 END AS ndcg_log2 FROM gain
)"""

EDGES = """e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT url AS src, unnest(out_links) AS dst FROM pages WHERE url IS NOT NULL) WHERE dst IS NOT NULL AND dst <> '')"""
DEGREES = """deg AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src), nodes AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)), size AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes)"""


def _pagerank(rounds: int, tolerance: float | None = None) -> str:
    """So many rounds; with a tolerance, the first of them within it."""
    steps = ["s0 AS MATERIALIZED (SELECT node, 1 / n AS score FROM nodes, size)"]
    for k in range(rounds):
        steps.append(f"""sink{k} AS (SELECT coalesce(sum(score), 0) AS m FROM s{k} WHERE node NOT IN (SELECT src FROM e)),
in{k} AS (SELECT dst AS node, sum(score / deg.n) AS s FROM s{k} JOIN e ON e.src = s{k}.node JOIN deg ON deg.src = e.src GROUP BY dst),
f{k} AS MATERIALIZED (SELECT node, 0.15e0 / n + 0.85e0 * m / n + 0.85e0 * coalesce(s, 0) AS score FROM nodes LEFT JOIN in{k} USING (node), size, sink{k}),
s{k + 1} AS MATERIALIZED (SELECT node, score / (SELECT sum(score) FROM f{k}) AS score FROM f{k})""")
    if tolerance is None:
        return f"WITH {EDGES}, {DEGREES}, {', '.join(steps)} SELECT node, round(score, 9) AS score FROM s{rounds}"
    moves = " UNION ALL ".join(f"SELECT {k} AS k, sqrt(sum((a.score - b.score) * (a.score - b.score))) AS move FROM s{k} a JOIN s{k - 1} b USING (node)" for k in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, node, score FROM s{k}" for k in range(1, rounds + 1))
    return f"""WITH {EDGES}, {DEGREES}, {', '.join(steps)}, moves AS ({moves}), done AS (SELECT min(k) AS k FROM moves WHERE move <= {tolerance}), every_ AS ({every})
SELECT node, round(score, 9) AS score FROM every_ JOIN done USING (k)"""


ROOT = f"""{EDGES}, root AS MATERIALIZED (SELECT dst AS node FROM (SELECT dst, count(*) AS n FROM e GROUP BY dst) ORDER BY n DESC, dst LIMIT 1000),
into_ AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY src) AS k FROM e WHERE dst IN (SELECT node FROM root)) WHERE k <= 50),
base AS MATERIALIZED (SELECT DISTINCT node FROM (SELECT node FROM root UNION ALL SELECT dst FROM e WHERE src IN (SELECT node FROM root) UNION ALL SELECT src FROM into_))"""


def _hits(rounds: int, tolerance: float | None = None) -> str:
    steps = ["out_ AS MATERIALIZED (SELECT src, dst FROM e WHERE src IN (SELECT node FROM base) AND dst IN (SELECT node FROM root))", "a0 AS (SELECT node, 1e0 AS a FROM root)", "h0 AS (SELECT node, 1e0 AS h FROM base)"]
    for k in range(rounds):
        steps.append(f"""ga{k} AS (SELECT dst AS node, sum(coalesce(h, 0)) AS s FROM into_ LEFT JOIN h{k} ON h{k}.node = into_.src GROUP BY dst),
ra{k} AS MATERIALIZED (SELECT node, coalesce(s, a) AS a FROM a{k} LEFT JOIN ga{k} USING (node)),
a{k + 1} AS MATERIALIZED (SELECT node, a / (SELECT sqrt(sum(a * a)) FROM ra{k}) AS a FROM ra{k}),
gh{k} AS (SELECT src AS node, sum(a) AS s FROM out_ JOIN a{k + 1} ON a{k + 1}.node = out_.dst GROUP BY src),
rh{k} AS MATERIALIZED (SELECT node, coalesce(s, 0) AS h FROM h{k} LEFT JOIN gh{k} USING (node)),
h{k + 1} AS MATERIALIZED (SELECT node, h / (SELECT sqrt(sum(h * h)) FROM rh{k}) AS h FROM rh{k})""")
    if tolerance is None:
        return f"WITH {ROOT}, {', '.join(steps)} SELECT node, round(h, 9) AS hub, round(a, 9) AS authority FROM h{rounds} LEFT JOIN a{rounds} USING (node)"
    moves = " UNION ALL ".join(
        f"SELECT {k} AS k, greatest((SELECT sqrt(sum((x.a - y.a) * (x.a - y.a))) FROM a{k} x JOIN a{k - 1} y USING (node)), (SELECT sqrt(sum((x.h - y.h) * (x.h - y.h))) FROM h{k} x JOIN h{k - 1} y USING (node))) / sqrt((SELECT count(*) FROM root)) AS move"
        for k in range(1, rounds + 1)
    )
    every = " UNION ALL ".join(f"SELECT {k} AS k, node, h, a FROM h{k} LEFT JOIN a{k} USING (node)" for k in range(1, rounds + 1))
    return f"""WITH {ROOT}, {', '.join(steps)}, moves AS ({moves}), done AS (SELECT coalesce(min(k) FILTER (WHERE move <= {tolerance}), {rounds}) AS k FROM moves), every_ AS ({every})
SELECT node, round(h, 6) AS hub, round(a, 6) AS authority FROM every_ JOIN done USING (k) ORDER BY a DESC NULLS LAST, node LIMIT 500"""


FOUND = """found AS (
  SELECT '' AS src, url, 0 AS wave, page_id AS arrive FROM pages WHERE url IS NOT NULL
  UNION ALL SELECT url, unnest(out_links), 1, page_id FROM pages WHERE url IS NOT NULL
)"""
HOST = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"
MAIL_TOKENS = _tokens("tok", "true", "SELECT mail_id AS id, min(body) AS t FROM mails GROUP BY mail_id")


def _gram(g: str) -> str:
    w = g.split(" ")
    name = g.replace(" ", "")
    if len(w) == 1:
        return f"CAST(len(list_filter(l, lambda x: x = '{w[0]}')) AS BIGINT) AS {name}"
    return f"CAST(len(list_filter(range(1, len(l)), lambda i: l[i] = '{w[0]}' AND l[i + 1] = '{w[1]}')) AS BIGINT) AS {name}"


_FRAMES = " AND ".join(f"NOT starts_with(x, '{p}')" for p in FRAME_PREFIXES).replace("\t", "' || chr(9) || '")
_CLEAN = f"array_to_string(list_filter(string_split(regexp_replace(coalesce(body, ''), '<[^>]*>', '', 'g'), chr(10)), lambda x: x <> '' AND {_FRAMES} AND NOT regexp_matches(x, '^\\S{{{ENCODED_CHARS + 1},}}\\s*$')), chr(10))"
_RUNS = ", ".join(f"coalesce(round(max({s}), 6), 0) AS {s.replace('_score', '')}" for s in SCORES)

_PAGES = r"""one AS (SELECT page_id, coalesce(min(html_source), '') AS h FROM pages GROUP BY page_id),
bare AS (
  SELECT page_id, regexp_replace(h, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)', ' ', 'g') AS b FROM one
)"""


HREF = r"""regexp_replace(regexp_extract(x, '(?i)(?:^|[\s"''])href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""


def _resolved(x: str) -> str:
    """Character references the pages hold, resolved; white space collapsed."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{sign}')"
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def _report() -> str:
    """A line of text for each measure, in order, of every topic and of all."""
    whole = ("retrieved", "relevant", "relevant_retrieved")
    parts = [f"SELECT query_no, {i} AS line_no, '{n}' AS name, CAST({c} AS DOUBLE) AS v FROM tot" for i, (n, c) in enumerate(zip(whole, ("ret", "n_rel", "found"), strict=True))]
    parts += [f"SELECT query_no, {3 + i}, '{n}', {n} FROM {t}" for i, (n, t) in enumerate((("avg_prec", "ap"), ("r_prec", "rp"), ("ndcg", "nd")))]
    parts.append("SELECT query_no, CAST(6 + 10 * recall AS INTEGER), printf('at_%03d', CAST(100 * recall AS INTEGER)), best FROM level")
    for i, (n, v) in enumerate((("p", "p"), ("r", "r"), ("f1", "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"))):
        parts.append(f"SELECT query_no, CAST({17 + 9 * i} + list_position([5, 10, 15, 20, 30, 100, 200, 500, 1000], cutoff) - 1 AS INTEGER), '{n}_' || cutoff, {v} FROM at_k")
    return f"""{JUDGED}, lv AS (SELECT unnest([0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 1e0]) AS recall),
level AS (SELECT query_no, recall, coalesce(max(CASE WHEN rel_ret / CAST(n_rel AS DOUBLE) >= recall THEN rel_ret / CAST(rank AS DOUBLE) END), 0) AS best FROM judged, lv GROUP BY query_no, recall),
tot AS (SELECT query_no, count(*) AS ret, max(n_rel) AS n_rel, sum(rel) AS found FROM judged GROUP BY query_no),
rows_ AS ({" UNION ALL ".join(parts)}),
both_ AS (SELECT * FROM rows_ UNION ALL SELECT 'all', line_no, name, CASE WHEN line_no < 3 THEN sum(v) ELSE avg(v) END FROM rows_ GROUP BY line_no, name)
SELECT query_no, CAST(line_no AS INTEGER) AS line_no, name || ' ' || CASE WHEN line_no < 3 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.4f', v) END AS line FROM both_"""


def _canonical(x: str) -> str:
    """An absolute URL in canonical form, as far as the pages' links need it: protocol and host in lower case, default port and fragment dropped, an empty path the root."""
    host = f"lower(regexp_extract({x}, '^[A-Za-z]+://([^/?#:]+)', 1))"
    port = f"regexp_replace(regexp_extract({x}, '^[A-Za-z]+://[^/?#:]+(:[0-9]+)?', 1), '^:80$', '')"
    path = f"regexp_extract({x}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"
    return f"lower(regexp_extract({x}, '^[A-Za-z]+')) || '://' || {host} || {port} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || regexp_extract({x}, '^[^?#]*([?][^#]+)?', 1)"


SQL: dict[str, str] = {
    "tokenize_original": f"WITH {ORIGINAL} SELECT doc_id, pos, term FROM tok",
    "tokenize_nostop": f"WITH {NOSTOP} SELECT doc_id, pos, term FROM tok",
    "token_ngrams": f"""WITH {_tokens("tok", "true")} SELECT gram, count(*) AS n FROM (SELECT term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM tok) WHERE gram IS NOT NULL GROUP BY gram""",
    "postings_tf_positions": f"WITH {NOSTOP} SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id",
    "index_blocks": f"""WITH {NOSTOP}, p AS (SELECT term, doc_id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS ps FROM tok GROUP BY term, doc_id)
SELECT term, string_agg(CAST(doc_id AS VARCHAR) || ' ' || ps || ',', '' ORDER BY doc_id) AS line, count(*) AS df FROM p GROUP BY term, doc_id // 65536""",
    "doc_lengths": f"WITH {NOSTOP} SELECT id AS doc_id, CAST(len(l) AS BIGINT) AS len FROM tok_l",
    "doc_lengths_distinct": f"WITH {NOSTOP} SELECT id AS doc_id, CAST(len(list_distinct(l)) AS BIGINT) AS len FROM tok_l",
    "corpus_stats": f"WITH {INDEX} SELECT d, v, floor(al * 100 + 0.5) / 100 AS avg_len FROM stats",
    "length_facet": f"""WITH {INDEX} SELECT count(len) AS "count", CAST(sum(len) AS BIGINT) AS total, min(len) AS "min", max(len) AS "max", round(avg(len), 4) AS mean, round(sum(CAST(len AS DOUBLE) * len), 4) AS sum_of_squares, round(var_pop(len), 4) AS variance, round(stddev_pop(len), 4) AS std_deviation FROM docs""",
    "term_stats_df_ttf_tlen": f"WITH {INDEX} SELECT term, df, ttf, tlen FROM terms",
    "term_lookup": f"WITH {INDEX} SELECT term, doc_id, tf, len FROM post WHERE term IN {_list(LOOKED_UP)}",
    "term_vector": f"WITH {INDEX} SELECT term, tf FROM post WHERE doc_id = 1",
    "query_terms": f"WITH {ASKED} SELECT query_no, term, qtf FROM asked",
    **{f"rank_{m}": _rank(m) for m in ("okapi", "tfidf", "bm25", "laplace", "jm")},
    "min_window": f"{WINDOWS} SELECT query_no, doc_id, n_terms, min_window FROM win",
    "rank_proximity": f"""{WINDOWS}, s AS (SELECT query_no, doc_id, round((1500 - min_window) * n_terms / CAST(len + v AS DOUBLE), 6) AS score FROM win JOIN docs USING (doc_id), stats),
r AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_no, doc_id, docno, CAST(rank AS INTEGER) AS rank, score FROM r JOIN documents USING (doc_id) WHERE rank <= 1000""",
    "borda_fusion": f"""{SCORED} SELECT query_no, doc_id, CAST({" + ".join(f"greatest(1001 - row_number() OVER (PARTITION BY query_no ORDER BY {m} DESC, doc_id), 0)" for m in ("okapi", "tfidf", "bm25", "laplace", "jm"))} AS BIGINT) AS points FROM scores""",
    "trec_run_text": f"""{SCORED}, r AS (SELECT query_no, doc_id, bm25 AS score, row_number() OVER (PARTITION BY query_no ORDER BY bm25 DESC, doc_id) AS rank FROM scores)
SELECT concat_ws(' ', query_no, 'Q0', docno, CAST(rank AS VARCHAR), printf('%.6f', score), 'Exp') AS line FROM r JOIN documents USING (doc_id) WHERE rank <= 1000""",
    "qrels_agg": f"{JUDGED} SELECT query_no, n_rel FROM counts",
    "eval_prec_recall_at_k": f'{JUDGED} SELECT query_no, CAST(cutoff AS INTEGER) AS cutoff, round(p, 6) AS "precision", round(r, 6) AS recall FROM at_k',
    "eval_f1": f"{JUDGED} SELECT query_no, CAST(cutoff AS INTEGER) AS cutoff, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM at_k",
    "eval_avg_precision": f"{JUDGED} SELECT query_no, round(avg_prec, 6) AS avg_prec FROM ap",
    "eval_rprec": f"{JUDGED} SELECT query_no, round(r_prec, 6) AS r_prec FROM rp",
    "eval_interp11": f"""{JUDGED}, lv AS (SELECT unnest([0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0, 1e0]) AS recall)
SELECT query_no, recall, round(coalesce(max(CASE WHEN rel_ret / CAST(n_rel AS DOUBLE) >= recall THEN rel_ret / CAST(rank AS DOUBLE) END), 0), 6) AS "precision" FROM judged, lv GROUP BY query_no, recall""",
    "eval_ndcg": f"{JUDGED} SELECT query_no, round(ndcg, 6) AS ndcg, round(ndcg_log2, 6) AS ndcg_log2 FROM nd",
    "eval_summary": f"""{JUDGED}, tot AS (SELECT query_no, count(*) AS ret, max(n_rel) AS n_rel, sum(rel) AS found FROM judged GROUP BY query_no)
SELECT count(*) AS topics, CAST(sum(ret) AS BIGINT) AS retrieved, CAST(sum(n_rel) AS BIGINT) AS relevant, CAST(sum(found) AS BIGINT) AS relevant_retrieved, round(avg(avg_prec), 6) AS map, round(avg(r_prec), 6) AS r_prec, round(avg(ndcg), 6) AS ndcg
FROM tot JOIN ap USING (query_no) JOIN rp USING (query_no) JOIN nd USING (query_no)""",
    "pr_curve": f"""{JUDGED} SELECT query_no, CAST(rel_ret AS BIGINT) AS i, round(rel_ret / CAST(n_rel AS DOUBLE), 6) AS recall, round(rel_ret / CAST(rank AS DOUBLE), 6) AS prec,
round(max(rel_ret / CAST(rank AS DOUBLE)) OVER (PARTITION BY query_no ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS interp_prec FROM judged WHERE rel = 1""",
    "page_links": rf"""WITH {_PAGES}, anchors AS (SELECT page_id, regexp_extract_all(b, '(?i)<a\s([^>]*)', 1) AS l FROM bare),
targets AS (SELECT page_id, list_filter(list_transform(l, lambda x: {_resolved(HREF)}), lambda x: x <> '') AS l FROM anchors)
SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n, unnest(l) AS href FROM targets""",
    "page_text": rf"""WITH {_PAGES}, parts AS (SELECT page_id, regexp_extract(b, '(?i)<title\b[^>]*>([^<]*)', 1) AS title, string_split(regexp_replace(b, '(?i)<title\b[^>]*>[^<]*(?:</title\s*>)?', ' ', 'g'), '<') AS l FROM bare),
texts AS (SELECT page_id, title, l[1] || array_to_string(list_transform(l[2:], lambda x: CASE WHEN NOT regexp_matches(x, '^[a-zA-Z/!?]') THEN '<' || x WHEN contains(x, '>') THEN ' ' || substr(x, position('>' IN x) + 1) ELSE ' ' END), '') AS t FROM parts)
SELECT page_id, {_resolved('title')} AS title, {_resolved('t')} AS text FROM texts""",
    "html_pages": "SELECT page_id, min(url) AS url FROM pages WHERE regexp_matches(header, '^HTTP/[0-9.]+ 200\\b') AND regexp_matches(lower(header), 'content-type:\\s*text/html') GROUP BY page_id",
    "link_edges": f"WITH {EDGES} SELECT src, dst FROM e",
    "inlinks": f"WITH {EDGES} SELECT dst, count(*) AS n FROM e GROUP BY dst",
    "inlink_lists": f"WITH {EDGES} SELECT dst AS page, 0 AS part, string_agg(src, ' ' ORDER BY src) AS neighbours FROM e GROUP BY dst",
    "outdegree": f"WITH {EDGES} SELECT src, count(*) AS n FROM e GROUP BY src",
    "sink_pages": f"WITH {EDGES} SELECT DISTINCT dst AS node FROM e WHERE dst NOT IN (SELECT src FROM e)",
    "pagerank_k": _pagerank(3),
    "hits_base_set": f"WITH {ROOT} SELECT node FROM base",
    "hits_k": _hits(2),
    "frontier_order": f"""WITH {FOUND}, per AS (SELECT url, min(wave) AS wave, count(DISTINCT src) AS inlinks, min(arrive) AS arrive FROM found WHERE url IS NOT NULL AND url <> '' GROUP BY url)
SELECT url, wave, inlinks, arrive, row_number() OVER (ORDER BY wave, inlinks DESC, arrive, url) AS place FROM per""",
    "merge_insert_if_absent": "SELECT DISTINCT l AS url FROM (SELECT unnest(out_links) AS l FROM pages) WHERE l IS NOT NULL AND l NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)",
    "canonical_links": f"""WITH raw AS (SELECT DISTINCT trim(url) AS u, trim(unnest(out_links)) AS h FROM pages WHERE url IS NOT NULL)
SELECT DISTINCT {_canonical('u')} AS src, {_canonical('h')} AS dst FROM raw WHERE h IS NOT NULL AND lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]+)', 1)) = lower(regexp_extract(h, '^[A-Za-z]+://([^/?#:]+)', 1))""",
    "pagerank": _pagerank(60, 1e-5),
    "hits": _hits(99, 1e-5),
    "approx_vocab_within": "SELECT true AS within",
    "rank_bm25_original": _rank("bm25", f"WITH {ORIGINAL}{_INDEX}, {_SCORED}"),
    "free_text_search": _rank("bm25", f"WITH {INDEX}, {_SCORED}".replace("[4:] AS l FROM topics", f" AS l FROM (SELECT 'search' AS query_no, '{SOUGHT}' AS text)")).replace("SELECT query_no, doc_id, docno, CAST(rank", "SELECT doc_id, docno, CAST(rank"),
    "legacy_query_terms": """WITH l AS (SELECT query_no, list_filter(string_split_regex(trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g')), '\\s+'), lambda x: x <> '') AS l FROM topics)
SELECT query_no, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, lower(unnest(l)) AS term FROM l""",
    "term_ids": f"WITH {MAIL_TOKENS} SELECT term, CAST(row_number() OVER (ORDER BY term) AS INTEGER) AS term_id FROM (SELECT DISTINCT term FROM tok)",
    "scores_text": f"WITH {EDGES} SELECT dst || ' ' || count(*) AS line FROM e GROUP BY dst",
    "words_text": f"WITH {MAIL_TOKENS} SELECT DISTINCT lower(upper(term)) AS word FROM tok",
    "index_catalog": f"""WITH {NOSTOP}, p AS (SELECT term, doc_id, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS ps FROM tok GROUP BY term, doc_id),
b AS (SELECT term, doc_id // 65536 AS block, strlen(string_agg(CAST(doc_id AS VARCHAR) || ' ' || ps || ',', '' ORDER BY doc_id)) AS size FROM p GROUP BY term, doc_id // 65536)
SELECT term, block, CAST(sum(size + 1) OVER (ORDER BY term, block ROWS UNBOUNDED PRECEDING) - size - 1 AS BIGINT) AS start, size FROM b""",
    "trec_eval_report": _report(),
    "judged_total": "WITH j AS (SELECT query_no, docno, count(*) AS k, max(coalesce(rel, 0)) AS rel FROM qrels GROUP BY query_no, docno) SELECT count(DISTINCT query_no) AS topics, CAST(sum(k) AS BIGINT) AS lines, count(*) AS judged, count(*) FILTER (WHERE rel > 0) AS relevant FROM j",
    "accuracy_by_split": f"""WITH {_LAST}, p AS (SELECT CAST(relevance AS DOUBLE) > 0 AS y, bm25_score > 5 AS p, CASE WHEN CAST(queryno AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM last WHERE relevance IS NOT NULL AND relevance <> '?'),
b AS (SELECT * FROM p UNION ALL SELECT y, p, 'total' FROM p)
SELECT split, count(*) FILTER (WHERE y AND p) AS relevant_right, count(*) FILTER (WHERE y AND NOT p) AS relevant_wrong, count(*) FILTER (WHERE NOT y AND NOT p) AS irrelevant_right, count(*) FILTER (WHERE NOT y AND p) AS irrelevant_wrong, round(avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM b GROUP BY split""",
    "sparse_matrix_split": f"""WITH {MAIL_TOKENS}, ids AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM (SELECT DISTINCT term FROM tok)), c AS (SELECT doc_id, i, count(*) AS tf FROM tok JOIN ids USING (term) GROUP BY doc_id, i),
m AS (SELECT mail_id, min(label) AS label, CASE WHEN lower(trim(min(split))) = 'train' THEN 'train' ELSE 'test' END AS split FROM mails GROUP BY mail_id)
SELECT split, mail_id, concat_ws(' ', CAST(CASE WHEN lower(trim(any_value(label))) = 'spam' THEN 1 ELSE 0 END AS VARCHAR), string_agg(i || ':' || tf, ' ' ORDER BY i)) AS line FROM c JOIN m ON doc_id = mail_id GROUP BY split, mail_id""",
    "collection_text": r"SELECT CAST(doc_id AS VARCHAR) AS docno, regexp_replace(coalesce(text, ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS text FROM documents",
    "topics_text": r"SELECT query_no, t AS text FROM (SELECT query_no, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) AS t FROM topics) WHERE t <> ''",
    "run_text": f"""WITH {_LAST}, r AS (SELECT queryno AS query_no, docno, bm25_score AS score, row_number() OVER (PARTITION BY queryno ORDER BY bm25_score DESC, docno) AS rank FROM last WHERE bm25_score <> 0)
SELECT query_no, 'Q0' AS q0, docno, CAST(rank AS INTEGER) AS rank, CAST(printf('%.6f', score) AS DOUBLE) AS score, 'Exp' AS tag FROM r WHERE rank <= 1000""",
    "qrels_text": "SELECT query_no, coalesce(assessor, '0') AS assessor, docno, coalesce(rel, 0) AS rel FROM qrels",
    "adjacency_text": f"WITH {EDGES} SELECT src, dst FROM e",
    "root_set_text": f"WITH {ROOT} SELECT node FROM root",
    "mail_labels_text": """WITH n AS (SELECT lower(trim(label)) AS label, regexp_extract(path, '[^/]*$') AS file_name FROM mail_labels WHERE label IS NOT NULL AND path IS NOT NULL)
SELECT file_name, min(label) AS label, TRY_CAST(regexp_extract(file_name, '[^.]*$') AS INTEGER) AS mail_id FROM n GROUP BY file_name""",
    "arff_text": f"WITH {_LAST} SELECT {', '.join(SCORES)}, CASE WHEN regexp_full_match(relevance, '[0-9]+') THEN CAST(relevance AS DOUBLE) END AS label FROM last",
    "libsvm_text": f"""WITH {MAIL_TOKENS}, c AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term), m AS (SELECT mail_id, min(label) AS label FROM mails GROUP BY mail_id)
SELECT CASE WHEN lower(trim(any_value(label))) = 'spam' THEN 1e0 ELSE 0e0 END AS label, CAST(count(*) AS INTEGER) AS terms, CAST(sum(tf) AS DOUBLE) AS total FROM c JOIN m ON doc_id = mail_id GROUP BY doc_id""",
    "robots_filter": """WITH u AS (SELECT DISTINCT url FROM (SELECT unnest(out_links) AS url FROM pages) WHERE url IS NOT NULL), p AS (SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(.*)$', 1) AS path FROM u)
SELECT url FROM p WHERE regexp_matches(url, '^[A-Za-z]+://[^/?#]*\\.test(?:[/?#]|$)') OR starts_with(path, '/sport/m') OR NOT (starts_with(path, '/sport') OR starts_with(path, '/tech'))""",
    "seed_hosts": f"SELECT DISTINCT {HOST} AS host, url FROM pages WHERE url IS NOT NULL",
    "mail_clean": f"""SELECT mail_id, regexp_replace(regexp_replace(replace({_CLEAN}, chr(9), ' '), ' +', ' ', 'g'), '( ?\\n)+', chr(10), 'g') AS body FROM (SELECT mail_id, min(body) AS body FROM mails GROUP BY mail_id)""",
    "mail_labels_joined": """WITH n AS (SELECT lower(trim(label)) AS label, regexp_extract(path, '[^/]*$') AS file_name FROM mail_labels WHERE label IS NOT NULL AND path IS NOT NULL), one AS (SELECT file_name, min(label) AS label FROM n GROUP BY file_name)
SELECT DISTINCT mail_id, file_name, one.label FROM mails JOIN one USING (file_name)""",
    "bigram_match": f"WITH {ORIGINAL}, nx AS (SELECT doc_id, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok) SELECT doc_id, count(*) AS n FROM nx WHERE term = '{BIGRAM[0]}' AND next = '{BIGRAM[1]}' GROUP BY doc_id",
    "ngram_feature_matrix": f"""WITH {MAIL_TOKENS}, m AS (SELECT mail_id, min(label) AS label, min(lower(trim(split))) AS split FROM mails GROUP BY mail_id)
SELECT mail_id, {", ".join(_gram(g) for g in (*SPAM_NGRAMS, "as far", "reply before"))}, CASE WHEN split = 'train' AND label IS NOT NULL THEN CASE WHEN lower(trim(label)) = 'spam' THEN 1 ELSE 0 END END AS label FROM tok_l JOIN m ON id = mail_id""",
    "sparse_matrix": f"""WITH {MAIL_TOKENS}, ids AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM (SELECT DISTINCT term FROM tok)), c AS (SELECT doc_id, i, count(*) AS tf FROM tok JOIN ids USING (term) GROUP BY doc_id, i),
m AS (SELECT mail_id, min(label) AS label FROM mails GROUP BY mail_id)
SELECT concat_ws(' ', CAST(CASE WHEN lower(trim(any_value(label))) = 'spam' THEN 1 ELSE 0 END AS VARCHAR), string_agg(i || ':' || tf, ' ' ORDER BY i)) AS line FROM c LEFT JOIN m ON doc_id = mail_id GROUP BY doc_id""",
    "ltr_feature_matrix": f"""WITH {_LAST} SELECT q.query_no, q.docno, {_RUNS}, CAST(max(rel) AS DOUBLE) AS label FROM qrels q LEFT JOIN last ON last.queryno = q.query_no AND last.docno = q.docno GROUP BY q.query_no, q.docno""",
    "train_test_split": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents",
    "accuracy_confusion": f"""WITH {_LAST}, p AS (SELECT CAST(relevance AS DOUBLE) > 0 AS y, bm25_score > 5 AS p FROM last WHERE relevance IS NOT NULL AND relevance <> '?')
SELECT count(*) FILTER (WHERE y AND p) AS relevant_right, count(*) FILTER (WHERE y AND NOT p) AS relevant_wrong, count(*) FILTER (WHERE NOT y AND NOT p) AS irrelevant_right, count(*) FILTER (WHERE NOT y AND p) AS irrelevant_wrong, round(avg(CASE WHEN y = p THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM p""",
    "top_n_by_value": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 500",
    "stop_words": f"WITH {_tokens('tok', f'x IN {STOP}')} SELECT term AS word, count(DISTINCT doc_id) AS df FROM tok GROUP BY term",
}
