"""The queries over this project's tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, fusion, mailtext, mixing, pagetext, spans, splits, terms, topn
from larkspur.session import table

SQL: dict[str, str] = {}

SCORES = ["okapi_score", "tfidf_score", "bm25_score", "laplace_score"]
#: A high value of each speaks for the document.
DIRECTIONS = [1, 1, 1, 1]


def _latest_scores(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """One row per judged document of a query, that of the latest run; 0.0 and NaN (not returned) become null."""
    rows = table(spark, sf_dir, "data_matrix_with_queryno_docno")
    last = rows.groupBy("queryno", "docno").agg(F.max(F.struct("scored_at", *columns)).alias("r"))
    return last.select("queryno", "docno", *(F.when((F.col(f"r.{c}") != 0) & ~F.isnan(f"r.{c}"), F.col(f"r.{c}")).alias(c) for c in columns))


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused ranking of every judged document of every query."""
    return _fused(spark, sf_dir).withColumn("projection", F.round("projection", 4))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_ranking(_latest_scores(spark, sf_dir, SCORES), "queryno", "docno", SCORES, DIRECTIONS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents of each query with at least 50 that lead its fused ranking."""
    ranking = _fused(spark, sf_dir).where(F.col("n") >= 50)
    return topn.top_n_per_group(ranking, ["queryno"], "projection", "docno", 5).select("queryno", "docno")


_MEAN_RANKS = ", ".join(
    f"rank() OVER (PARTITION BY queryno ORDER BY s{i}) + (count(*) OVER (PARTITION BY queryno, s{i}) - 1) / 2e0 AS r{i}" for i in range(len(SCORES))
)
#: Four scores that weigh alike, without the principal component: the mean of their mean ranks.
SQL["p2_found"] = f"""
WITH last AS (
  SELECT queryno, docno, {", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) OR {c} = 0 THEN CAST('-infinity' AS DOUBLE) ELSE {c} END AS s{i}" for i, c in enumerate(SCORES))},
         row_number() OVER (PARTITION BY queryno, docno ORDER BY scored_at DESC NULLS LAST, {", ".join(f"{c} DESC NULLS LAST" for c in SCORES)}) AS run
  FROM data_matrix_with_queryno_docno
), ranks AS (SELECT queryno, docno, count(*) OVER (PARTITION BY queryno) AS n, {_MEAN_RANKS} FROM last WHERE run = 1),
placed AS (SELECT queryno, docno, row_number() OVER (PARTITION BY queryno ORDER BY round({" + ".join(f"r{i}" for i in range(len(SCORES)))}, 6) DESC, docno) AS place FROM ranks WHERE n >= 50)
SELECT queryno, docno FROM placed WHERE place <= 5
"""


def _component_sql(rounds: int = 12) -> str:
    """The loadings of the first component: the correlation matrix is squared again and again, until all its columns point along it."""
    m = range(len(SCORES))
    cells = [(i, j) for i in m for j in m if i <= j]

    def cell(t: str, i: int, j: int) -> str:
        return f"{t}.c{min(i, j)}{max(i, j)}"

    steps = ["m0 AS MATERIALIZED (SELECT " + ", ".join(f"corr(z{i}, z{j}) AS c{i}{j}" for i, j in cells) + " FROM centred)"]
    for k in range(rounds):
        trace = " + ".join(cell(f"m{k}", i, i) for i in m)
        products = ", ".join("(" + " + ".join(f"{cell(f'm{k}', i, x)} * {cell(f'm{k}', x, j)}" for x in m) + f") / (({trace}) * ({trace})) AS c{i}{j}" for i, j in cells)
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT {products} FROM m{k})")
    rows = [" + ".join(cell("x", i, j) for j in m) for i in m]
    norm = " + ".join(f"({r}) * ({r})" for r in rows)
    steps.append(f"loading AS MATERIALIZED (SELECT {', '.join(f'({r}) / sqrt({norm}) / d{i} AS w{i}' for i, r in enumerate(rows))} FROM m{rounds} x, (SELECT {', '.join(f'stddev_pop(z{i}) AS d{i}' for i in m)} FROM centred))")
    return ", ".join(steps)


SQL["p2_ranking"] = SQL["p2_found"].split(",\nplaced AS")[0] + f"""
, centred AS MATERIALIZED (SELECT queryno, docno, n, {", ".join(f"(r{i} - (n + 1) / 2e0) / n AS z{i}" for i in range(len(SCORES)))} FROM ranks),
{_component_sql()}
SELECT queryno, docno, n, round({" + ".join(f"z{i} * w{i}" for i in range(len(SCORES)))}, 4) AS projection FROM centred, loading
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of each query with the highest BM25 score."""
    rows = _latest_scores(spark, sf_dir, ["bm25_score"])
    return topn.top_n_per_group(rows, ["queryno"], "bm25_score", "docno", 10).select("queryno", "docno")


SQL["p6_found"] = """
WITH last AS (
  SELECT queryno, docno, bm25_score,
         row_number() OVER (PARTITION BY queryno, docno ORDER BY scored_at DESC NULLS LAST, bm25_score DESC NULLS LAST) AS run
  FROM data_matrix_with_queryno_docno
), kept AS (
  SELECT queryno, docno, row_number() OVER (PARTITION BY queryno ORDER BY bm25_score DESC, docno) AS place
  FROM last WHERE run = 1 AND bm25_score IS NOT NULL AND NOT isnan(bm25_score) AND bm25_score <> 0
)
SELECT queryno, docno FROM kept WHERE place <= 10
"""


def _fields(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    """Field name, table with one row a record, identifier and text column."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    mails = table(spark, sf_dir, "mails").groupBy("mail_id").agg(F.min("body").alias("body"))
    return [("text", documents, "doc_id", "text"), ("body", mails, "mail_id", "body")]


def _non_null(df: DataFrame, text: str) -> int:
    return df.where(F.col(text).isNotNull()).count()


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How distinctive each term of each story and mail is."""
    parts = [
        terms.distinctive_terms(df, ident, text).select(F.lit(field).alias("field"), F.col("id").alias("record_id"), "term", "tf", "degree", "df", "score")
        for field, df, ident, text in _fields(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinctive terms, however small their weight, that occur at least four times in a record and in at most five records of the field."""
    parts = [
        terms.distinctive_terms(df, ident, text, min_tf=4, max_df=5).select(F.lit(field).alias("field"), F.col("id").alias("record_id"), "term")
        for field, df, ident, text in _fields(spark, sf_dir)
    ]
    return parts[0].unionByName(parts[1])


_WORDS_SQL = r"""
WITH records AS (
  SELECT 'text' AS field, doc_id AS record_id, text AS t FROM documents
  UNION ALL
  SELECT 'body', CAST(mail_id AS BIGINT), min(body) FROM mails GROUP BY mail_id
), sizes AS (SELECT field, count(t) AS n FROM records GROUP BY field),
words AS (SELECT field, record_id, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS term FROM records),
held AS (SELECT field, record_id, term, count(*) AS tf FROM words GROUP BY ALL),
counted AS (SELECT field, term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM held GROUP BY ALL)
"""

SQL["p3_found"] = _WORDS_SQL + "SELECT field, record_id, term FROM held JOIN counted USING (field, term) WHERE tf >= 4 AND df <= 5"


SQL["p3_scores"] = _WORDS_SQL + """
, placed AS MATERIALIZED (SELECT field, record_id, generate_subscripts(l, 1) AS pos, unnest(l) AS term FROM (SELECT field, record_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS l FROM records)),
near AS (
  SELECT DISTINCT a.field, a.record_id, a.term, b.term AS other FROM placed a, (SELECT unnest([-3, -2, -1, 1, 2, 3]) AS d) JOIN placed b ON b.field = a.field AND b.record_id = a.record_id AND b.pos = a.pos + d
  WHERE a.term <> b.term
),
degrees AS (SELECT field, record_id, term, count(*) AS degree FROM near GROUP BY ALL),
kept AS (SELECT field, count(DISTINCT record_id) AS records FROM held GROUP BY field)
SELECT field, record_id, term, tf, coalesce(degree, 0) AS degree, df, round(coalesce(degree, 0) * ln((1 + records) / CAST(df AS DOUBLE)), 6) AS score
FROM held JOIN counted USING (field, term) JOIN kept USING (field) LEFT JOIN degrees USING (field, record_id, term)
"""


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of every term, and every sequence of two and three terms, of the stories and of the mails."""
    parts = []
    for field, df, ident, text in _fields(spark, sf_dir):
        counted = terms.term_counts(df, ident, text, max_n=3)
        mark = terms.usefulness(F.col("df"), _non_null(df, text), rare_below=3, common_share=0.2)
        parts.append(counted.select(F.lit(field).alias("field"), "term", "n", "cf", "df", mark.alias("mark")))
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms too rare or too common for the index."""
    return p4_terms(spark, sf_dir).where((F.col("n") == 1) & F.col("mark").isNotNull()).select("field", "term", "mark")


_MARKED_SQL = """
, marked AS (
  SELECT field, term, cf, df, CASE WHEN df < 3 THEN 'rare' WHEN 5 * df > n THEN 'common' END AS mark
  FROM counted JOIN sizes USING (field)
)
"""
SQL["p4_terms"] = _WORDS_SQL.replace("held AS", """lists AS (SELECT field, record_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS l FROM records),
grams AS (SELECT field, record_id, n, array_to_string(l[i:i + n - 1], ' ') AS term FROM (SELECT field, record_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3]) AS n))),
held_n AS (SELECT field, record_id, n, term, count(*) AS tf FROM grams GROUP BY ALL),
counted_n AS (SELECT field, term, n, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM held_n GROUP BY ALL),
held AS""") + """
SELECT field, term, CAST(c.n AS INTEGER) AS n, cf, df, CASE WHEN df < 3 THEN 'rare' WHEN 5 * df > s.n THEN 'common' END AS mark FROM counted_n c JOIN sizes s USING (field)"""
SQL["p4_found"] = _WORDS_SQL + _MARKED_SQL + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL"


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every story."""
    return bpe.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stories as one training set in which each source has its target share of tokens."""
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that training set reaches, per source."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def _mail_overlaps(spark: SparkSession, sf_dir: str) -> splits.Overlaps:
    return splits.find_overlaps(table(spark, sf_dir, "mails"), "mail_id", "body", "split", "source", "train", ["dev", "test"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of an evaluation split and of the training split that are equal or nearly so."""
    pairs = splits.overlapping_pairs(_mail_overlaps(spark, sf_dir))
    return pairs.select(F.col("id_1").cast("int").alias("mail_id_1"), F.col("id_2").cast("int").alias("mail_id_2"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mails of each evaluation split and source overlap with the training split."""
    return splits.overlap_report(_mail_overlaps(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail of a split with its class of equal mails and the number of mails of the other side it overlaps."""
    rows = splits.overlap_classes(_mail_overlaps(spark, sf_dir))
    return rows.select(F.col("id").alias("mail_id"), "side", F.col("class").cast("int").alias("class_id"), "members", "links")


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of equal mails that overlap, evaluation first."""
    rows = splits.overlap_links(_mail_overlaps(spark, sf_dir))
    return rows.select(F.col("class_1").cast("int").alias("class_1"), F.col("class_2").cast("int").alias("class_2"), "exact")


# the edit distance of word sequences, row by row of its table, for pairs that lack few enough of each other's words
_DISTANCE = """list_reduce(
      list_transform(range(1, len(a.l) + 1), lambda i: [i]),
      lambda before, i: list_reduce(
        list_transform(range(1, len(b.l) + 1), lambda j: [j]),
        lambda row, j: list_append(row, least(row[-1] + 1, before[j[1] + 1] + 1, before[j[1]] + CASE WHEN a.l[i[1]] = b.l[j[1]] THEN 0 ELSE 1 END)), [i[1]]),
      range(0, len(b.l) + 1))[-1]"""
_OVERLAP_SQL = r"""
WITH one AS (
  SELECT mail_id, side, split, source, array_to_string(l, ' ') AS canon, len(l) AS n, l FROM (
    SELECT mail_id, CASE WHEN lower(trim(min(split))) = 'train' THEN 'train' WHEN lower(trim(min(split))) IN ('dev', 'test') THEN 'eval' END AS side,
           lower(trim(min(split))) AS split, min(source) AS source, regexp_extract_all(lower(min(body)), '[\p{L}\p{N}]+') AS l FROM mails WHERE body IS NOT NULL GROUP BY mail_id)
  WHERE side IS NOT NULL AND len(l) > 0
), classes AS MATERIALIZED (SELECT canon, min(mail_id) AS class_id, any_value(n) AS n, any_value(l) AS l, count(*) FILTER (WHERE side = 'train') AS n_train, count(*) FILTER (WHERE side = 'eval') AS n_eval FROM one GROUP BY canon),
long AS MATERIALIZED (SELECT class_id, n, n_train, n_eval, l, list_distinct(l) AS u FROM classes WHERE n >= 20),
alike AS MATERIALIZED (
  SELECT a.class_id AS x, b.class_id AS y FROM long a JOIN long b ON a.n_eval > 0 AND b.n_train > 0 AND a.class_id <> b.class_id AND abs(a.n - b.n) <= greatest(a.n, b.n) // 5
    AND len(a.u) - len(list_intersect(a.u, b.u)) <= greatest(a.n, b.n) // 5
),
links AS MATERIALIZED (
  SELECT class_id AS class_1, class_id AS class_2, true AS exact FROM classes WHERE n_train > 0 AND n_eval > 0
  UNION ALL
  SELECT x, y, false FROM alike JOIN long a ON a.class_id = x JOIN long b ON b.class_id = y WHERE """ + _DISTANCE + """ <= greatest(a.n, b.n) // 5
), members AS (SELECT one.*, class_id, n_train, n_eval FROM one JOIN classes USING (canon))
"""
SQL["p1_links"] = _OVERLAP_SQL + "SELECT class_1, class_2, exact FROM links"
SQL["p1_found"] = _OVERLAP_SQL + """
SELECT DISTINCT least(e.mail_id, t.mail_id) AS mail_id_1, greatest(e.mail_id, t.mail_id) AS mail_id_2
FROM links JOIN members e ON e.class_id = class_1 AND e.side = 'eval' AND e.n >= 20 JOIN members t ON t.class_id = class_2 AND t.side = 'train'
"""
SQL["p1_report"] = _OVERLAP_SQL + """
, met AS (SELECT class_1 AS class_id, max(CASE WHEN exact THEN 1 ELSE 0 END) AS exact, sum(n_train) AS met FROM links JOIN classes ON classes.class_id = class_2 GROUP BY class_1)
SELECT split, source, count(*) AS records, count(*) FILTER (WHERE exact = 1) AS exact, count(*) FILTER (WHERE exact = 0) AS near, CAST(coalesce(sum(met), 0) AS BIGINT) AS training_records_met
FROM members LEFT JOIN met USING (class_id) WHERE side = 'eval' GROUP BY split, source
"""
SQL["p1_classes"] = _OVERLAP_SQL + """
, to_train AS (SELECT class_1 AS class_id, sum(n_train) AS k FROM links JOIN classes ON classes.class_id = class_2 GROUP BY class_1),
to_eval AS (SELECT class_2 AS class_id, sum(n_eval) AS k FROM links JOIN classes ON classes.class_id = class_1 GROUP BY class_2)
SELECT mail_id, side, class_id, n_train + n_eval AS members, CAST(coalesce(CASE WHEN side = 'eval' THEN t.k ELSE e.k END, 0) AS BIGINT) AS links
FROM members LEFT JOIN to_train t USING (class_id) LEFT JOIN to_eval e USING (class_id)
"""


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that have a passage of at least 200 characters in common."""
    pairs = spans.sharing_pairs(spans.find_shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return pairs.select(F.col("id_1").alias("doc_id_1"), F.col("id_2").alias("doc_id_2"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every story of at least 200 characters with its class of equal stories and the number of stories it shares a passage with."""
    rows = spans.sharing_classes(spans.find_shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return rows.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), "members", "links")


def p10_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of equal stories that have a passage in common."""
    return spans.sharing_links(spans.find_shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text"))


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared passages of every story and how much of it they cover."""
    documents = table(spark, sf_dir, "documents")
    rows = spans.shared_coverage(documents, "doc_id", "text", spans.find_shared_spans(documents, "doc_id", "text"))
    return rows.withColumn("passages", F.array_join(F.transform("passages", lambda p: F.concat(p["start"].cast("string"), F.lit("-"), p["stop"].cast("string"))), " "))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every mail that its sender newly wrote."""
    return mailtext.newly_written(table(spark, sf_dir, "mails"), "mail_id", "body", "subject", "sender", "received_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every page's text that belong to its article."""
    return pagetext.main_content(table(spark, sf_dir, "pages"), "page_id", "url", "text", "html_source", "title")


_STRETCHES_SQL = """
WITH places AS (SELECT doc_id, text, i, substr(text, i, 200) AS s FROM (SELECT doc_id, text, CAST(unnest(range(1, length(text) - 198)) AS INTEGER) AS i FROM documents WHERE length(text) >= 200)),
stretches AS (SELECT DISTINCT doc_id, s FROM places),
shared AS MATERIALIZED (SELECT s FROM stretches GROUP BY s HAVING count(*) > 1),
linked AS MATERIALIZED (SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM stretches a JOIN shared USING (s) JOIN stretches b ON a.s = b.s AND a.doc_id < b.doc_id),
classes AS (SELECT text, min(doc_id) AS class_id, count(*) AS members FROM documents WHERE length(text) >= 200 GROUP BY text),
members AS MATERIALIZED (SELECT doc_id, class_id, members FROM documents JOIN classes USING (text))
"""
SQL["p10_found"] = _STRETCHES_SQL + "SELECT doc_id_1, doc_id_2 FROM linked"
SQL["p10_links"] = _STRETCHES_SQL + """
SELECT DISTINCT least(a.class_id, b.class_id) AS class_1, greatest(a.class_id, b.class_id) AS class_2
FROM linked JOIN members a ON a.doc_id = doc_id_1 JOIN members b ON b.doc_id = doc_id_2 WHERE a.class_id <> b.class_id
"""
SQL["p10_classes"] = _STRETCHES_SQL + """
, met AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id_1 AS doc_id FROM linked UNION ALL SELECT doc_id_2 FROM linked) GROUP BY doc_id)
SELECT doc_id, class_id, members, coalesce(k, 0) AS links FROM members LEFT JOIN met USING (doc_id)
"""
SQL["p10_coverage"] = _STRETCHES_SQL + """
, held AS (SELECT doc_id, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= i - 200 THEN 0 ELSE 1 END AS starts FROM places JOIN shared USING (s)),
islands AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM held),
spans AS (SELECT doc_id, min(i) - 1 AS a, max(i) + 199 AS b FROM islands GROUP BY doc_id, island),
per AS (SELECT doc_id, string_agg(a || '-' || b, ' ' ORDER BY a) AS passages, CAST(sum(b - a) AS BIGINT) AS shared_chars FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, coalesce(passages, '') AS passages, coalesce(shared_chars, 0) AS shared_chars,
  round(CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / CAST(length(text) AS DOUBLE) ELSE 0 END, 6) AS shared_share
FROM documents LEFT JOIN per USING (doc_id)
"""
