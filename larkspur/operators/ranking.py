"""Ranking of documents for topics: five term models, proximity and rank fusion, all topics in one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.stem import stem_dictionary
from larkspur.functions.text import MODELS, query_tokens
from larkspur.operators.index import Index, ranked
from larkspur.session import cut, measured

# Parameters of the models.
K1, K2, B = 1.2, 1.5, 0.75
LAMBDA = 0.99
PROXIMITY_CEILING = 1500
RUN_LENGTH = 1000
SCORE_DIGITS = 6

#: A topic with more candidates than this is not ranked whole; a table of up to so many small rows is broadcast.
WHOLE_TOPIC_ROWS, BROADCAST_ROWS = 2_000_000, 1_000_000

TERM_MODELS = ("okapi", "tfidf", "bm25", "laplace", "jm")


def query_terms(topics: DataFrame, query_no: str = "query_no", text: str = "text", model: str = "no_stopwords", drop_first: int = 3) -> DataFrame:
    """``query_no, term, qtf`` of each topic. A topic without words of its own has no rows; null texts are such."""
    parts = topics.select(F.col(query_no).alias("query_no"), F.explode(query_tokens(F.col(text), drop_first)).alias("term"))
    if MODELS[model]["stem"]:
        parts = parts.join(stem_dictionary(parts), "term").select("query_no", F.col("stem").alias("term"))
    return parts.groupBy("query_no", "term").agg(F.count("*").alias("qtf"))


def okapi(tf: Column, length: Column, avg_len: float) -> Column:
    return tf / (tf + 0.5 + 1.5 * length / F.lit(avg_len))


def tfidf(tf: Column, length: Column, avg_len: float, d: int, df: Column) -> Column:
    """The quotient of document counts is that of whole numbers."""
    return okapi(tf, length, avg_len) * F.log10(F.floor(F.lit(d) / df).cast("double"))


def bm25(tf: Column, length: Column, avg_len: float, d: int, df: Column, qtf: Column) -> Column:
    rarity = F.log10((F.lit(d) + 0.5) / (df + 0.5))
    return rarity * (tf + K1 * tf) / (tf + K1 * ((1 - B) + B * length / F.lit(avg_len))) * (qtf + K2 * qtf) / (qtf + K2)


def laplace(tf: Column, length: Column, v: int) -> Column:
    return F.log10((tf + 1) / (length + F.lit(v)))


def jm_present(tf: Column, length: Column, ttf: Column, tlen: Column, compat: bool = False) -> Column:
    """The background is what the other documents with the term hold; without any it is 0 (``compat``: not a number)."""
    none = F.lit(float("nan")) if compat else F.lit(0.0)
    background = F.when(tlen - length > 0, (ttf - tf) / F.when(tlen - length > 0, tlen - length)).otherwise(none)
    return F.log10(F.lit(LAMBDA) * tf / length + F.lit(1 - LAMBDA) * background)


def jm_absent(length: Column, ttf: Column, tlen: Column, compat: bool = False) -> Column:
    """0 where the remaining documents with the term have no length (``compat``: not a number)."""
    none = F.lit(float("nan")) if compat else F.lit(0.0)
    return F.when(tlen - length > 0, F.log10(F.lit(1 - LAMBDA) * ttf / F.when(tlen - length > 0, tlen - length))).otherwise(none)


def matches(index: Index, terms: DataFrame, positions: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Query terms joined with their postings and statistics; terms that no document holds fall out.

    The terms are written and counted first. Up to ``broadcast_rows`` they are broadcast, so no posting moves and a common term is no hot key; more are
    dealt by topic to batches of about that size, each broadcast, and each reads of the postings' buckets what its terms need.
    """
    known, seen = measured(terms.join(index.terms, "term"), "known", n=F.count("*"))
    columns = ["term", "doc_id", "tf", "len", *(["positions"] if positions else [])]
    postings = index.postings.select(*columns)
    batches = -(-seen["n"] // broadcast_rows)
    if batches <= 1:
        return F.broadcast(known).join(postings, "term")
    part = F.pmod(F.xxhash64("query_no"), F.lit(batches))
    whole = None
    for i in range(batches):
        found = F.broadcast(known.where(part == i)).join(postings, "term")
        whole = found if whole is None else whole.unionByName(found)
    return whole


def all_scores(index: Index, terms: DataFrame, models: tuple[str, ...] = TERM_MODELS, compat: bool = False) -> DataFrame:
    """``query_no, doc_id`` and the models' scores of every document with a query term.

    One join and one aggregation serve all topics and models. What absent terms add to the language models is not
    expanded into a grid of documents and terms: for Laplace it is a count, for Jelinek-Mercer a sum for each distinct
    length of a topic's candidates, which are few.
    """
    unknown = set(models) - set(TERM_MODELS)
    if unknown:
        raise ValueError(f"no models {sorted(unknown)}")
    tf, length, df, qtf, ttf, tlen = (F.col(c) for c in ("tf", "len", "df", "qtf", "ttf", "tlen"))
    parts = {
        "okapi": okapi(tf, length, index.avg_len), "tfidf": tfidf(tf, length, index.avg_len, index.d, df), "bm25": bm25(tf, length, index.avg_len, index.d, df, qtf),
        "laplace": laplace(tf, length, index.v) - F.log10(1 / (length + F.lit(index.v))), "jm": jm_present(tf, length, ttf, tlen, compat) - jm_absent(length, ttf, tlen),
    }
    found = matches(index, terms)
    present = found.groupBy("query_no", "doc_id").agg(F.first("len").alias("len"), *(F.sum(parts[m]).alias(m) for m in models))
    if not {"laplace", "jm"} & set(models):
        return present.select("query_no", "doc_id", *models)
    known = cut(terms.join(index.terms, "term").select("query_no", "ttf", "tlen"), "asked")
    counts = known.groupBy("query_no").agg(F.count("*").alias("n_asked"))
    if "jm" not in models:
        whole = present.join(counts, "query_no")
    else:
        # what absent terms give depends on topic and length alone, and those are read from the matches without scores
        absent = F.sum(jm_absent(F.col("len"), F.col("ttf"), F.col("tlen"), compat)).alias("grid")
        grid, seen = measured(found.select("query_no", "len").distinct().join(known, "query_no").groupBy("query_no", "len").agg(absent, F.count("*").alias("n_asked")), "grid", n=F.count("*"))
        whole = present.join(F.broadcast(grid) if seen["n"] <= BROADCAST_ROWS else grid, ["query_no", "len"])
    out = {"laplace": F.col("laplace") + F.col("n_asked") * F.log10(1 / (F.col("len") + F.lit(index.v))), "jm": F.col("jm") + F.col("grid")}
    return whole.select("query_no", "doc_id", *(out[m].alias(m) if m in out else F.col(m) for m in models))


def scored(index: Index, terms: DataFrame, models: tuple[str, ...] = TERM_MODELS) -> DataFrame:
    """``all_scores``, rounded and written once, for any number of runs and fusions."""
    return cut(all_scores(index, terms, models).select("query_no", "doc_id", *(F.round(m, SCORE_DIGITS).alias(m) for m in models)), "scores")


def run_of(index: Index, scores: DataFrame, score: str, most: int = RUN_LENGTH, digits: int = SCORE_DIGITS) -> DataFrame:
    """``query_no, doc_id, docno, rank, score``: the best documents of each topic, rounded scores first, then identifier."""
    rounded = scores.select("query_no", "doc_id", F.round(score, digits).alias("score"))
    return ranked(rounded, ["query_no"], "score", ["doc_id"], most).join(index.docs.select("doc_id", "docno"), "doc_id").select("query_no", "doc_id", "docno", "rank", "score")


def rank(index: Index, terms: DataFrame, model: str, most: int = RUN_LENGTH) -> DataFrame:
    """The run of one term model."""
    return run_of(index, all_scores(index, terms, (model,)), model, most)


def min_windows(index: Index, terms: DataFrame) -> DataFrame:
    """``query_no, doc_id, n_terms, len, min_window``: the smallest span (last position less first) that holds each matched query term once.

    Documents with one matched term have none.
    """
    found = matches(index, terms, positions=True)
    per_doc = found.groupBy("query_no", "doc_id").agg(F.first("len").alias("len"), F.count("*").alias("n_terms"), F.collect_list("positions").alias("lists")).where("n_terms >= 2")
    schema = f"query_no {terms.schema['query_no'].dataType.simpleString()}, doc_id bigint, n_terms bigint, len bigint, min_window int"
    return per_doc.select("query_no", "doc_id", "n_terms", "len", "lists").mapInArrow(_window_runner, schema)


def _window_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array(smallest_windows(batch.column("lists")), pa.int32())
        yield pa.record_batch({**{c: batch.column(c) for c in ("query_no", "doc_id", "n_terms", "len")}, "min_window": found})


def smallest_windows(lists: pa.ListArray) -> np.ndarray:
    """The smallest covering span of each row's position lists, all rows of a batch at once.

    Occurrences are ordered by row and position; for each list the last position so far is carried forward, and at every occurrence
    from which all lists of its row have been met, the span reaches back to the least of those.
    """
    outer, inner, places = lists.offsets.to_numpy(), lists.values.offsets.to_numpy(), lists.values.values.to_numpy().astype(np.int64)
    size = np.diff(outer)
    row_of_list = np.repeat(np.arange(len(lists)), size)
    list_no = np.arange(len(row_of_list)) - outer[:-1][row_of_list]
    row, no = np.repeat(row_of_list, np.diff(inner)), np.repeat(list_no, np.diff(inner))
    order = np.lexsort((places, row))
    row, no, places = row[order], no[order], places[order]
    floor = row * (int(places.max(initial=0)) + 1)
    at = floor + places
    least = at.copy()
    for k in range(int(size.max(initial=0))):
        last = np.maximum.accumulate(np.where(no == k, at, -1))
        least = np.where(size[row] > k, np.minimum(least, last), least)
    span = np.where(least >= floor, at - least, np.iinfo(np.int32).max)
    return np.minimum.reduceat(span, np.flatnonzero(np.diff(row, prepend=-1))) if len(row) else np.zeros(0, dtype=np.int64)


def proximity(index: Index, terms: DataFrame, most: int = RUN_LENGTH) -> DataFrame:
    """The run by closeness of at least two distinct query terms."""
    scored = min_windows(index, terms).withColumn("score", (PROXIMITY_CEILING - F.col("min_window")) * F.col("n_terms") / (F.col("len") + F.lit(index.v)))
    return run_of(index, scored, "score", most)


def borda(scores: DataFrame, models: tuple[str, ...] = TERM_MODELS, most: int = RUN_LENGTH, whole_topic_rows: int = WHOLE_TOPIC_ROWS) -> DataFrame:
    """``query_no, doc_id, points``: each model gives a document 1001 less its rank, nothing beyond rank 1000; all candidates are kept.

    A topic's candidates are dealt to one task, once for all models. Topics with more than ``whole_topic_rows`` of them, of which there are at most rows / ``whole_topic_rows``,
    are ranked in a window per topic and model before whose shuffle each task drops what cannot be among a model's best.
    """
    hot = [r[0] for r in scores.groupBy("query_no").agg(F.count("*").alias("n")).where(F.col("n") > whole_topic_rows).select("query_no").toLocalIterator()]
    usual = scores.where(~F.col("query_no").isin(hot)) if hot else scores
    place = [F.row_number().over(Window.partitionBy("query_no").orderBy(F.col(m).desc_nulls_last(), "doc_id")).alias(m) for m in models]
    points = sum((F.greatest(F.lit(most + 1) - F.col(m), F.lit(0)) for m in models), F.lit(0)).cast("bigint").alias("points")
    found = usual.select("query_no", "doc_id", *place).select("query_no", "doc_id", points)
    if not hot:
        return found
    many = scores.where(F.col("query_no").isin(hot))
    stacked = many.select("query_no", "doc_id", F.posexplode(F.array(*models)).alias("model", "score"))
    best = ranked(stacked, ["query_no", "model"], "score", ["doc_id"], most).select("query_no", "doc_id", (F.lit(most + 1) - F.col("rank")).alias("p"))
    given = many.select("query_no", "doc_id", F.lit(0).alias("p")).unionByName(best).groupBy("query_no", "doc_id").agg(F.sum("p").cast("bigint").alias("points"))
    return found.unionByName(given)


def search(index: Index, text: str, n: int = RUN_LENGTH, model: str = "bm25", drop_first: int = 0) -> DataFrame:
    """The ``n`` best documents for a free text."""
    topic = index.docs.sparkSession.createDataFrame([("search", text)], "query_no string, text string")
    return rank(index, query_terms(topic, drop_first=drop_first), model, n)


def qrel_lines(scored: DataFrame, query_no: str, assessor: str, n: int = 200) -> DataFrame:
    """``line``: the ``n`` best hand-scored documents (``docno, score``) as judgments ``query assessor document grade``."""
    best = scored.orderBy(F.col("score").desc_nulls_last(), "docno").limit(n)
    return best.select(F.concat_ws(" ", F.lit(query_no), F.lit(assessor), "docno", F.col("score").cast("int").cast("string")).alias("line"))


def fuse_runs(runs: list[DataFrame], most: int = RUN_LENGTH) -> DataFrame:
    """The same fusion of runs given as tables ``query_no, docno, rank``."""
    whole = runs[0].select("query_no", "docno", "rank")
    for r in runs[1:]:
        whole = whole.unionByName(r.select("query_no", "docno", "rank"))
    return whole.groupBy("query_no", "docno").agg(F.sum(F.greatest(F.lit(most + 1) - F.col("rank"), F.lit(0))).cast("bigint").alias("points"))


def run_lines(run: DataFrame, tag: str = "Exp") -> DataFrame:
    """A run as text lines ``query Q0 document rank score tag``."""
    return run.select(F.concat_ws(" ", "query_no", F.lit("Q0"), "docno", F.col("rank").cast("string"), F.format_string("%.6f", "score"), F.lit(tag)).alias("line"))
