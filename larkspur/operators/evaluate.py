"""Evaluation of runs against relevance judgments, all topics at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs and recall levels of the measures, and the depth to which a run counts.
CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
DEPTH = 1000


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean of precision and recall, 0 where both are 0."""
    return F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(F.lit(0.0))


def judged(qrels: DataFrame, compat: bool = False) -> DataFrame:
    """``query_no, docno, rel``: one judgment per document, the highest of its assessors (``compat``: the last by assessor). Null judgments count 0."""
    rel = F.coalesce(F.col("rel"), F.lit(0))
    best = F.max_by(rel, F.col("assessor")) if compat else F.max(rel)
    return qrels.groupBy("query_no", "docno").agg(best.cast("int").alias("rel"))


def judged_total(qrels: DataFrame) -> DataFrame:
    """One row ``topics, lines, judged, relevant``: topics, judging lines, judged documents (a document of two topics is two) and the relevant ones among them."""
    one = qrels.groupBy("query_no", "docno").agg(F.count("*").alias("lines"), F.max(F.coalesce("rel", F.lit(0))).alias("rel"))
    return one.agg(F.count_distinct("query_no").alias("topics"), F.sum("lines").alias("lines"), F.count("*").alias("judged"), F.count_if(F.col("rel") > 0).alias("relevant"))


def relevant_counts(qrels: DataFrame, compat: bool = False) -> DataFrame:
    """``query_no, n_rel``: relevant documents per topic; ``compat`` counts every judging line."""
    rows = qrels if compat else judged(qrels)
    return rows.groupBy("query_no").agg(F.count_if(F.col("rel") > 0).alias("n_rel"))


def judged_run(run: DataFrame, qrels: DataFrame, score: str = "score", compat: bool = False) -> DataFrame:
    """``query_no, docno, rank, rel, n_rel, rel_ret``: the run to its depth, with 0/1 relevance and the relevant documents seen so far.

    Topics without a relevant document are left out. Equal scores go by document number.
    """
    rated = judged(qrels, compat)
    asked = relevant_counts(qrels, compat).where("n_rel > 0")
    w = Window.partitionBy("query_no").orderBy(F.col(score).desc_nulls_last(), "docno")
    top = run.select("query_no", "docno", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= DEPTH)
    rows = top.join(asked, "query_no").join(rated.withColumnRenamed("rel", "grade"), ["query_no", "docno"], "left")
    rel = F.when(F.col("grade") > 0, 1).otherwise(0)
    so_far = Window.partitionBy("query_no").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("rel", rel).withColumn("rel_ret", F.sum("rel").over(so_far)).select("query_no", "docno", "rank", "rel", "n_rel", "rel_ret")


def precision_recall_at(run: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """``query_no, cutoff, precision, recall, f1``; beyond the end of a run nothing more is found."""
    per = run.groupBy("query_no").agg(F.max("n_rel").alias("n_rel"), *(F.count_if((F.col("rank") <= k) & (F.col("rel") == 1)).alias(f"c{k}") for k in cutoffs))
    each = per.select("query_no", "n_rel", F.explode(F.array(*(F.struct(F.lit(k).alias("cutoff"), F.col(f"c{k}").alias("found")) for k in cutoffs))).alias("x"))
    p, r = F.col("x.found") / F.col("x.cutoff"), F.col("x.found") / F.col("n_rel")
    return each.select("query_no", F.col("x.cutoff").alias("cutoff"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def average_precision(run: DataFrame) -> DataFrame:
    """``query_no, avg_prec``: precision at each relevant document found, summed, by the number of relevant documents."""
    found = F.when(F.col("rel") == 1, F.col("rel_ret") / F.col("rank")).otherwise(0.0)
    return run.groupBy("query_no").agg((F.sum(found) / F.max("n_rel")).alias("avg_prec"))


def r_precision(run: DataFrame) -> DataFrame:
    """``query_no, r_prec``: precision after as many documents as are relevant; a shorter run is counted as if padded."""
    return run.groupBy("query_no").agg((F.count_if((F.col("rel") == 1) & (F.col("rank") <= F.col("n_rel"))) / F.max("n_rel")).alias("r_prec"))


def interpolated_precision(run: DataFrame, recalls: tuple[float, ...] = RECALLS) -> DataFrame:
    """``query_no, recall, precision``: the best precision at any rank with at least that recall, 0 if it is never reached."""
    level = F.explode(F.array(*(F.lit(r) for r in recalls))).alias("recall")
    at = F.col("rel_ret") / F.col("rank")
    topics = run.groupBy("query_no").agg(F.collect_list(F.when(F.col("rel") == 1, F.struct((F.col("rel_ret") / F.col("n_rel")).alias("r"), at.alias("p")))).alias("points"), F.max(at).alias("best"))
    each = topics.select("query_no", "points", "best", level)
    reached = F.array_max(F.transform(F.filter("points", lambda x: x["r"] >= F.col("recall")), lambda x: x["p"]))
    return each.select("query_no", "recall", F.coalesce(F.when(F.col("recall") <= 0, F.col("best")).otherwise(reached), F.lit(0.0)).alias("precision"))


def ndcg(run: DataFrame, log2: bool = False) -> DataFrame:
    """``query_no, ndcg``: discounted gain by that of the same documents in ideal order; discounts are decimal logarithms of the rank (or binary ones
    of rank + 1), the first document's gain is whole, relevance is 0 or 1. 0 where nothing relevant was found."""
    if log2:
        def gain(rank: Column) -> Column:
            return 1 / F.log2(rank + 1)
    else:
        def gain(rank: Column) -> Column:
            return F.when(rank == 1, 1.0).otherwise(1 / F.log10(F.when(rank > 1, rank).otherwise(10)))
    got = run.groupBy("query_no").agg(F.sum(F.when(F.col("rel") == 1, gain(F.col("rank").cast("double"))).otherwise(0.0)).alias("dcg"), F.sum("rel").cast("int").alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("found"), F.lit(1))), F.lit(0.0), lambda a, k: a + gain(k.cast("double")))
    return got.select("query_no", F.when(F.col("found") > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0)).alias("ndcg"))


def pr_curve(run: DataFrame) -> DataFrame:
    """``query_no, i, recall, prec, interp_prec`` at each relevant document found, every topic under its own number."""
    after = Window.partitionBy("query_no").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = run.where("rel = 1").withColumn("prec", F.col("rel_ret") / F.col("rank"))
    return rows.select("query_no", F.col("rel_ret").alias("i"), (F.col("rel_ret") / F.col("n_rel")).alias("recall"), "prec", F.max("prec").over(after).alias("interp_prec"))


def summary(run: DataFrame) -> DataFrame:
    """One row: topics, documents retrieved, relevant and relevant retrieved, and the means over topics of average and R-precision and nDCG."""
    totals = run.groupBy("query_no").agg(F.count("*").alias("ret"), F.max("n_rel").alias("n_rel"), F.sum("rel").alias("found"))
    each = totals.join(average_precision(run), "query_no").join(r_precision(run), "query_no").join(ndcg(run), "query_no")
    return each.agg(
        F.count("*").alias("topics"), F.sum("ret").alias("retrieved"), F.sum("n_rel").alias("relevant"), F.sum("found").alias("relevant_retrieved"),
        F.avg("avg_prec").alias("map"), F.avg("r_prec").alias("r_prec"), F.avg("ndcg").alias("ndcg"),
    )


def measures(run: DataFrame) -> DataFrame:
    """``query_no, retrieved, relevant, relevant_retrieved`` and every measure of each topic, by name: mean precision, R-precision, nDCG, the interpolated precisions and those at the cut-offs."""
    totals = run.groupBy("query_no").agg(F.count("*").alias("retrieved"), F.max("n_rel").alias("relevant"), F.sum("rel").alias("relevant_retrieved"))
    levels = interpolated_precision(run).groupBy("query_no").agg(*(F.max(F.when(F.col("recall") == r, F.col("precision"))).alias(f"at_{round(100 * r):03d}") for r in RECALLS))
    cuts = precision_recall_at(run).groupBy("query_no").agg(
        *(F.max(F.when(F.col("cutoff") == k, F.col(m))).alias(f"{a}_{k}") for a, m in (("p", "precision"), ("r", "recall"), ("f1", "f1")) for k in CUTOFFS)
    )
    whole = totals
    for part in (average_precision(run), r_precision(run), ndcg(run), levels, cuts):
        whole = whole.join(part, "query_no")
    return whole


def report(run: DataFrame) -> DataFrame:
    """``query_no, line_no, line``: the evaluation as text, topic by topic and under ``all`` in total, numbers with four decimals, halves to even.

    Counts are summed over topics, measures are means. The total comes from one more aggregation of the topics' rows.
    """
    topics = measures(run)
    counts = ("retrieved", "relevant", "relevant_retrieved")
    names = [c for c in topics.columns if c != "query_no" and c not in counts]
    total = topics.agg(*(F.sum(c).alias(c) for c in counts), *(F.avg(c).alias(c) for c in names)).select(F.lit("all").alias("query_no"), *counts, *names)
    rows = topics.select("query_no", *counts, *names).unionByName(total)
    lines = [F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in counts] + [F.concat(F.lit(f"{c} "), four_decimals(F.col(c))) for c in names]
    return rows.select("query_no", F.posexplode(F.array(*lines)).alias("line_no", "line"))


def four_decimals(value: Column) -> Column:
    """A number with four decimals, a half rounded to the even digit, without grouping."""
    return F.replace(F.format_number(value, 4), F.lit(","), F.lit(""))
