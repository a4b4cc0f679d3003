"""Learning to rank and spam classification on feature tables."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.index import ranked

LTR_FEATURES = ("okapi_score", "tfidf_score", "bm25_score", "laplace_score", "mercer_score")


def hash_split(ident: Column, parts: int = 5, seed: int = 7) -> Column:
    """``test`` for one part in ``parts`` by a hash of the identifier, else ``train``: the same on every run."""
    return F.when(F.pmod(F.xxhash64(ident, F.lit(seed)), F.lit(parts)) == 0, F.lit("test")).otherwise(F.lit("train"))


def modulo_split(ident: Column, parts: int = 5) -> Column:
    """The same by the identifier itself."""
    return F.when(ident % parts == 0, F.lit("test")).otherwise(F.lit("train"))


def ltr_matrix(qrels: DataFrame, runs: dict[str, DataFrame]) -> DataFrame:
    """``query_no, docno, <run>.., label``: the judged documents with each run's score (0.0 where it lacks the document) and the highest judgment.

    The runs are stacked and pivoted in one aggregation instead of one join each.
    """
    names = list(runs)
    stacked = None
    for n, r in runs.items():
        part = r.select("query_no", "docno", F.lit(n).alias("run"), "score")
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy("query_no", "docno").agg(*(F.max(F.when(F.col("run") == n, F.col("score"))).alias(n) for n in names))
    rated = qrels.groupBy("query_no", "docno").agg(F.max("rel").cast("double").alias("label"))
    return rated.join(wide, ["query_no", "docno"], "left").na.fill(0.0, names).select("query_no", "docno", *names, "label")


def latest_features(matrix: DataFrame, keys: list[str], features: tuple[str, ...], at: str) -> DataFrame:
    """The latest row of each key; missing and NaN features as 0.0, the label as a number, null where unknown (``?``)."""
    last = matrix.groupBy(*keys).agg(F.max(F.struct(at, *features, "relevance")).alias("r"))
    clean = [F.when(F.col(f"r.{f}").isNull() | F.isnan(f"r.{f}"), 0.0).otherwise(F.col(f"r.{f}")).alias(f) for f in features]
    return last.select(*keys, *clean, F.when(F.col("r.relevance").rlike("^[0-9]+$"), F.col("r.relevance").try_cast("double")).alias("label"))


def fit_linear(train: DataFrame, features: tuple[str, ...] = LTR_FEATURES):
    """Least-squares weights of the features for the label, over rows that have one."""
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train.where(F.col("label").isNotNull()))
    return LinearRegression(featuresCol="_x", labelCol="label", solver="normal").fit(rows)


def linear_score(rows: DataFrame, model, features: tuple[str, ...] = LTR_FEATURES) -> DataFrame:
    """``score``: the model's value, as a plain expression of the columns."""
    value = F.lit(float(model.intercept))
    for f, w in zip(features, model.coefficients, strict=True):
        value = value + F.lit(float(w)) * F.col(f)
    return rows.withColumn("score", value)


def ltr_runs(matrix: DataFrame, query: str, docno: str, features: tuple[str, ...] = LTR_FEATURES, most: int = 1000) -> DataFrame:
    """``query_no, docno, split, rank, score``: topics split by hash, a linear model fitted on the training ones, and both parts ranked by it."""
    rows = matrix.withColumn("split", hash_split(F.col(query)))
    model = fit_linear(rows.where("split = 'train'"), features)
    scored = linear_score(rows, model, features).select(F.col(query).alias("query_no"), F.col(docno).alias("docno"), "split", F.round("score", 6).alias("score"))
    return ranked(scored, ["query_no"], "score", ["docno"], most)


def string_order(score: Column, docno: Column) -> Column:
    """The compatible ordering key: the score written with 17 decimals, followed by the document number, compared as text."""
    return F.concat(F.format_string("%.17f", score), docno)


def confusion(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: relevant and irrelevant right and wrong, and the part that is right. Rows without a label don't count."""
    y, p = F.col(label) > 0, F.col(predicted) > 0
    return predictions.where(F.col(label).isNotNull()).agg(
        F.count_if(y & p).alias("relevant_right"), F.count_if(y & ~p).alias("relevant_wrong"), F.count_if(~y & ~p).alias("irrelevant_right"),
        F.count_if(~y & p).alias("irrelevant_wrong"), F.avg(F.when(y == p, 1.0).otherwise(0.0)).alias("accuracy"),
    )


def confusion_by(predictions: DataFrame, label: str, predicted: str, split: str) -> DataFrame:
    """The same for each split and, under ``total``, for all, from one aggregation: every row counts for its split and for the total."""
    each = predictions.where(F.col(split).isNotNull() & F.col(label).isNotNull()).select(F.explode(F.array(F.col(split), F.lit("total"))).alias("split"), F.col(label).alias("y"), F.col(predicted).alias("p"))
    y, p = F.col("y") > 0, F.col("p") > 0
    return each.groupBy("split").agg(
        F.count_if(y & p).alias("relevant_right"), F.count_if(y & ~p).alias("relevant_wrong"), F.count_if(~y & ~p).alias("irrelevant_right"),
        F.count_if(~y & p).alias("irrelevant_wrong"), F.avg(F.when(y == p, 1.0).otherwise(0.0)).alias("accuracy"),
    )


def spam_tree(matrix: DataFrame, features: list[str], depth: int = 5):
    """A decision tree by information gain, fitted on the rows with a label."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(matrix.where(F.col("label").isNotNull()))
    return DecisionTreeClassifier(featuresCol="_x", labelCol="label", impurity="entropy", maxDepth=depth, seed=1).fit(rows)


def tree_predictions(matrix: DataFrame, model, features: list[str]) -> DataFrame:
    """``prediction, p_spam`` of each row."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(matrix)
    out = model.transform(rows).withColumn("p_spam", F.round(vector_to_array("probability")[1], 9))
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("_x", "rawPrediction", "probability")


def linear_weights(rows: DataFrame, tokens: str, label: str, strength: float = 0.01, most_terms: int = 1 << 24):
    """``term, term_id, weight`` of a logistic regression on term counts.

    ``most_terms`` is a documented bound of the fitted model, which the driver and every task hold: 2**24 weights are 128 MB. A larger vocabulary is refused, not cut.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(tokens).isNotNull()).select(F.col(label).cast("double").alias("label"), F.col(tokens).alias("_t"))
    counter = CountVectorizer(inputCol="_t", outputCol="_x", vocabSize=most_terms + 1).fit(known)
    if len(counter.vocabulary) > most_terms:
        raise ValueError(f"more than {most_terms} terms: raise most_terms, or leave out rare ones before")
    model = LogisticRegression(featuresCol="_x", labelCol="label", regParam=strength, maxIter=25).fit(counter.transform(known))
    pairs = [(t, i + 1, float(w)) for i, (t, w) in enumerate(zip(counter.vocabulary, model.coefficients.toArray(), strict=True))]
    return rows.sparkSession.createDataFrame(pairs, "term string, term_id int, weight double")


def top_terms(weights: DataFrame, n: int = 1000) -> DataFrame:
    """``term, weight``: the terms with the greatest weights, equal ones by term."""
    return weights.orderBy(F.col("weight").desc(), "term").limit(n).select("term", "weight")


def named_weights(weights: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, weight`` of weights by number (a fitted model read from a file) and a term dictionary."""
    return weights.join(terms, "term_id").select("term", "weight")
