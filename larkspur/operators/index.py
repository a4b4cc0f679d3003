"""The positional inverted index: postings, document lengths, corpus and term statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.stem import stem_dictionary
from larkspur.functions.text import MODELS, tokens
from larkspur.session import cut, cut_buckets, files_state


def positions(documents: DataFrame, ident: str, text: str, model: str = "no_stopwords", algorithm: str = "porter2") -> DataFrame:
    """``doc_id, pos, term``: every token, positions from 0 among those the model keeps.

    Stems are looked up per distinct term. With stems and stop words, words are dropped before stemming, as queries do. Null and empty texts have no rows.
    """
    rows = documents.select(F.col(ident).alias("doc_id"), F.posexplode(tokens(F.col(text), model)).alias("pos", "term"))
    if not MODELS[model]["stem"]:
        return rows
    return rows.join(stem_dictionary(rows, "term", algorithm), "term").select("doc_id", "pos", F.col("stem").alias("term"))


def postings(occurrences: DataFrame) -> DataFrame:
    """``term, doc_id, tf, positions``: one row per term and document, positions ascending."""
    return occurrences.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def document_lengths(documents: DataFrame, ident: str, text: str, model: str = "no_stopwords", length_mode: str = "tokens") -> DataFrame:
    """``doc_id, len`` of every document, 0 without text; ``length_mode='distinct'`` counts distinct terms instead of tokens.

    Lengths need no stems and no shuffle: they are the sizes of token arrays.
    """
    found = tokens(F.col(text), model)
    return documents.select(F.col(ident).alias("doc_id"), F.size(F.array_distinct(found) if length_mode == "distinct" else found).cast("bigint").alias("len"))


def half_up(value: Column, digits: int) -> Column:
    """Rounded so that halves go up, whatever the sign."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def corpus_stats(lengths: DataFrame, terms: DataFrame, avg_len_round: int | None = None) -> DataFrame:
    """One row ``d, v, avg_len``: documents, distinct terms and mean length. No document gives 0, 0 and null."""
    average = F.avg("len")
    one = lengths.agg(F.count("*").alias("d"), (half_up(average, avg_len_round) if avg_len_round is not None else average).alias("avg_len"))
    vocabulary = terms.agg(F.count_distinct("term").alias("v"))
    both = one.unionByName(vocabulary, allowMissingColumns=True)
    return both.agg(F.max("d").alias("d"), F.max("v").alias("v"), F.max("avg_len").alias("avg_len"))


def term_stats(postings_: DataFrame, lengths: DataFrame) -> DataFrame:
    """``term, df, ttf, tlen``: documents with the term, its occurrences, and the summed length of those documents."""
    return postings_.join(lengths, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"), F.sum("len").alias("tlen"))


def length_facet(lengths: DataFrame) -> DataFrame:
    """Count, total, extremes, mean, sum of squares, population variance and deviation of document lengths."""
    x = F.col("len").cast("double")
    return lengths.agg(
        F.count("len").alias("count"), F.sum("len").alias("total"), F.min("len").alias("min"), F.max("len").alias("max"), F.avg("len").alias("mean"),
        F.sum(x * x).alias("sum_of_squares"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_deviation"),
    )


def approximate_vocabulary(occurrences: DataFrame, error: float = 0.02) -> DataFrame:
    """One row ``v``: the number of distinct terms from a sketch of fixed size."""
    return occurrences.agg(F.approx_count_distinct("term", error).alias("v"))


def term_lookup(postings_: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of given terms; over an index written in term order the filter reaches the scan and skips its other parts."""
    return postings_.where(F.col("term").isin(terms))


def term_vector(postings_: DataFrame, doc_id: int) -> DataFrame:
    """``term, tf`` of one document."""
    return postings_.where(F.col("doc_id") == doc_id).select("term", "tf")


#: Document numbers a posting block spans: what one row of a merged index can hold is bounded, however common its term.
BLOCK_DOCUMENTS = 65_536


def merge_partial_indexes(parts: list[DataFrame], block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """``term, block, postings``: partial postings (of different documents) merged by one shuffle, a row per term and range of documents."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    block = F.floor(F.col("doc_id") / block_documents)
    return whole.groupBy("term", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "positions"))).alias("postings"))


def as_block(postings_array: Column) -> Column:
    """A term's postings as one text line: ``doc pos pos,doc pos,``."""
    return F.concat_ws("", F.transform(postings_array, lambda p: F.concat(p["doc_id"].cast("string"), F.lit(" "), F.array_join(F.transform(p["positions"], lambda x: x.cast("string")), " "), F.lit(","))))


def catalog(lines: DataFrame, order: list[str], line: str) -> DataFrame:
    """``order, start, size``: where each line begins, and its bytes, in a file that holds the lines in order, each with a line feed.

    Offsets are running totals over range partitions, so no task sees all lines; a reader seeks to ``start`` and reads ``size`` bytes.
    """
    from larkspur.operators.web import running_total

    sized = lines.select(*order, F.octet_length(line).cast("bigint").alias("size"))
    placed = running_total(sized, [F.col(c) for c in order], F.col("size") + 1, "stop")
    return placed.select(*order, (F.col("stop") - F.col("size") - 1).alias("start"), "size")


def block_at(path: str, start: int, size: int) -> str:
    """One block of an index file by its place in the catalog; only its bytes are read."""
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(size).decode()


def from_block(block: Column) -> Column:
    """The postings of such a line: an array of document, frequency and positions."""
    parts = F.filter(F.split(block, ","), lambda x: F.trim(x) != "")
    numbers = F.transform(parts, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda y: y.cast("bigint")))
    return F.transform(
        numbers, lambda n: F.struct(n[0].alias("doc_id"), (F.size(n) - 1).cast("bigint").alias("tf"), F.transform(F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))), lambda x: x.cast("int")).alias("positions"))
    )


@dataclass
class Index:
    """A built index: ``postings`` (term, doc_id, tf, positions, len), ``docs`` (doc_id, docno, len), ``terms`` (term, df, ttf, tlen) and the corpus' d, v, avg_len."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    d: int
    v: int
    avg_len: float


def build_index(documents: DataFrame, ident: str, docno: str, text: str, model: str = "no_stopwords", avg_len_round: int | None = None, algorithm: str = "porter2") -> Index:
    """Builds the index once, to be read by any number of queries.

    Documents are dealt to buckets once; a bucket holds its documents' postings, in term order. All of a query's work on a document then
    stays in its bucket, whatever terms it has in common, a common term is no hot key, and a query's terms read only the
    parts of a bucket that hold them. Documents' lengths travel with their postings, which saves queries a join.
    """
    kept = tokens(F.col(text), model)
    base = documents.select(F.col(ident).alias("doc_id"), F.col(docno).alias("docno"), kept.alias("t"))
    docs = cut(base.select("doc_id", "docno", F.size("t").cast("bigint").alias("len")), "docs")
    rows = base.repartition("doc_id").select("doc_id", F.size("t").cast("bigint").alias("len"), F.posexplode("t").alias("pos", "term"))
    if MODELS[model]["stem"]:
        rows = rows.join(stem_dictionary(rows, "term", algorithm), "term").withColumn("term", F.col("stem")).drop("stem")
    found = rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"), F.first("len").alias("len"))
    written = cut_buckets(found, "doc_id", ["term", "doc_id"], "postings")
    terms = cut(written.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"), F.sum("len").alias("tlen")), "terms")
    stats = docs.agg(F.count("*").alias("d"), F.avg("len").alias("a")).first()
    avg = stats["a"]
    if avg is not None and avg_len_round is not None:
        avg = int(avg * 10**avg_len_round + 0.5) / 10**avg_len_round
    return Index(written, docs, terms, stats["d"], terms.count(), avg or 0.0)


_BUILT: dict[tuple, Index] = {}


def index_of(documents: DataFrame, key: str, model: str = "no_stopwords") -> Index:
    """The index of a collection, built once per application and kept in the shared folder; anew when the collection's files have changed."""
    name = (documents.sparkSession.sparkContext.applicationId, key, model, files_state(documents))
    if name not in _BUILT:
        _BUILT[name] = build_index(documents, "doc_id", "docno", "text", model)
    return _BUILT[name]


def ranked(scores: DataFrame, group: list[str], score: str, ties: list[str], most: int) -> DataFrame:
    """``rank`` from 1 by descending score within each group, up to ``most``; Spark drops what cannot qualify before its shuffle."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
