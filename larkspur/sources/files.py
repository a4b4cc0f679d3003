"""Readers and writers of the text formats collections, topics, runs, judgments, graphs, mails and matrices come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.graph import adjacency
from larkspur.operators.mail import libsvm_lines, split_mail, subject_lines
from larkspur.operators.ranking import run_lines


def read_collection(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``docno, text`` of tagged documents, many to a file; a document's several texts are joined by line feeds. Other files (a readme) go by ``glob``."""
    reader = spark.read.option("lineSep", "</DOC>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parse_collection(reader.text(path))


def parse_collection(parts: DataFrame) -> DataFrame:
    """The same of a table ``value`` that holds one document a row; rows without a document number are left out."""
    docno = F.regexp_extract("value", r"<DOCNO>\s*(\S+)\s*</DOCNO>", 1)
    texts = F.regexp_extract_all("value", F.lit(r"(?s)<TEXT>\s*(.*?)\s*</TEXT>"), F.lit(1))
    return parts.select(docno.alias("docno"), F.array_join(texts, "\n").alias("text")).where(F.col("docno") != "")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``query_no, text`` of lines ``51.   text``; blank lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.trim(F.split("value", r"\.\s+", 2)[0]).alias("query_no"), F.trim(F.get(F.split("value", r"\.\s+", 2), F.lit(1))).alias("text"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word`` of a list with one word a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def _fields(value: Column, n: int) -> list[Column]:
    parts = F.split(F.trim(F.regexp_replace(value, "\r$", "")), r"\s+")
    return [F.get(parts, F.lit(i)) for i in range(n)]


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``query_no, q0, docno, rank, score, tag`` of six blank-separated columns; line ends may be of either kind."""
    q, q0, d, r, s, t = _fields(F.col("value"), 6)
    return spark.read.text(path).where(F.trim("value") != "").select(q.alias("query_no"), q0.alias("q0"), d.alias("docno"), r.try_cast("int").alias("rank"), s.try_cast("double").alias("score"), t.alias("tag"))


def write_run(run: DataFrame, path: str, tag: str = "Exp") -> None:
    """A run as text, topics together and in rank order within each file."""
    run_lines(run.repartitionByRange("query_no", "rank").sortWithinPartitions("query_no", "rank"), tag).write.mode("overwrite").text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_no, assessor, docno, rel`` of four blank-separated columns."""
    q, a, d, r = _fields(F.col("value"), 4)
    return spark.read.text(path).where(F.trim("value") != "").select(q.alias("query_no"), a.alias("assessor"), d.alias("docno"), r.try_cast("int").alias("rel"))


def read_adjacency(spark: SparkSession, path: str, reverse: bool = False) -> DataFrame:
    """``src, dst`` of lines ``page neighbour neighbour``; ``reverse``: the neighbours link to the page. Repetitions stay."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("a"), F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("b"))
    return rows.select(F.col("b").alias("src"), F.col("a").alias("dst")) if reverse else rows.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Lines of a page and its neighbours in order; a page with very many has several lines, which readers add up."""
    adjacency(edges).select(F.concat_ws(" ", "page", F.array_join("neighbours", " ")).alias("value")).write.mode("overwrite").text(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``node`` of a list with one page a line (a root set)."""
    return spark.read.text(path).select(F.trim("value").alias("node")).where("node <> ''").distinct()


def write_scores(scores: DataFrame, path: str, node: str = "node", score: str = "score") -> None:
    """Lines ``page score``, best first."""
    scores.orderBy(F.col(score).desc(), node).select(F.concat_ws(" ", node, F.col(score).cast("string")).alias("value")).write.mode("overwrite").text(path)


def read_mails(spark: SparkSession, path: str, glob: str = "inmail.*") -> DataFrame:
    """``mail_id, file_name, header, body, subject`` of a folder of raw mails in ISO-8859-1."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    raw = F.decode("content", "ISO-8859-1")
    name = F.element_at(F.split("path", "/"), -1)
    header, body = split_mail(raw)
    return files.select(F.element_at(F.split(name, r"\."), -1).try_cast("int").alias("mail_id"), name.alias("file_name"), header.alias("header"), body.alias("body"), subject_lines(header).alias("subject"))


def read_mail_labels(spark: SparkSession, path: str) -> DataFrame:
    """``label, path, file_name, mail_id`` of lines ``spam ../data/inmail.1``; the mail's number is that of its file."""
    lab, p = _fields(F.col("value"), 2)
    rows = spark.read.text(path).where(F.trim("value") != "").select(lab.alias("label"), p.alias("path"))
    return labelled_files(rows)


def labelled_files(rows: DataFrame) -> DataFrame:
    """Label lines with the file's name and number; labels trimmed and lower-cased, null ones left out, one row a file (the alphabetically first of differing labels)."""
    named = rows.where(F.col("label").isNotNull() & F.col("path").isNotNull()).select(F.lower(F.trim("label")).alias("label"), F.element_at(F.split("path", "/"), -1).alias("file_name"))
    return named.groupBy("file_name").agg(F.min("label").alias("label")).withColumn("mail_id", F.element_at(F.split("file_name", r"\."), -1).try_cast("int"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The data rows of an ARFF file as doubles under its attributes' names; ``?`` is null. Values are parted by blanks or commas."""
    lines = spark.read.text(path)
    names = [r[0] for r in lines.where(F.lower(F.col("value")).startswith("@attribute")).select(F.regexp_extract("value", r"(?i)^@attribute\s+'?([^'\s]+)'?", 1)).collect()]
    parts = F.split(F.trim(F.regexp_replace("value", "\r$", "")), r"[\s,]+")
    rows = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("@") & ~F.trim("value").startswith("%"))
    return rows.select(*(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))


def arff_lines(rows: DataFrame, relation: str, attributes: dict[str, str]) -> tuple[list[str], DataFrame]:
    """Header lines and a table ``value`` of data lines; nulls are written ``?``."""
    header = [f"@relation {relation}", "", *(f"@attribute {n} {k}" for n, k in attributes.items()), "", "@data"]
    return header, rows.select(F.concat_ws(" ", *(F.coalesce(F.col(n).cast("string"), F.lit("?")) for n in attributes)).alias("value"))


def write_arff(rows: DataFrame, path: str, relation: str, attributes: dict[str, str]) -> None:
    """An ARFF folder: the header in a file of its own that sorts first, the data written by the tasks."""
    header, data = arff_lines(rows, relation, attributes)
    spark = rows.sparkSession
    data.write.mode("overwrite").text(path)
    spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.mode("append").text(path)


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """``label, features`` of lines ``1 3:2 17:1``: a map from id to value."""
    parts = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.split(p, ":")[0].cast("int").alias("k"), F.split(p, ":")[1].cast("double").alias("v")))
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("double").alias("label"), F.map_from_entries(pairs).alias("features"))


def write_libsvm(matrix: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    libsvm_lines(matrix, label, features).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def read_linear_model(spark: SparkSession, path: str, header: int = 6) -> DataFrame:
    """``term_id, weight`` of a linear model's file: ``header`` lines, then one weight a line, numbered from 1.

    Lines are read in splits, each by its own task; a line's number is its place within its split after the lines of the splits before, of which there is one count each.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    splits = lines.groupBy("f", "b").agg(F.count("*").alias("c"))
    before = splits.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    n = F.row_number().over(Window.partitionBy("f", "b").orderBy("i")) + F.col("before") - header
    numbered = lines.join(F.broadcast(before), ["f", "b"]).withColumn("n", n).where((F.col("n") >= 1) & (F.trim("value") != ""))
    return numbered.select(F.col("n").cast("int").alias("term_id"), F.regexp_replace(F.trim("value"), "\r$", "").try_cast("double").alias("weight"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """A table in the library's own format, whole (``overwrite``) or added to (``append``), optionally in partitions."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
