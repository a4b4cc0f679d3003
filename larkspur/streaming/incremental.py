"""Indexing and link counting of collections that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.index import positions, postings
from larkspur.session import cut
from larkspur.sources.files import parse_collection


def collection_stream(spark: SparkSession, path: str, files_per_trigger: int = 15) -> DataFrame:
    """``docno, text`` of tagged documents in files that appear in a folder."""
    return parse_collection(spark.readStream.option("lineSep", "</DOC>").option("maxFilesPerTrigger", files_per_trigger).text(path))


def append_postings(batch: DataFrame, batch_id: int, out: str, ident: str, text: str, model: str) -> None:
    """Writes a batch's postings as one partial index; the same batch written again replaces itself."""
    found = postings(positions(batch, ident, text, model)).sortWithinPartitions("term")
    found.write.mode("overwrite").parquet(f"{out}/part={batch_id}")


def index_stream(documents: DataFrame, out: str, checkpoint: str, ident: str = "docno", text: str = "text", model: str = "no_stopwords") -> StreamingQuery:
    """Appends partial indexes as documents arrive, each once; readers see them as one table partitioned by ``part``."""
    write = documents.writeStream.foreachBatch(lambda df, n: append_postings(df, n, out, ident, text, model))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, parts: str, out: str) -> None:
    """All partial indexes as one, in term order, a row per term and document (a document indexed again counts with its latest part)."""
    whole = spark.read.parquet(parts)
    latest = whole.groupBy("term", "doc_id").agg(F.max_by(F.struct("tf", "positions"), "part").alias("p"))
    latest.select("term", "doc_id", "p.tf", "p.positions").repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(out)


def inlink_counts(links: DataFrame, late: str = "1 hour", every: str = "10 minutes", at: str = "found_at") -> DataFrame:
    """``window, url, n``: links found to each URL by time window, late ones up to the watermark; the frontier's running in-link counts."""
    return links.withWatermark(at, late).groupBy(F.window(at, every), "url").agg(F.count("*").alias("n"))


def merge_stream(fresh: DataFrame, store: str, key: str, checkpoint: str, parts: int = 256) -> StreamingQuery:
    """Appends arriving rows whose key the store lacks, and no key twice.

    The store is kept in ``parts`` folders by a hash of the key; a batch reads the keys of the folders it touches, at most one number a folder reaching the driver.
    """
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        one = cut(batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("part", part), "batch")
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        touched = [r[0] for r in one.select("part").distinct().collect()]
        if fs.exists(path) and any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/part={p}")) for p in touched):
            known = spark.read.schema(one.schema).parquet(store).where(F.col("part").isin(touched)).select("part", key)
            one = one.join(known, ["part", key], "left_anti").select(*one.columns)
        one.write.mode("append").partitionBy("part").parquet(store)

    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
