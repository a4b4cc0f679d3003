"""Session defaults and the shared scratch area for cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Settings used when this library starts its own session; an existing session keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g", app: str = "larkspur") -> SparkSession:
    """A local session with the library's defaults, for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the application's Python workers this package, wherever they run, once."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), "larkspur")
    spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only where that is unset and all executors are on this machine."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("executors on several machines need a folder they share: set spark.checkpoint.dir")
    own = os.path.join(tempfile.gettempdir(), f"larkspur-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    spark.sparkContext.setCheckpointDir(own)
    return f"file://{own}"


def files_state(df: DataFrame) -> int:
    """A number that changes when a file that ``df`` reads is added, removed or written again (its name, length and time); folders are listed once each."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = {unquote(p) for p in df.inputFiles()}
    seen = []
    for folder in {p.rsplit("/", 1)[0] for p in paths}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(conf).listStatus(path):
            seen.append((status.getPath().getName(), status.getLen(), status.getModificationTime()))
    names = {p.rsplit("/", 1)[1] for p in paths}
    return hash(tuple(sorted(x for x in seen if x[0] in names)))


def measured(df: DataFrame, label: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``cut``, with aggregates of the rows taken while they are written, so that they cost no job of their own."""
    seen = Observation()
    written = cut(df.observe(seen, *(c.alias(n) for n, c in sums.items())), label)
    return written, seen.get


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, removed when the application ends."""
    where = f"{shared_dir(spark)}/larkspur-{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage beyond the written files, so a lost executor costs no recomputation and a plan that
    uses it twice runs its source once. The files are removed when the application ends.
    """
    spark = df.sparkSession
    where = scratch_path(spark, label)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def cut_buckets(df: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """``cut`` into buckets by ``key``, each sorted by ``order``.

    What is grouped or joined by the key later needs no exchange, and filters on the order skip parts of each bucket.
    """
    spark = df.sparkSession
    name = f"larkspur_{label}_{uuid.uuid4().hex}"
    where = scratch_path(spark, label)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*order).option("path", where).format("parquet").saveAsTable(name)
    bucketed = spark.table(name)
    bucketed.schema  # resolved, so that the catalog need not keep the name
    spark.sql(f"DROP TABLE {name}")
    return bucketed
