"""One ranking from several differently scaled scores: first principal component of rank-transformed scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import cut

#: A group of more rows than this is ranked over range partitions; smaller ones whole, by one task each.
WHOLE_GROUP_ROWS = 1_000_000
#: A score that more rows of a large group share than this is joined by broadcast.
HEAVY_VALUE_ROWS = 100_000


def _average_ranks(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each group, ties sharing their mean rank; ``group`` is ascending."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    index = np.arange(len(v))
    new_group = np.ones(len(v), dtype=bool)
    new_group[1:] = g[1:] != g[:-1]
    new_value = new_group.copy()
    new_value[1:] |= v[1:] != v[:-1]
    run = np.cumsum(new_value) - 1
    size = np.bincount(run)
    first = index[new_value] - np.maximum.accumulate(np.where(new_group, index, 0))[new_value]
    ranks = np.empty(len(v))
    ranks[order] = (first + (size + 1) / 2)[run]
    return ranks


def _rank_block(rows: pa.Table, n_scores: int) -> pa.Table:
    keys = rows["k"].combine_chunks()
    size = len(rows)
    starts = np.ones(size, dtype=bool)
    a, b = keys.slice(1).to_numpy(zero_copy_only=False), keys.slice(0, size - 1).to_numpy(zero_copy_only=False)
    starts[1:] = a != b
    group = np.cumsum(starts) - 1
    count = np.bincount(group)[group]
    out = {"k": rows["k"], "d": rows["d"], "n": pa.array(count, pa.int64())}
    for i in range(n_scores):
        out[f"r{i}"] = pa.array(_average_ranks(group, rows[f"s{i}"].to_numpy()))
    return pa.table(out)


def _rank_runner(n_scores: int, block_rows: int):
    """Rows arrive sorted by group; complete groups are ranked together, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count < block_rows:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows["k"].to_numpy()
            last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if last:
                yield from _rank_block(rows.slice(0, last), n_scores).to_batches()
            held = rows.slice(last).to_batches()
            count = len(rows) - last
        if count:
            yield from _rank_block(pa.Table.from_batches(held).combine_chunks(), n_scores).to_batches()

    return run


def _hot_ranks(rows: DataFrame, scores: list[str]) -> DataFrame:
    """The same ranks for groups too large for a task.

    Each score's distinct values are counted per group (partial sums before the shuffle), range-partitioned by group
    and value, and ranked from the counts within a partition plus what the partitions before it hold. The latter is
    one number for a group and partition, at most two a partition, so it is small enough to join by broadcast.
    """
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = rows
    for i, s in enumerate(scores):
        counts = cut(
            rows.groupBy("k", F.col(s).alias("v")).agg(F.count("*").alias("c"))
            .repartitionByRange(n_parts, "k", "v").withColumn("p", F.spark_partition_id()),
            "counts",
        )
        before = (
            counts.groupBy("k", "p").agg(F.sum("c").alias("pc"))
            .withColumn("b", F.coalesce(F.sum("pc").over(Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .select("k", "p", "b")
        )
        inside = F.sum("c").over(Window.partitionBy("k", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
        ranks = cut(
            counts.withColumn("i", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), ["k", "p"])
            .select("k", F.col("v").alias(s), "c", (F.col("b") + F.col("i") + (F.col("c") + 1) / 2).alias(f"r{i}")),
            "values",
        )
        often = F.col("c") > HEAVY_VALUE_ROWS  # at most rows / HEAVY_VALUE_ROWS values, so they are broadcast instead of meeting in one task
        heavy, light = ranks.where(often).drop("c"), ranks.where(~often).drop("c")
        out = out.join(F.broadcast(heavy), ["k", s]).unionByName(out.join(light, ["k", s]))
    return out.join(F.broadcast(total), "k").select("k", "d", "n", *(f"r{i}" for i in range(len(scores))))


def rank_transform(
    df: DataFrame, key: str, ident: str, scores: list[str], whole_group_rows: int = WHOLE_GROUP_ROWS
) -> DataFrame:
    """Columns ``k, d, n, r0..`` - group, identifier, group size, and the mean rank (from 1, low is worst) of each score.

    ``df`` has one row for a group and identifier. A null or NaN score counts as lower than any value of its group; equal
    scores share their mean rank. A null group is a group. The list of groups above ``whole_group_rows`` has at most
    rows / ``whole_group_rows`` entries, the bound for joining it by broadcast; those groups take the range-partitioned way.
    """
    names = [f"s{i}" for i in range(len(scores))]
    low = F.lit(float("-inf"))
    rows = df.select(
        F.coalesce(F.col(key).cast("string"), F.lit("\u0000")).alias("k"), F.col(ident).alias("d"),
        *(F.when(F.isnan(c) | F.col(c).isNull(), low).otherwise(F.col(c).cast("double")).alias(a) for c, a in zip(scores, names, strict=True)),
    )
    rows = cut(rows, "scores")  # read for the sizes of groups and for the ranks
    hot = [r["k"] for r in rows.groupBy("k").count().where(F.col("count") > whole_group_rows).select("k").toLocalIterator()]
    usual = rows.where(~F.col("k").isin(hot)) if hot else rows
    kind = rows.schema["d"].dataType
    schema = T.StructType(
        [T.StructField("k", T.StringType()), T.StructField("d", kind), T.StructField("n", T.LongType())]
        + [T.StructField(f"r{i}", T.DoubleType()) for i in range(len(scores))]
    )
    ranked = usual.repartition("k").sortWithinPartitions("k").mapInArrow(_rank_runner(len(scores), 100_000), schema)
    if hot:
        ranked = ranked.unionByName(_hot_ranks(rows.where(F.col("k").isin(hot)), names))
    return ranked.withColumn("k", F.when(F.col("k") == "\u0000", F.lit(None)).otherwise(F.col("k")))


def first_component(ranked: DataFrame, columns: list[str], directions: list[int]) -> list[float]:
    """Loadings of the first principal component of the columns' correlation matrix.

    The matrix comes from one distributed aggregation of sums and products, a single row. The component's sign is the
    one that agrees with most of the declared ``directions`` (1: high is good, -1: low is good), weighted by loading. Without rows, or where
    no column varies, all loadings are equal, so that every score weighs alike.
    """
    m = len(columns)
    sums = [F.sum(c).alias(f"m{i}") for i, c in enumerate(columns)]
    products = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"x{i}_{j}") for i in range(m) for j in range(i, m)]
    row = ranked.agg(F.count("*").alias("n"), *sums, *products).first()
    signs = np.array(directions, dtype=float)
    if not row["n"]:
        return list(signs / np.sqrt(m))
    mean = np.array([row[f"m{i}"] for i in range(m)]) / row["n"]
    cov = np.empty((m, m))
    for i in range(m):
        for j in range(i, m):
            cov[i, j] = cov[j, i] = row[f"x{i}_{j}"] / row["n"] - mean[i] * mean[j]
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    if not (sd > 1e-12).all():
        return list(signs / np.sqrt(m))
    _, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    first = vectors[:, -1]
    if first @ signs < 0:
        first = -first
    return list(first / sd)


def fused_ranking(
    df: DataFrame, key: str, ident: str, scores: list[str], directions: list[int] | None = None, whole_group_rows: int = WHOLE_GROUP_ROWS
) -> DataFrame:
    """One ranking per group: ``key, ident, n, projection``, the best item having the highest projection.

    Ranks within the group stand in for the scores, centred and divided by the group's size, so neither scale nor
    distribution of a score matters. The projection is that on the first principal component over all groups. Missing
    scores rank below all others of their group; a group of one has projection 0; an empty table gives no rows; other
    columns are ignored.
    """
    directions = directions or [1] * len(scores)
    ranked = rank_transform(df, key, ident, scores, whole_group_rows)
    cols = [f"r{i}" for i in range(len(scores))]
    centred = cut(
        ranked.select("k", "d", "n", *(((F.col(c) - (F.col("n") + 1) / 2) / F.col("n")).alias(c) for c in cols)), "ranks"
    )
    loadings = first_component(centred, cols, directions)
    projection = sum((F.col(c) * F.lit(float(w)) for c, w in zip(cols, loadings, strict=True)), F.lit(0.0))
    return centred.select(F.col("k").alias(key), F.col("d").alias(ident), "n", F.round(projection, 9).alias("projection"))
