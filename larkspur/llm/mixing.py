"""Mixing sources to target shares of a token budget by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import text_blocks
from larkspur.llm.bpe import TOKENIZERS, PairIndexEncoder, load_ranks
from larkspur.session import cut

#: Steps of the seeded uniform number at which a source's tokens are summed; the table of sums has sources x steps rows.
STEPS = 4096


def _uniform(ident: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the identifier and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)


def _name(source: Column) -> Column:
    return F.lower(F.trim(source))


def poisson_steps(rate: float, most: int) -> list[float]:
    """P(X <= k) for k = 0..most-1: a number u is replicated as often as it has steps at or below it."""
    steps, term, total = [], math.exp(-min(rate, 700.0)), 0.0
    for k in range(most):
        total += term
        steps.append(total if rate < 700 else 0.0)
        term *= rate / (k + 1)
    return steps


@dataclass
class Plan:
    """What each source is to contribute: the Poisson rate, the cap, and the tokens there are and are wanted."""

    rate: dict[str, float]
    most: dict[str, int]
    share: dict[str, float]
    available: dict[str, int]
    wanted: dict[str, float]

    def copies(self, source: Column, ident: Column, seed: int) -> Column:
        """How often a document is used; 0 for a source without a target."""
        steps = F.create_map(*(x for s in self.rate for x in (F.lit(s), F.array(*(F.lit(float(p)) for p in poisson_steps(self.rate[s], self.most[s])))))) if self.rate else None
        if steps is None:
            return F.lit(0)
        u = _uniform(ident, seed)
        own = F.coalesce(F.try_element_at(steps, F.coalesce(_name(source), F.lit(""))), F.array().cast("array<double>"))
        return F.size(F.filter(own, lambda p: p <= u))


def _token_runner(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(ranks.value)
        for keys, texts in text_blocks(batches, "key", "text"):
            _, count = encoder.encode(texts)
            yield pa.record_batch({
                "id": pa.array([k["id"] for k in keys], pa.int64()), "source": pa.array([k["source"] for k in keys], pa.string()), "n_tokens": pa.array(count, pa.int64()),
            })

    return run


def sized(df: DataFrame, ident: str, text: str, source: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``id, source, n_tokens`` of every document; source names are trimmed and lower-cased."""
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary, folder))  # fixed size, under 3 MB
    key = F.struct(F.col(ident).cast("bigint").alias("id"), _name(F.col(source)).alias("source"))
    return df.select(key.alias("key"), F.col(text).alias("text")).mapInArrow(_token_runner(ranks), "id bigint, source string, n_tokens bigint")


def plan_mix(sizes: DataFrame, targets: DataFrame, seed: int, total_tokens: float | None = None) -> Plan:
    """Rates that bring each source to its share.

    ``targets`` (``source, target_share, max_repeats``) is a table of declared targets, one row a source. Shares of sources without tokens are spread
    over the others in proportion. ``total_tokens`` defaults to the largest size at which every source with a target still reaches its share at a rate, its
    mean number of uses before the cap, no higher than the cap; so no source is merely repeated whole. The rate of a source is the smallest at which the documents' own seeded numbers give the wanted tokens: the tokens
    above each of ``STEPS`` values of the number are summed in one aggregation, whose result is sources x ``STEPS`` rows whatever the collection's size.
    """
    rows = targets.select(_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()
    share = {r["source"]: float(r["target_share"] or 0) for r in rows if r["source"] is not None}
    most = {r["source"]: int(r["max_repeats"] or 0) for r in rows if r["source"] is not None}
    step = F.floor(_uniform(F.col("id"), seed) * STEPS).cast("int")
    named = sizes.where(F.col("source").isin(list(share))) if share else sizes.limit(0)
    got = named.groupBy("source", step.alias("step")).agg(F.sum("n_tokens").alias("t")).collect()
    sums = {s: np.zeros(STEPS) for s in share}
    for r in got:
        sums[r["source"]][r["step"]] = r["t"]
    available = {s: int(x.sum()) for s, x in sums.items()}
    usable = {s: share[s] for s in share if available[s] and share[s] > 0 and most[s] > 0}
    whole = sum(usable.values())
    usable = {s: x / whole for s, x in usable.items()}

    def realised(source: str, rate: float) -> float:
        above = np.concatenate([np.cumsum(sums[source][::-1])[::-1], [0.0]])  # tokens of numbers at or above step i
        at = np.minimum(np.array(poisson_steps(rate, most[source])) * STEPS, STEPS)
        return float(np.interp(at, np.arange(STEPS + 1), above).sum())

    if total_tokens is None:
        total_tokens = min((realised(s, most[s]) / usable[s] for s in usable), default=0.0)
    plan = Plan({}, most, share, available, {s: usable.get(s, 0.0) * total_tokens for s in share})
    for s in usable:
        low, high = 0.0, 1.0
        while realised(s, high) < plan.wanted[s] and high < 700:
            high *= 2
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if realised(s, middle) < plan.wanted[s] else (low, middle)
        plan.rate[s] = high
    return plan


def mix(df: DataFrame, ident: str, text: str, source: str, targets: DataFrame, seed: int = 17, total_tokens: float | None = None, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``ident, source, copy_no, place, text``: the training set, each document as often as its seeded Poisson number says, in random order.

    The number is the inverse of the Poisson distribution with the source's rate at a hash of identifier and seed, at most ``max_repeats``; so a
    document's use depends on nothing but itself and its source's rate. ``place`` is a hash of document and copy; rows are dealt over partitions and sorted by it.
    Null and empty texts, null sources and sources without a target are not used; an empty table gives no rows; other columns are ignored.
    """
    plan = plan_mix(cut(sized(df, ident, text, source, vocabulary, folder), "sizes"), targets, seed, total_tokens)
    copies = plan.copies(F.col("source"), F.col("id"), seed)
    rows = df.select(F.col(ident).cast("bigint").alias("id"), _name(F.col(source)).alias("source"), F.col(text).alias("text"))
    used = rows.where(F.length("text") > 0).withColumn("copies", copies).where(F.col("copies") > 0)
    each = used.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    placed = each.withColumn("place", F.xxhash64("id", "copy_no", F.lit(seed + 1)))
    return placed.repartition("place").sortWithinPartitions("place").select(F.col("id").alias(ident), "source", "copy_no", "place", "text")


def mix_report(df: DataFrame, ident: str, text: str, source: str, targets: DataFrame, seed: int = 17, total_tokens: float | None = None, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """A row per source of either side: tokens there are, tokens and copies used, share wanted and share reached."""
    sizes = cut(sized(df, ident, text, source, vocabulary, folder), "sizes")
    plan = plan_mix(sizes, targets, seed, total_tokens)
    used = sizes.withColumn("copies", F.when(F.col("n_tokens") > 0, plan.copies(F.col("source"), F.col("id"), seed)).otherwise(0))
    per = used.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("available_tokens"), F.sum("copies").cast("bigint").alias("copies"),
        F.max("copies").cast("int").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"),
    )
    wanted = targets.select(_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    both = per.join(wanted, "source", "full_outer").na.fill(0, ["documents", "available_tokens", "copies", "most_repeats", "used_tokens", "target_share", "max_repeats"])
    total = both.agg(F.sum("used_tokens")).first()[0] or 0
    return both.withColumn("actual_share", F.round(F.coalesce(F.try_divide("used_tokens", F.lit(total)), F.lit(0.0)), 6))
