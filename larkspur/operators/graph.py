"""Link graphs: edges, in-links, PageRank and hub/authority scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import cut, measured

# Damping, tolerance and most rounds of the iterations, in-links a page may bring into the base set.
DAMPING, TOLERANCE, MAX_ROUNDS, MAX_INLINKS = 0.85, 1e-5, 99, 50


def edges_of(pages: DataFrame, source: str, links: str) -> DataFrame:
    """``src, dst``: distinct links of pages. Null sources, link lists and links are left out."""
    return pages.where(F.col(source).isNotNull()).select(F.col(source).alias("src"), F.explode(F.col(links)).alias("dst")).where(F.col("dst").isNotNull() & (F.col("dst") != "")).distinct()


def out_degree(links: DataFrame) -> DataFrame:
    """``src, n``: links of each page; over rows that are not distinct, repetitions count."""
    return links.groupBy("src").agg(F.count("*").alias("n"))


def inlinks(edges: DataFrame) -> DataFrame:
    """``dst, n``: how many distinct pages link to each page."""
    return edges.distinct().groupBy("dst").agg(F.count("*").alias("n"))


#: Neighbours one row or line of an adjacency list holds; a page with more has several.
LIST_LENGTH = 1000


def adjacency(edges: DataFrame, page: str = "src", neighbour: str = "dst", most: int = LIST_LENGTH) -> DataFrame:
    """``page, part, neighbours``: sorted lists of distinct neighbours, in parts of about ``most``, so that no page's list is one unbounded row."""
    e = edges.select(F.col(page).alias("page"), F.col(neighbour).alias("neighbour")).distinct()
    size = e.groupBy("page").agg(F.ceil(F.count("*") / most).alias("parts"))
    part = F.pmod(F.xxhash64("neighbour"), F.col("parts"))
    return e.join(size, "page").groupBy("page", part.cast("int").alias("part")).agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def sink_pages(edges: DataFrame) -> DataFrame:
    """``node``: pages that are linked to and link nowhere."""
    return edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def pagerank(edges: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE, degrees: DataFrame | None = None) -> DataFrame:
    """``node, score``: PageRank over distinct edges, sinks spread over all pages, mass normalised each round.

    Runs ``rounds`` rounds, or without it until the change's Euclidean norm is at most ``tolerance``, at most ``MAX_ROUNDS``. Edges carry their
    share and stay partitioned by source; a page's incoming shares are added up before the shuffle, so a page that everything links to is no hot key.
    Each round's scores are written, so plans stay short and a lost executor repeats one round. No edge gives no rows.
    ``degrees`` (``src, n``) may count links otherwise, for instance with their repetitions, as some link files do.
    """
    degrees = out_degree(edges) if degrees is None else degrees
    shares = edges.join(degrees, "src").repartition("src").select("src", "dst", (1 / F.col("n")).alias("part")).persist()
    nodes, seen = measured(nodes_of(edges).join(degrees.select(F.col("src").alias("node"), F.lit(True).alias("links")), "node", "left"), "nodes", n=F.count("*"), sinks=F.count_if(F.col("links").isNull()))
    n = seen["n"]
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    scores, sink, lost = nodes.select("node", "links", F.lit(1.0 / n).alias("score")), seen["sinks"] / n, F.col("links").isNull()
    for _ in range(MAX_ROUNDS if rounds is None else rounds):
        base = (1 - damping) / n + damping * sink / n
        incoming = scores.select(F.col("node").alias("src"), "score").join(shares, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("part")).alias("s"))
        fresh = scores.select("node", "links", F.col("score").alias("was")).join(incoming, "node", "left").withColumn("score", F.lit(base) + damping * F.coalesce("s", F.lit(0.0)))
        fresh, seen = measured(
            fresh.select("node", "links", "was", "score"), "rank", total=F.sum("score"), sink=F.coalesce(F.sum(F.when(lost, F.col("score"))), F.lit(0.0)),
            square=F.sum(F.col("score") * F.col("score")), both=F.sum(F.col("score") * F.col("was")), old=F.sum(F.col("was") * F.col("was")),
        )
        scores, sink = fresh.select("node", "links", (F.col("score") / seen["total"]).alias("score")), seen["sink"] / seen["total"]
        if rounds is None and _change(seen["square"], seen["both"], seen["old"], seen["total"]) <= tolerance:
            break
    shares.unpersist()
    return scores.select("node", "score")


def _change(square: float, both: float, old: float, scale: float) -> float:
    """Norm of the difference of scaled new values and old ones, from their sums of squares and products."""
    return math.sqrt(max(square / scale**2 - 2 * both / scale + old, 0.0))


def base_set(edges: DataFrame, root: DataFrame, most: int = MAX_INLINKS) -> DataFrame:
    """``node``: the root pages, all they link to, and up to ``most`` pages that link to each (the first by name)."""
    r = root.select("node").distinct()
    out = edges.join(r.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    back = capped_inlinks(edges, r, most).select(F.col("src").alias("node"))
    return r.unionByName(out).unionByName(back).distinct()


def capped_inlinks(edges: DataFrame, root: DataFrame, most: int = MAX_INLINKS) -> DataFrame:
    """``src, dst``: for each root page, up to ``most`` of its in-links; the rest leaves before the shuffle."""
    into = edges.join(root.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
    w = Window.partitionBy("dst").orderBy("src")
    return into.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("src", "dst")


def hits(edges: DataFrame, root: DataFrame, rounds: int | None = None, most: int = MAX_INLINKS, tolerance: float = TOLERANCE) -> DataFrame:
    """``node, hub, authority``: scores on the base set, authorities of root pages only (null elsewhere).

    Each round takes authorities from hubs, then hubs from the new authorities, both scaled to norm 1. A root page nobody links to keeps its
    authority and is scaled with the others. Without ``rounds`` it runs until the mean square change of both is within ``tolerance``, at most ``MAX_ROUNDS``.
    """
    r = cut(root.select("node").distinct(), "root")
    known = cut(base_set(edges, r, most), "base")
    into = cut(capped_inlinks(edges, r, most), "into")
    # a root page's authority counts for every base page that links to it
    out = cut(edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(r.withColumnRenamed("node", "dst"), "dst", "left_semi"), "out")
    auth = r.select("node", F.lit(1.0).alias("a"))
    hub = known.select("node", F.lit(1.0).alias("h"))
    if not known.limit(1).count():
        return known.select("node", F.lit(0.0).alias("hub"), F.lit(0.0).alias("authority"))

    def sums(v: str) -> dict:
        return {"square": F.sum(F.col(v) * F.col(v)), "both": F.sum(F.col(v) * F.col("was")), "old": F.sum(F.col("was") * F.col("was")), "n": F.count("*")}

    for _ in range(MAX_ROUNDS if rounds is None else rounds):
        got = into.join(hub.withColumnRenamed("node", "src"), "src", "left").groupBy(F.col("dst").alias("node")).agg(F.sum(F.coalesce("h", F.lit(0.0))).alias("s"))
        a, sa = measured(auth.select("node", F.col("a").alias("was")).join(got, "node", "left").select("node", "was", F.coalesce("s", "was").alias("a")), "auth", **sums("a"))
        norm_a = math.sqrt(sa["square"] or 0) or 1.0
        auth = a.select("node", (F.col("a") / norm_a).alias("a"))
        gave = out.join(auth.select(F.col("node").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("a").alias("s"))
        h, sh = measured(hub.select("node", F.col("h").alias("was")).join(gave, "node", "left").select("node", "was", F.coalesce("s", F.lit(0.0)).alias("h")), "hub", **sums("h"))
        norm_h = math.sqrt(sh["square"] or 0) or 1.0
        hub = h.select("node", (F.col("h") / norm_h).alias("h"))
        if rounds is None:
            change = max(_change(sa["square"], sa["both"], sa["old"], norm_a), _change(sh["square"], sh["both"], sh["old"], norm_h))
            if change / math.sqrt(sa["n"] or 1) <= tolerance:
                break
    return hub.join(auth, "node", "left").select("node", F.col("h").alias("hub"), F.col("a").alias("authority"))


def top(scores: DataFrame, score: str, ident: str, n: int) -> DataFrame:
    """The ``n`` best rows, equal scores by identifier; each task keeps ``n``, the driver sees no more than it returns."""
    return scores.orderBy(F.col(score).desc_nulls_last(), ident).limit(n)
