"""Crawled pages: text and links, robots rules, the frontier, and crawling by waves."""

from __future__ import annotations

import html as html_
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.urls import canonical, canonical_url, host_key, twin_key
from larkspur.session import cut


# Elements whose content is no text of the page.
_SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>([^<]*)(?:</title\s*>)?", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
_ANCHOR = re.compile(r"<a\s([^>]*)", re.I)
_TARGET = re.compile(r"(?:^|[\s\"'])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def parse_source(source: str | None) -> tuple[str, str, list[str]]:
    """Title, text and anchor targets of a page: without scripts, styles and comments, character references resolved, whatever the quotes; '' and none for null.

    Cut and invalid mark-up is read as far as it goes. Targets keep their order and repetitions; empty ones are left out.
    """
    bare = _SILENT.sub(" ", source or "")
    title = _TITLE.search(bare)
    hrefs = []
    for a in _ANCHOR.finditer(bare):
        t = _TARGET.search(a.group(1))
        target = html_.unescape(next((g for g in t.groups() if g is not None), "")).strip() if t else ""
        if target:
            hrefs.append(target)
    text = " ".join(html_.unescape(_TAG.sub(" ", _TITLE.sub(" ", bare))).split())
    return " ".join(html_.unescape(title.group(1)).split()) if title else "", text, hrefs


def _page_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        titles, texts, hrefs = zip(*map(parse_source, batch.column("source").to_pylist()), strict=True) if len(batch) else ((), (), ())
        yield pa.record_batch({"page_id": batch.column("page_id"), "title": pa.array(titles, pa.string()), "text": pa.array(texts, pa.string()), "hrefs": pa.array(hrefs, pa.list_(pa.string()))})


def parsed_pages(pages: DataFrame, ident: str, source: str) -> DataFrame:
    """``page_id, title, text, hrefs`` of every page, each parsed once, in Arrow batches. Other columns are ignored."""
    rows = pages.select(F.col(ident).cast("bigint").alias("page_id"), F.col(source).alias("source"))
    return rows.mapInArrow(_page_runner, "page_id bigint, title string, text string, hrefs array<string>")


def page_links(pages: DataFrame, ident: str, source: str) -> DataFrame:
    """``page_id, n, href`` of every anchor as it is written, numbered from 0."""
    return parsed_pages(pages, ident, source).select("page_id", F.posexplode("hrefs").alias("n", "href"))


def canonical_links(pages: DataFrame, url: str, links: str, drop_query: bool = False, same_host: bool = True) -> DataFrame:
    """``src, dst``: distinct links between canonical URLs. Each distinct pair of page and written link is resolved once."""
    raw = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("u"), F.explode(links).alias("h")).where(F.col("h").isNotNull()).distinct()
    found = raw.select(canonical_url(F.col("u"), F.col("u"), drop_query).alias("src"), canonical_url(F.col("h"), F.col("u"), drop_query, same_host).alias("dst"))
    return found.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def html_pages(pages: DataFrame, header: str, status: int = 200) -> DataFrame:
    """Pages whose response header has the status and the content type text/html."""
    h = F.col(header)
    return pages.where(h.rlike(rf"^HTTP/[0-9.]+ {status}\b") & F.lower(h).rlike(r"content-type:\s*text/html"))


def joined_header(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def seed_hosts(urls: DataFrame, url: str) -> DataFrame:
    """``host, url``: distinct start pages with the host a crawl deals them by. One host's pages are rows, not a list."""
    return urls.where(F.col(url).isNotNull()).select(host_key(F.col(url)).alias("host"), F.col(url).alias("url")).distinct()


_RULE = re.compile(r"^\s*(user-agent|allow|disallow)\s*:\s*([^#]*)", re.I)


def robots_rules(text: str | None, agent: str = "*") -> list[tuple[str, bool]]:
    """Path prefixes and whether they may be fetched, of the groups for ``agent`` or, without one, for all."""
    groups: dict[str, list[tuple[str, bool]]] = {}
    agents: list[str] = []
    fresh = True
    for line in (text or "").splitlines():
        m = _RULE.match(line)
        if not m:
            continue
        field, value = m.group(1).lower(), m.group(2).strip()
        if field == "user-agent":
            agents = [value.lower()] if fresh else [*agents, value.lower()]
            fresh = False
            groups.setdefault(value.lower(), [])
            continue
        fresh = True
        if value:
            for a in agents:
                groups[a].append((value, field == "allow"))
    return groups.get(agent.lower(), groups.get("*", []))


def robots_table(files: DataFrame, host: str, text: str, agent: str = "*") -> DataFrame:
    """``host, prefix, allow`` of each host and its twin under the other protocol; a missing file allows everything."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, p, a) for h, t in zip(b["h"], b["t"], strict=True) if h for p, a in robots_rules(t, agent)]
            yield pd.DataFrame(rows, columns=["host", "prefix", "allow"])

    rules = files.select(F.col(host).alias("h"), F.col(text).alias("t")).mapInPandas(parse, "host string, prefix string, allow boolean")
    return rules.unionByName(rules.withColumn("host", twin_key(F.col("host")))).distinct()


def fetched_robots(hosts: DataFrame, host: str, fetch: Callable[[str], Page | None]) -> DataFrame:
    """``host, text``: every host's rules file, fetched in the tasks; one that is missing or can't be had is null, and allows everything."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = [fetch(f"{h}/robots.txt") for h in b["host"]]
            yield pd.DataFrame({"host": b["host"], "text": [p.source if p and p.status == 200 else None for p in pages]})

    return hosts.where(F.col(host).isNotNull()).select(F.col(host).alias("host")).distinct().mapInPandas(visit, "host string, text string")


def robots_filter(urls: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """The URLs that may be fetched: the longest rule that fits decides, an allowing one before a forbidding one of equal length; no rule allows."""
    u = urls.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct().withColumn("host", host_key(F.col("url")))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(.*)$", 1)
    fits = u.withColumn("path", F.when(path == "", "/").otherwise(path)).join(rules, "host").where(F.col("path").startswith(F.col("prefix")))
    worst = fits.groupBy("url").agg(F.max(F.struct(F.length("prefix"), "allow")).alias("m")).where(~F.col("m.allow")).select("url")
    return u.select("url").join(worst, "url", "left_anti")


def frontier_order(links: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """``url, wave, inlinks, arrive, place``: the order in which pages are fetched, lower wave, more in-links, earlier arrival.

    ``links``: ``src, url, wave, arrive``, one row for each link found. A URL's wave and arrival are its first, its in-links the distinct pages that link to it.
    """
    seen = links.where(F.col("url").isNotNull() & (F.col("url") != ""))
    if visited is not None:
        seen = seen.join(visited.select("url").distinct(), "url", "left_anti")
    per = seen.groupBy("url").agg(F.min("wave").alias("wave"), F.count_distinct("src").alias("inlinks"), F.min("arrive").alias("arrive"))
    return placed(per, ["wave", F.col("inlinks").desc(), "arrive", "url"], "place")


def placed(rows: DataFrame, order: list, name: str) -> DataFrame:
    """A running number over a total order without one task seeing all rows: range partitions, numbered from the counts of those before.

    The list of counts has one entry a partition.
    """
    return running_total(rows, order, F.lit(1), name)


def running_total(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over all rows up to each, in a total order, in the same way."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "dealt")
    before, total = {}, 0
    for r in sorted(dealt.groupBy("_p").agg(F.sum(value).alias("s")).collect()):
        before[r["_p"]] = total
        total += r["s"]
    shift = F.create_map(*(x for p, b in before.items() for x in (F.lit(p), F.lit(b)))) if before else None
    local = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn(name, (local + (shift[F.col("_p")] if before else F.lit(0))).cast("bigint")).drop("_p")


def insert_if_absent(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Of ``fresh`` the rows whose key ``store`` lacks, one for each key; null keys are left out."""
    return fresh.where(F.col(key).isNotNull()).dropDuplicates([key]).join(store.select(key).distinct(), key, "left_anti")


@dataclass
class Page:
    """What a fetch gives: status, content type, source."""

    status: int
    content_type: str
    source: str


def http_fetch(url: str, timeout: float = 10.0, agent: str = "larkspur") -> Page | None:
    """A page over HTTP; None where it can't be had."""
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            return Page(r.status, r.headers.get("Content-Type", ""), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"))
    except (OSError, ValueError, LookupError):
        return None


def parse_page(url: str, page: Page) -> dict | None:
    """Title, text and canonical links on the same host of an HTML page; None for anything else."""
    if page.status != 200 or not page.content_type.lower().startswith("text/html"):
        return None
    title, text, hrefs = parse_source(page.source)
    links = [c for h in hrefs if (c := canonical(h, url))]
    return {"url": url, "title": title or None, "text": text, "source": page.source, "out_links": list(dict.fromkeys(links))}


def crawl(seeds: DataFrame, url: str, fetch: Callable[[str], Page | None], rules: DataFrame | None = None, waves: int = 2, delay: float = 0.0) -> DataFrame:
    """``url, title, text, source, out_links, wave``: breadth-first from the seeds, a wave at a time, on the seeds' hosts.

    A wave's URLs are dealt to tasks by host, fetched in frontier order with ``delay`` seconds between fetches of a host, and only pages the robots rules allow.
    ``fetch`` is called in the tasks. What has been visited is a table, not the driver's.
    """
    schema = "url string, title string, text string, source string, out_links array<string>"

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for b in batches:
            rows = []
            for u, host in zip(b["url"], b["host"], strict=True):
                wait = delay - (time.monotonic() - last.get(host, -1e9))
                if wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                page = fetch(u)
                parsed = parse_page(u, page) if page else None
                if parsed:
                    rows.append(parsed)
            yield pd.DataFrame(rows, columns=["url", "title", "text", "source", "out_links"])

    start = seeds.select(canonical_url(F.col(url), F.col(url)).alias("url")).where(F.col("url").isNotNull()).distinct()
    queue = start.select(F.lit("").alias("src"), "url", F.lit(0).alias("wave"), F.lit(0).cast("bigint").alias("arrive"))
    visited = start.limit(0)
    parts = []
    for wave in range(waves):
        order = frontier_order(queue, visited)
        if rules is not None:
            order = order.join(robots_filter(order, "url", rules), "url", "left_semi")
        todo = order.withColumn("host", host_key(F.col("url"))).repartition("host").sortWithinPartitions("host", "place")
        got = cut(todo.select("url", "host").mapInPandas(visit, schema).withColumn("wave", F.lit(wave)), "wave")
        parts.append(got)
        visited = cut(visited.unionByName(order.select("url")).distinct(), "visited")
        queue = got.select(F.col("url").alias("src"), F.posexplode("out_links").alias("arrive", "url")).select("src", "url", F.lit(wave + 1).alias("wave"), F.col("arrive").cast("bigint"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole

