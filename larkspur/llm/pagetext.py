"""The main content of crawled pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.hashing import line_print
from larkspur.session import cut

# Elements of the page language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b big bdo cite code dfn em font i img kbd label mark q s samp small span strike strong sub sup tt u var".split())
SECTIONS = frozenset("div td th section article main aside nav header footer form".split())
SILENT = frozenset("script style noscript template head title".split())
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
STOPS = {"li": ("ul", "ol"), "p": ("div", "td", "body", "section", "article", "li", "blockquote"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?|<![^>]*>", re.S)
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([\w -]+)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。、，«»\"“”„'’`()]")


@dataclass
class Block:
    """A block of text of a page: its root-to-leaf tag path, the number of the section element around it, its innermost element that is
    no inline one, its text, and how many of its characters are a link's."""

    path: str
    section: int
    tag: str
    text: str
    linked: int


def page_blocks(source: str) -> list[Block]:
    """The blocks of a page in reading order; cut and invalid mark-up is read as far as it goes."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, int]] = []
    parts: list[str] = []
    linked = [0]
    silent = links = count = 0
    opened: list[tuple[str, str, int]] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            where = opened or stack
            outer = [x for x in where if x[0] not in INLINE]
            sections = [x for x in outer if x[0] in SECTIONS]
            if len(sections) > 1 and sections[-1][0] == "div":  # a box inside a section is part of it
                sections = sections[:1] if sections[0][0] != "td" else sections
            blocks.append(Block("/".join(x[1] for x in where), sections[-1][2] if sections else 0, outer[-1][0] if outer else "", text, min(linked[0], len(text))))
        parts.clear()
        linked[0] = 0
        opened.clear()

    at = 0
    for m in _TOKEN.finditer(source):
        text = source[at : m.start()]
        at = m.end()
        if text and not silent:
            if text.strip():
                if not opened:
                    opened.extend(stack)
                if links:
                    linked[0] += len(text.strip())
            parts.append(text)
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag in SILENT:
                silent = max(0, silent - 1)
                parts.clear()
                continue
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in SILENT:
            flush()
            silent += 1
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if tag in CLOSES and stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in STOPS.get(tag, ()) or tag not in CLOSES:
                    break
        if tag in VOID:
            continue
        label = _CLASS.search(m.group(3) or "")
        count += 1
        stack.append((tag, f"{tag}.{label.group(1).strip().lower()}" if label else tag, count))
        if tag == "a":
            links += 1
    if not silent:
        tail = source[at:]
        if tail.strip() and not opened:
            opened.extend(stack)
        parts.append(tail)
        flush()
    return blocks


# What sites put into and around an article, in the languages of the crawl.
BYLINE = re.compile(r"^(?:by|von|par|por|di)\s+[A-ZÀ-Þ]\S*(?:\s+[A-ZÀ-Þ]\S*){0,3}$", re.I)
DATELINE = re.compile(
    r"^(?:(?:updated|published|posted|last modified|stand|publié|publicado)\b.{0,40}\d.*|(?:\w+,?\s+)?\w+ \d{1,2},? \d{4}(?:,? \d{1,2}:\d\d.*)?|\d{1,2}\.? \w+ \d{4}(?:,? \d{1,2}:\d\d.*)?|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}.*)$", re.I,
)
COMMENT = re.compile(r"^(?:posted by \S+.{0,40}:|\S+ (?:says|wrote|writes)\s*:|(?:no|\d[\d,.]*)\s+comments?\b)|\breply\s+report$", re.I)
AROUND = re.compile(
    r"^(?:tags?\s*:|share(?: this)?\s*(?::|$)|rate this page|bookmark this page|e-?mail this page|print this page|advertisement\b|anzeige$|publicité$|publicidad$|sponsored\b|read (?:more|also)\b|see also\b|more on this\b.*:|related\s*:|"
    r"(?:subscribe|sign up|log in|register) (?:to read|for our)\b|source\s*:\s*$)|\bstory continues below\b|\bmore stories this month\b|\bnever miss a story\b|\bof the week\s*:", re.I,
)
LEGAL = re.compile(r"^(?:copyright\b|©|\(c\) )|all rights reserved|\bcookies?\b.*\b(?:accept|settings|continuing|use)\b|not responsible for the content|no part of this site", re.I)
NUMBER = re.compile(r"^[$€£+-]?\d")
SENTENCE = re.compile(r"[.!?。！？…»]['\"”’»)]*$")
#: Lines that stand in so large a part of all articles, or of a site's, belong to the sites; pages with one article count once. The first bounds how many there are.
SHARE_OF_PAGES, SHARE_OF_SITE, SITE_PAGES = 0.004, 0.2, 3
#: Forms of lines recur more easily; of all articles they must stand in this part.
FORM_SHARE = 0.02
#: Elements that are items of an article beside its paragraphs, and characters in which a line's lead ends in a colon.
ITEMS, LEAD_CHARS = frozenset(("li", "dt", "dd", "blockquote", "pre")), 40
#: Characters from which a line of sentences counts as running text.
RUNNING_CHARS = 60

HEADLINE, LINKED, ENDS, RUNNING, NOTE, HEADING, TITLE, SITES, DATA, ITEM = 1, 2, 4, 8, 16, 32, 64, 128, 256, 512


def line_shape(line: str) -> str:
    """A line's form: digits and names masked, and of a line with a lead before a colon only that."""
    lead, colon, _ = line[:LEAD_CHARS].partition(":")
    words = (lead if colon else line).split()
    masked = [re.sub(r"\d+(?:[.,:]\d+)*", "#", "^" if w[:1].isupper() and (k or colon and len(words) > 1) else w.lower()) for k, w in enumerate(words)]
    return " ".join(masked) + colon


def page_lines(text: str, source: str | None, title: str | None) -> list[tuple[int, int, int, int, int, int, float]]:
    """Of each non-blank line of a page's text: number, print, print of its form (negative; 0 for a sentence), section, characters, flags and smoothed path ratio.

    Lines are matched to the blocks of the mark-up in reading order; a line the (cut or missing) mark-up lacks has a path of its own.
    """
    blocks = page_blocks(source) if source else []
    places: dict[str, list[int]] = {}
    for k, b in enumerate(blocks):
        places.setdefault(b.text, []).append(k)
    name = " ".join(title.split()) if title else ""
    out, paths = [], []
    sums: dict[tuple[int, str], list[int]] = {}
    at = -1
    for number, raw in enumerate(text.split("\n"), 1):
        line = " ".join(raw.split())
        if not line:
            continue
        block = None
        for k in places.get(line, ()):
            if k > at:
                block, at = blocks[k], k
                break
        flags = 0
        if block is not None:
            flags |= HEADLINE * (block.tag == "h1") | HEADING * (block.tag in ("h2", "h3", "h4")) | LINKED * (block.linked >= 0.7 * len(line)) | ITEM * (block.tag in ITEMS)
        ends = bool(SENTENCE.search(line))
        flags |= ENDS * ends | RUNNING * (ends and len(line) >= RUNNING_CHARS)
        flags |= NOTE * bool(BYLINE.match(line) or DATELINE.match(line) or COMMENT.search(line) or AROUND.search(line))
        numbers = [bool(NUMBER.match(w)) for w in line.split()] if len(line) < RUNNING_CHARS else []
        flags |= DATA * bool(numbers and (2 * sum(numbers) >= len(numbers) or numbers[0] and len(numbers) <= 5))
        flags |= SITES * bool(LEGAL.search(line))
        flags |= TITLE * (len(line) > 8 and (name == line or name.startswith(line + " - ") or name.startswith(line + " | ")))
        shape = 0 if flags & (HEADLINE | TITLE) or ends and ":" not in line[:LEAD_CHARS] else -1 - (xxhash.xxh64_intdigest(line_shape(line)) >> 1)
        path = (block.section, block.path) if block else (-1, str(number))
        total = sums.setdefault(path, [0, 0, 0, 0])
        for k, n in enumerate((len(line), len(PUNCTUATION.findall(line)), 1, len(line) if flags & LINKED else 0)):
            total[k] += n
        paths.append(path)
        out.append((number, line_print(line), shape, path[0], len(line), flags))
    ratio = {path: path_ratio(*x) for path, x in sums.items()}
    return [(*x, v) for x, v in zip(out, smoothed([ratio[p] for p in paths]), strict=True)]


def article_print(lines: list[tuple]) -> int:
    """A print of a page's headline and longest line of running text, which copies of an article share; without a headline, of all its lines."""
    heads = [x[1] for x in lines if x[5] & HEADLINE] or [x[1] for x in lines if x[5] & TITLE]
    running = max((x for x in lines if x[5] & RUNNING), key=lambda x: (x[4], x[1]), default=None)
    if heads and running:
        return xxhash.xxh64_intdigest(f"{heads[-1]} {running[1]}") >> 1
    return xxhash.xxh64_intdigest(" ".join(str(x[1]) for x in lines)) >> 1


def path_ratio(chars: float, marks: float, nodes: float, linked: float) -> float:
    """A path's fused ratio: characters a node times punctuation a node, less the part that is linked."""
    return math.sqrt((chars / nodes) * (marks / nodes + 0.1)) * (1 - linked / max(chars, 1))


def smoothed(values: list[float]) -> list[float]:
    """Each value with its neighbours, weighted by a Gaussian of one node's width."""
    weights = [math.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)]
    out = []
    for i in range(len(values)):
        total = mass = 0.0
        for d, w in zip((-2, -1, 0, 1, 2), weights, strict=True):
            if 0 <= i + d < len(values):
                total += w * values[i + d]
                mass += w
        out.append(total / mass)
    return out


def article_lines(lines: list[tuple], furniture: Collection[int]) -> list[int]:
    """The numbers of the lines that belong to the article.

    Nodes whose smoothed path ratio is above the page's threshold are content. The section with most content is the article's; it begins at the headline and runs over its content nodes, as long
    as the site's own lines don't begin. After the last of them, and the last list item, table row or sentence, only such stay.
    Lines that recur or whose form recurs, notes, pointers and comments are left out.
    """
    if not lines:
        return []
    values = [x[6] for x in lines]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    threshold = max(mean - 0.5 * spread, 0.3 * max(values))
    own = [x[1] in furniture and not x[5] & DATA or bool(x[5] & SITES) for x in lines]  # counts and table rows recur with other numbers
    data = [False, *(bool(x[5] & DATA) for x in lines), False]
    rows = [data[i + 1] and (data[i] or data[i + 2]) for i in range(len(lines))]  # rows and counts that stand together recur in form alone
    note = [bool(x[5] & NOTE) or x[2] != 0 and x[2] in furniture and not row for x, row in zip(lines, rows, strict=True)]
    content = [x[6] >= threshold and not site and not left for x, site, left in zip(lines, own, note, strict=True)]
    mass: dict[int, float] = {}
    for x, good in zip(lines, content, strict=True):
        if good:
            mass[x[3]] = mass.get(x[3], 0.0) + x[4] * x[6]
    heads = [i for i, x in enumerate(lines) if x[5] & HEADLINE] or [i for i, x in enumerate(lines) if x[5] & TITLE]
    if not mass and not any(x[5] & HEADLINE for x in lines):
        return []
    main = max(mass, key=lambda s: mass[s]) if mass else lines[heads[-1]][3]
    if mass and heads and mass.get(lines[heads[-1]][3], 0) >= 0.3 * mass[main]:
        main = lines[heads[-1]][3]
    inside = [i for i, x in enumerate(lines) if content[i] and x[3] == main]
    start = heads[-1] if heads else None
    if mass and (start is None or not any(i >= start and lines[i][5] & RUNNING for i in inside)):
        start = next((i for i in inside if lines[i][5] & RUNNING), None)
        if start is None:
            return []
    last = max((i for i, x in enumerate(lines) if i >= start and x[3] == main and (content[i] or x[5] & (ENDS | ITEM | DATA)) and not own[i] and not note[i]), default=start)
    kept = [lines[start][0]]
    body = False
    for i in range(start + 1, len(lines)):
        number, _, _, section, chars, flags, _ = lines[i]
        if section != main and section >= 0 and main >= 0:
            if any(x[3] == main for x in lines[i + 1 :]):
                continue
            break
        if note[i]:
            continue
        if flags & SITES and (main <= 0 or section != main):
            break
        if flags & SITES:
            continue
        if own[i] and not (flags & ENDS and chars < RUNNING_CHARS):  # a short sentence may recur in articles
            after = lines[i + 1] if i + 1 < len(lines) else None
            if main > 0 and section == main or after and after[5] & RUNNING and not own[i + 1] and not note[i + 1] and not own[i - 1]:
                continue
            break
        if flags & LINKED and not flags & (ENDS | DATA):
            follows = lines[i + 1] if i + 1 < len(lines) else None
            bounded = main > 0 and section == main  # a section of its own holds no list of other stories
            if not bounded and (flags & HEADING or (follows and follows[5] & LINKED and not follows[5] & ENDS)):
                break
            if chars > 30 and not (bounded and flags & HEADING):
                continue
        if i > last and not flags & (ENDS | ITEM | DATA):
            continue
        kept.append(number)
        body = body or bool(flags & RUNNING) or chars > 20
    return kept if body or len(kept) > 1 and lines[start][5] & HEADLINE else []


_LINE = "array<struct<line_no:int,print:bigint,shape:bigint,section:int,chars:int,flags:int,value:double>>"
_LINE_FIELDS = ("line_no", "print", "shape", "section", "chars", "flags", "value")
_LINE_ARROW = pa.list_(pa.struct([("line_no", pa.int32()), ("print", pa.int64()), ("shape", pa.int64()), ("section", pa.int32()), ("chars", pa.int32()), ("flags", pa.int32()), ("value", pa.float64())]))


def _line_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.slice(at, 200)
            pages = [page_lines(t, h, n) for t, h, n in zip(*(part.column(c).to_pylist() for c in ("text", "html", "title")), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in pages])])
            fields = list(zip(*(line for x in pages for line in x), strict=True)) or [()] * len(_LINE_FIELDS)
            kinds = [f.type for f in _LINE_ARROW.value_type]
            lines = pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds, strict=True)], fields=list(_LINE_ARROW.value_type))
            yield pa.record_batch({"id": part.column("id"), "site": part.column("site"), "article": pa.array([article_print(x) for x in pages], pa.int64()), "lines": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines)})


def _article_runner(furniture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = furniture.value
        for batch in batches:
            held = batch.column("lines")
            bounds = held.offsets.to_pylist()
            rows = list(zip(*(held.values.field(i).to_pylist() for i in range(len(_LINE_FIELDS))), strict=True))
            out, known = [], {}
            for k, (site, own) in enumerate(zip(batch.column("site").to_pylist(), batch.column("own"), strict=True)):
                if site not in known:
                    known = {site: everywhere.union(own.as_py() or ())}
                out.append(article_lines(rows[bounds[k] : bounds[k + 1]], known[site]))
            yield pa.record_batch({"id": batch.column("id"), "own": pa.array(out, pa.list_(pa.int32()))})

    return run


def main_content(df: DataFrame, ident: str, url: str, text: str, source: str, title: str) -> DataFrame:
    """``ident, line_no``: the non-blank lines (from 1) of each page's text that belong to its article.

    Lines are matched to the page's mark-up. The length and punctuation of text are summed for each root-to-leaf tag path of a page's sections; a path's ratio
    of both, less what is linked, is smoothed along the page, and a threshold on it selects the content nodes and with them the article's section and extent. Lines that stand in a set share of all
    articles, or of a site's, and forms of lines that do, are the sites' own (pages of one article, under several addresses or on several sites, count once); of the former there are at most lines an article / share, so they are broadcast, the latter are joined by site.

    Rows of one ``ident`` count once. A page with null text has no lines; one with null, cut or invalid mark-up is read by its text as far as the mark-up
    fails; a null title or url only lacks what it would tell; an empty table gives no rows; other columns are ignored.
    """
    rows = df.select(
        F.col(ident).cast("bigint").alias("id"), F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("site"),
        F.col(text).alias("text"), F.col(source).alias("html"), F.col(title).alias("title"),
    ).where(F.col("text").isNotNull())
    one = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("site", "text", "html", "title")).alias("m")).select("id", "m.*")
    parsed = cut(one.mapInArrow(_line_runner, f"id bigint, site string, article bigint, lines {_LINE}"), "pages")
    articles = parsed.select("article").distinct().count()
    both = F.array_distinct(F.filter(F.concat("lines.print", "lines.shape"), lambda p: p != 0))
    prints = cut(parsed.select("site", "article", F.explode(both).alias("print")).distinct(), "prints")
    often = prints.select("article", "print").distinct().groupBy("print").agg(F.count("*").alias("n")).where(F.col("n") >= F.greatest(F.lit(float(SITE_PAGES)), F.when(F.col("print") < 0, FORM_SHARE).otherwise(SHARE_OF_PAGES) * articles))
    furniture = df.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in often.select("print").toLocalIterator()))
    sizes = parsed.select("site", "article").distinct().groupBy("site").agg(F.count("*").alias("articles"))
    own = (
        prints.groupBy("site", "print").agg(F.count("*").alias("n")).where(F.col("n") >= SITE_PAGES).join(sizes, "site").where(F.col("n") >= SHARE_OF_SITE * F.col("articles"))
        .groupBy("site").agg(F.collect_set("print").alias("own"))
    )
    found = parsed.join(own, "site", "left").select("id", "site", "lines", "own").mapInArrow(_article_runner(furniture), "id bigint, own array<int>")
    return found.select(F.col("id").alias(ident), F.explode("own").alias("line_no"))
