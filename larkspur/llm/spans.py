"""Long exact passages shared between records, found through recompression symbols."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import code_points
from larkspur.llm.hashing import mixed, paired, signed
from larkspur.session import cut

#: Characters of text whose symbols a task holds at once; a longer text is held alone.
BLOCK_CHARS = 100_000
#: Occurrences of a key up to which they are compared two by two; those of more frequent keys meet by their whole stretches.
COMPARED = 100
#: Two groups of equal texts are spelt out as pairs up to so many; beyond, each text is paired with the other group's first, and class rows and links say the rest.
SPELT_OUT = 1_000_000
#: Keys a task remembers to have met in several texts, and texts it remembers to have read; what it forgets it sends again, and the reducer drops it.
REMEMBERED = 500_000
#: A symbol may take part in a round only up to this length, which grows by this factor from round to round.
FIRST_LENGTH, LENGTH_GROWTH = 2.0, 1.45


class Level:
    """The symbols of all records of a block after some rounds, in order of position.

    ``name`` is a symbol's global name, ``start`` and ``end`` its characters. ``low`` and ``high`` bound the characters
    that decided that this symbol stands here: in any text with the same characters there, the same symbol does too.
    Both never fall from one symbol to the next, so the bounds of united symbols are those of the first and the last.
    """

    def __init__(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.start, self.end, self.low, self.high = name, start, end, low, high


def _heads(follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each united symbol; ``follows`` is true where a symbol is united with the one before it."""
    at = np.flatnonzero(~follows)
    last = np.empty_like(at)
    last[:-1] = at[1:] - 1
    last[-1] = len(follows) - 1
    return at, last


def first_level(points: np.ndarray) -> Level:
    position = np.arange(len(points), dtype=np.int32)
    return Level(mixed(points), position, position + 1, position, position + 1)


def name_runs(level: Level, points: np.ndarray, longest: float) -> Level:
    """One symbol for each maximal run of equal symbols, named by symbol and count.

    That a neighbour differs usually shows in its nearest first or last character; else its own bounds are taken over.
    """
    name, start, end, low, high = level.name, level.start, level.end, level.low, level.high
    active = (end - start) <= longest
    same = np.zeros(len(name), dtype=bool)
    same[1:] = (name[1:] == name[:-1]) & active[1:]
    told = ~same[1:]
    last_char, first_char = points[end - 1], points[start]
    low, high = low.copy(), high.copy()
    seen = np.where(last_char[1:] != last_char[:-1], np.minimum(level.low[1:], start[1:] - 1), level.low[:-1])
    low[1:] = np.where(told & active[1:], seen, level.low[1:])
    seen = np.where(first_char[1:] != first_char[:-1], np.maximum(level.high[:-1], start[1:] + 1), level.high[1:])
    high[:-1] = np.where(told & active[:-1], seen, level.high[:-1])
    if not same.any():
        return Level(name, start, end, low, high)
    at, last = _heads(same)
    count = last - at + 1
    name = name[at]
    several = np.flatnonzero(count > 1)
    name[several] = paired(name[several], count[several].astype(np.uint64) | np.uint64(1 << 40))
    return Level(name, start[at], end[last], low[at], high[last])


def name_pairs(level: Level, longest: float, round_no: int) -> Level:
    """One symbol for each left symbol followed by a right one; a bit of its name, another each round, makes a symbol left or right.

    A pair owes nothing to its surroundings: a left symbol never ends a pair and a right one never begins one. A
    symbol left alone owes it to the one neighbour it could have joined.
    """
    active = (level.end - level.start) <= longest
    right = (level.name & np.uint64(1 << (round_no % 64))) != 0
    left = ~right & active
    right &= active
    follows = np.zeros(len(right), dtype=bool)
    follows[1:] = left[:-1] & right[1:]
    low, high = level.low.copy(), level.high.copy()
    high[:-1] = np.where(left[:-1] & ~follows[1:], level.high[1:], level.high[:-1])
    low[1:] = np.where(right[1:] & ~follows[1:], level.low[:-1], level.low[1:])
    at, last = _heads(follows)
    name = level.name[at]
    two = np.flatnonzero(last > at)
    name[two] = paired(name[two], level.name[last[two]])
    return Level(name, level.start[at], level.end[last], low[at], high[last])


def anchors(points: np.ndarray, begin: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start and end of symbols' surroundings such that two equal stretches of ``length`` characters always show one in common.

    ``begin`` and ``stop`` bound the records in ``points``, which a separator different for each record parts. For every stretch of ``length`` characters
    within a record, the highest level is sought at which a symbol's deciding characters all lie in the stretch; the symbol with most of them is
    taken. Level and symbol depend on nothing but the stretch's characters. The key is the symbol's name with a hash of its deciding characters.
    """
    levels = [first_level(points)]
    longest, round_no = FIRST_LENGTH, 0
    while longest < length:
        runs = name_runs(levels[-1], points, longest)
        levels.append(name_pairs(runs, longest, round_no))
        longest, round_no = longest * LENGTH_GROWTH, round_no + 1
    size = len(points)
    valid = np.zeros(size + 1, dtype=np.int32)
    wide = stop - begin >= length
    np.add.at(valid, begin[wide], 1)
    np.add.at(valid, stop[wide] - length + 1, -1)
    open_ = np.cumsum(valid[:-1]) > 0  # starts of stretches that still lack a symbol
    names, starts, ends = [], [], []
    for depth in range(len(levels) - 1, -1, -1):
        if not open_.any():
            break
        level = levels[depth]
        i = np.flatnonzero((level.high - level.low) <= length)
        a, b = np.maximum(level.high[i] - length, 0), np.minimum(level.low[i], size - 1)  # the stretches from a to b hold the symbol
        before = np.concatenate([[0], np.cumsum(open_)])
        fits = (b >= a) & (before[np.maximum(b + 1, a)] > before[a])
        i, a, b = i[fits], a[fits], b[fits]
        if not len(i):
            continue
        opening = np.flatnonzero(open_[1:] & ~open_[:-1]) + 1
        at = np.unique(np.concatenate([[0], a, b + 1, opening]))
        at = at[open_[np.minimum(at, size - 1)] & (at < size)]
        first, last = np.searchsorted(b, at, "left"), np.searchsorted(a, at, "right") - 1
        some = first <= last
        width = (level.high[i] - level.low[i]).astype(np.int64)
        order = ((length - width) << 40) + (level.name[i] >> np.uint64(24)).astype(np.int64)  # the widest, then the least name
        take = i[np.unique(_least(order, first[some], last[some]))]
        names.append(level.name[take])
        starts.append(level.low[take])
        ends.append(level.high[take])
        change = np.zeros(size + 1, dtype=np.int32)
        np.add.at(change, a, 1)
        np.add.at(change, b + 1, -1)
        open_ &= np.cumsum(change[:-1]) == 0
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    name, start, end = np.concatenate(names), np.concatenate(starts), np.concatenate(ends)
    return paired(name, stretch_hashes(points, start, end)), start, end


def stretch_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the characters from each ``start`` to ``end``, wherever they stand: a polynomial in an odd number, modulo 2**64."""
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    size = len(points)
    with np.errstate(over="ignore"):
        powers, back = np.full(size + 1, base, dtype=np.uint64), np.full(size + 1, inverse, dtype=np.uint64)
        powers[0] = back[0] = 1
        powers, back = np.cumprod(powers, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(mixed(points + np.uint32(seed)) * powers[:-1], out=sums[1:])
        return mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the least value, the leftmost of equal ones, between each ``first`` and ``last``."""
    rows = [np.arange(len(values))]
    width = 1
    most = int((last - first).max()) + 1 if len(first) else 1
    while 2 * width <= most:
        a, b = rows[-1][:-width], rows[-1][width:]
        rows.append(np.where(values[a] <= values[b], a, b))
        width *= 2
    depth = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), dtype=np.int64)
    for d in range(len(rows)):
        m = depth == d
        a, b = rows[d][first[m]], rows[d][last[m] - (1 << d) + 1]
        out[m] = np.where(values[a] <= values[b], a, b)
    return out


def _joined_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters, a separator of its own before and after each text, and where each text begins and stops.

    A symbol that a text's edge decided has a separator among its deciding characters, so it is never taken for one that the text alone decided.
    """
    parts, begin, stop, at = [np.array([0x110000 + len(texts)], dtype=np.uint32)], [], [], 1
    for k, t in enumerate(texts):
        points = code_points(t)
        parts += [points, np.array([0x110000 + k], dtype=np.uint32)]
        begin.append(at)
        at += len(points)
        stop.append(at)
        at += 1
    return np.concatenate(parts), np.array(begin), np.array(stop)


def _anchor_runner(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        known = np.zeros(0, dtype=np.int64)

        def block(prints: list[int], texts: list[str]) -> pa.RecordBatch:
            nonlocal known
            points, begin, stop = _joined_points(texts)
            key, start, end = anchors(points, begin, stop, length)
            text = np.searchsorted(begin, start, side="right") - 1
            own = np.array(prints, dtype=np.int64)[text]
            key = signed(key)
            order = np.lexsort((start, own, key))
            key, own, start, end, text = key[order], own[order], start[order] - begin[text[order]], end[order] - begin[text[order]], text[order]
            new_key = np.ones(len(key), dtype=bool)
            new_key[1:] = key[1:] != key[:-1]
            new_text = new_key.copy()
            new_text[1:] |= own[1:] != own[:-1]
            group = np.cumsum(new_key) - 1
            texts_of_key = np.bincount(group[new_text], minlength=int(group[-1]) + 1 if len(group) else 0)
            seen_before = np.isin(key, known)
            shared = (texts_of_key[group] > 1) | seen_before if len(group) else np.zeros(0, dtype=bool)
            # of a key met in several texts here, two rows tell its reducer; the others travel by a route of their own
            nth_text = np.cumsum(new_text) - np.cumsum(new_text)[np.flatnonzero(new_key)][group] if len(group) else group
            tells = ~shared | (~seen_before & new_text & (nth_text < 2))
            route = np.where(tells, key, signed(paired(key.view(np.uint64), own.view(np.uint64))))
            known = np.union1d(known, key[shared & ~seen_before])
            if len(known) > REMEMBERED:
                known = known[:0]
            return pa.record_batch({
                "route": pa.array(route), "key": pa.array(key), "print": pa.array(own), "start": pa.array(start, pa.int32()),
                "end": pa.array(end, pa.int32()), "shared": pa.array(shared),
            })

        prints: list[int] = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for p, t in zip(batch.column("print").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if p in done:
                    continue
                if len(done) > REMEMBERED:
                    done.clear()
                done.add(p)
                if texts and size + len(t) > BLOCK_CHARS:
                    yield block(prints, texts)
                    prints, texts, size = [], [], 0
                prints.append(p)
                texts.append(t)
                size += len(t)
        if texts:
            yield block(prints, texts)

    return run


def _shared_keys(rows: pa.Table) -> pa.RecordBatch | None:
    key, own = rows["key"].to_numpy(), rows["print"].to_numpy()
    new_key = np.ones(len(key), dtype=bool)
    new_key[1:] = key[1:] != key[:-1]
    group = np.cumsum(new_key) - 1
    head = np.flatnonzero(new_key)
    several = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
    flagged = np.maximum.reduceat(rows["shared"].to_numpy(), head)
    keep = (several | flagged)[group]
    return rows.filter(pa.array(keep)).select(["key", "print", "start", "end"])


def _shared_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by key; a key's rows are at most two a task that met it, so whole keys are held."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < 100_000:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows["key"].to_numpy()
        last = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
        if last:
            yield from _shared_keys(rows.slice(0, last)).to_batches()
        held, count = rows.slice(last).to_batches(), len(rows) - last
    if count:
        yield from _shared_keys(pa.Table.from_batches(held).combine_chunks()).to_batches()


def _match_runner(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[int]] = {"pa": [], "pb": [], "sa": [], "sb": [], "n": []}
            columns = [batch.column(c).to_pylist() for c in ("pa", "pb", "from", "diagonal", "ta", "tb")]
            for pa_, pb_, at, diagonal, ta, tb in zip(*columns, strict=True):
                x, y = code_points(ta), code_points(tb)
                size = min(len(x), len(y))
                edge = np.diff((x[:size] == y[:size]).astype(np.int8), prepend=0, append=0)
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    if e - s >= length:
                        for k, v in zip(out, (pa_, pb_, at + s, at + s - diagonal, e - s), strict=True):
                            out[k].append(v)
            yield pa.record_batch({k: pa.array(v, pa.int64() if k[0] == "p" else pa.int32()) for k, v in out.items()})

    return run


def _stretch_runner(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("print", "start", "end", "from", "t")]
            for own, start, end, at, t in zip(*columns, strict=True):
                points = code_points(t)
                first, last = max(end - length - at, 0), min(start - at, len(points) - length)
                if last < first:
                    continue
                s = np.arange(first, last + 1)
                before = np.where(s + at > 0, points[np.maximum(s - 1, 0)].astype(np.int64), -1)
                yield pa.record_batch({
                    "w1": pa.array(signed(stretch_hashes(points, s, s + length))), "w2": pa.array(signed(stretch_hashes(points, s, s + length, 77))),
                    "print": pa.array(np.full(len(s), own, dtype=np.int64)), "start": pa.array((s + at).astype(np.int32)), "before": pa.array(before, pa.int32()),
                })

    return run


@dataclass
class SharedSpans:
    """``texts``: print, id and length of every record long enough; ``classes``: print, members, first member and length.
    ``matches``: (pa, pb, sa, sb, n), maximal common passages of two different texts, by print and start. ``stretches``: (w1, w2, print,
    start, before), stretches of the sought length that several texts hold, for passages that very many texts share."""

    texts: DataFrame
    classes: DataFrame
    matches: DataFrame
    stretches: DataFrame


def printed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, text) with a print for each different text, and the texts: print, members, first member, length.

    The print has 64 bits. A second hash, of other 64, tells whether different texts have one in common, which n texts make expect n * n / 2**65 times, three times among ten
    thousand million; such texts get prints of both hashes.
    """
    both = rows.select("id", "text", F.xxhash64("text").alias("print"), F.xxhash64(F.lit(1), "text").alias("second"))

    def classes(df: DataFrame) -> DataFrame:
        found = df.groupBy("print").agg(F.count("*").alias("members"), F.min("id").alias("first"), F.max(F.length("text")).alias("length"), F.min("second").alias("low"), F.max("second").alias("high"))
        return cut(found, "classes")

    found = classes(both)
    clashes = [r[0] for r in found.where("low <> high").select("print").toLocalIterator()]
    if clashes:
        both = both.withColumn("print", F.when(F.col("print").isin(clashes), F.xxhash64("print", "second")).otherwise(F.col("print")))
        found = classes(both)
    return both.drop("second"), found.drop("low", "high")


def find_shared_spans(df: DataFrame, ident: str, text: str, length: int = 200, compared: int = COMPARED) -> SharedSpans:
    """Passages of at least ``length`` characters that two records have in common, character for character.

    Equal texts are one, known by 128 bits. Each text is recompressed in rounds that name runs and pairs by hashes, so that
    the same characters get the same symbols in every task without an exchange; ``anchors`` gives keys of which any two
    equal stretches have one in common. One shuffle brings equal keys together. Texts with a key in common are compared there;
    keys of more than ``compared`` occurrences are settled by 128-bit hashes of whole stretches, so that no frequent key is ever expanded into pairs that need not match.
    Matches, classes and members are joined without broadcast, so none of them reaches the driver.

    Null texts and texts shorter than ``length`` share nothing; ``ident`` is unique; other columns are ignored; an empty table gives empty tables.
    """
    rows, texts = printed(df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.length("text") >= length))
    found = rows.select("print", "text").mapInArrow(_anchor_runner(length), "route bigint, key bigint, print bigint, start int, end int, shared boolean")
    shared = cut(
        found.repartition("route").sortWithinPartitions("key").mapInArrow(_shared_runner, "key bigint, print bigint, start int, end int").dropDuplicates(),
        "anchors",
    )
    frequency = shared.groupBy("key").agg(F.count("*").alias("times"))
    counted = shared.join(frequency, "key")
    few, many = counted.where(F.col("times") <= compared), counted.where(F.col("times") > compared)
    a, b = few.alias("a"), few.alias("b")
    diagonals = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.print") < F.col("b.print")))
        .groupBy(F.col("a.print").alias("pa"), F.col("b.print").alias("pb"), (F.col("a.start") - F.col("b.start")).alias("diagonal"))
        .agg(F.min("a.start").alias("lo"), F.max("a.start").alias("hi"))
        .withColumn("from", F.greatest(F.lit(0), F.col("lo") - length, F.col("diagonal")))
        .withColumn("size", F.col("hi") + 2 * length - F.col("from"))
    )
    needed = shared.select("print").distinct()
    # each text that is needed is read from its first record alone, by a key that no two records share
    first = texts.join(needed.hint("merge"), "print").select(F.col("first").alias("id"))
    whole = cut(rows.join(first.hint("merge"), "id", "left_semi").select("print", "text"), "texts")
    one = diagonals.join(whole.withColumnRenamed("print", "pa").hint("merge"), "pa").withColumn("ta", F.substring("text", F.col("from") + 1, F.col("size"))).drop("text")
    two = one.join(whole.withColumnRenamed("print", "pb").hint("merge"), "pb").withColumn("tb", F.substring("text", F.col("from") - F.col("diagonal") + 1, F.col("size")))
    matches = two.select("pa", "pb", "from", "diagonal", "ta", "tb").mapInArrow(_match_runner(length), "pa bigint, pb bigint, sa int, sb int, n int")
    around = (
        many.join(whole, "print").withColumn("from", F.greatest(F.lit(0), F.col("start") - length))
        .select("print", "start", "end", "from", F.substring("text", F.col("from") + 1, F.lit(3 * length)).alias("t"))
    )
    stretches = around.mapInArrow(_stretch_runner(length), "w1 bigint, w2 bigint, print bigint, start int, before int").dropDuplicates(["w1", "w2", "print", "start"])
    several = stretches.groupBy("w1", "w2").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p < q").select("w1", "w2")
    return SharedSpans(rows.select("print", "id", F.length("text").alias("length")), texts, cut(matches, "matches"), cut(stretches.join(several, ["w1", "w2"], "left_semi"), "stretches"))


def linked_texts(found: SharedSpans) -> DataFrame:
    """``pa, pb``: every two different texts with a common passage, by print."""
    a, b = found.stretches.alias("a"), found.stretches.alias("b")
    # a passage's first common stretch is the one before which the texts differ, so each passage is met once
    often = a.join(b, (F.col("a.w1") == F.col("b.w1")) & (F.col("a.w2") == F.col("b.w2")) & (F.col("a.print") < F.col("b.print")) & ((F.col("a.before") != F.col("b.before")) | (F.col("a.before") == -1)))
    return found.matches.select("pa", "pb").unionByName(often.select(F.col("a.print").alias("pa"), F.col("b.print").alias("pb"))).distinct()


def sharing_links(found: SharedSpans) -> DataFrame:
    """``class_1, class_2``: every two classes of equal records whose texts have a common passage; a class is known by its least record."""
    c = found.classes.select("print", "first")
    both = linked_texts(found).join(c.select(F.col("print").alias("pa"), F.col("first").alias("x")).hint("merge"), "pa").join(c.select(F.col("print").alias("pb"), F.col("first").alias("y")).hint("merge"), "pb")
    return both.select(F.least("x", "y").alias("class_1"), F.greatest("x", "y").alias("class_2"))


def sharing_classes(found: SharedSpans) -> DataFrame:
    """``id, class, members, links``: every record long enough, its class of equal records, that class' size, and with how many other records it has a passage in common."""
    c = found.classes.select("print", "first", "members")
    linked = linked_texts(found)
    each = linked.select(F.col("pa").alias("print"), F.col("pb").alias("other")).unionByName(linked.select(F.col("pb").alias("print"), F.col("pa").alias("other")))
    met = each.join(c.select(F.col("print").alias("other"), "members").hint("merge"), "other").groupBy("print").agg(F.sum("members").alias("met"))
    rows = found.texts.select("id", "print").join(c.hint("merge"), "print").join(met.hint("merge"), "print", "left")
    return rows.select("id", F.col("first").alias("class"), "members", (F.coalesce("met", F.lit(0)) + F.col("members") - 1).alias("links"))


def sharing_pairs(found: SharedSpans, spelt_out: int = SPELT_OUT) -> DataFrame:
    """``id_1, id_2`` (smaller first) of every two records with a common passage.

    Two groups of equal texts with more than ``spelt_out`` pairs are given as stars: every member with the first of the other
    group, and every member of a large group with its first. No link between different texts is lost; ``sharing_classes`` and ``sharing_links`` give all links in rows that grow with records and class pairs.
    """
    linked = linked_texts(found)
    ca = found.classes.select(F.col("print").alias("pa"), F.col("members").alias("na"), F.col("first").alias("fa"))
    cb = found.classes.select(F.col("print").alias("pb"), F.col("members").alias("nb"), F.col("first").alias("fb"))
    links = linked.join(ca.hint("merge"), "pa").join(cb.hint("merge"), "pb")
    ma, mb = found.texts.select(F.col("print").alias("pa"), F.col("id").alias("x")).hint("merge"), found.texts.select(F.col("print").alias("pb"), F.col("id").alias("y")).hint("merge")
    few, many = links.where(F.col("na") * F.col("nb") <= spelt_out), links.where(F.col("na") * F.col("nb") > spelt_out)
    equal = found.texts.join(found.classes.where("members > 1").select("print", "members", "first").hint("merge"), "print")
    small = equal.where(F.col("members") * F.col("members") <= spelt_out)
    s, t = small.alias("s"), small.alias("t")
    pairs = (
        few.join(ma, "pa").join(mb, "pb").select("x", "y")
        .unionByName(many.join(ma, "pa").select("x", F.col("fb").alias("y")))
        .unionByName(many.join(mb, "pb").select(F.col("fa").alias("x"), "y"))
        .unionByName(s.join(t, (F.col("s.print") == F.col("t.print")) & (F.col("s.id") < F.col("t.id"))).select(F.col("s.id").alias("x"), F.col("t.id").alias("y")))
        .unionByName(equal.where(F.col("members") * F.col("members") > spelt_out).where("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y")))
    )
    return pairs.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2")).distinct()


def _merge_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, spans = batch.column("print"), batch.column("spans").to_pylist()
        out, covered = [], []
        for one in spans:
            one.sort(key=lambda x: x["start"])
            kept: list[dict[str, int]] = []
            for x in one:
                if kept and x["start"] <= kept[-1]["stop"]:
                    kept[-1]["stop"] = max(kept[-1]["stop"], x["stop"])
                else:
                    kept.append({"start": x["start"], "stop": x["stop"]})
            out.append(kept)
            covered.append(sum(x["stop"] - x["start"] for x in kept))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.record_batch({"print": prints, "passages": pa.array(out, kind), "shared_chars": pa.array(covered, pa.int64())})


def shared_coverage(df: DataFrame, ident: str, text: str, found: SharedSpans, length: int = 200) -> DataFrame:
    """``ident, n_chars, passages, shared_chars, shared_share`` of every record: what of it stands in another record too.

    ``passages`` lists disjoint stretches (start, stop). A text that another record repeats whole is shared whole. A record that shares nothing has an empty list.
    """
    m = found.matches
    spans = (
        m.select(F.col("pa").alias("print"), F.col("sa").alias("start"), (F.col("sa") + F.col("n")).alias("stop"))
        .unionByName(m.select(F.col("pb").alias("print"), F.col("sb").alias("start"), (F.col("sb") + F.col("n")).alias("stop")))
        .unionByName(found.stretches.select("print", "start", (F.col("start") + length).alias("stop")))
        .unionByName(found.classes.where("members > 1").select("print", F.lit(0).alias("start"), F.col("length").alias("stop")))
        .groupBy("print").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    )
    merged = spans.mapInArrow(_merge_runner, "print bigint, passages array<struct<start:int,stop:int>>, shared_chars bigint")
    per = found.texts.select("id", "print").join(merged, "print")
    every = df.select(F.col(ident).cast("bigint").alias("id"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("n_chars")).join(per.drop("print"), "id", "left")
    share = F.round(F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)), 6)
    return every.select(
        F.col("id").alias(ident), "n_chars", F.coalesce("passages", F.array().cast("array<struct<start:int,stop:int>>")).alias("passages"),
        F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"), share.alias("shared_share"),
    )
