"""Counts of terms and n-grams over a collection, and how much a term says about its record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.blocks import Words, text_blocks, words_of
from larkspur.session import cut

#: Partial rows a task collects before it hands them on.
HELD_ROWS = 1_000_000


def block_suffixes(words: Words, max_n: int) -> pa.Table:
    """The distinct suffixes of a block's records, truncated to ``max_n`` words, with what they add to the counts of their prefixes.

    Columns ``suffix``: its words; ``cf``: occurrences; ``d0..``: of those, the ones that are their record's first with the prefix of that length, so that
    record sets become numbers that add up. Suffixes count for their prefixes of two and more words; a row of one word counts for the word, so that what follows a frequent word need not meet.
    """
    size = len(words.code)
    columns = [words.code]
    for k in range(1, max_n):
        ahead = np.full(size, -1, dtype=np.int64)
        if size > k:
            ahead[:-k] = np.where(words.record[k:] == words.record[:-k], words.code[k:], -1)
        columns.append(ahead)
    order = np.lexsort([words.record, *reversed(columns)])
    columns, record = [c[order] for c in columns], words.record[order]
    n_records = int(record.max()) + 1 if size else 1
    departs = np.zeros(size, dtype=bool)
    departs[:1] = True
    firsts, runs = [], []
    for column in columns:
        departs[1:] |= column[1:] != column[:-1]
        run = np.cumsum(departs) - 1
        first = np.zeros(size, dtype=np.int64)
        first[np.unique(run * n_records + record, return_index=True)[1]] = 1
        firsts.append(np.where(column >= 0, first, 0))
        runs.append(run)
    parts = []
    for depth in {0, max_n - 1}:
        run = runs[depth]
        heads = np.flatnonzero(np.diff(run, prepend=-1))
        if depth:
            whole = columns[1][heads] >= 0
        else:
            whole = np.ones(len(heads), dtype=bool)
        kept = heads[whole]
        parted = [words.vocabulary.take(pa.array(c[kept], mask=c[kept] < 0)) for c in columns[: depth + 1]]
        data = {"suffix": pc.binary_join_element_wise(*parted, " ", null_handling="skip") if depth else parted[0]}
        data["cf"] = pa.array(np.diff(np.append(heads, size))[whole], pa.int64())
        for k in range(max_n):
            counted = (k == 0) if depth == 0 else 0 < k
            data[f"d{k}"] = pa.array(np.bincount(run, weights=firsts[k], minlength=len(heads)).astype(np.int64)[whole] if counted and size else np.zeros(len(kept), dtype=np.int64))
        parts.append(pa.table(data))
    return pa.concat_tables(parts)


def _summed(parts: list[pa.Table]) -> pa.Table:
    names = parts[0].column_names
    return pa.concat_tables(parts).group_by("suffix").aggregate([(c, "sum") for c in names[1:]]).select(["suffix", *(f"{c}_sum" for c in names[1:])]).rename_columns(names)


def _packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Suffix and, as one value of 32-bit numbers, its counts."""
    counts = np.stack([rows[c].to_numpy() for c in rows.column_names[1:]], axis=1).astype("<i4")
    width = counts.shape[1] * 4
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(counts.tobytes())])
    yield from pa.table({"suffix": rows["suffix"], "counts": packed.cast(pa.binary())}).to_batches()


def _suffix_runner(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows, floor = 0, 0
        for _, texts in text_blocks(batches):
            parts.append(block_suffixes(words_of(texts), max_n))
            rows += len(parts[-1])
            if rows > max(HELD_ROWS, 2 * floor):
                parts = [_summed(parts)]
                rows = floor = len(parts[0])
                if rows > HELD_ROWS:
                    yield from _packed(parts[0])
                    parts, rows, floor = [], 0, 0
        if parts:
            yield from _packed(_summed(parts))

    return run


class PrefixStack:
    """The open prefixes of suffixes that arrive in reverse lexicographic order, one of each length, with their counts so far.

    A prefix closes, and its counts are final, where a suffix departs from it. Suffixes are taken a batch at a time.
    """

    def __init__(self, max_n: int) -> None:
        self.max_n = max_n
        self.last: list[str | None] | None = None
        self.cf, self.df = [0] * max_n, [0] * max_n

    def _row(self, k: int) -> pa.Table:
        whole = self.last is not None and None not in self.last[: k + 1] and self.cf[k] > 0
        return self._table([" ".join(self.last[: k + 1])], k, [self.cf[k]], [self.df[k]]) if whole else self._table([], k, [], [])

    @staticmethod
    def _table(terms, k: int, cf, df) -> pa.Table:
        return pa.table({"term": pa.array(terms, pa.string()), "n": pa.array(np.full(len(terms), k + 1), pa.int32()), "cf": pa.array(cf, pa.int64()), "df": pa.array(df, pa.int64())})

    def push(self, batch: pa.RecordBatch) -> pa.Table:
        """The prefixes that close within the batch."""
        size = len(batch)
        parted = pc.list_slice(pc.split_pattern(batch.column("suffix"), " "), 0, self.max_n, return_fixed_size_list=True)
        words = [parted.values.take(pa.array(np.arange(size) * self.max_n + k)) for k in range(self.max_n)]
        single = np.asarray(pc.is_null(words[1])) if self.max_n > 1 else np.ones(size, dtype=bool)
        sums = np.frombuffer(batch.column("counts").cast(pa.binary(4 * self.max_n + 4)).buffers()[1], dtype="<i4")[: size * (self.max_n + 1)].reshape(size, -1).astype(np.int64)
        cf = sums[:, 0]
        departs = np.zeros(size, dtype=bool)
        closed = []
        for k, word in enumerate(words):
            held = word.fill_null("")  # no word is empty
            departs[1:] |= np.asarray(pc.not_equal(held.slice(1), held.slice(0, size - 1)))
            departs[0] |= self.last is None or (self.last[k] or "") != held[0].as_py()
            counts = np.where(single == (k == 0), cf, 0), sums[:, k + 1]
            at = np.flatnonzero(departs)
            starts = at if departs[0] else np.concatenate([[0], at])
            cfs, dfs = (np.add.reduceat(x, starts) for x in counts)
            if departs[0]:
                closed.append(self._row(k))
            else:
                cfs[0] += self.cf[k]
                dfs[0] += self.df[k]
            self.cf[k], self.df[k] = int(cfs[-1]), int(dfs[-1])
            done, cfs, dfs = starts[:-1], cfs[:-1], dfs[:-1]
            whole = np.asarray(pc.is_valid(word))[done] & (cfs > 0)
            grams = pc.binary_join_element_wise(*(w.take(pa.array(done[whole])) for w in words[: k + 1]), " ") if k else word.take(pa.array(done[whole]))
            closed.append(self._table(grams, k, cfs[whole], dfs[whole]))
        self.last = [w[size - 1].as_py() for w in words]
        return pa.concat_tables(closed)

    def end(self) -> pa.Table:
        return pa.concat_tables([self._row(k) for k in range(self.max_n)])


def _stack_runner(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(max_n)
        for batch in batches:
            if len(batch):
                yield from stack.push(batch).combine_chunks().to_batches()
        yield from stack.end().combine_chunks().to_batches()

    return run


def term_counts(df: DataFrame, ident: str, text: str, max_n: int = 3) -> DataFrame:
    """``term, n, cf, df``: occurrences of every n-gram of up to ``max_n`` words and the number of records that hold it.

    ``ident`` is unique. Suffixes truncated to ``max_n`` words are routed by their first term, and with it by their second, so that a frequent first term is split; what a task has seen of a suffix is
    added up before. They arrive in reverse lexicographic order and a stack of open prefixes counts all n-grams in one pass. Record sets are carried as numbers of
    first occurrences within a record, which add up, so no set of records is ever held.
    Null and empty texts, and an empty table, give no rows; other columns are ignored.
    """
    rows = df.select(F.col(ident).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).select("id", "text")
    suffixes = rows.mapInArrow(_suffix_runner(max_n), "suffix string, counts binary")
    routed = suffixes.repartition(F.substring_index("suffix", " ", 2)).sortWithinPartitions(F.col("suffix").desc())  # no character of a word comes before the blank
    return routed.mapInArrow(_stack_runner(max_n), "term string, n int, cf bigint, df bigint")


def usefulness(df: Column, records: Column | int, rare_below: int, common_share: float) -> Column:
    """``rare`` below ``rare_below`` records, ``common`` above ``common_share`` of them, else null; rare goes first."""
    total = records if isinstance(records, Column) else F.lit(records)
    return F.when(df < rare_below, F.lit("rare")).when(F.try_divide(df, total) > common_share, F.lit("common"))


def word_graph(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record, code, frequency and distinct-neighbour degree of every term of every record of a block.

    Two different terms of a record are neighbours where they stand less than ``window`` words apart.
    """
    v = max(len(words.vocabulary), 1)
    nodes, tf = np.unique(words.record * v + words.code, return_counts=True)
    edges = []
    for d in range(1, window):
        a, b = words.code[:-d], words.code[d:]
        keep = (words.record[:-d] == words.record[d:]) & (a != b)
        a, b = a[keep], b[keep]
        edges.append((words.record[:-d][keep] * v + np.minimum(a, b)) * v + np.maximum(a, b))
    found = np.unique(np.concatenate(edges)) if edges else np.zeros(0, dtype=np.int64)
    low, high = found // v, found % v
    high = low // v * v + high
    degree = np.bincount(np.searchsorted(nodes, low), minlength=len(nodes)) + np.bincount(np.searchsorted(nodes, high), minlength=len(nodes))
    return nodes // v, nodes % v, tf, degree


def _graph_runner(window: int, min_tf: int, max_df: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[pa.Table] = []
        scored: list[pa.Table] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            total = _df_sum(counts)
            keep = pa.concat_tables(scored)
            # records only add up, so a term past the limit here stays past it
            over = total.filter(pc.greater(total["df"], max_df))["term"]
            keep = keep.filter(pc.invert(pc.is_in(keep["term"], value_set=over.combine_chunks())))
            empty = pa.nulls(len(total))
            yield from pa.table({"term": total["term"], "df": total["df"], "id": empty.cast(pa.int64()), "tf": empty.cast(pa.int64()), "degree": empty.cast(pa.int64())}).to_batches()
            yield from keep.select(["term", "df", "id", "tf", "degree"]).to_batches()

        for ids, texts in text_blocks(batches):
            words = words_of(texts)
            record, code, tf, degree = word_graph(words, window)
            df = np.bincount(code, minlength=len(words.vocabulary))
            counts.append(pa.table({"term": words.vocabulary, "df": pa.array(df, pa.int64())}))
            counts.append(pa.table({"term": pa.array([None], pa.string()), "df": pa.array([len(np.unique(record))], pa.int64())}))  # without a term: the block's records
            often = np.flatnonzero(tf >= min_tf)
            scored.append(
                pa.table({
                    "term": words.vocabulary.take(pa.array(code[often])), "df": pa.array(np.zeros(len(often)), pa.int64()),
                    "id": pa.array(ids, pa.int64()).take(pa.array(record[often])), "tf": pa.array(tf[often], pa.int64()), "degree": pa.array(degree[often], pa.int64()),
                })
            )
            rows += len(counts[-1]) + len(scored[-1])
            if rows > HELD_ROWS:
                yield from flush()
                counts, scored, rows = [], [], 0
            elif len(counts) > 50:
                counts = [_df_sum(counts)]
        if scored:
            yield from flush()

    return run


def _block_runner(window: int, min_tf: int):
    """A row for each term of a block, with the block's records that hold it: what is said of a term is sent once a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            words = words_of(texts)
            record, code, tf, degree = word_graph(words, window)
            n = len(words.vocabulary)
            df = np.bincount(code, minlength=n)
            order = np.argsort(code, kind="stable")
            order = order[tf[order] >= min_tf]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(code[order], minlength=n))])
            entries = pa.StructArray.from_arrays(
                [pa.array(ids, pa.int64()).take(pa.array(record[order])), pa.array(tf[order], pa.int64()), pa.array(degree[order], pa.int64())], ["id", "tf", "degree"]
            )
            held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
            yield pa.record_batch({"term": words.vocabulary, "df": pa.array(df, pa.int64()), "held": held})
            yield pa.record_batch({"term": pa.array([None], pa.string()), "df": pa.array([len(np.unique(record))], pa.int64()), "held": pa.array([[]], held.type)})

    return run


def _df_sum(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("term").aggregate([("df", "sum")]).rename_columns(["term", "df"])


def distinctive_terms(df: DataFrame, ident: str, text: str, window: int = 4, min_tf: int = 1, max_df: int | None = None, min_score: float = 0.0) -> DataFrame:
    """``id, term, tf, degree, df, score`` of every term of every record: degree in the record's word graph times rarity.

    The graph joins terms that stand within ``window`` words; a term's number of distinct neighbours replaces its
    frequency, so repetition in one phrase adds nothing. Rarity is ln((1 + records) / df) over records with a term, where df is the
    number of records holding the term. ``min_tf`` drops terms rarer in their record from the result, ``max_df`` those in more records and ``min_score`` those
    of less weight, none of them from the counts. With ``max_df`` a task sends a term's records only while they can still qualify, and a window over a term sees one count a task and at most
    ``max_df`` scored rows a task, never the records of a common term. Null and empty texts have no terms; an empty table gives no rows; ``ident`` is unique; other columns are ignored.
    """
    rows = df.select(F.col(ident).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).select("id", "text")
    if max_df is not None:
        found = cut(rows.mapInArrow(_graph_runner(window, min_tf, max_df), "term string, df bigint, id bigint, tf bigint, degree bigint"), "graph")
        held = found.where(F.col("term").isNotNull()).withColumn("df", F.sum("df").over(Window.partitionBy("term"))).where(F.col("id").isNotNull() & (F.col("df") <= max_df))
        records = found.where(F.col("term").isNull()).agg(F.sum("df")).first()[0] or 0
        return _scored(held, records, min_score)
    blocks = cut(rows.mapInArrow(_block_runner(window, min_tf), "term string, df bigint, held array<struct<id:bigint,tf:bigint,degree:bigint>>"), "graph")
    total = blocks.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    records = blocks.where(F.col("term").isNull()).agg(F.sum("df")).first()[0] or 0  # the row without term counts a block's records
    return _scored(blocks.drop("df").join(total, "term").select("term", "df", F.inline("held")), records, min_score)


def _scored(held: DataFrame, records: int, min_score: float) -> DataFrame:
    score = F.round(F.col("degree") * F.log((1 + F.lit(records)) / F.col("df")), 6)
    return held.select("id", "term", "tf", "degree", "df", score.alias("score")).where(F.col("score") >= min_score)
