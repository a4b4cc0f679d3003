"""Same or nearly the same records in evaluation and training splits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.blocks import text_blocks, words_of
from larkspur.llm.hashing import mixed, paired, signed, string_hashes
from larkspur.session import cut

#: One word in so many of the longer record may differ.
WORDS_PER_EDIT = 5
#: Parity bits of a record's words, in 64-bit numbers; with fewer, those of long records say nothing.
PARITY_NUMBERS = 8
#: Counters of word pairs by hash; fixed, so that the table of them has at most so many rows whatever the collection's size.
BUCKETS = 1 << 20
#: Two groups of equal records are spelt out as pairs up to so many; beyond, each record is paired with the other group's first, and class rows and links say the rest.
SPELT_OUT = 1_000_000


def within_edits(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements of words turn ``a`` into ``b`` (bit-parallel columns)."""
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return max(len(a), len(b)) <= most
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for j, w in enumerate(b):
        eq = where.get(w, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance - (len(b) - 1 - j) > most:
            return False
        up = up << 1 | 1
        plus = ((down << 1) | ~(d | up)) & full
        minus = up & d
    return distance <= most


def shared_pairs_needed(n: int) -> int:
    """The fewest word pairs a record of ``n`` words shares with any record within the edits allowed, at least 1."""
    return max(1, min(m - 1 - 2 * (m // WORDS_PER_EDIT) for m in range(n, n * WORDS_PER_EDIT // (WORDS_PER_EDIT - 1) + 1)))


def _word_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Record and hash of every adjacent word pair, its repetitions told apart; each record's words and its parity bits.

    Every word flips one of 512 bits by its hash. An insertion or deletion flips one bit, a replacement at most two, so
    records ``k`` edits apart differ in at most ``2k`` bits.
    """
    words = words_of(texts)
    own = string_hashes(words.vocabulary)[words.code] if len(words.vocabulary) else np.zeros(0, dtype=np.uint64)
    n = np.bincount(words.record, minlength=len(texts))
    bits = 64 * PARITY_NUMBERS
    bit = (mixed(own) % np.uint64(bits)).astype(np.int64)
    parity = np.bincount(words.record * bits + bit, minlength=len(texts) * bits).reshape(len(texts), bits)
    flags = np.packbits((parity & 1).astype(np.uint8), axis=1).view(np.int64)
    same = words.record[1:] == words.record[:-1]
    record, pair = words.record[1:][same], paired(own[:-1], own[1:])[same]
    order = np.lexsort((pair, record))
    record, pair = record[order], pair[order]
    index = np.arange(len(pair))
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (record[1:] != record[:-1])
    again = index - np.maximum.accumulate(np.where(new, index, 0)) if len(pair) else index
    return record, paired(pair, again.astype(np.uint64)), n, flags


def _bucket_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for _, texts in text_blocks(batches):
        total += np.bincount((_word_pairs(texts)[1] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    held = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held], pa.int64())})


def _rarest_runner(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for ids, texts in text_blocks(batches):
            record, pair, n, flags = _word_pairs(texts)
            often = frequency[(pair % np.uint64(BUCKETS)).astype(np.int64)]
            order = np.lexsort((pair, often, record))
            record, pair = record[order], pair[order]
            place = np.arange(len(record)) - np.searchsorted(record, record)
            need = np.array([shared_pairs_needed(int(x)) for x in n], dtype=np.int64)
            keep = place < (n - 1 - need + 1)[record]
            record, pair = record[keep], pair[keep]
            yield pa.record_batch({
                "pair": pa.array(signed(pair), pa.int64()), "c": pa.array(ids, pa.int64()).take(pa.array(record)), "n": pa.array(n[record], pa.int32()),
                **{f"b{i}": pa.array(np.ascontiguousarray(flags[record, i])) for i in range(PARITY_NUMBERS)},
            })

    return run


def nearly_equal(a: list[str], b: list[str]) -> bool:
    """Whether at most one word in WORDS_PER_EDIT of the longer record is edited; an edit touches one word and two adjacent pairs, which rules most out."""
    most = max(len(a), len(b)) // WORDS_PER_EDIT
    if len(set(a) - set(b)) > most or len(set(b) - set(a)) > most:
        return False
    if len(set(zip(a, a[1:], strict=False)) - set(zip(b, b[1:], strict=False))) > 2 * most:
        return False
    return within_edits(a, b, most)


def _verify_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, list[str]] = {}
        keep = []
        for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True):
            for t in (x, y):
                if t not in words:
                    words[t] = t.split(" ")
            keep.append(nearly_equal(words[x], words[y]))
        yield pa.RecordBatch.from_arrays([batch.column("ca"), batch.column("cb")], ["ca", "cb"]).filter(pa.array(keep, pa.bool_()))


@dataclass
class Overlaps:
    """``members``: id, split, source, side (eval or train) and class of each record; ``links``: (ca, cb), the class of an
    evaluation record and that of a training record, equal (ca = cb) or nearly so; ``classes``: sizes and first members. ``min_words``: words from which records are compared."""

    members: DataFrame
    classes: DataFrame
    links: DataFrame
    min_words: int


def find_overlaps(df: DataFrame, ident: str, text: str, split: str, source: str, train: str, evaluation: list[str], min_words: int = 20) -> Overlaps:
    """Overlaps between the training split and the evaluation splits.

    Records are canonicalised to their lower-cased words, which drops case, punctuation and white space, and grouped by
    a 128-bit hash of that; a class with members on both sides is an exact overlap. Near overlaps, at most one word in five of the longer record
    edited, are found between classes of at least ``min_words`` words: records that close share so many adjacent word pairs that
    the rarest of each, as many as can be missing plus one, have one in common. Hashes of those are joined, evaluation against training, the join condition drops
    most pairs by length and parity bits, and an exact comparison of the words follows. Nothing is lost on the way: all filters are bounds.

    Rows of one ``ident`` count once (the least, should they differ). Links, classes and members are joined without broadcast, so none of them reaches the driver. Null texts, texts without words and rows of another or no split are no overlap;
    split names are trimmed and lower-cased; a null source is a source. A frequent word pair makes a skewed join key, which adaptive execution splits.
    """
    rows = df.select(F.col(ident).alias("id"), F.lower(F.trim(F.col(split))).alias("split"), F.col(source).alias("source"), F.col(text).alias("text"))
    side = F.when(F.col("split") == train, F.lit("train")).when(F.col("split").isin(evaluation), F.lit("eval"))
    canon = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")
    records = cut(
        rows.withColumn("side", side).where(F.col("side").isNotNull() & F.col("text").isNotNull()).groupBy("id").agg(F.min(F.struct("side", "split", "source", "text")).alias("m")).select("id", "m.*")
        .withColumn("canon", canon).where(F.col("canon") != "").withColumn("h", F.unhex(F.md5("canon"))).drop("text"),
        "records",
    )
    is_train = F.col("side") == "train"
    classes = cut(
        records.groupBy("h").agg(
            F.min("id").cast("bigint").alias("c"), F.first("canon").alias("canon"),
            F.count_if(is_train).alias("n_train"), F.count_if(~is_train).alias("n_eval"),
            F.min(F.when(is_train, F.col("id"))).alias("first_train"), F.min(F.when(~is_train, F.col("id"))).alias("first_eval"),
        ).withColumn("n", F.length("canon") - F.length(F.replace("canon", F.lit(" "), F.lit(""))) + 1),
        "classes",
    )
    members = records.drop("canon").join(classes.select("h", "c", "n").hint("merge"), "h").drop("h")
    long = classes.where(F.col("n") >= min_words).select(F.col("c").alias("id"), F.col("canon").alias("text"), "n_train", "n_eval")
    texts = long.select("id", "text")
    spark = df.sparkSession
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for b in texts.mapInArrow(_bucket_runner, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[b.column("bucket").to_numpy()] = b.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)  # BUCKETS numbers, 8 MB
    schema = "pair bigint, c bigint, n int, " + ", ".join(f"b{i} bigint" for i in range(PARITY_NUMBERS))
    a = long.where("n_eval > 0").select("id", "text").mapInArrow(_rarest_runner(shared), schema).alias("a")
    b = long.where("n_train > 0").select("id", "text").mapInArrow(_rarest_runner(shared), schema).alias("b")
    edits = F.floor(F.greatest("a.n", "b.n") / WORDS_PER_EDIT)
    apart = sum((F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in range(1, PARITY_NUMBERS)), F.bit_count(F.col("a.b0").bitwiseXOR(F.col("b.b0"))))
    near = a.join(b, (F.col("a.pair") == F.col("b.pair")) & (F.col("a.c") != F.col("b.c")) & (F.abs(F.col("a.n") - F.col("b.n")) <= edits) & (apart <= 2 * edits))
    candidates = near.select(F.col("a.c").alias("ca"), F.col("b.c").alias("cb")).distinct()
    wa, wb = classes.select(F.col("c").alias("ca"), F.col("canon").alias("wa")), classes.select(F.col("c").alias("cb"), F.col("canon").alias("wb"))
    found = candidates.join(wa.hint("merge"), "ca").join(wb.hint("merge"), "cb").select("ca", "cb", "wa", "wb").mapInArrow(_verify_runner, "ca bigint, cb bigint")
    equal = classes.where("n_train > 0 AND n_eval > 0").select(F.col("c").alias("ca"), F.col("c").alias("cb"))
    return Overlaps(cut(members, "members"), classes.drop("canon", "h"), cut(equal.unionByName(found), "links"), min_words)


def overlapping_pairs(found: Overlaps, spelt_out: int = SPELT_OUT) -> DataFrame:
    """``id_1, id_2`` (smaller first) of every evaluation record and every training record whose classes overlap.

    Two classes with more than ``spelt_out`` such pairs are given as stars: every member with the first member of the other class;
    ``overlap_classes`` and ``overlap_links`` give the same links whole, in rows that grow with records and class pairs.
    """
    c = found.classes.where(F.col("n") >= found.min_words)
    ea = c.select(F.col("c").alias("ca"), "n_eval", "first_eval").hint("merge")
    tb = c.select(F.col("c").alias("cb"), "n_train", "first_train").hint("merge")
    links = found.links.join(ea, "ca").join(tb, "cb")
    ev = found.members.where("side = 'eval'").select(F.col("c").alias("ca"), F.col("id").alias("e")).hint("merge")
    tr = found.members.where("side = 'train'").select(F.col("c").alias("cb"), F.col("id").alias("t")).hint("merge")
    few = links.where(F.col("n_eval") * F.col("n_train") <= spelt_out).select("ca", "cb")
    many = links.where(F.col("n_eval") * F.col("n_train") > spelt_out)
    pairs = (
        few.join(ev, "ca").join(tr, "cb").select("e", "t")
        .unionByName(many.join(ev, "ca").select("e", F.col("first_train").alias("t")))
        .unionByName(many.join(tr, "cb").where(F.col("t") != F.col("first_train")).select(F.col("first_eval").alias("e"), "t"))
    )
    return pairs.select(F.least("e", "t").alias("id_1"), F.greatest("e", "t").alias("id_2")).distinct()


def overlap_links(found: Overlaps) -> DataFrame:
    """``class_1, class_2, exact``: every class with evaluation records and class with training records that overlap; a class is known by its least record."""
    return found.links.select(F.col("ca").alias("class_1"), F.col("cb").alias("class_2"), (F.col("ca") == F.col("cb")).alias("exact"))


def overlap_classes(found: Overlaps) -> DataFrame:
    """``id, side, class, members, links``: every record of either side, its class of equal records, that class' size, and how many records of the other side it overlaps."""
    sizes = found.classes.select("c", "n_eval", "n_train", (F.col("n_eval") + F.col("n_train")).alias("members")).hint("merge")
    to_train = found.links.join(sizes.select(F.col("c").alias("cb"), "n_train"), "cb").groupBy(F.col("ca").alias("c")).agg(F.sum("n_train").alias("to_train"))
    to_eval = found.links.join(sizes.select(F.col("c").alias("ca"), "n_eval"), "ca").groupBy(F.col("cb").alias("c")).agg(F.sum("n_eval").alias("to_eval"))
    rows = found.members.join(sizes, "c").join(to_train.hint("merge"), "c", "left").join(to_eval.hint("merge"), "c", "left")
    links = F.when(F.col("side") == "eval", F.col("to_train")).otherwise(F.col("to_eval"))
    return rows.select("id", "side", F.col("c").alias("class"), "members", F.coalesce(links, F.lit(0)).alias("links"))


def overlap_report(found: Overlaps) -> DataFrame:
    """Per evaluation split and source: records, those with an exact and with only a near overlap, and the training records they meet."""
    sizes = found.classes.select(F.col("c").alias("cb"), "n_train")
    per_class = (
        found.links.join(sizes.hint("merge"), "cb").groupBy(F.col("ca").alias("c"))
        .agg(F.max((F.col("ca") == F.col("cb")).cast("int")).alias("exact"), F.sum("n_train").alias("met"))
    )
    ev = found.members.where("side = 'eval'").join(per_class.hint("merge"), "c", "left")
    return ev.groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count_if(F.col("exact") == 1).alias("exact"), F.count_if(F.col("exact") == 0).alias("near"),
        F.coalesce(F.sum("met"), F.lit(0)).alias("training_records_met"),
    )
