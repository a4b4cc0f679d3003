"""Mail cleaning and the features spam filters use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import ngrams, raw_tokens
from larkspur.operators.web import placed

# Starts of lines that only frame a mail's parts, and the length from which a line of one word is taken for encoded content.
FRAME_PREFIXES = (
    "------=_NextPart", "Content-Type: ", "\tcharset=", "        boundary=", "Content-Transfer-Encoding: ", "----", "        charset=", "This is a multi-part message in MIME format.", "Content-ID: ",
)
ENCODED_CHARS = 40

# The n-grams whose scores are a mail's dense features.
SPAM_NGRAMS = ("porn", "free", "win", "sex", "horny", "click here")


def clean_body(body: Column) -> Column:
    """Body without mark-up, framing lines, encoded and empty lines; lines end in a line feed; '' for null."""
    lines = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"<[^>]*>", ""), "\n")
    kept = F.filter(lines, lambda x: (x != "") & ~_framing(x) & ~x.rlike(rf"^\S{{{ENCODED_CHARS + 1},}}\s*$"))
    return F.array_join(kept, "\n")


def _framing(line: Column) -> Column:
    test = line.startswith(FRAME_PREFIXES[0])
    for p in FRAME_PREFIXES[1:]:
        test = test | line.startswith(p)
    return test


def collapse_blanks(text: Column) -> Column:
    """Tabs as blanks, runs of blanks as one, blank runs of lines as one line feed."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), " +", " "), "( ?\n)+", "\n")


def subject_lines(header: Column) -> Column:
    """All header lines that begin with ``Subject: ``, joined."""
    return F.array_join(F.filter(F.split(F.coalesce(header, F.lit("")), "\r?\n"), lambda x: x.startswith("Subject: ")), "\n")


def split_mail(raw: Column) -> tuple[Column, Column]:
    """Header and body of a raw mail, parted at its first blank line; without one all is header."""
    unix = F.replace(F.coalesce(raw, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    at = F.locate("\n\n", unix)
    return F.when(at > 0, F.substr(unix, F.lit(1), at - 1)).otherwise(unix), F.when(at > 0, F.substr(unix, at + 2)).otherwise(F.lit(""))


def label_of(label: Column, split: Column | None = None) -> Column:
    """1 for spam, 0 for anything else, null where the split is for testing or the label is missing."""
    value = F.when(label.isNotNull(), F.when(F.lower(F.trim(label)) == "spam", 1).otherwise(0))
    return value if split is None else F.when(F.lower(F.trim(split)) == "train", value)


def mail_tokens(mails: DataFrame, ident: str, body: str) -> DataFrame:
    """``mail_id, pos, term`` of every token; rows of one mail count once."""
    one = mails.select(F.col(ident).alias("mail_id"), F.col(body).alias("body")).dropDuplicates(["mail_id"])
    return one.select("mail_id", F.posexplode(raw_tokens(F.col("body"))).alias("pos", "term"))


def bigram_matches(tokens: DataFrame, first: str, second: str, ident: str = "mail_id") -> DataFrame:
    """``ident, n``: how often ``second`` directly follows ``first``."""
    w = Window.partitionBy(ident).orderBy("pos")
    either = tokens.where(F.col("term").isin(first, second)).withColumn("next", F.lead("term").over(w)).withColumn("at", F.lead("pos").over(w))
    return either.where((F.col("term") == first) & (F.col("next") == second) & (F.col("at") == F.col("pos") + 1)).groupBy(ident).agg(F.count("*").alias("n"))


def ngram_counts(found: Column, grams: tuple[str, ...] = SPAM_NGRAMS) -> list[Column]:
    """For each n-gram, how often it occurs among a text's tokens, as columns named without blanks."""
    out = []
    for g in grams:
        runs = ngrams(found, len(g.split(" "))) if " " in g else found
        out.append(F.size(F.filter(runs, _is(g))).cast("bigint").alias(g.replace(" ", "")))
    return out


def _is(word: str):
    return lambda t: t == F.lit(word)


def ngram_matrix(mails: DataFrame, ident: str, body: str, label: str, split: str, grams: tuple[str, ...] = SPAM_NGRAMS) -> DataFrame:
    """A row per mail: each n-gram's count, and the label (null outside the training split). One scan; no join per n-gram."""
    one = mails.select(F.col(ident).alias("mail_id"), F.col(body).alias("body"), F.col(label).alias("l"), F.col(split).alias("s")).dropDuplicates(["mail_id"])
    split_up = one.select("mail_id", "l", "s", raw_tokens(F.col("body")).alias("t"))
    return split_up.select("mail_id", *ngram_counts(F.col("t"), grams), label_of(F.col("l"), F.col("s")).alias("label"))


def sparse_matrix(tokens: DataFrame, ident: str = "mail_id") -> DataFrame:
    """``ident, features``: term id to frequency, ids from 1 in term order, entries by id."""
    counts = tokens.groupBy(ident, "term").agg(F.count("*").cast("int").alias("tf"))
    rows = counts.join(term_ids(tokens), "term")
    return rows.groupBy(ident).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term_id", "tf")))).alias("features"))


def term_ids(tokens: DataFrame) -> DataFrame:
    """``term, term_id``: distinct terms numbered from 1 in order, by range partitions, so no task holds the whole vocabulary."""
    return placed(tokens.select("term").distinct(), ["term"], "term_id").select("term", F.col("term_id").cast("int").alias("term_id"))


def libsvm_lines(matrix: DataFrame, label: str, features: str, beside: tuple[str, ...] = ()) -> DataFrame:
    """``line``: label and ``id:value`` pairs by ascending id; the columns ``beside`` stay with it."""
    entries = F.array_sort(F.map_entries(features))
    return matrix.select(*beside, F.concat_ws(" ", F.coalesce(F.col(label), F.lit(0)).cast("string"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), " ")).alias("line"))
