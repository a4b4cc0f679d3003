"""Tokens of texts and queries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to index (the library's own list).
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few "
    "for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own "
    "same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why "
    "will with would you your"
).split()

# Words of topic descriptions that say nothing about what is sought.
TOPIC_WORDS = (
    "document report include describe identifi predict cite discuss directli take sign current actual public type event result make effort taken caus determin system "
    "or be against of ani a which ha at on in some about the will an by into it method certain to with other how do over someth been and sinc action u. d both even us job level side "
    "either sole instanc standard individu organ produc second"
).split()

#: A token: word characters, with single dots allowed between them (``u.s``, ``1.24``).
TOKEN = r"\w+(?:\.\w+)*"

#: How the four index models treat stop words and stems; ``original`` drops lone ``s``, what is left of an English genitive.
MODELS = {
    "original": {"stop": False, "stem": False}, "no_stopwords": {"stop": True, "stem": False},
    "stemmed": {"stop": False, "stem": True}, "no_stopwords_stemmed": {"stop": True, "stem": True},
}


def words(*values: str) -> Column:
    return F.array(*(F.lit(v) for v in values))


def raw_tokens(text: Column) -> Column:
    """Lower-cased tokens in order; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def tokens(text: Column, model: str = "no_stopwords") -> Column:
    """Tokens as the index model keeps them, before stemming; positions count what is kept."""
    if model not in MODELS:
        raise ValueError(f"no index model {model!r}")
    found = raw_tokens(text)
    if model == "original":
        return F.filter(found, lambda t: t != F.lit("s"))
    if MODELS[model]["stop"]:
        return F.filter(found, lambda t: ~t.isin(STOP_WORDS))
    return found


def query_tokens(text: Column, drop_first: int = 3, stop: bool = True, topic_words: bool = True) -> Column:
    """Tokens of a topic: without its first words (``Document will discuss``), stop words and topic words; repetitions stay."""
    found = raw_tokens(text)
    kept = F.when(F.size(found) > drop_first, F.slice(found, F.lit(drop_first + 1), F.greatest(F.size(found), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    drop = set(STOP_WORDS if stop else ()) | set(TOPIC_WORDS if topic_words else ())
    return F.filter(kept, lambda t: ~t.isin(sorted(drop))) if drop else kept


def legacy_query_tokens(text: Column) -> Column:
    """The older way: everything but letters and blanks is removed, then split at white space."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^a-zA-Z ]", ""))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(clean, r"\s+"), lambda t: F.lower(t)))


def ngrams(tokens_: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by blanks: the array zipped with itself shifted, so each token is read ``n`` times at most."""
    rows = F.arrays_zip(*(F.slice(tokens_, F.lit(k + 1), F.greatest(F.size(tokens_) - k, F.lit(0))).alias(f"t{k}") for k in range(n)))
    whole = F.slice(rows, F.lit(1), F.greatest(F.size(tokens_) - (n - 1), F.lit(0)))
    return F.transform(whole, lambda r: F.concat_ws(" ", *(r[f"t{k}"] for k in range(n))))
