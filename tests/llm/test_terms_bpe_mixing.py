import math
import os
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import bpe, mixing, terms
from larkspur.llm.blocks import words_of

TEXTS = [(1, "The cat, the CAT sat."), (2, "cat"), (3, None), (4, ""), (5, " \n.. "), (6, "Ça élève 12 x" + "² 生日 a_b")]


def df(spark, data=TEXTS):
    return spark.createDataFrame([(i, t, i, "x") for i, t in data], "id bigint, text string, df bigint, term string")


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cn", "Cs", "Co"], max_codepoint=0x2FFFF), max_size=40)), max_size=5))
def test_words_of_blocks(texts):
    got = words_of(texts)
    vocabulary = got.vocabulary.to_pylist()
    assert [(r, vocabulary[c]) for r, c in zip(got.record, got.code, strict=True)] == [(i, w) for i, t in enumerate(texts) for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())]
    assert vocabulary == sorted(vocabulary, key=lambda w: w.encode())


@pytest.mark.parametrize("max_n", [1, 3])
def test_term_counts_against_brute_force(spark, max_n, monkeypatch):
    monkeypatch.setattr(terms, "HELD_ROWS", 3)
    cf, rec = Counter(), defaultdict(set)
    for i, t in TEXTS:
        w = words(t)
        for n in range(1, max_n + 1):
            for k in range(len(w) - n + 1):
                g = (" ".join(w[k : k + n]), n)
                cf[g] += 1
                rec[g].add(i)
    got = {(r["term"], r["n"]): (r["cf"], r["df"]) for r in terms.term_counts(df(spark), "id", "text", max_n).collect()}
    assert got == {g: (cf[g], len(rec[g])) for g in cf}
    assert terms.term_counts(df(spark).limit(0), "id", "text").count() == 0


def test_prefix_stack_of_many_batches():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    for max_n in (1, 2, 4):
        parts = [terms.block_suffixes(words_of(texts[i : i + 7]), max_n) for i in range(0, 40, 7)]
        rows = pa.Table.from_batches(terms._packed(terms._summed(parts).sort_by([("suffix", "descending")]))).combine_chunks()
        cf, rec = Counter(), defaultdict(set)
        for i, t in enumerate(texts):
            w = t.split()
            for n in range(1, max_n + 1):
                for k in range(len(w) - n + 1):
                    cf[" ".join(w[k : k + n])] += 1
                    rec[" ".join(w[k : k + n])].add(i)
        for step in (1, 3, 1000):
            stack, got = terms.PrefixStack(max_n), []
            for at in range(0, len(rows), step):
                got += stack.push(rows.slice(at, step).to_batches()[0]).to_pylist()
            got += stack.end().to_pylist()
            assert len(got) == len(cf) and {r["term"]: (r["cf"], r["df"]) for r in got} == {g: (cf[g], len(rec[g])) for g in cf}


def test_usefulness_marks(spark):
    d = spark.createDataFrame([(2,), (3,), (20,), (21,)], "d bigint")
    from pyspark.sql import functions as F

    assert [r[0] for r in d.select(terms.usefulness(F.col("d"), 100, 3, 0.2)).collect()] == ["rare", None, None, "common"]


def graph(text, window):
    w = words(text)
    near = defaultdict(set)
    for i, a in enumerate(w):
        for b in w[max(0, i - window + 1) : i + window]:
            if a != b:
                near[a].add(b)
    return {t: (n, len(near[t])) for t, n in Counter(w).items()}


@pytest.mark.parametrize("window", [2, 4])
def test_distinctive_terms_against_brute_force(spark, window):
    data = TEXTS + [(7, "a b a c a d b b b a")]
    held = Counter(t for _, x in data for t in set(words(x)))
    n = sum(bool(words(x)) for _, x in data)
    got = {(r["id"], r["term"]): r for r in terms.distinctive_terms(df(spark, data), "id", "text", window).collect()}
    assert len(got) == sum(len(set(words(x))) for _, x in data)
    for i, x in data:
        for t, (tf, degree) in graph(x, window).items():
            r = got[i, t]
            assert (r["tf"], r["degree"], r["df"]) == (tf, degree, held[t]) and math.isclose(r["score"], degree * math.log((1 + n) / held[t]), abs_tol=1e-6)
    rare = terms.distinctive_terms(df(spark, data), "id", "text", window, min_tf=2, max_df=1)
    assert sorted(map(tuple, rare.collect())) == sorted(tuple(r) for r in got.values() if r["tf"] >= 2 and r["df"] <= 1)
    assert {r["term"] for r in terms.distinctive_terms(df(spark, data), "id", "text", window, min_score=4.0).collect()} == {t for (_, t), r in got.items() if r["score"] >= 4.0}


needs_files = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files here")


@needs_files
def test_token_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    data = TEXTS + [(7, "<|endoftext|> isn't   it\r\n\t42½"), (8, "a" * 5000 + " " * 300), (9, "\u0085​\x1c tail  ")]
    got = {r["id"]: r["ids"] for r in bpe.token_ids(df(spark, data), "id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in data}
    assert {r["id"]: r["n_tokens"] for r in bpe.token_counts(df(spark, data), "id", "text").collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.token_ids(df(spark).limit(0), "id", "text").count() == 0


@needs_files
@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_pair_index_round_trip(text):
    encoder = test_pair_index_round_trip.__dict__.setdefault("encoder", bpe.PairIndexEncoder(bpe.load_ranks("byte_bpe_50k")))
    ids, count = encoder.encode([text, None])
    assert b"".join(encoder.token[i] for i in ids).decode() == text and list(count) == [len(ids), 0]


def test_poisson_steps():
    steps = mixing.poisson_steps(2.0, 3)
    assert math.isclose(steps[0], math.exp(-2)) and math.isclose(steps[2], math.exp(-2) * (1 + 2 + 2))


@needs_files
def test_mix_reaches_shares_within_caps(spark):
    data = [(i, "one two three four " * (1 + i % 5), "Big " if i % 10 else "small", 0) for i in range(3000)] + [(9001, None, "big", 0), (9002, "", "big", 0), (9003, "x", None, 0), (9004, "x", "other", 0)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("missing", 0.2, 3)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.mix_report(docs, "doc_id", "text", "source", targets).collect()}
    assert abs(got["big"]["actual_share"] - 0.625) < 0.02 and abs(got["small"]["actual_share"] - 0.375) < 0.02
    assert 2.9 < got["small"]["copies"] / got["small"]["documents"] < 3.5  # the source that bounds the size is not merely repeated four times
    assert got["big"]["most_repeats"] == 1 and got["small"]["most_repeats"] <= 4 and got["missing"]["used_tokens"] == 0 and got["other"]["copies"] == 0
    mixed = mixing.mix(docs, "doc_id", "text", "source", targets).collect()
    uses = Counter(r["doc_id"] for r in mixed)
    assert sum(r["copies"] for r in got.values()) == len(mixed) and not {9001, 9002, 9003, 9004} & set(uses)
    assert len({(r["doc_id"], r["copy_no"]) for r in mixed}) == len(mixed)
    assert mixing.mix(docs.limit(0), "doc_id", "text", "source", targets).count() == 0
