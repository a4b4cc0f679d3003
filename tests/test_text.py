import pandas as pd
from pyspark.sql import functions as F

from larkspur.functions.stem import Porter, Porter2, stem_dictionary
from larkspur.functions.text import legacy_query_tokens, ngrams, query_tokens, raw_tokens, tokens

TEXT = "The U.S. car's 1.24 a.b."


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_index_models(spark):
    assert one(spark, lambda c: tokens(c, "original"), TEXT) == ["the", "u.s", "car", "1.24", "a.b"]
    assert one(spark, lambda c: tokens(c, "no_stopwords"), TEXT) == ["u.s", "car", "s", "1.24", "a.b"]
    assert one(spark, lambda c: tokens(c, "stemmed"), TEXT) == ["the", "u.s", "car", "s", "1.24", "a.b"]


def test_null_and_empty_texts_have_no_tokens(spark):
    assert one(spark, raw_tokens, None) == [] and one(spark, raw_tokens, "") == [] and one(spark, raw_tokens, " .. ") == []
    assert one(spark, query_tokens, None) == []


def test_query_tokens_drop_the_first_words(spark):
    assert one(spark, query_tokens, "Document will discuss the steady pipeline, pipeline and result") == ["steady", "pipeline", "pipeline"]
    assert one(spark, query_tokens, "Document will discuss") == [] and one(spark, query_tokens, "One") == []
    assert one(spark, legacy_query_tokens, "It's 3 o'clock") == ["its", "oclock"] and one(spark, legacy_query_tokens, "12") == []


def test_ngrams(spark):
    assert one(spark, lambda c: ngrams(raw_tokens(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: ngrams(raw_tokens(c), 3), "a b") == [] and one(spark, lambda c: ngrams(raw_tokens(c), 1), "a b") == ["a", "b"]


def test_stemmers_follow_their_published_rules():
    porter = {"caresses": "caress", "ponies": "poni", "ties": "ti", "agreed": "agre", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "adjustment": "adjust", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    porter2 = {"ties": "tie", "cries": "cri", "consistently": "consist", "knackeries": "knackeri", "generously": "generous", "communism": "communism", "skies": "sky", "dying": "die", "gas": "gas", "happy": "happi", "by": "by", "succeed": "succeed"}
    assert {w: Porter()(w) for w in porter} == porter
    assert {w: Porter2()(w) for w in porter2} == porter2
    assert Porter()("été") == "été" and Porter2()("u.s") == "u.s"


def test_stem_dictionary_sees_each_term_once(spark):
    df = spark.createDataFrame(pd.DataFrame({"term": ["cats", "cats", None, "dog"]}))
    assert {(r["term"], r["stem"]) for r in stem_dictionary(df).collect()} == {("cats", "cat"), ("dog", "dog")}
