import os

import pytest
from pyspark.sql import functions as F

from larkspur.operators import learn, mail
from larkspur.sources import files
from larkspur.sources.config import Config
from larkspur.streaming import incremental


def test_clean_body(spark):
    body = "<b>Hi</b> there\nContent-Type: x\n" + "x" * 41 + "\n\n----\n> quoted\n" + "y" * 40
    got = spark.createDataFrame([(body,), (None,)], "b string").select(mail.clean_body(F.col("b")).alias("x")).collect()
    assert got[0]["x"] == "Hi there\n> quoted\n" + "y" * 40 and got[1]["x"] == ""
    assert spark.range(1).select(mail.collapse_blanks(F.lit("a\t b \n\n \nc")).alias("x")).first()["x"] == "a b\nc"


def test_split_mail_and_subject(spark):
    raw = "From: a\r\nSubject: x\r\nSubject: y\r\n\r\nbody\r\n\r\nmore"
    h, b = mail.split_mail(F.lit(raw))
    r = spark.range(1).select(h.alias("h"), b.alias("b"), mail.subject_lines(h).alias("s")).first()
    assert r["b"] == "body\n\nmore" and r["s"] == "Subject: x\nSubject: y"


def test_bigrams_are_adjacent_and_ordered(spark, rows):
    m = spark.createDataFrame([(1, "click here click x here"), (2, "here click"), (3, None)], "id int, body string")
    t = mail.mail_tokens(m, "id", "body")
    assert rows(mail.bigram_matches(t, "click", "here")) == [(1, 1)]


def test_ngram_matrix(spark, rows):
    m = spark.createDataFrame([(1, "Win free FREE click here", "spam", "train"), (1, "Win free FREE click here", "spam", "train"), (2, None, "ham", "test"), (3, "x", None, "train")], "id int, body string, label string, split string")
    got = mail.ngram_matrix(m, "id", "body", "label", "split")
    assert rows(got, "mail_id", "free", "win", "clickhere", "label") == [(1, 2, 1, 1, 1), (2, 0, 0, 0, None), (3, 0, 0, 0, None)]


def test_sparse_matrix_and_libsvm(spark, tmp_path, rows):
    t = mail.mail_tokens(spark.createDataFrame([(1, "b a b"), (2, "c")], "id int, body string"), "id", "body")
    m = mail.sparse_matrix(t).withColumn("label", F.lit(1))
    assert {r["mail_id"]: r["features"] for r in m.collect()} == {1: {1: 1, 2: 2}, 2: {3: 1}}
    files.write_libsvm(m, str(tmp_path / "m"))
    assert rows(files.read_libsvm(spark, str(tmp_path / "m")).select("label", F.map_keys("features").alias("k"))) == [(1.0, [1, 2]), (1.0, [3])]


def test_collection_topics_runs_and_judgments(spark, tmp_path, rows):
    (tmp_path / "ap1").write_text("<DOC>\n<DOCNO> X-1 </DOCNO>\n<TEXT>\none\n</TEXT>\n<TEXT>two</TEXT>\n</DOC>\n<DOC>\n<DOCNO> X-2 </DOCNO>\n</DOC>\n")
    (tmp_path / "readme").write_text("not a document")
    assert rows(files.read_collection(spark, str(tmp_path), "ap*")) == [("X-1", "one\ntwo"), ("X-2", "")]
    (tmp_path / "topics").write_text("51.   Document will discuss x. y\n\n52.   z\n")
    assert rows(files.read_topics(spark, str(tmp_path / "topics"))) == [("51", "Document will discuss x. y"), ("52", "z")]
    (tmp_path / "run").write_bytes(b"51 Q0 X-1 1 -0.5 Exp\r\n")
    assert rows(files.read_run(spark, str(tmp_path / "run"))) == [("51", "Q0", "X-1", 1, -0.5, "Exp")]
    run = files.read_run(spark, str(tmp_path / "run"))
    files.write_run(run, str(tmp_path / "out"))
    assert rows(files.read_run(spark, str(tmp_path / "out"))) == rows(run)
    (tmp_path / "qrels").write_text("51 0 X-1 2\n")
    assert rows(files.read_qrels(spark, str(tmp_path / "qrels"))) == [("51", "0", "X-1", 2)]
    (tmp_path / "stop").write_text("The\nthe\n\nof\n")
    assert rows(files.read_words(spark, str(tmp_path / "stop"))) == [("of",), ("the",)]


def test_graph_mail_and_model_files(spark, tmp_path, rows):
    (tmp_path / "g").write_text("a\nb a a\n")
    assert rows(files.read_adjacency(spark, str(tmp_path / "g"))) == [("b", "a"), ("b", "a")]
    assert rows(files.read_adjacency(spark, str(tmp_path / "g"), reverse=True)) == [("a", "b"), ("a", "b")]
    files.write_adjacency(files.read_adjacency(spark, str(tmp_path / "g")), str(tmp_path / "go"))
    assert rows(files.read_adjacency(spark, str(tmp_path / "go"))) == [("b", "a")]
    os.mkdir(tmp_path / "mails")
    (tmp_path / "mails" / "inmail.7").write_bytes("Subject: é\n\nbody é".encode("latin-1"))
    assert rows(files.read_mails(spark, str(tmp_path / "mails")), "mail_id", "body", "subject") == [(7, "body é", "Subject: é")]
    (tmp_path / "labels").write_text("SPAM ../data/inmail.7\nham ../data/inmail.8\nham ../data/inmail.8\n")
    assert rows(files.read_mail_labels(spark, str(tmp_path / "labels")), "mail_id", "label") == [(7, "spam"), (8, "ham")]
    (tmp_path / "model").write_text("\n".join(["h"] * 6 + ["0.5", "-1"]) + "\n")
    assert rows(files.read_linear_model(spark, str(tmp_path / "model"))) == [(1, 0.5), (2, -1.0)]
    (tmp_path / "large").write_text("".join(f"h{i}\n" for i in range(6)) + "".join(f"{i}.5\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")  # several splits
    try:
        got = {r["term_id"]: r["weight"] for r in files.read_linear_model(spark, str(tmp_path / "large")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: i + 0.5 for i in range(1, 5001)}
    m = spark.createDataFrame([(0.5, 1.0), (1.5, None)], "f double, class double")
    files.write_arff(m, str(tmp_path / "arff"), "r", {"f": "real", "class": "real"})
    assert rows(files.read_arff(spark, str(tmp_path / "arff"))) == [(0.5, 1.0), (1.5, None)]


def test_config(tmp_path):
    (tmp_path / "c").write_text("# x\na = 1\nb: yes\nl=x, y\n")
    c = Config.load(str(tmp_path / "c"))
    assert c.get_int("a") == 1 and c.get_bool("b") and c.get_list("l") == ["x", "y"] and c.get("no", "d") == "d"
    c.set("t", False)
    c.store(str(tmp_path / "d"))
    assert Config.load(str(tmp_path / "d")).values == c.copy().values


def test_confusion_and_splits(spark):
    p = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.0, 0), (0.0, 1), (None, 1)], "y double, p int")
    assert tuple(learn.confusion(p, "y", "p").first()) == (1, 1, 1, 1, 0.5)
    both = spark.createDataFrame([(1.0, 1, "train"), (1.0, 0, "train"), (0.0, 0, "test"), (None, 1, "test"), (1.0, 1, None)], "y double, p int, part string")
    assert {r["split"]: tuple(r)[1:] for r in learn.confusion_by(both, "y", "p", "part").collect()} == {"train": (1, 1, 0, 0, 0.5), "test": (0, 0, 1, 0, 1.0), "total": (1, 1, 1, 0, 2 / 3)}
    s = spark.range(1000).select(learn.hash_split(F.col("id")).alias("s")).groupBy("s").count().collect()
    assert 150 < {r["s"]: r["count"] for r in s}["test"] < 250


def test_linear_model_learns_and_ranks(spark):
    m = spark.createDataFrame([(str(q), f"d{i}", float(i), float(i * 2 + 1)) for q in range(8) for i in range(5)], "query string, docno string, f double, label double")
    run = learn.ltr_runs(m, "query", "docno", ("f",))
    assert {r["docno"] for r in run.where("rank = 1").collect()} == {"d4"} and {r["split"] for r in run.collect()} <= {"train", "test"}
    key = spark.range(1).select(learn.string_order(F.lit(0.222), F.lit("b")).alias("k")).first()["k"]
    assert key == "0.22200000000000000b"


def test_spam_tree_and_weights(spark):
    m = spark.createDataFrame([(i, i % 2, i % 2, ["win" if i % 2 else "hello", "x"]) for i in range(20)], "mail_id int, free int, label int, t array<string>")
    model = learn.spam_tree(m, ["free"])
    assert all(r["prediction"] == r["label"] for r in learn.tree_predictions(m, model, ["free"]).collect())
    assert learn.top_terms(learn.linear_weights(m, "t", "label"), 1).first()["term"] == "win"
    with pytest.raises(ValueError, match="terms"):
        learn.linear_weights(m, "t", "label", most_terms=2)


def test_incremental_index(spark, tmp_path, rows):
    os.mkdir(tmp_path / "in")
    for n, text in ((1, "car boat"), (2, "car")):
        (tmp_path / "in" / f"ap{n}").write_text(f"<DOC>\n<DOCNO> D{n} </DOCNO>\n<TEXT>{text}</TEXT>\n</DOC>\n")
    stream = incremental.collection_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    incremental.index_stream(stream, str(tmp_path / "parts"), str(tmp_path / "cp")).awaitTermination(120)
    incremental.compact(spark, str(tmp_path / "parts"), str(tmp_path / "whole"))
    assert rows(spark.read.parquet(str(tmp_path / "whole")), "term", "doc_id", "tf") == [("boat", "D1", 1), ("car", "D1", 1), ("car", "D2", 1)]


def test_merge_stream_inserts_once(spark, tmp_path, rows):
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "url string, v int").write.parquet(str(tmp_path / "fresh"))
    for n in range(2):
        fresh = spark.readStream.schema("url string, v int").parquet(str(tmp_path / "fresh"))
        incremental.merge_stream(fresh, str(tmp_path / "store"), "url", str(tmp_path / f"c{n}")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "store")), "url") == [("a",), ("b",)]
    spark.createDataFrame([("b", 3), ("c", 4), (None, 5)], "url string, v int").write.parquet(str(tmp_path / "more"))
    fresh = spark.readStream.schema("url string, v int").parquet(str(tmp_path / "more"))
    incremental.merge_stream(fresh, str(tmp_path / "store"), "url", str(tmp_path / "c2")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "store")), "url", "v") == [("a", 1), ("b", 2), ("c", 4)]


def test_inlink_counts_by_window(spark, tmp_path, rows):
    data = [("u", "1998-01-01 00:01:00"), ("u", "1998-01-01 00:02:00"), ("v", "1998-01-01 00:03:00"), ("u", "1998-01-01 05:00:00")]
    df = spark.createDataFrame(data, "url string, t string")
    df.select("url", F.col("t").cast("timestamp").alias("found_at")).coalesce(1).write.parquet(str(tmp_path / "links"))
    links = spark.readStream.schema("url string, found_at timestamp").parquet(str(tmp_path / "links"))
    q = incremental.inlink_counts(links).writeStream.outputMode("complete").format("memory").queryName("inlinks_by_window").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("inlinks_by_window"), "url", "n") == [("u", 1), ("u", 2), ("v", 1)]
