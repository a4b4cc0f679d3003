import math
import random
from itertools import product

from pyspark.sql import functions as F

from larkspur.operators import index, ranking

DOCS = [(1, "A", "car car u.s patrol"), (2, "B", "patrol boat"), (3, "C", None), (4, "D", ""), (5, "E", "the of and")]


def docs(spark, data=DOCS):
    return spark.createDataFrame(data, "doc_id bigint, docno string, text string")


def test_positions_and_postings(spark, rows):
    p = index.postings(index.positions(docs(spark), "doc_id", "text"))
    assert rows(p, "term", "doc_id", "tf", "positions") == [("boat", 2, 1, [1]), ("car", 1, 2, [0, 1]), ("patrol", 1, 1, [3]), ("patrol", 2, 1, [0]), ("u.s", 1, 1, [2])]


def test_lengths_keep_empty_documents(spark, rows):
    assert rows(index.document_lengths(docs(spark), "doc_id", "text")) == [(1, 4), (2, 2), (3, 0), (4, 0), (5, 0)]
    assert rows(index.document_lengths(docs(spark), "doc_id", "text", length_mode="distinct"))[0] == (1, 3)


def test_corpus_stats_rounding(spark):
    lengths = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "doc_id bigint, len bigint")
    terms = spark.createDataFrame([("a",), ("a",), ("b",)], "term string")
    assert tuple(index.corpus_stats(lengths, terms, 2).first()) == (3, 2, 1.33)
    empty = index.corpus_stats(lengths.limit(0), terms.limit(0)).first()
    assert tuple(empty) == (0, 0, None)


def test_blocks_round_trip(spark, rows):
    p = index.postings(index.positions(docs(spark), "doc_id", "text"))
    lines = index.merge_partial_indexes([p.where("doc_id = 1"), p.where("doc_id <> 1")]).select("term", index.as_block(F.col("postings")).alias("b"))
    assert {r["term"]: r["b"] for r in lines.collect()}["patrol"] == "1 3,2 0,"
    back = lines.select("term", F.explode(index.from_block(F.col("b"))).alias("p")).select("term", "p.*")
    assert rows(back, "term", "doc_id", "tf", "positions") == rows(p, "term", "doc_id", "tf", "positions")


def test_model_formulas(spark):
    r = spark.range(1).select(
        ranking.okapi(F.lit(2), F.lit(10), 10.0).alias("okapi"), ranking.tfidf(F.lit(2), F.lit(10), 10.0, 100, F.lit(30)).alias("tfidf"),
        F.log10(1 / (F.lit(100) + 900)).alias("absent"), ranking.jm_present(F.lit(2), F.lit(10), F.lit(2), F.lit(10)).alias("jm"), ranking.jm_absent(F.lit(10), F.lit(2), F.lit(10)).alias("jm0"),
        ranking.bm25(F.lit(1), F.lit(10), 10.0, 9, F.lit(4), F.lit(1)).alias("bm25"),
    ).first()
    assert r["okapi"] == 0.5 and math.isclose(r["tfidf"], 0.5 * math.log10(3)) and math.isclose(r["absent"], -3)
    assert math.isclose(r["jm"], math.log10(0.99 * 0.2)) and r["jm0"] == 0  # the only document with the term has no background
    assert math.isclose(r["bm25"], math.log10(9.5 / 4.5) * 2.2 / 2.2 * 2.5 / 2.5)


def brute_window(lists):
    return min(max(c) - min(c) for c in product(*lists))


def test_min_window_against_brute_force(spark):
    rng = random.Random(3)
    data, want = [], {}
    for d in range(60):
        words = [rng.choice("xyzwv") * 2 for _ in range(rng.randint(1, 14))]
        data.append((d, str(d), " ".join(words)))
        lists = [[i for i, w in enumerate(words) if w == t] for t in ("xx", "yy", "zz")]
        held = [x for x in lists if x]
        if len(held) >= 2:
            want[d] = brute_window(held)
    idx = index.build_index(docs(spark, data), "doc_id", "docno", "text")
    terms = spark.createDataFrame([("q", t, 1) for t in ("xx", "yy", "zz", "nope")], "query_no string, term string, qtf bigint")
    got = {r["doc_id"]: r["min_window"] for r in ranking.min_windows(idx, terms).collect()}
    assert got == want


def test_language_models_against_the_full_grid(spark):
    data = [(1, "A", "car car boat"), (2, "B", "boat sail"), (3, "C", "tree"), (4, "D", "car")]
    idx = index.build_index(docs(spark, data), "doc_id", "docno", "text")
    terms = spark.createDataFrame([("q", "car", 1), ("q", "boat", 2), ("q", "unknown", 1)], "query_no string, term string, qtf bigint")
    got = {r["doc_id"]: r for r in ranking.all_scores(idx, terms).collect()}
    assert set(got) == {1, 2, 4}
    v, lens = 4, {1: 3, 2: 2, 4: 1}
    tf = {1: {"car": 2, "boat": 1}, 2: {"boat": 1, "sail": 1}, 4: {"car": 1}}
    total = {t: (sum(x.get(t, 0) for x in tf.values()), sum(n for d, n in lens.items() if t in tf[d])) for t in ("car", "boat")}
    for d, n in lens.items():
        lap = sum(math.log10((tf[d].get(t, 0) + 1) / (n + v)) for t in ("car", "boat"))
        jm = 0.0
        for t in ("car", "boat"):
            ttf, tlen = total[t]
            if t in tf[d]:
                back = (ttf - tf[d][t]) / (tlen - n) if tlen > n else 0
                jm += math.log10(0.99 * tf[d][t] / n + 0.01 * back)
            elif tlen > n:
                jm += math.log10(0.01 * ttf / (tlen - n))
        assert math.isclose(got[d]["laplace"], lap) and math.isclose(got[d]["jm"], jm)


def test_borda_points(spark):
    runs = [spark.createDataFrame([("q", "x", 1), ("q", "y", 1200)], "query_no string, docno string, rank int"), spark.createDataFrame([("q", "x", 3)], "query_no string, docno string, rank int")]
    assert {r["docno"]: r["points"] for r in ranking.fuse_runs(runs).collect()} == {"x": 1998, "y": 0}


def test_run_lines(spark):
    run = spark.createDataFrame([("51", "D1", 1, 2.5)], "query_no string, docno string, rank int, score double")
    assert ranking.run_lines(run).first()["line"] == "51 Q0 D1 1 2.500000 Exp"


def test_search_and_judgment_lines(spark):
    idx = index.build_index(docs(spark), "doc_id", "docno", "text")
    assert [r["docno"] for r in ranking.search(idx, "boat patrol").orderBy("rank").collect()] == ["B", "A"]
    scored = spark.createDataFrame([("d1", 2.0), ("d2", 1.0), ("d0", 2.0)], "docno string, score double")
    assert [r["line"] for r in ranking.qrel_lines(scored, "7", "me", 2).collect()] == ["7 me d0 2", "7 me d1 2"]


def test_compatible_language_model_is_not_a_number_where_undefined(spark):
    r = spark.range(1).select(ranking.jm_present(F.lit(2), F.lit(10), F.lit(2), F.lit(10), True).alias("a"), ranking.jm_absent(F.lit(10), F.lit(2), F.lit(10), True).alias("b")).first()
    assert math.isnan(r["a"]) and math.isnan(r["b"])


def test_borda_keeps_all_candidates(spark):
    data = [(i, f"D{i}", "car " * (i + 1)) for i in range(6)]
    idx = index.build_index(docs(spark, data), "doc_id", "docno", "text")
    terms = spark.createDataFrame([("q", "car", 1)], "query_no string, term string, qtf bigint")
    scores = ranking.scored(idx, terms, ("okapi", "bm25"))
    for whole in (100, 2):  # ranked whole, and as a topic too large for a task
        got = {r["doc_id"]: r["points"] for r in ranking.borda(scores, ("okapi", "bm25"), 3, whole).collect()}
        assert sorted(got) == list(range(6)) and sorted(got.values()) == [1, 1, 2, 2, 3, 3]


def test_terms_in_batches_match_alike(spark):
    idx = index.build_index(docs(spark, [(i, f"D{i}", "car boat " * (i % 3) + "ship") for i in range(9)]), "doc_id", "docno", "text")
    terms = spark.createDataFrame([(f"q{i}", t, 1) for i in range(5) for t in ("car", "ship", "none")], "query_no string, term string, qtf bigint")
    whole, parts = (sorted(map(str, ranking.matches(idx, terms, False, n).collect())) for n in (1000, 3))
    assert whole == parts and len(whole) == 5 * (6 + 9)


def test_catalog_finds_every_block(spark, tmp_path):
    lines = spark.createDataFrame([("b", 0, "1 2 3,"), ("a", 0, "é 1,"), ("b", 1, "x" * 50)], "term string, block int, line string")
    got = index.catalog(lines, ["term", "block"], "line").collect()
    (tmp_path / "index").write_bytes("".join(r["line"] + "\n" for r in sorted(lines.collect())).encode())
    for r in got:
        want = lines.where((F.col("term") == r["term"]) & (F.col("block") == r["block"])).first()["line"]
        assert index.block_at(str(tmp_path / "index"), r["start"], r["size"]) == want
    assert len(got) == 3


def test_a_rewritten_collection_is_indexed_anew(spark, tmp_path):
    path = str(tmp_path / "documents")
    sizes = []
    for n in (2, 3):
        docs(spark, [(i, f"D{i}", "car") for i in range(n)]).write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
        sizes.append(index.index_of(table, path).d)
        assert index.index_of(table, path) is index.index_of(spark.read.parquet(path), path)
    assert sizes == [2, 3]
