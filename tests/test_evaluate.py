import math

from larkspur.operators import evaluate as ev


def run_of(spark, rels, n_rel=None, q="1"):
    run = spark.createDataFrame([(q, f"d{i:03}", float(100 - i)) for i in range(len(rels))], "query_no string, docno string, score double")
    extra = [(q, "1", f"x{i}", 1) for i in range((n_rel or sum(rels)) - sum(rels))]
    qrels = spark.createDataFrame([(q, "1", f"d{i:03}", r) for i, r in enumerate(rels)] + extra, "query_no string, assessor string, docno string, rel int")
    return ev.judged_run(run, qrels)


def test_average_precision_and_r_precision(spark):
    run = run_of(spark, [1, 0, 1])
    assert math.isclose(ev.average_precision(run).first()["avg_prec"], (1 + 2 / 3) / 2)
    assert ev.r_precision(run).first()["r_prec"] == 0.5
    assert ev.r_precision(run_of(spark, [1], n_rel=4)).first()["r_prec"] == 0.25


def test_ndcg_uses_decimal_logarithms(spark):
    assert math.isclose(ev.ndcg(run_of(spark, [0, 1])).first()["ndcg"], 1 / math.log10(2))
    assert ev.ndcg(run_of(spark, [0, 0], n_rel=1)).first()["ndcg"] == 0


def test_precision_at_cutoffs_pads_short_runs(spark):
    at = {r["cutoff"]: r for r in ev.precision_recall_at(run_of(spark, [1, 0, 1])).collect()}
    assert at[5]["precision"] == 0.4 and at[1000]["precision"] == 0.002 and at[5]["recall"] == 1.0
    none = ev.precision_recall_at(run_of(spark, [0], n_rel=1)).first()
    assert none["f1"] == 0


def test_interpolation_and_curve(spark):
    run = run_of(spark, [0, 1, 1], n_rel=4)
    level = {r["recall"]: r["precision"] for r in ev.interpolated_precision(run).collect()}
    assert math.isclose(level[0.0], 2 / 3) and math.isclose(level[0.5], 2 / 3) and level[0.6] == 0
    curve = sorted((r["i"], r["prec"], r["interp_prec"]) for r in ev.pr_curve(run).collect())
    assert curve == [(1, 0.5, 2 / 3), (2, 2 / 3, 2 / 3)]


def test_judgments_repeat_and_contradict(spark, rows):
    q = spark.createDataFrame([("1", "a", "d", 0), ("1", "b", "d", 2), ("1", "b", "d", 2), ("1", "c", "e", None)], "query_no string, assessor string, docno string, rel int")
    assert rows(ev.judged(q)) == [("1", "d", 2), ("1", "e", 0)]
    assert ev.relevant_counts(q).first()["n_rel"] == 1 and ev.relevant_counts(q, compat=True).first()["n_rel"] == 2


def test_topics_without_relevant_documents_are_left_out(spark):
    assert run_of(spark, [0, 0]).count() == 0


def test_ties_go_by_document(spark, rows):
    run = spark.createDataFrame([("1", "b", 1.0), ("1", "a", 1.0), ("1", "c", None)], "query_no string, docno string, score double")
    qrels = spark.createDataFrame([("1", "x", "a", 1)], "query_no string, assessor string, docno string, rel int")
    assert [(r["docno"], r["rank"]) for r in ev.judged_run(run, qrels).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_summary(spark):
    s = ev.summary(run_of(spark, [1, 0, 1])).first()
    assert (s["topics"], s["retrieved"], s["relevant"], s["relevant_retrieved"]) == (1, 3, 2, 2)


def test_report_of_topics_and_total(spark):
    run = run_of(spark, [1, 0, 1], q="1").unionByName(run_of(spark, [0, 1], n_rel=2, q="2"))
    lines = {}
    for r in ev.report(run).orderBy("query_no", "line_no").collect():
        lines.setdefault(r["query_no"], []).append(r["line"])
    assert set(lines) == {"1", "2", "all"} and len({len(x) for x in lines.values()}) == 1
    assert lines["1"][:5] == ["retrieved 3", "relevant 2", "relevant_retrieved 2", "avg_prec 0.8333", "r_prec 0.5000"]
    assert lines["all"][:4] == ["retrieved 5", "relevant 4", "relevant_retrieved 3", "avg_prec 0.5417"] and "at_050 1.0000" in lines["1"] and "p_5 0.4000" in lines["1"]


def test_halves_are_rounded_to_even_digits(spark):
    df = spark.createDataFrame([(0.03125,), (0.09375,), (1234.5,), (0.0,)], "x double")
    assert [r[0] for r in df.select(ev.four_decimals(df.x)).collect()] == ["0.0312", "0.0938", "1234.5000", "0.0000"]


def test_judged_documents_in_total(spark):
    q = spark.createDataFrame([("1", "a", "d1", 0), ("1", "b", "d1", 2), ("1", "a", "d2", None), ("2", "a", "d1", 0)], "query_no string, assessor string, docno string, rel int")
    assert tuple(ev.judged_total(q).first()) == (2, 4, 3, 1) and tuple(ev.judged_total(q.limit(0)).first()) == (0, None, 0, 0)
