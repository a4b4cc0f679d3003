import math
import random

import numpy as np
import pytest

from larkspur.llm import fusion, topn


def scored(spark, data):
    return spark.createDataFrame(data, "g string, d string, s double, k0 int, tie string")


def test_top_n_with_nulls_ties_and_repeated_rows(spark, rows):
    data = [("a", "x", 1.0, 1, ""), ("a", "x", 1.0, 1, ""), ("a", "y", 1.0, 1, ""), ("a", "z", 2.0, 1, ""), ("a", "n", None, 1, ""), ("a", "q", math.nan, 1, ""), (None, "m", 5.0, 1, ""), (None, "l", 5.0, 1, "")]
    got = topn.top_n_per_group(scored(spark, data), ["g"], "s", "d", 2)
    assert rows(got, "g", "d") == [("a", "x"), ("a", "z"), (None, "l"), (None, "m")]
    assert topn.top_n_per_group(scored(spark, data).limit(0), ["g"], "s", "d", 2).count() == 0


def test_top_n_against_sorting_with_small_buffers(spark, monkeypatch, rows):
    monkeypatch.setattr(topn, "ABSORB_ROWS", 50)
    rng = random.Random(1)
    data = [(rng.choice("aaaab"), f"d{i:04}", float(rng.randint(0, 40)), 0, "") for i in range(3000)] + [(f"g{i}", "d", 1.0, 0, "") for i in range(300)]
    want = []
    for g in {x[0] for x in data}:
        want += [(g, d) for _, d in sorted((-s, d) for gg, d, s, *_ in data if gg == g)[:7]]
    got = topn.top_n_per_group(scored(spark, data).repartition(5), ["g"], "s", "d", 7)
    assert rows(got, "g", "d") == sorted(want, key=repr)


@pytest.mark.parametrize(("whole", "heavy"), [(1_000_000, 100), (3, 100), (3, 2)])
def test_ranks_are_mean_ranks_on_either_way(spark, whole, heavy, monkeypatch):
    monkeypatch.setattr(fusion, "HEAVY_VALUE_ROWS", heavy)
    rng = random.Random(2)
    data = [(g, f"{g}{i}", rng.choice([None, math.nan, 1.0, 2.0, 3.5]), float(i % 4)) for g in "ab" for i in range(11)] + [(None, "n", 1.0, 1.0)]
    df = spark.createDataFrame(data, "q string, d string, x double, y double")
    got = {(r["k"], r["d"]): r for r in fusion.rank_transform(df, "q", "d", ["x", "y"], whole).collect()}
    assert len(got) == len(data)
    for q, d, x, y in data:
        group = [r for r in data if r[0] == q]
        low = [-math.inf if v is None or math.isnan(v) else v for _, _, v, _ in group]
        mine = -math.inf if x is None or math.isnan(x) else x
        assert got[q, d]["r0"] == sum(v < mine for v in low) + (low.count(mine) + 1) / 2
        assert got[q, d]["r1"] == sum(r[3] < y for r in group) + (sum(r[3] == y for r in group) + 1) / 2
        assert got[q, d]["n"] == len(group)


def test_fusion_ignores_scale_and_follows_directions(spark):
    rng = np.random.default_rng(3)
    quality = rng.normal(size=200)
    data = [("q", f"d{i:03}", float(v * 1e6 + rng.normal() * 1e5), float(-np.exp(v + rng.normal() * 0.1)), float(i)) for i, v in enumerate(quality)]
    df = spark.createDataFrame(data, "q string, d string, up double, down double, q2 double")
    got = fusion.fused_ranking(df, "q", "d", ["up", "down"], [1, -1]).orderBy("projection", ascending=False).limit(10).collect()
    best = {f"d{i:03}" for i in np.argsort(-quality)[:20]}
    assert {r["d"] for r in got} <= best


def test_fusion_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([("q", "d", None)], "q string, d string, s double")
    assert fusion.fused_ranking(df, "q", "d", ["s"]).first()["projection"] == 0
    assert fusion.fused_ranking(df.limit(0), "q", "d", ["s"]).count() == 0
