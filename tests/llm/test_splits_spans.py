import random

import numpy as np
import pytest

from larkspur.llm import spans, splits

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_within_edits_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(2))
        d = edit(a, b)
        assert all(splits.within_edits(a, b, k) == (d <= k) for k in range(12))


def mails(rng, n=140):
    bodies = [[rng.choice(WORDS) for _ in range(rng.randint(15, 45))] for _ in range(n)]
    for i in range(0, n, 4):  # slightly changed copies of others
        base = list(bodies[rng.randrange(n)])
        for _ in range(rng.randint(0, len(base) // 4)):
            k = rng.randrange(len(base))
            base[k : k + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 2)
        bodies[i] = base
    data = []
    for i, b in enumerate(bodies):
        text = " ".join(b)
        data.append((i, text.title() + "!" if i % 3 == 0 else text, rng.choice(["train", " Train", "DEV", "test", None]), rng.choice(["inbox", None]), i))
    data += [(1000, None, "train", "x", 0), (1001, "", "dev", "x", 0), (1002, "ok", "train", "x", 0), (1003, "OK.", "dev", "x", 0), (data[0][0], *data[0][1:])]
    return data


@pytest.mark.parametrize("spelt_out", [10**6, 3])
def test_overlaps_against_brute_force(spark, spelt_out):
    data = mails(random.Random(7)) + [(2000 + i, " ".join(WORDS) + " end" * (i % 2), "train" if i < 6 else "test", "hot", 0) for i in range(10)]
    df = spark.createDataFrame(data, "mail_id int, body string, split string, source string, n int")
    found = splits.find_overlaps(df, "mail_id", "body", "split", "source", "train", ["dev", "test"])
    rows = {i: ((b or "").lower().replace("!", "").split(), (s or "").strip().lower()) for i, b, s, *_ in data}
    want = set()
    for i, (a, s) in rows.items():
        for j, (b, t) in rows.items():
            if s in ("dev", "test") and t == "train" and len(a) >= 20 and len(b) >= 20 and edit(a, b) <= max(len(a), len(b)) // 5:
                want.add((min(i, j), max(i, j)))
    got = {tuple(r) for r in splits.overlapping_pairs(found, spelt_out=spelt_out).collect()}
    if spelt_out > 100:
        assert got == want and len(want) > 20
    else:  # stars of large groups: fewer pairs, each true, every record still linked
        assert got < want and {x for p in got for x in p} == {x for p in want for x in p}
    # class rows and links say the same, whatever is spelt out
    members = {r["id"]: r for r in splits.overlap_classes(found).collect()}
    links = {(r["class_1"], r["class_2"]) for r in splits.overlap_links(found).collect()}
    again = {(min(i, j), max(i, j)) for i, a in members.items() for j, b in members.items() if a["side"] == "eval" and b["side"] == "train" and (a["class"], b["class"]) in links}
    assert {p for p in again if all(len(rows[x][0]) >= 20 for x in p)} == want and all(r["class"] == min(i for i, x in members.items() if x["class"] == r["class"]) for r in members.values())
    assert {i: r["links"] for i, r in members.items()} == {i: sum(i in p for p in again) for i in members}
    assert all(r["members"] == sum(x["class"] == r["class"] for x in members.values()) for r in members.values())
    report = {(r["split"], r["source"]): r for r in splits.overlap_report(found).collect()}
    assert sum(r["exact"] + r["near"] for r in report.values()) == len({e for p in want for e in p if rows[e][1] != "train"} | {1003})


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "mail_id int, body string, split string, source string")
    found = splits.find_overlaps(df, "mail_id", "body", "split", "source", "train", ["dev"])
    assert splits.overlapping_pairs(found).count() == 0 and splits.overlap_report(found).count() == 0


def stories(rng, n=60, length=40):
    texts = ["".join(rng.choice("abcdefgh ,.\n") for _ in range(rng.randint(0, 300))) for _ in range(n)]
    for i in range(0, n, 3):  # passages around the sought length, with runs and repetitions in some
        passage = "".join(rng.choice("xyz ") for _ in range(rng.randint(length - 8, length + 60)))
        if i % 2:
            passage = rng.choice([" ", "-", "ab", "xyz"]) * 80
        for j in rng.sample(range(n), rng.randint(2, 4)):
            k = rng.randint(0, len(texts[j]))
            texts[j] = texts[j][:k] + passage + texts[j][k:]
    return texts


def grams(text, length):
    return {text[i : i + length] for i in range(len(text) - length + 1)}


@pytest.mark.parametrize("seed", range(6))
def test_equal_stretches_always_share_an_anchor(seed):
    length = 40
    texts = stories(random.Random(seed))
    points, begin, stop = spans._joined_points(texts)
    key, start, end = spans.anchors(points, begin, stop, length)
    text = np.searchsorted(begin, start, side="right") - 1
    at: dict[int, dict[int, set]] = {}
    for k, t, s, e in zip(key.tolist(), text.tolist(), start.tolist(), end.tolist(), strict=True):
        assert begin[t] <= s < e <= stop[t] and e - s <= length
        at.setdefault(t, {}).setdefault(k, set()).add((s - begin[t], e - begin[t]))
    for i in range(len(texts)):
        for j in range(i):
            for g in grams(texts[i], length) & grams(texts[j], length):
                p, q = texts[i].index(g), texts[j].index(g)
                inside = [{k for k, places in at.get(t, {}).items() if any(o <= s and e <= o + length for s, e in places)} for t, o in ((i, p), (j, q))]
                assert inside[0] & inside[1]


def test_anchors_do_not_depend_on_the_block():
    texts = [t for seed in range(4) for t in stories(random.Random(seed)) if len(t) >= 40]

    def keys(block):
        points, begin, stop = spans._joined_points(block)
        key, start, end = spans.anchors(points, begin, stop, 40)
        text = np.searchsorted(begin, start, side="right") - 1
        return {(int(t), int(s - begin[t]), int(e - begin[t]), int(k)) for k, s, e, t in zip(key, start, end, text, strict=True)}

    alone = {(i, *x[1:]) for i, t in enumerate(texts) for x in keys([t])}
    assert alone == keys(texts)


@pytest.mark.parametrize(("compared", "spelt_out", "block"), [(100, 10**6, 400_000), (1, 10**6, 700), (100, 5, 400_000)])
def test_shared_spans_against_brute_force(spark, compared, spelt_out, block, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK_CHARS", block)
    length = 40
    texts = [*stories(random.Random(11)), None, "", "é" * 50, "生" * 39 + "é" * 45, "\U0001f600" * 45, "b" + "\U0001f600" * 45]
    texts += [texts[5] or "", "hot story " * 9, "hot story " * 9, "hot story " * 9, "hot story " * 9]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, key string, start int")
    found = spans.find_shared_spans(df, "doc_id", "text", length, compared)
    held = [grams(t or "", length) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if held[i] & held[j]}
    got = {tuple(r) for r in spans.sharing_pairs(found, spelt_out).collect()}
    if spelt_out > 100:
        assert got == want
    else:
        assert got < want and {x for p in got for x in p} == {x for p in want for x in p}
    members = {r["id"]: r for r in spans.sharing_classes(found).collect()}
    assert set(members) == {i for i, h in enumerate(held) if h}
    assert all(r["links"] == sum(i in p for p in want) and r["members"] == texts.count(texts[i]) and r["class"] == texts.index(texts[i]) for i, r in members.items())
    assert {tuple(r) for r in spans.sharing_links(found).collect()} == {(members[i]["class"], members[j]["class"]) for i, j in want if texts[i] != texts[j]}
    cover = {r["doc_id"]: r for r in spans.shared_coverage(df, "doc_id", "text", found, length).collect()}
    assert len(cover) == len(texts)
    for i, t in enumerate(texts):
        others = set().union(*(held[j] for j in range(len(texts)) if j != i)) if t else set()
        marks = np.zeros(len(t or ""), dtype=bool)
        for k in range(len(t or "") - length + 1):
            if t[k : k + length] in others:
                marks[k : k + length] = True
        assert cover[i]["shared_chars"] == marks.sum() and cover[i]["n_chars"] == len(t or "")


def test_different_texts_with_one_print_stay_apart(spark, monkeypatch):
    real = spans.F.xxhash64
    monkeypatch.setattr(spans.F, "xxhash64", lambda *c: spans.F.lit(7).cast("bigint") if len(c) == 1 and isinstance(c[0], str) else real(*c))
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "id bigint, text string")
    rows, classes = spans.printed(df)
    by = {r["id"]: r["print"] for r in rows.collect()}
    assert by[0] == by[2] and len(set(by.values())) == 3
    assert sorted((r["first"], r["members"]) for r in classes.collect()) == [(0, 2), (1, 1), (3, 1)]


def test_shared_spans_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    found = spans.find_shared_spans(df, "doc_id", "text")
    assert spans.sharing_pairs(found).count() == 0 and spans.shared_coverage(df, "doc_id", "text", found).count() == 0
