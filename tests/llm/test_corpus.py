import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import leakage, mixture, neighbours, splitting, tokens


def exact_pairs(rows, k, least):
    byid = {}
    for i, v, at in rows:
        if i is not None and v is not None and len(v) == 64 and None not in v and any(v) and all(map(math.isfinite, v)):
            if i not in byid or at > byid[i][1]:
                byid[i] = (v, at)
    ids = sorted(byid)
    x = np.array([byid[i][0] for i in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for a in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-round(s[a, j], 6), ids[j]))[:k]
        out |= {tuple(sorted((ids[a], ids[j]))) for j in order if s[a, j] >= least}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 64))
    rows = []
    for i in range(1500):
        v = base[i % 150] + (0 if i % 3 == 0 and i % 150 == 0 else 0.25) * rng.normal(size=64)
        rows.append((f"id{i:05d}", [float(x) for x in v.astype(np.float32)], i))
    copy = rows[0][1]
    rows += [(f"copy{i:04d}", copy, 0) for i in range(700)] + [(f"scaled{i}", [2 * x for x in copy], 0) for i in range(4)]
    return rows + [("none", None, 0), ("zero", [0.0] * 64, 0), ("short", [1.0] * 63, 0), ("hole", [None] + [1.0] * 63, 0), ("nan", [float("nan")] * 64, 0), (None, copy, 0), ("id00007", rows[7][1], 9)]


def test_neighbours_find_what_brute_force_finds(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, "id string, vector array<float>, v int").withColumn("ingested_at", F.timestamp_seconds("v")).withColumn("gid", F.lit("clash")).drop("v")
    want = exact_pairs(vectors, 5, 0.9)
    got = {tuple(r) for r in neighbours.similar_pairs(neighbours.nearest(df, 5, 0.9, leaf=60)).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    assert neighbours.nearest(df.limit(0), 5, 0.9).count() == 0
    monkeypatch.setattr(neighbours, "LARGE_LEAF", 50)
    shared = {tuple(r) for r in neighbours.similar_pairs(neighbours.nearest(df, 5, 0.9, leaf=200)).collect()}
    assert len(shared & want) >= 0.95 * len(want)


WORDS = [f"w{i}" for i in range(3000)]


def test_leakage(spark):
    rng = random.Random(1)
    passages = [" ".join(rng.choices(WORDS, k=60)) for _ in range(6)]
    zh = "".join(chr(0x4E00 + rng.randint(0, 900)) for _ in range(80))
    items = [(i, p) for i, p in enumerate(passages)] + [(90, passages[0]), (91, None), (92, ""), (93, "two words"), (94, zh)]
    noise = lambda n: " ".join(rng.choices(WORDS, k=n))
    w = [p.split() for p in passages]
    eighth = [x if i % 8 else "zzz" for i, x in enumerate(w[1])]
    docs = [
        (100, noise(50) + ". " + passages[0].upper().replace(" ", ",\n") + " " + noise(30)), (101, noise(20) + " " + " ".join(eighth) + " " + noise(20)), (102, " ".join(w[2][:36])), (103, " ".join(w[3][:20]) + noise(50)),
        (104, "text " + " ".join(f"[{x}](https://a.example/{i})" if i % 9 == 0 else x for i, x in enumerate(w[4]))), (105, noise(200)), (106, None), (107, ""), (108, noise(30_000) + " " + passages[5]), (109, "前文" + zh[10:70] + "后文"), (100, passages[1]),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("passage_no", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, passage string").withColumn("doc_id", F.lit(0))
    got = {(r.item_id, r.doc_id) for r in leakage.leaked(d, i).collect()}
    assert got == {(0, 100), (90, 100), (1, 100), (1, 101), (2, 102), (4, 104), (5, 108), (94, 109)}
    assert leakage.leaked(d.limit(0), i).count() == 0 and leakage.leaked(d, i.limit(0)).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH), h[i - 1, j] + leakage.GAP, h[i, j - 1] + leakage.GAP)
    return h.max()


def test_alignment_score_is_optimal():
    rng = random.Random(2)
    for _ in range(80):
        a, b = (np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 12))]) for _ in range(2))
        covered, equal, _ = leakage.align(a, b)
        if smith_waterman(a, b) <= 0:
            assert covered == 0
        else:
            assert 0 < equal <= covered <= len(a)
            assert equal * leakage.MATCH >= smith_waterman(a, b) - 1e-9
        same, right = leakage.align_straight(a, b, 0)
        assert right <= same <= min(len(a), len(b))


def test_token_counts_equal_the_tokenizer():
    count = tokens.counter()
    for text in ["", " ", "a b", "a  b\n\n c ", "it's 12.5 % 漢字 — ok\t\tx ", "x" * 100 + " y", "\n a"]:
        assert count.count(text) == len(count._encode(text)), repr(text)
    assert count.count(None) == 0


def test_mixture_reaches_its_targets(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["word"] * rng.randint(1, 60)), rng.choice(["a", "A ", "b", "c", None])) for i in range(1500)] + [(9001, None, "a"), (9002, "", "b"), (None, "x", "a")]
    plan = [("a", 0.45, 2), ("b", 0.25, 3), ("c", 0.2, 1), ("gone", 0.1, 5), (None, 0.1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("key", F.lit("clash")).withColumn("tokens", F.lit(-1))
    p = spark.createDataFrame(plan, "source string, target_weight double, max_repeats int")
    found = {r.source: r for r in mixture.feasibility(d, p).collect()}
    assert not found["gone"].feasible and found["gone"].tokens == 0 and found["a"].feasible
    copies, shares = mixture.mix(d, p)
    s = {r.source: r for r in shares.collect()}
    for name in ("a", "b"):
        assert abs(s[name].mixed_tokens - found[name].target_tokens) < 0.06 * found[name].target_tokens
    assert copies.filter("source = 'c' AND copies > 1").count() == 0 and copies.filter("source = 'a' AND copies > 2").count() == 0
    assert all(r.feasible for r in mixture.feasibility(d.limit(0), p).collect())
    twice = p.unionByName(p.withColumn("source", F.upper("source")))
    assert mixture.feasibility(d, twice).count() == mixture.feasibility(d, p).count()
    assert mixture.mix(d.limit(0), p)[0].count() == 0 and mixture.feasibility(d, p.limit(0)).count() == 0


def test_sparse_table_and_pieces():
    rng = random.Random(6)
    values = np.array([rng.randint(0, 5) for _ in range(70)])
    table = splitting.RangeMaximum(values)
    for a in range(70):
        for b in range(a + 1, 71):
            best = max(range(a, b), key=lambda i: (values[i], i))
            assert table.place(a, b) == best
    text = "# Head\n\n" + "\n\n".join(" ".join(rng.choices(["word", "extraordinarily", "x,", "end."], k=40)) for _ in range(20)) + " " + "y" * 5000
    for limit, overlap in ((30, 0), (30, 8), (1, 0), (7, 50), (5000, 3)):
        parts = splitting.cut(text, limit, overlap)
        assert all(splitting.size(text[a:b]) <= limit or len(text[a:b].split()) == 1 for a, b in parts)
        covered = set()
        for a, b in parts:
            covered |= set(range(a, b))
        assert all(text[i].isspace() for i in set(range(len(text))) - covered)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(parts, parts[1:]))
        if overlap == 8:
            assert all(splitting.size(text[q[0] : p[1]]) <= 8 if q[0] < p[1] else True for p, q in zip(parts, parts[1:]))
    assert splitting.cut("", 5) == [] and splitting.cut("  a  ", 5) == [(2, 3)]


def test_oversized_rows(spark):
    rows = [(1, "a b c d e f", None, None, 9), (2, "a b", ["s"], 7, 9), (3, None, None, 1, 9), (4, "", [], 1, 9), (5, "para one here.\n\npara two here.", ["x", "y"], 1, 9)]
    df = spark.createDataFrame(rows, "id long, text string, section_path array<string>, config_id int, piece_index int").withColumn("lang", F.lit("en"))
    configs = spark.createDataFrame([(1, 4, 1, False), (2, 5, 0, True)], "config_id int, max_tokens int, overlap_tokens int, is_default boolean")
    out = splitting.pieces(splitting.with_limits(df, configs)).orderBy("id", "piece_index").collect()
    assert {r.id for r in out} == {1, 5} and all(r.piece_tokens <= 5 for r in out) and [r.section_path for r in out if r.id == 5][0] == ["x", "y"]
    assert [r.piece_text for r in out if r.id == 5][0] == "para one here."
    assert splitting.pieces(splitting.with_limits(df.limit(0), configs)).count() == 0


def test_neighbours_of_any_similarity(spark, tmp_path):
    import numpy as np

    from loam.llm import queries

    x = np.random.default_rng(3).normal(size=(1500, 64)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist(), "2024-01-01 00:00:00") for i, v in enumerate(x)], "id string, vector array<float>, ingested_at string")
    df.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).write.parquet(f"{tmp_path}/records.parquet")
    got = {}
    for r in queries.queries()["p5_neighbours"](spark, str(tmp_path)).collect():
        got.setdefault(int(r.id), set()).add(int(r.other))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    best = np.argsort(-sim, axis=1)[:, :5]
    assert len(got) == len(x) and all(len(v) == 5 for v in got.values()) and np.sort(sim, axis=1)[:, -5:].max() < 0.9
    assert sum(len(got[i] & set(b.tolist())) for i, b in enumerate(best)) >= 0.9 * best.size


def test_overlaps_start_at_sentences_and_are_not_reduced():
    text = " ".join(f"Alpha beta gamma delta s{i}." for i in range(20))
    parts = splitting.cut(text, 30, 12)
    assert all(text[b] == "A" for b, _ in parts) and all(6 <= splitting.size(text[q[0] : p[1]]) <= 12 for p, q in zip(parts, parts[1:]))
    words = " ".join("w" for _ in range(60))
    parts = splitting.cut(words, 10, 8)
    assert all(splitting.size(words[q[0] : p[1]]) == 8 for p, q in zip(parts, parts[1:])) and parts[-1][1] == len(words)
    assert all(q[0] > p[0] for p, q in zip(parts, parts[1:]))


def test_pieces_know_their_section():
    text = "intro\n# A\nx\n## B\ny\n# C ##\nz"
    starts = [0, text.index("x"), text.index("y"), text.index("z")]
    assert splitting.paths(text, starts, ["T"]) == [["T"], ["T", "A"], ["T", "A", "B"], ["T", "C"]]
    assert splitting.paths(text, [0], None) == [None] and splitting.paths("# A\nx", [0], ["T", "A"]) == [["T", "A"]]


def test_short_passages_are_found_whole(spark):
    docs = spark.createDataFrame([(10, "One two, THREE four five."), (11, "two three five"), (12, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three four"), (2, "  "), (3, "two three four")], "item_id long, passage string")
    assert {(r.item_id, r.doc_id, r.covered) for r in leakage.leaked(docs, items).collect()} == {(1, 10, 1.0), (3, 10, 1.0)}
