"""Centroid clustering, fast sketches and masked search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from ripplepanel.llm import centroids, fast_sketches, masked_search
from ripplepanel.llm.near_duplicates import shingles, _WordHashes

SF = "/root/testdata/sf0.01"


def brute_clusters(rows, k, rounds, seed=3, size=64, scale=1024):
    kept = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v in rows
            if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept])
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), tuple(v)) for i, v in kept if i is not None)
    at = np.array([v for _, v in named[:k]])
    for last in range(rounds + 1):
        d = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if last < rounds:
            at = np.array([x[near == c].sum(axis=0) // (near == c).sum() if (near == c).any() else at[c] for c in range(len(at))])
    return sorted(zip([i for i, _ in kept], near.tolist(), d.min(axis=1).tolist()), key=str), at


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) + rng.integers(0, 5)).tolist()) for i in range(700)]
    rows += [(i, [float(c) for c in rng.integers(0, 2, 6)]) for i in range(700, 800)]  # many ties
    rows += [(3, rows[3][1]), (800, None), (801, []), (802, [1.0] * 5), (803, [1.0] * 7), (804, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (805, [float("nan")] * 6), (806, [float("inf")] * 6), (None, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS cluster", "1 AS x", "2 AS part")
    for k, scale in ((1, 1024), (7, 1024), (12, 1), (2000, 4)):
        found, at = centroids.cluster_vectors(df, centroids=k, rounds=6, size=6, scale=scale)
        if k > 100:  # every named vector is a centroid, repeated ones too
            assert len(at) == 802
            continue
        want, mid = brute_clusters(rows, k, 6, size=6, scale=scale)
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == want
        assert at == mid.tolist()
    assert centroids.report(df.limit(0)).collect() == []
    assert centroids.report(df.where("vec_id IN (800, 801)"), size=6).collect() == []
    with pytest.raises(Exception, match="do not fit"):
        centroids.report(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_search_skips_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-2000, 2000, (40, 16))
    x = (middles[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 16))).astype(np.int64)
    at, before = middles.astype(np.int64), None
    a, b, upper, lower = np.full(3000, -1), np.full(3000, -1), np.zeros(3000), np.zeros(3000)
    spent = []
    for _ in range(4):
        spent.append(centroids.assign(x, a, b, upper, lower, centroids.Guide(at, before)))
        d = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
        assert (a == d.argmin(axis=1)).all()
        before, at = at, at + rng.integers(-3, 4, at.shape)
    assert spent[0] < 3000 * 40 and max(spent[1:]) < 3000


def test_clusters_equal_sql(spark):
    import duckdb

    from ripplepanel.llm.sql import CENTROIDS

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(CENTROIDS).df().sort_values("vec_id")
    got = centroids.report(spark.read.parquet(f"{SF}/embeddings.parquet")).toPandas().sort_values("vec_id")
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c


def test_sketches_fill_and_agree_as_often_as_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 40, 300, 3000)]
    made = fast_sketches.sketches(sets, 128)
    assert (made != fast_sketches._EMPTY).all() and (made[0] >> np.uint64(32)).max() >= 128
    one = fast_sketches.sketches(sets[3:4], 128)
    assert (one[0] == made[3]).all()  # whatever stands beside it
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
            k = int(round(len(pool) * (1 - share) / 2))
            two = fast_sketches.sketches([pool[: len(pool) - k], pool[k:]], 128)
            got.append((two[0] == two[1]).mean())
        assert abs(np.mean(got) - share) < 0.02


def near_groups(rows, size=4, over=80):
    known = _WordHashes()
    sets = [set(shingles(t or "", known, size).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= over * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_sketch_groups_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(10**6)}"
    rows = []
    for family in range(3):  # copies around the threshold, with one passage that all families share
        passage = [f"p{i}" for i in range(60)]
        base = [*passage, *(word() for _ in range(100))]
        for _ in range(50):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 7))):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    base = [word() for _ in range(120)]
    for i in range(40):  # a chain: neighbours are similar, ends are not
        base[(i * 9) % 115] = word()
        rows.append((len(rows), " ".join(base)))
    rows += [(500, None), (501, ""), (501, " \n"), (502, "one two"), (502, "ONE  two"), (None, "one two"), (None, "zz yy"), (510, "one two three"),
             (511, "a b c d e"), (512, "b c d e f"), (513, "é É"), (514, "É É"), (515, "x " * 30_000), (516, "x " * 30_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n", "'y' AS cls", "1 AS kept")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in fast_sketches.sketch_groups(docs).collect()), key=str)
    assert got == near_groups(rows)
    assert fast_sketches.sketch_groups(docs.limit(0)).collect() == []


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=20):
    split = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(split(t))) for d, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, q in Counter(split(text)).items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def searched(docs, items, **kw):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in masked_search.ranked_search(docs, items, **kw).collect()), key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in range(90)] + ["Ünder", "été", "A1b"]
    odds = 1 / np.arange(1, len(words) + 1)
    draw = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(int(i), draw(int(rng.integers(0, 60)))) for i in range(400)]
    docs += [(7, docs[7][1]), (None, "t1 t2"), (None, "t88"), (900, None), (901, "... --"), (902, "t3 " * 5000), (903, "T3_t3,t3 t3")]
    items = [(i, draw(int(rng.integers(1, 90)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere"), (23, "t3"), (23, "t3"), (None, "t5 t5 t6"), (24, " ".join(words))]
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS item", "2 AS item_id")
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS rank", "0 AS doc_id")
    assert searched(left, right) == brute_search(docs, items)
    assert searched(left, right, top=3) == brute_search(docs, items, 3)
    assert searched(left.limit(0), right) == [] and searched(left, right.limit(0)) == []
    monkeypatch.setattr(masked_search, "BLOCK_BYTES", 1000)  # several passes
    assert searched(left, right) == brute_search(docs, items)


def test_bounds_spare_documents():
    rng = np.random.default_rng(9)
    words = [f"t{i}".encode() for i in range(40)]
    known = {w: i for i, w in enumerate(words)}
    held = masked_search._Load(known)
    for i in range(3000):
        held.add(i, b" ".join(rng.choice(words, 12)))
    asked, weight = np.arange(6), np.array([900, 700, 500, 300, 200, 100])
    some, all_ = (masked_search._Search([(asked, weight)], len(known), 3000, 36000, top) for top in (20, 3000))
    some.load(held)
    all_.load(held)
    assert [r[0] for r in some.best[0]] == [r[0] for r in all_.best[0]][:20]
    assert some.scored < all_.scored / 3
    before = some.scored
    some.load(held)  # the same documents again: the score to beat is known from the start
    assert some.scored - before <= before


def test_long_text_is_split_at_breaks(monkeypatch):
    monkeypatch.setattr(masked_search, "SPLIT_BYTES", 10)
    text = "Alpha beta, gamma-delta ÉÉ" + "x" * 40 + " end"
    assert [t.decode() for part in masked_search.terms(text.encode()) for t in part] == TERM.findall(
        re.sub("[A-Z]", lambda m: m[0].lower(), text))
