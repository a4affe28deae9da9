"""Near duplicates, personal data and the pipeline against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ripplepanel.llm import near_duplicates, personal_data

SF = "/root/testdata/sf0.01"


def brute_groups(rows):
    """doc_id -> (set size, least id reachable), by comparing all documents that share a shingle."""
    def runs(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [runs(t) for _, t in rows]
    holders, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for found in holders.values():
        for a in range(len(found)):
            for b in range(a):
                shared[found[b], found[a]] += 1
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def groups_of(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.jaccard_groups(docs).collect()), key=str)


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert groups_of(docs) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_of_chains_passages_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*passage, *(word() for _ in range(int(rng.integers(0, 40))))])) for i in range(40)]
    base = [word() for _ in range(120)]
    for i in range(40, 80):  # a chain: neighbours are similar, ends are not
        base[(i * 9) % 115] = word()
        rows.append((i, " ".join(base)))
    rows += [(80, None), (81, ""), (81, " \n"), (82, "one two"), (82, "ONE  two"), (None, "one two"), (None, "zz yy"), (90, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n", "'y' AS cls")
    assert groups_of(docs) == brute_groups(rows)
    assert near_duplicates.jaccard_groups(docs.limit(0)).collect() == []
    kept = near_duplicates.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    leads = {c for d, n, c in brute_groups(rows) if c is not None}
    assert {r.doc_id for r in kept.collect()} - {None} == leads


def near_copies(rng, n, words=60):
    """Copies of one text with a word or two of their own: many links within one group."""
    base = [f"w{k}" for k in rng.integers(0, 10**6, words)]
    out = []
    for i in range(n):
        mine = list(base)
        for _ in range(int(rng.integers(1, 3))):
            mine[int(rng.integers(0, words))] = f"x{rng.integers(10**6)}"
        out.append(" ".join(mine))
    return out


def brute_links(rows):
    """Per row, with how many other sets its own set is linked."""
    def runs(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [runs(t) for _, t in rows]
    every = {s for s in sets if s}
    return [sum(o != s and 100 * len(s & o) >= 75 * len(s | o) for o in every) if s else 0 for s in sets]


@pytest.mark.parametrize("classes", [1_000, 7])
def test_links_within_a_group_are_all_counted(spark, monkeypatch, classes):
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", classes)
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t in enumerate(near_copies(rng, 40) + near_copies(rng, 15, 30))]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, None), (201, "one two")]
    got = near_duplicates.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(zip((d for d, _ in rows), brute_links(rows), strict=True))
    assert {r.doc_id: r.n_links for r in got} == want
    assert max(want.values()) > 10


def test_texts_without_id_are_linked(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 80)]
    rows = []
    for i in range(6):  # a chain whose middle has no id
        words[12 * i] = f"x{i}"
        rows.append((None if i in (2, 3) else i, " ".join(words)))
    assert groups_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)


def test_a_family_of_edited_copies_is_not_paired_with_itself(spark, monkeypatch):
    """Copies with words of their own that are too far apart to link: shingles with the same holders count once, and few pairs are verified."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.choice(22, 4, replace=False) * 5 + 5:  # all four apart: 20 of 116 shingles are the copy's own
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([f"p{j}" for j in range(30)] + [f"q{i}x{j}" for j in range(8)])) for i in range(2)]
    seen, tables = {}, {}
    real_links, real_cut = near_duplicates._Verifier.links, near_duplicates.cut

    def links(self, pairs, tag):
        seen[tag] = pairs.count()
        return real_links(self, pairs, tag)

    def cut(df, tag):
        tables[tag] = real_cut(df, tag)
        return tables[tag]

    monkeypatch.setattr(near_duplicates._Verifier, "links", links)
    monkeypatch.setattr(near_duplicates, "cut", cut)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups_of(docs) == brute_groups(rows)
    lists = tables["mixed"].groupBy("token").agg({"cls": "collect_set"}).collect()
    assert len(lists) == len({frozenset(r[1]) for r in lists})
    assert seen["rest"] <= 60


def test_parities_keep_every_link(spark):
    rng = np.random.default_rng(6)
    rows, links = [], []
    for i in range(300):
        both = rng.integers(0, 2**63, rng.integers(1, 900), dtype=np.uint64)
        more = [rng.integers(0, 2**63, rng.integers(0, len(both) // 3 + 2), dtype=np.uint64) for _ in range(2)]
        x, y = (np.unique(np.concatenate([both, m])) for m in more)
        shared = len(np.intersect1d(x, y))
        rows.append((2 * i, 2 * i + 1, len(x) + len(y), near_duplicates._marks(x), near_duplicates._marks(y)))
        if 100 * shared >= 75 * (len(x) + len(y) - shared):
            links.append(2 * i)
    pairs = spark.createDataFrame([(a, b, n, bytearray(x), bytearray(y)) for a, b, n, x, y in rows],
                                  "a long, b long, n long, marks_a binary, marks_b binary")
    kept = {r.a for r in pairs.mapInArrow(near_duplicates._alike, "a long, b long").collect()}
    assert len(links) > 50 and set(links) <= kept and len(kept) < 300
    assert pairs.limit(0).mapInArrow(near_duplicates._alike, "a long, b long").collect() == []


def test_prefix_choice_follows_cost():
    cheap, dear = np.zeros(100), np.concatenate([np.zeros(20), np.full(80, 500.0)])
    assert near_duplicates.choose_matches(cheap, 100, 75) == 1
    assert near_duplicates.choose_matches(dear, 100, 75) > 1


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                if not 12 <= len(digits) <= 19 or sum(x - 9 * (x > 9) for x in twice) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_spans_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(2)
    noise = ["".join(rng.choice(list("0123456789.@+-() aé\U0001f600%_"), int(rng.integers(0, 60)))) for _ in range(400)]
    said = [*noise, None, "", "a@b.c%d@e.f x 1.2.3.4.5.6.7.8 999.1.1.1 +49 (30) 1234-5678. 4994226020900891 é4994 2260 2090 0891", "1" * 5000,
            "mail bob (at) example (dot) com IBAN DE89 3704 0044 0532 0130 00 api_key = 'A1b2C3d4E5f6G7h8I9j0K1'"]
    for k in range(120):  # account numbers to learn from, half of them with a wrong check number
        check = 98 - int(f"{k:018d}131400") % 97
        said.insert(0, f"account DE{(check + k % 2 * 7) % 100:02d}{k:018d} and more")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(said)], "doc_id long, text string"))
    docs = docs.selectExpr("*", "'x' AS spans", "'y' AS base")
    detector = personal_data.fit_detector(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = personal_data.report(docs, detector).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k, _ in KINDS]
    last = next(r for r in rows if r.doc_id == 10**6 + len(said) - 1)
    assert "account:" in last.spans and "secret:" in last.spans
    assert personal_data.report(docs.limit(0), detector).collect() == []


def test_nothing_to_learn_adds_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "plain words only")], "doc_id long, text string")
    rows = personal_data.report(docs, personal_data.fit_detector(docs)).collect()
    assert [r.spans for r in rows] == ["", ""]


def test_single_rare_spans_are_found(spark):
    # nothing like them in the sample that fits the detector
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rare = spark.createDataFrame([
        (1, "pay to DE89 3704 0044 0532 0130 00 today"), (2, "pay to DE88 3704 0044 0532 0130 00 today"),
        (3, "ask bob (at) example (dot) com now"), (4, "telefon 030 1234 5678 by day"), (5, "from 030 1234 5678 on")], "doc_id long, text string")
    for detector in (personal_data.fit_detector(docs), personal_data.fit_detector(docs.limit(0))):
        got = {r.doc_id: r.spans for r in personal_data.report(rare, detector).collect()}
        assert got == {1: "account:7:34", 2: "", 3: "email:4:30", 4: "phone:8:21", 5: ""}


def test_calibration_needs_precision():
    rows = [("a", 0.9, 1.0)] * 50 + [("a", 0.6, 0.0)] * 10 + [("b", 0.9, 0.0)] * 5
    assert personal_data.calibrate(rows) == {"a": pytest.approx(0.9)}


def test_thresholds_equal_plain_calibration(spark):
    rng = np.random.default_rng(2)
    rows = [(k, round(float(s), 2), float(s + rng.normal(0, 0.1) > 0.6)) for k in "ab" for s in rng.random(300)]
    table = spark.createDataFrame(rows, "kind string, score double, label double").groupBy("kind", "score", "label").count()
    want = personal_data.calibrate(rows)
    assert want and personal_data.thresholds(table.withColumnRenamed("count", "weight")) == pytest.approx(want)


def test_detector_learns_from_all_candidates(spark, monkeypatch):
    rows = [(i, " ".join(f"{'token=' if i % 2 else 'x '}k{i * 10 + j:08d}aB9zQ7mT4pL2w" for j in range(10))) for i in range(700)]
    rows.append((0, rows[0][1]))  # a repeated row adds no candidate
    kept, cut = [], personal_data.cut
    monkeypatch.setattr(personal_data, "cut", lambda df, tag: kept.append(cut(df, tag)) or kept[-1])
    personal_data.fit_detector(spark.createDataFrame(rows, "doc_id long, text string"), trees=1)
    assert kept[0].selectExpr("sum(weight)").first()[0] == 7_000


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame(
        [(10**6, None, None, None, None), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, "", "en", None, 0)], docs.schema)
    docs, seen = docs.unionByName(extra).selectExpr("*", "'x' AS ids").cache(), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "").cache()
        seen[name] = docs
        assert docs.count() <= before.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in seen["language ID"].collect()}
    assert not left & {10**6, 10**6 + 1, 10**6 + 2}
    rows = [(r.doc_id, r.text) for r in seen["language ID"].collect()]
    assert {r.doc_id for r in seen["n-gram Jaccard join"].collect()} == {c for _, _, c in brute_groups(rows)}
    for r in seen["personal data"].collect():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in docs.collect())
