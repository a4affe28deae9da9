"""Token counts and sentence pieces against their libraries; quality rules and search against SQL."""

import pytest

import __spark_entry__ as entry_module
from check_oracle import compare, connect
from ripplepanel.llm import bm25_search, quality_rules, sentence_pieces, token_counts
from ripplepanel.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, "a"), (1, None, "b"), (2, "", ""), (3, "hi <|endoftext|> there's\n\n  x中文՘ʰ", ""),
    (3, "hi <|endoftext|> there's\n\n  x中文՘ʰ", ""), (None, "hey you", ""), (4, " \t\n ", ""), (5, "a" * 3000 + " " * 50 + "é" * 500, "")]


@pytest.fixture(scope="module")
def odd(spark):
    # clashing names: the operators' own column names, with other types
    return spark.createDataFrame(ODD, "doc_id long, text string, n_tokens string").selectExpr(
        "doc_id", "text", "n_tokens", "n_tokens AS n_bytes", "n_tokens AS score", "n_tokens AS n_words", "n_tokens AS ids")


def test_token_counts_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False)))
                   for r in docs.collect()), key=str)
    assert sorted(map(tuple, token_counts.count_tokens(docs, path).collect()), key=str) == want
    assert token_counts.count_tokens(odd, path).count() == len(ODD)
    assert token_counts.count_tokens(odd.limit(0), path).collect() == []


def test_agreed_characters_are_cut_alike():
    counter = token_counts.PieceCounter(tokenizer_file("byte_bpe_50k.json"))
    split = counter.tokenizer.pre_tokenizer.pre_tokenize_str
    for c in [*range(0x20, 0x2100, 7), *range(0x3000, 0xD7A4, 211)]:
        text = f"a{chr(c)}{chr(c)}1 {chr(c)} \n{chr(c)}"
        assert counter.plain(text) == [text[a:b] for _, (a, b) in split(text)], hex(c)


def test_table_of_counts_is_emptied(monkeypatch):
    counter = token_counts.PieceCounter(tokenizer_file("byte_bpe_50k.json"))
    whole = counter.count(["one two three", "two four"]).tolist()
    monkeypatch.setattr(token_counts, "KNOWN", 1)
    assert [counter.count([t]).tolist()[0] for t in ("one two three", "two four")] == whole


def test_pieces_equal_the_library(spark, odd):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sentence_pieces.encode(docs, path, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.n_pieces == len(r.ids) and r.round_trip
    back = sentence_pieces.decode(sentence_pieces.encode(docs, path), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sentence_pieces.encode(odd.limit(0), path).collect() == []


def test_unigram_search_is_the_best_path():
    model = sentence_pieces.PieceModel(tokenizer_file("piece_bpe_32k.model"))
    model.merges = False
    model.scores = -(model.scores * 0 + 1) - (abs(model.scores) % 7) / 7

    def best(word):
        at = [(0.0, ())]
        for end in range(1, len(word) + 1):
            ways = [(at[s][0] + float(model.scores[model.ids[word[s:end]]]), (*at[s][1], model.ids[word[s:end]]))
                    for s in range(max(0, end - model.longest), end) if word[s:end] in model.ids]
            at.append(max(ways, key=lambda w: w[0]))
        return at[-1][0]

    words = ["▁reading", "▁helloes", "abcabcab"]
    for word, path in zip(words, model.search(words), strict=True):
        assert "".join(model.pieces[i] for i in path) == word
        assert sum(float(model.scores[i]) for i in path) == pytest.approx(best(word))


@pytest.mark.parametrize("name", ["op2_bm25_topk", "op6_quality_rules"])
def test_query_matches_sql(spark, name):
    verdict = compare(entry_module.queries()[name](spark, SF), connect(SF), entry_module.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_quality_rules_on_odd_rows(spark, odd):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows)
    again = spark.createDataFrame([(7, "a b c d a b c\nx\nx\n \n \n")], "doc_id long, text string")
    (row,) = quality_rules.measures(again).collect()
    assert (row.n_words, row.n_dup_lines, row.n_repeat_words, row.word_chars) == (9, 1, 6, 9)
    (row,) = quality_rules.measures(again.selectExpr("doc_id", "'a a a a' AS text")).collect()
    assert row.n_repeat_words == 4
    assert quality_rules.judge(odd.limit(0)).collect() == []


def test_cascade_order_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.default_rules()
    a = quality_rules.judge(docs, rules).select("doc_id", "kept").collect()
    b = quality_rules.judge(docs, rules[::-1]).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)


def test_search_over_shards_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = docs.where("doc_id % 25 = 0")
    many = bm25_search.similar_documents(docs, asked, shard_bytes=60_000).collect()
    assert sorted(many) == sorted(bm25_search.similar_documents(docs, asked).collect())
    x = spark.createDataFrame([(0, None, "a"), (50, "", "b"), (100, "Ab ab c", ""), (100, "c d", ""), (None, "ab", "")],
                              "doc_id long, text string, score string")
    assert [(r.query_id, r["rank"], r.doc_id) for r in bm25_search.similar_documents(x, x).collect()] == [
        (100, 1, 100), (100, 2, 100), (100, 3, None)]
    assert bm25_search.similar_documents(x.limit(0), x.limit(0)).collect() == []


def test_search_of_a_shard_skips_what_cannot_enter(spark):
    import math
    from collections import Counter

    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    held = [(r.doc_id, Counter((r.text or "").encode().lower().split())) for r in rows]
    mean = sum(sum(c.values()) for _, c in held) / len(held)
    df = Counter(t for _, c in held for t in c)
    index = bm25_search.ShardIndex(mean)
    for r in rows:
        index.add(r.doc_id, (r.text or "").encode())
    index.close()
    asked = [h for h in held if h[0] % 10 == 0 and h[1]]
    for _, query in asked:
        weights = {t: n * math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) for t, n in query.items()}
        want = []
        for doc_id, c in held:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            score = sum(w * c[t] * 2.2 / (c[t] + norm) for t, w in weights.items() if t in c)
            want.append((-round(score, 6), doc_id))
        docs, scores = index.search(bm25_search._hashes(weights, len(weights)), np.array(list(weights.values())), 10)
        got = sorted((-round(s, 6), index.ids[d]) for s, d in zip(scores.tolist(), docs.tolist()))[:10]
        assert got == sorted(w for w in want if w[0] < 0)[:10]
    # a walk over all would score every document in full
    assert index.scored < 0.4 * len(asked) * len(held)


def test_long_text_is_counted_in_parts(monkeypatch):
    text = b"Ab cd\x0bab " * 50 + b"x" * 40 + b" y"
    want = bm25_search.count_words(text)
    monkeypatch.setattr(bm25_search, "SPLIT_BYTES", 17)
    assert bm25_search.count_words(text) == want and want[b"ab"] == 100


def _made_rows(n=900):
    """Two tongues, words from common to unique, long rows, and groups of exact copies."""
    import random
    from collections import Counter

    draw, rows = random.Random(5), []
    for i in range(n):
        if i % 9 == 8:
            rows.append((i, rows[draw.randrange(len(rows))][1]))
            continue
        size = draw.choice([1, 5, 40, 40, 200])
        rows.append((i, Counter(b"%d-%d" % (i % 2, draw.paretovariate(0.6) % 5000) for _ in range(size)) + Counter([b"own%d" % i])))
    return rows


def _packed_search(bm25, rows, asked):
    """The results of packs over one shard, of brute force, and the index."""
    import math
    from collections import Counter

    import numpy as np

    mean = sum(sum(c.values()) for _, c in rows) / len(rows)
    df = Counter(t for _, c in rows for t in c)
    index = bm25.ShardIndex(mean)
    for doc_id, c in rows:
        index.add(doc_id, b" ".join(t for t, n in c.items() for _ in range(n)))
    index.close()
    got, want = {}, {}
    columns = [[bm25._hashes(c, len(c)), np.array(list(c.values())), np.array([df[t] for t in c])] for _, c in asked]
    packs = list(bm25._packs(np.array([i for i, _ in asked]), np.array([len(c) for _, c in asked]), *map(np.concatenate, zip(*columns))))
    for pack in packs:
        idf = np.log(1 + (len(rows) - pack.dfs + 0.5) / (pack.dfs + 0.5))
        found = index.search_pack(len(pack.query_ids), pack.terms, idf, pack.heads, pack.who, pack.times, 10)
        for query, (docs, scores) in zip(pack.query_ids.tolist(), found, strict=True):
            got[query] = bm25._best(((round(s, 6), index.ids[d]) for s, d in zip(scores.tolist(), docs.tolist())), 10)
    for query, c in asked:
        weights = {t: n * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t, n in c.items()}
        scores = []
        for doc_id, d in rows:
            norm = 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)
            score = sum(w * d[t] * 2.2 / (d[t] + norm) for t, w in weights.items() if t in d)
            scores += [(round(score, 6), doc_id)] if score else []
        want[query] = bm25._best(scores, 10)
    return got, want, index, packs


@pytest.mark.parametrize("small", [{}, {
    "PACK": 16, "PACK_TERMS": 900, "BLOCK": 90, "BLOCK_LEAST": 40, "BLOCK_MOST": 120, "CELLS": 7000, "FACTOR_CELLS": 3000, "ENTRIES": 50,
    "STEP": 4, "COMMON": 20, "ROWS": 300}, {"ENTRY_COST": 10**9}, {"ENTRY_COST": 0}])
def test_packs_find_what_brute_force_finds(monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(bm25_search, name, value)
    rows = _made_rows()
    got, want, index, packs = _packed_search(bm25_search, rows, rows[::3])
    assert got == want
    if "PACK" in small:
        assert len(packs) > 15 and len(index.blocks) > 4


def test_packed_queries_share_terms_and_work():
    rows = _made_rows()
    got, want, index, (pack,) = _packed_search(bm25_search, rows, rows[::3])
    assert got == want
    # each term is sent once, and products take what would be added up for every query on its own
    assert len(set(pack.terms.tolist())) == len(pack.terms) < 0.5 * len(pack.who)
    alone = sum(len(a.keys() & d.keys()) for _, a in rows[::3] for _, d in rows)
    assert index.entries < 0.25 * alone
    assert index.scored < 0.1 * len(rows[::3]) * len(rows)
