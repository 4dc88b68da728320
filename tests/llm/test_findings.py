"""Cases that once gave wrong rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import common, decontaminate, mixing, neartext, quality, secretscan, urlrules


def test_rows_that_differ_in_which_column_is_null_stay_apart(spark):
    rows = [(7, "one two three", "en", None), (7, "one two three", None, "en"), (8, None, "en", None), (8, None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert docs.select(common.row_key(docs).alias("k")).distinct().count() == 4
    mix = {(r.source, r.lang) for r in mixing.mixed(docs).collect()}
    assert {("en", None), (None, "en")} >= mix and mix
    kept = neartext.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == [7, 8]
    nested = spark.createDataFrame([([1, None],), ([None, 1],), (None,)], "a array<int>")
    assert nested.select(common.row_key(nested).alias("k")).distinct().count() == 3


def test_knapsack_is_the_best_sum():
    words = lambda lengths, take: sum(n * t for n, t in zip(lengths, take, strict=True))
    for lengths, counts, budget, best in (
        ([100_000, 7], [1, 30], 100_100, 100_098), ([200_000, 50, 3], [2, 400, 900], 210_000, 210_000), ([90_000, 90_001, 90_002], [1] * 3, 100_000, 90_002), ([400_000, 410_000, 420_000, 1000], [1] * 4, 415_000, 411_000),
    ):
        assert words(lengths, mixing.fit(lengths, counts, budget)) == best
    rng = random.Random(5)
    for _ in range(60):
        lengths = rng.sample(range(1, 400), rng.randint(1, 6))
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, sum(n * c for n, c in zip(lengths, counts, strict=True)))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing.fit(lengths, counts, budget)
        assert all(t <= c for t, c in zip(take, counts, strict=True))
        assert words(lengths, take) == max(s for s in sums if s <= budget)


def test_a_rest_beyond_the_table_is_met_in_coarser_units():
    lengths = [5000, 4999, 701, 13, 1]
    took = mixing.knapsack([(k, n, 40) for k, n in enumerate(lengths)], 200_003, cells=1000)
    assert sum(lengths[k] * n for k, n in took.items()) == 200_003 and max(took.values()) <= 40


def test_a_label_with_byte_one_is_no_dot(spark):
    pages = spark.createDataFrame([(1, "http://net\x01foo/a"), (2, "http://a.net/a"), (3, "http://net/" + "x" * 300_000)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "block"}


def test_letters_alone_can_be_a_key():
    novel = lambda t: [t[a:b] for a, _, b in secretscan.novel_spans(t, secretscan.base_spans(t))]
    assert novel("the secret is kZvQmXwLrTbNyHsDfGqPjWe") == ["kZvQmXwLrTbNyHsDfGqPjWe"]
    assert novel("the secret is getUserAccessTokenFromSession") == []
    assert novel("das Passwort secret Rechtsschutzversicherungsgesellschaften") == []


def test_a_question_with_other_names_is_a_leak(spark):
    items = spark.createDataFrame([(0, "During the long voyage Priya Raman bought 5 crates of oranges and sold them in Madras for a profit of 12 percent")], "item_id long, text string")
    rows = [
        (0, "During the long voyage Wei Zhang bought 7 crates of oranges and sold them in Shanghai for a profit of 9 percent"),
        (1, "During the long voyage Wei Wei bought 7 crates of oranges and sold them in Wei for a profit of 9 percent"),
        (2, "during the long voyage priya raman bought 5 crates of oranges and sold them in madras for a profit of 12 percent"),
        (3, "During the long voyage " + "nothing happened at all " * 20_000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, items).collect()) == [0, 2]


def test_neighbours_are_counted_across_blocks(monkeypatch):
    words = [b"a", b"B", b"a", b"7", b"a", b"a", b"zz"] * 9
    text = b" ".join(words).decode()
    forms = [quality.SAME if k and words[k] == words[k - 1] else quality.form(w) for k, w in enumerate(words)]
    names = sorted({*words, *forms})
    ids = {k: i for i, k in enumerate(names)}
    contexts = np.full(len(names), -1)
    own = [i for i, k in enumerate(names) if k[:1] == b"\0"]
    contexts[own] = np.arange(len(own))
    want = np.zeros((len(names), len(own)), int)
    for i in range(len(words)):
        for j in range(len(words)):
            if 0 < abs(i - j) <= 2:
                for kind in (forms[i], words[i]):
                    want[ids[kind], contexts[ids[forms[j]]]] += 1
    for block in (1 << 20, 11):
        monkeypatch.setattr(quality, "word_blocks", lambda t, b=block: common.word_blocks(t, block=b))
        near = np.zeros_like(want)
        quality.neighbours(text, ids, contexts, near)
        assert (near == want).all()


def test_a_score_counts_words_the_sample_lacks():
    model = quality.Model.untrained({}, np.zeros((0, quality.DIM), np.float32))
    a, b = model.pool("alpha beta"), model.pool("gamma delta")
    assert not np.allclose(a, b) and a[-1] == b[-1] == 1.0
    assert (model.pool(None)[:-2] == 0).all()


def test_clashing_columns_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5), (2, None, None, None)], "doc_id long, text string, score string, shard int")
    model = quality.Model.untrained({}, np.zeros((0, quality.DIM), np.float32))
    out = quality.score(docs, model, "_bw_score")
    assert out.columns == [*docs.columns, "_bw_score"] and out.where(F.col("score") == "x").count() == 1
