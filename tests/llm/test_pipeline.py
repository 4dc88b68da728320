"""Near-duplicate texts and the corpus pipeline against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from braidwork.llm import neartext, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        rows.append((k, prose(rng, rng.choice([3, 30, 200, 900]))))
    base = prose(rng, 400)
    rows.append((100, base))
    rows += [(101 + k, edited(rng, base, 3)) for k in range(25)]  # copies of one text, each some 0.93 like it
    rows += [(200 + k, edited(rng, rows[k][1], 1)) for k in range(60) if len(rows[k][1].split()) >= 200]
    rows += [(300 + k, rows[k][1].upper()) for k in range(5)]
    rows += [(400, prose(rng, 200) + " " + base[:900])]  # shares a passage only
    rows += [(None, rows[2][1]), (None, None), (500, None), (501, ""), (7, rows[7][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("unit", [8192, 8])
def test_one_text_of_each_group(spark, unit):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    kept = neartext.one_of_each(docs, unit=unit).collect()
    texts = [t for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {find(i) for i in range(len(rows))}
    assert len(kept) == len(groups)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    assert Counter(r.doc_id for r in kept) == Counter(low.get(g) for g in groups)
    assert neartext.one_of_each(docs.limit(0)).count() == 0


def test_sketch_similarity_is_exact_for_short_texts():
    rng = random.Random(2)
    a = prose(rng, 300)
    for n in (0, 1, 5, 20):
        b = edited(rng, a, n)
        assert abs(neartext.similarity(neartext.describe(a)[2], neartext.describe(b)[2]) - jaccard(a, b)) < 1e-9
    long = prose(rng, 20_000, 10**6)
    other = edited(rng, long, 400)
    assert abs(neartext.similarity(neartext.describe(long)[2], neartext.describe(other)[2]) - jaccard(long, other)) < 0.08


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    items = [(k, prose(rng, 20)) for k in range(5)]
    rows, labels = [], []
    for k in range(260):
        text = prose(rng, rng.randrange(20, 120), 300)
        bad = k % 4 == 0
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append([k, text, "en", f"src{k % 3}", len(text)])
        labels.append((k, int(not bad)))
    rows += [[300 + k, rows[k][1], "en", "src0", rows[k][4]] for k in (1, 2, 3)]  # copies
    rows += [[400 + k, prose(rng, 30, 300) + " " + items[k][1], "en", "src1", 0] for k in range(5)]  # leaks
    rows.append([None, "w1 w2 w3 a text without an id", None, None, None])
    d = str(tmp_path)
    spark.createDataFrame(rows, DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{len(seen)}")
        out = spark.read.parquet(f"{d}/{len(seen)}")
        if name != "sharding":
            assert out.columns == docs.columns
        seen.append([r.asDict() for r in out.collect()])
        docs = out
    good, single, clean, mixed, sharded = seen
    quality = dict(labels)
    assert np.mean([quality.get(r["doc_id"], 1) for r in good]) > 0.98
    assert {k for k, q in labels if q} <= {r["doc_id"] for r in good}
    ids = Counter(r["doc_id"] for r in single)
    assert all(n == 1 for n in ids.values()) and not {301, 302, 303} & set(ids) and {1, 2, 3} <= set(ids)
    texts = [r["text"] for r in single]
    assert not any(jaccard(a, b) >= 0.8 for i, a in enumerate(texts) for b in texts[:i])
    assert {r["doc_id"] for r in single} - {r["doc_id"] for r in clean} == {400 + k for k in range(5)}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    assert max(Counter((r["doc_id"], r["text"]) for r in mixed).values()) <= 3
    total = sum(len(r["text"].split()) for r in clean)
    assert abs(sum(len(r["text"].split()) for r in mixed) - total) < 0.02 * total
    assert Counter(r["doc_id"] for r in sharded) == Counter(r["doc_id"] for r in mixed)
    assert {r["shard"] for r in sharded} <= set(range(corpus_pipeline.SHARDS))
    whole = corpus_pipeline.run(spark, d).collect()
    assert Counter((r.doc_id, r.shard) for r in whole) == Counter((r["doc_id"], r["shard"]) for r in sharded)


def kept_ids(spark, texts, unit=8192):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    return {r.doc_id for r in neartext.one_of_each(docs, unit=unit).collect()}


@pytest.mark.parametrize("unit", [8192, 8])
def test_near_copies_among_texts_of_one_word_set(spark, unit):
    """Reordered lines share a word set; they must not hide a real pair."""
    rng = random.Random(11)
    lines = [prose(rng, 8) for _ in range(40)]
    texts = [" ".join(rng.sample(lines, len(lines))) for _ in range(40)]
    # All with half of one text: candidates of each other that are no pairs.
    texts += [" ".join([*lines[:34], *rng.sample(lines[34:], 6), prose(rng, 60)]) for _ in range(40)]
    copies = [edited(rng, t, 4) for t in texts]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(texts, copies))
    assert not any(jaccard(a, b) >= 0.8 for i, a in enumerate(texts) for b in texts[:i])
    assert kept_ids(spark, [*texts, *copies], unit) == set(range(len(texts)))


def test_recall_does_not_depend_on_the_word_set(spark):
    """Edits by new words in texts of few word kinds, and in long texts."""
    rng = random.Random(12)
    texts = [prose(rng, n, kinds) for n, kinds, count in [(300, 150, 20), (5000, 500, 10), (5000, 2000, 10), (20_000, 3000, 3)] for _ in range(count)]
    copies = [edited(rng, t, len(t.split()) // 50) for t in texts]
    assert all(0.8 <= jaccard(a, b) < 0.86 for a, b in zip(texts, copies))
    assert kept_ids(spark, [*texts, *copies]) == set(range(len(texts)))


def test_long_texts_are_decided_by_all_shingles(spark):
    rng = random.Random(13)
    texts, like = [], []
    for _ in range(40):
        a = prose(rng, 1500, 10**6)
        b, n = a, rng.choice([31, 32, 33, 34])
        words = b.split()
        for at in range(20, 20 + 40 * n, 40):
            words[at] = f"e{rng.randrange(10**6)}"
        b = " ".join(words)
        texts += [a, b]
        like.append(jaccard(a, b) >= 0.8)
    assert 5 < sum(like) < 35
    assert kept_ids(spark, texts) == {2 * k for k in range(40)} | {2 * k + 1 for k in range(40) if not like[k]}


def simhash_rows(seed):
    """Texts that only SimHash links, that only shingles link, and chains of both."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = prose(rng, 300, 10**6)
        texts += [base, *(edited(rng, base, n) for n in (2, 5, 7, 9, 12))]
    line = prose(rng, 9)
    texts += [" ".join([line] * 30 + [prose(rng, 12)]) for _ in range(6)]
    texts += [prose(rng, rng.choice([1, 2, 3, 40])) for _ in range(30)] + [texts[-1].upper(), "", "  ", None]
    rows = [(1000 - k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[-5]), (3, texts[7]), (3, texts[7])]
    rng.shuffle(rows)
    return rows


def links_of(rows):
    fps = [simhash.fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    return {p for p in pairs if (fps[p[0]] ^ fps[p[1]]).bit_count() <= 3}, {(i, j) for i, j in pairs if jaccard(rows[i][1], rows[j][1]) >= 0.8}


@pytest.mark.parametrize("unit", [8192, 8])
def test_the_stage_links_by_simhash(spark, unit):
    rows = simhash_rows(21)
    near, similar = links_of(rows)

    def groups(pairs):
        root = np.arange(len(rows))
        a, b = zip(*sorted(pairs))
        simhash.merge(root, np.array(a), np.array(b))
        return root

    both = groups(near | similar)
    # Each kind links what the other does not.
    assert len(near - similar) >= 15 and len(similar - near) >= 15
    assert len(set(both)) < min(len(set(groups(near))), len(set(groups(similar))))
    ids = {r: min((d for (d, _), x in zip(rows, both) if x == r and d is not None), default=None) for r in set(both)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    stage = corpus_pipeline.drop_near_duplicates if unit == 8192 else lambda spark, docs, _: neartext.one_of_each(docs, unit=unit, radius=simhash.RADIUS)
    kept = stage(spark, docs, "").collect()
    assert Counter(r.doc_id for r in kept) == Counter(ids.values())
    assert stage(spark, docs.limit(0), "").count() == 0


def test_texts_that_fill_a_sketch_together_are_decided_by_all_shingles(spark):
    """Each has under 512 shingles, both together more."""
    rng = random.Random(14)
    texts, like = [], []
    for k in range(40):
        a = prose(rng, 494 + k % 10, 10**6)
        words = a.split()
        for at in range(20, 20 + 40 * 11, 40):
            words[at] = f"e{rng.randrange(10**6)}"
        texts += [a, " ".join(words)]
        like.append(jaccard(*texts[-2:]) >= 0.8)
        assert len(shingles(texts[-1]) | shingles(a)) > 512 > len(shingles(a))
    assert 10 < sum(like) < 30
    assert kept_ids(spark, texts) == {2 * k for k in range(40)} | {2 * k + 1 for k in range(40) if not like[k]}
