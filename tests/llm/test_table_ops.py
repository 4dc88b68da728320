"""Mixing, sharding, url rules and vectors against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidwork.llm import common, mixing, shards, urlrules, vectors

# --- mixing ------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3.0 * sizes[s]
        left = float(sum(sizes.values())) - sum(full.values())
        if len(full) == len(names):
            return full


def mix_rows(seed, n=400):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", None, "zz", "tiny"]
    rows = []
    for k in range(n):
        s = rng.choices(names, [90, 60, 50, 40, 20, 10, 1])[0]
        rows.append((k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 3, 9, 40]))), s))
    return rows + [(None, "no id here", "a"), (None, None, "a"), (3, "same row", "b"), (3, "same row", "b"), (9000, "x " * 200, "zz")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mix_rows(seed)
    docs = spark.createDataFrame([(*r, 5, 1) for r in rows], "doc_id long, text string, source string, size int, taken int")
    got = mixing.passes(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(dict(sizes))
    assert len(got) == len(rows)
    by_target = {(r.source_size, round(r.target, 6)) for r in got}
    assert by_target == {(sizes[s], round(want[s], 6)) for s in sizes}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.times <= 3
        taken[r.source_size, round(r.target, 6)] += r.times * r.size
    for (_, target), words in taken.items():
        assert abs(words - target) <= max(9, 0.001 * target)  # nine words are the second shortest text
    again = mixing.passes(docs).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in mix.collect())
    assert words == sum(r.times * r.size for r in got) and mix.count() == sum(r.times for r in got)
    assert mixing.passes(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_fit_is_the_best_subset_sum():
    rng = random.Random(3)
    for _ in range(300):
        lengths = rng.sample(range(1, 30), rng.randrange(1, 6))
        counts = [rng.randrange(1, 5) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randrange(total + 1)
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        got = sum(a * b for a, b in zip(lengths, take))
        assert got <= budget
        # what stays free cannot fill more of the gap
        free = [n for n, c, t in zip(lengths, counts, take) for _ in range(c - t)]
        assert not any(n <= budget - got for n in free)
    assert mixing.fit([0, 5], [7, 0], 3) == [0, 0]
    big = mixing.fit(list(range(1, 3000)), [1000] * 2999, 2_000_000_123)
    assert sum(a * b for a, b in zip(range(1, 3000), big)) == 2_000_000_123


def test_fit_takes_a_long_document_that_fits():
    for lengths, budget, want in [([90_000, 90_001, 90_002], 100_000, 90_002), ([400_000, 410_000, 420_000, 1000], 415_000, 411_000), ([100_000], 100_000, 100_000)]:
        take = mixing.fit(lengths, [1] * len(lengths), budget)
        assert sum(a * b for a, b in zip(lengths, take)) == want


def test_targets_with_equal_ratios(spark):
    sizes = {"a": 100, "b": 40, "c": 20, "d": 100, "e": 0}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


# --- shards ------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(4)
    rows = [(k, "é" * rng.randrange(200)) for k in range(3000)] + [(None, None), (None, ""), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, shard int")
    got = shards.shard_by_bytes(docs, 7, slots=512).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    held, places = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r["size"]
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(held) == set(range(7)) and max(held.values()) / min(held.values()) < 1.02
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    kept = shards.with_shard(docs, 7, slots=512)
    assert kept.columns == ["doc_id", "text", "shard", "virtual_slot"] and kept.count() == len(rows)
    assert Counter((r.doc_id, r.shard) for r in kept.collect()) == Counter((r.doc_id, r.shard) for r in got)
    assert shards.shard_by_bytes(docs.limit(0)).count() == 0 and shards.with_shard(docs.limit(0)).count() == 0


def test_slot_map_versions(spark):
    rng = random.Random(5)
    load = [rng.randrange(1, 100) for _ in range(400)]
    first = shards.balanced(load, 8)
    held = lambda m, x: [sum(b for b, s in zip(x, m.shard) if s == k) for k in range(m.shards)]
    assert max(held(first, load)) - min(held(first, load)) <= 2
    later = [b * (5 if s == 2 else 1) for b, s in zip(load, first.shard)]
    second = shards.rebalanced(first, later)
    assert second.version == 2 and max(held(second, later)) <= 1.02 * sum(later) / 8
    assert sum(a != b for a, b in zip(first.shard, second.shard)) < 200
    third = shards.grown(second, later)
    assert third.shards == 9 and all(a == b or b == 8 for a, b in zip(second.shard, third.shard))
    assert held(third, later)[8] > 0.9 * sum(later) / 9
    table = first.frame(spark).unionByName(second.frame(spark))
    assert shards.SlotMap.read(table) == second and shards.SlotMap.read(table, 1) == first


# --- url rules ---------------------------------------------------------------


def plain_judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0] + best[1])):
            best = (h, p, v)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_url_rules(spark, parts):
    rng = random.Random(6)
    labels = ["net", "org", "com", "example", "a", "b", "", "É", "net:80", "\U0010ffff"]
    urls = [None, "", "no scheme", "http://", "://net/", "http://net", "http://net?x", "HTTP://A.NET/en", "x://y://net/", "http://net/a\nb"]
    for _ in range(400):
        urls.append(rng.choice(["http://", "https://u@"]) + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/en", "/en/", "/en/x?y=/de/", "/de/z#q", "/fr/"]))
    urls += ["http://m.example.net/en/hot"] * 300
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.example.net", "", "block"), ("b.a.example.net", "/e", "allow"), ("com", "/en/x", "block")]
    pages = spark.createDataFrame([(k % 350 if k % 9 else None, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = urlrules.judge(pages, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string"), parts=parts).collect()
    want = Counter((k % 350 if k % 9 else None, *plain_judge(u, rules)) for k, u in enumerate(urls))
    assert Counter(map(tuple, got)) == want
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urlrules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), "block").collect()[0].verdict == "block"


# --- vectors -----------------------------------------------------------------


def vector_rows(seed, n=500, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    rows = []
    for k in range(n):
        v = base[k] if k % 3 else base[rng.integers(0, 40)] + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.05, 0.1])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 4)))
    rows += [(n + k, rows[3][1], 3) for k in range(60)]
    rows += [(None, rows[7][1], rows[7][2]), (9000, None, 1), (9001, [0.0] * dim, 1), (9002, [float("nan")] + [1.0] * (dim - 1), 1), (9003, rows[9][1], None), (9004, [], 1), (9005, [None] + [1.0] * (dim - 1), 1), (9006, [1.0] * (dim - 1), 1), (9007, [float("inf")] * dim, 1), (9008, [1e30] * dim, 1), (9009, [1e-30] * dim, 1)]
    return rows


def plain_links(rows, least=0.93):
    n, root = len(rows), list(range(len(rows)))
    good = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and None not in r[1] and bool(np.isfinite(r[1]).all()) and any(r[1]) for r in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], low.get(find(i)), rows[i][0] == low.get(find(i))) for i in range(n)]


def test_vectors_recall_and_symmetry(spark, monkeypatch):
    rows = vector_rows(8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = plain_links([(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    monkeypatch.setattr(vectors, "OCCUPANCY", 8)
    monkeypatch.setattr(vectors, "INDEXED", 16)
    monkeypatch.setattr(vectors, "VISITING", 32)
    got = vectors.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    found, all_links = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert 0.9 * all_links <= found <= all_links and found % 2 == 0
    monkeypatch.setattr(vectors, "OCCUPANCY", 1 << 30)  # one cell a label: nothing can be missed
    assert Counter(map(str, map(tuple, vectors.near_duplicates(frame).collect()))) == Counter(map(str, want))
    assert vectors.near_duplicates(frame.limit(0)).count() == 0
    assert vectors.near_duplicates(frame.where("label is null")).count() == 1


def test_traversal_is_in_order_of_the_sums():
    rng = np.random.default_rng(9)
    index = vectors.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(7, 3)))
    x = rng.normal(size=(20, 6))
    a, b = index.distances(x)
    sums = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
    for n in (1, 5, 20, 49):
        cells = index.traverse(x, n)
        assert np.allclose(np.take_along_axis(sums, cells, 1), np.sort(sums, 1)[:, :n])
        assert (cells[:, 0] == index.home(x)).all()


# --- components --------------------------------------------------------------


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(150)] + [(3, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
