import random
import time

import numpy as np

from pointlake.llm import decontam


def naive_tiles(item, doc, min_match):
    """Greedy string tiling by its definition."""
    p, t, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not p[i + n] and not t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < min_match:
            return out
        out.append((i, j, n))
        p[i : i + n] = t[j : j + n] = [True] * n


def test_tiles_match_the_definition():
    rng = random.Random(4)
    for _ in range(150):
        letters = rng.choice([2, 4, 9])
        item = [rng.randrange(letters) for _ in range(rng.randrange(1, 45))]
        doc = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        cut = rng.randrange(len(item) + 1)
        doc += item[cut:] + [99] * rng.randrange(3) + item[:cut] + doc[:5]
        k = rng.choice([2, 3, 5])
        want = naive_tiles(item, doc, k)
        assert decontam.greedy_tiles(np.array(item) + 1, np.array(doc) + 1, k) == want
        ids = lambda x: np.array(x, np.uint64) + np.uint64(1)
        if len(item) >= k:
            assert decontam.tiles_of(ids(item), ids(doc), k) == want


def naive_rows(docs, items, min_match=5, threshold=0.5):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            a, b = decontam.words_of(item), decontam.words_of(text)
            if a:
                tiles = naive_tiles(a, b, min(min_match, len(a)))
                got = sum(n for _, _, n in tiles)
                if got and got >= threshold * len(a):
                    out.add((doc_id, item_id, len(a), got, len(tiles)))
    return out


def test_rows_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randrange(3, 30))) for k in range(12)] + [(50, None), (51, ""), (52, "--"), (0, "Repeated id, w1 w2 w3 w4")]
    docs = [(k, say(rng.randrange(40))) for k in range(30)] + [(100, None), (101, "")]
    for k in range(20):
        words = items[k % 12][1].upper().split()
        cut = rng.randrange(len(words))
        docs.append((200 + k, f"{say(9)}, {' '.join(words[cut:])}! {say(3)} {' '.join(words[:cut])}"))
    docs += [(300, "repeated ID w1, w2. w3 w4"), (300, "repeated ID w1, w2. w3 w4"), (None, "repeated ID w1, w2. w3 w4")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = naive_rows(docs, [(i, t) for i, t in items if t])
    for bitmap_bits in (26, 7):
        rows = decontam.leaking_pairs(d, b, bitmap_bits=bitmap_bits).collect()
        assert {(r.doc_id, r.item_id, r.item_words, r.matched_words, r.n_tiles) for r in rows} == want
        assert sum(r.doc_id == 300 and r.item_id == 0 for r in rows) == 2 and 200 <= len([r for r in rows if r.doc_id]) + 200
    kept = decontam.without_leaks(d, b).collect()
    bad = {w[0] for w in want}
    assert sorted(r.doc_id for r in kept) == sorted(i for i, _ in docs if i not in bad)
    assert decontam.leaking_pairs(d, b.limit(0)).count() == decontam.leaking_pairs(d.limit(0), b).count() == 0


def test_one_word_repeated_costs_time_in_proportion(spark):
    item, doc = np.ones(200, np.uint64), np.ones(1_000_000, np.uint64)
    began = time.perf_counter()
    assert decontam.tiles_of(item, doc, 5) == [(0, 0, 200)]
    assert time.perf_counter() - began < 20
    docs = spark.createDataFrame([(1, "again " * 1_000_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    got = decontam.leaking_pairs(docs, spark.createDataFrame([(7, "again " * 200)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched_words, r.n_tiles) for r in got] == [(1, 7, 200, 1)]


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 4, 300).astype(np.uint64)
    for k in (1, 3, 17):
        seen = {}
        for at, h in enumerate(decontam.window_hashes(ids, k).tolist()):
            assert seen.setdefault(h, ids[at : at + k].tolist()) == ids[at : at + k].tolist()
        assert len(set(seen)) == len({tuple(ids[i : i + k].tolist()) for i in range(301 - k)})
