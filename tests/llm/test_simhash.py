import random

import numpy as np
import xxhash

from pointlake.llm import simhash
from pointlake.llm.graph import connected_components


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def sample_texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "Zeta", "é", "ö"]
    texts = [None, "", "  \n", "one", "One", "one two", "a b c", "A  B\tC"]
    for _ in range(60):
        base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            near[rng.randrange(len(near))] = "edit"
            texts.append(" ".join(near))
    return texts


def test_matches_brute_force(spark):
    texts = sample_texts()
    docs = spark.createDataFrame(
        [(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component_id long"
    )
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(prints)
    for piece_rows in (32768, 3):
        got = simhash.near_duplicates(docs, piece_rows=piece_rows).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
            assert r.component_id == want[r.doc_id]


def test_tiles_keep_every_link():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(8)]))
    prints = prints[np.argsort(np.bitwise_count(prints), kind="stable")]
    label = simhash.tile_links(prints, 3, tile=16)
    want = plain_components({i: int(p) for i, p in enumerate(prints)})
    assert [int(x) for x in label] == [want[i] for i in range(len(prints))]


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, None), (7, "a b c d")], schema))
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert rows[None, "0" * 16] is None
    assert rows[None, f"{plain_fingerprint('a b c d'):016x}"] == 7


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(24)] + [(900, 901)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(25)} | {900: 900, 901: 900}


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar_components(texts):
    """The least id of each text's component, by all pairs of whole shingle sets."""
    ids = sorted(texts)
    sets = {i: plain_shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}
    for y in ids:
        for x in ids:
            if x < y and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]) and root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def similar_texts(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " ", "one", "One", "a b c d", "a b  c d", "a b c e"]
    line = say(30)
    for k in range(70):
        base = say(rng.randrange(5, 300))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            for _ in range(rng.randrange(1, 9)):
                near[rng.randrange(len(near))] = "edit"
            texts.append(" ".join(near))
        if k % 3 == 0:  # a repeated line weighs more in the fingerprint than in the set
            texts += [" ".join(base + line), " ".join(base + line * 6)]
        texts += [" ".join(base + say(len(base) // 5)), " ".join(base[: len(base) * 5 // 6])]
    hub = say(120)
    for k in range(150):  # near copies, some linked to none
        near = list(hub)
        for _ in range(rng.randrange(1, 10)):
            near[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    return texts


def test_similar_texts_match_brute_force(spark):
    texts = similar_texts(14)
    want = plain_similar_components(dict(enumerate(texts)))
    prints, sets = [plain_fingerprint(t) for t in texts], [plain_shingles(t) for t in texts]
    beyond = sum((prints[x] ^ prints[y]).bit_count() > 11 and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]) for y in range(len(texts)) for x in range(y))
    assert beyond > 20 and 100 < len(set(want.values())) < len(texts) - 100
    docs = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(texts)), (9, texts[9], "x"), (9, texts[9], "x")], "doc_id long, text string, key string")
    for options in ({}, {"piece": 1}):
        got = simhash.near_duplicate_texts(docs, **options).collect()
        assert len(got) == len(texts) + 2
        assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.near_duplicate_texts(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base, "b"), (5, base, "a"), (3, base + " x", "c"), (None, base + " y", "d"), (7, "other text", "e"), (7, "another one", "f"), (None, "alone here", "g"), (None, None, "h"), (9, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[2], rows[4], rows[5], rows[6], rows[8]]))
    some = simhash.one_of_each(docs.filter("doc_id = 5")).collect()
    assert [tuple(r) for r in some] == [(5, base, "a")]


def test_tile_pairs_are_skipped(monkeypatch):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) & rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    prints[::2] |= rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    prints = prints[np.argsort(np.bitwise_count(prints), kind="stable")]
    compared, plain = [], np.nonzero
    monkeypatch.setattr(simhash.np, "nonzero", lambda x: compared.append(x.shape) or plain(x))
    simhash.tile_links(prints, 3, tile=64)
    tiles = -(-4000 // 64)
    assert 0 < len(compared) < tiles * (tiles + 1) // 2 // 2


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 3000)))
        b = np.unique(np.append(a[rng.random(len(a)) > 0.1], rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 900))))
        apart = np.bitwise_count(np.bitwise_xor(simhash.sketch(a), simhash.sketch(b))).sum()
        assert apart <= simhash.sketches_apart(simhash.long_sketch(a).tobytes(), simhash.long_sketch(b).tobytes()) <= len(np.setxor1d(a, b))


def test_frequent_shingles_change_no_prefix_match():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 60)))
        b = np.unique(np.append(a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 40, rng.integers(0, 6))))
        frequent = rng.permutation(np.unique(rng.choice(np.append(a, b), rng.integers(0, len(a) + 1))))
        rank = np.argsort(frequent)
        if simhash.similar(a, b, 0.8) and len(b):
            heads = [simhash.prefix(x, frequent[rank], rank, 0.8) for x in (a, b)]
            assert len(np.intersect1d(*heads))
