import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm import lm_score


def corpus():
    rng = random.Random(12)
    words = ["the", "cat", "Sat", "on", "mat", "é", "and", "zz9"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "unseen rare words the"), (104, "x" * 5000), (7, rows[7][1])]


def train_rows(rows):
    return [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]


def test_base_score_matches_definition(spark):
    rows = corpus()
    seen = Counter(w for _, t in train_rows(rows) for w in lm_score.tokens((t or "").encode()))
    total, distinct = sum(seen.values()), len(seen)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int")
    got = lm_score.document_scores(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    texts = dict(rows)
    for r in got:
        words = lm_score.tokens((texts[r.doc_id] or "").encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in seen for w in words), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 1) / (total + distinct + 1)) for w in words), rel=1e-9)
        assert r.score < 0
    assert lm_score.document_scores(docs.limit(0)).count() == 0


def plain_tree(texts):
    """Context-tree weighting by its recursion, one byte decision at a time."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(byte):
        node = 1
        for k in range(7, -1, -1):
            yield node, byte >> k & 1
            node = 2 * node + (byte >> k & 1)

    def walk(text):
        padded = b"\n" * lm_score.DEPTH + text
        for at in range(lm_score.DEPTH, len(padded)):
            yield [padded[at - d : at] for d in range(lm_score.DEPTH + 1)], padded[at]

    for text in texts:
        for nodes, byte in walk(text):
            for which, bit in bits(byte):
                for a, b in zip(nodes, nodes[1:], strict=False):
                    children[a, which].add(b)
                for node in nodes:
                    counts[node, which][bit] += 1

    def log_kt(node, which):
        a, b = counts[node, which]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    cache = {}

    def log_weighted(node, which):
        if (node, which) not in cache:
            if len(node) == lm_score.DEPTH:
                cache[node, which] = log_kt(node, which)
            else:
                go = sum(log_weighted(c, which) for c in children[node, which])
                cache[node, which] = np.logaddexp(log_kt(node, which), go) - math.log(2)
        return cache[node, which]

    def chance_of_one(nodes, which):
        a, b = counts[nodes[0], which]
        own = (b + 0.5) / (a + b + 1)
        if len(nodes) == 1:
            return own
        share = 0.5 * math.exp(log_kt(nodes[0], which) - log_weighted(nodes[0], which))
        return share * own + (1 - share) * chance_of_one(nodes[1:], which)

    def log10(text):
        total = 0.0
        for nodes, byte in walk(text):
            for which, bit in bits(byte):
                p = chance_of_one(nodes, which)
                total += math.log10(p if bit else 1 - p)
        return total

    return log10


def test_scores_match_the_recursion(spark):
    rows = [r for r in corpus() if r[0] != 104] + [(200, "\xff zebra quiz"), (201, "the cat sat on the mat and"), (202, "zebra")]
    spelt = lambda t: lm_score.spelled(lm_score.tokens((t or "").encode()))
    log10 = plain_tree([spelt(t) for _, t in train_rows(rows)])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for frequent in (1 << 20, 40, 0):
        got = lm_score.score(docs, ~lm_score.held_out(), frequent=max(1, frequent)).collect()
        assert len(got) == len(rows)
        texts = defaultdict(set)
        for i, t in rows:
            texts[i].add(t)
        for r in got:
            (text,) = texts[r.doc_id]
            assert r.score == pytest.approx(log10(spelt(text)), rel=1e-5)
            assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / len(spelt(text)))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (1, None)], "doc_id long, text string")
    got = lm_score.score(docs, F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.bits_per_byte, 6)) for r in got) == [(1, 0, 0, 8.0), (2, 0, 0, 8.0)]


def test_held_out_text_of_the_kind_is_likelier(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["north", "south", "east", "west"]) for _ in range(40))) for i in range(200)]
    odd = [(1000 + i, "".join(rng.choice("abcdefghijklmnop") for _ in range(200))) for i in range(3)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    got = lm_score.document_scores(docs).collect()
    prose = [r.bits_per_byte for r in got if r.held_out and r.doc_id < 1000]
    assert max(prose) < 0.8 < 2 < min(r.bits_per_byte for r in got if r.doc_id >= 1000)
