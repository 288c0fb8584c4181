import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointlake.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The base counts by their definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts():
    rng = random.Random(6)
    out = [None, "", "\n\n \t", "a", "a a a", "a a a a", "x\ny\nx\n \nx ", "é\x1c\x85ö | <b> #1", "A\r\nA\r\nB", "\x0b\x0c"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "bb", "ñ", " ", " ", "\n", "\t", "|", "%"]) for _ in range(rng.randrange(300))))
    return out


def test_counts_match_definitions(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(rows)] + [(3, "a", 0.5)], "doc_id long, text string, quality double")
    got = q.verdicts(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        n, chars, symbols, dup, repeat = plain(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
    assert q.verdicts(docs.limit(0)).count() == 0


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    accuracy, votes_often = np.array([0.95, 0.8, 0.7, 0.9, 0.65]), np.array([0.9, 0.5, 1.0, 0.3, 0.8])
    right = rng.random((20000, 5)) < accuracy
    votes = np.where(right == truth[:, None], 1, -1) * (rng.random((20000, 5)) < votes_often)
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    model = q.estimate(patterns, weights.astype(float))
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(np.array(model.right) - accuracy).max() < 0.04


def test_a_rule_that_clashes_with_the_rest_loses_weight():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    right = rng.random((20000, 4)) < np.array([0.95, 0.95, 0.95, 0.5])
    votes = np.where(right == truth[:, None], 1, -1)
    model = q.estimate(*[x.astype(float) if k else x for k, x in enumerate(np.unique(votes, axis=0, return_counts=True))])
    assert max(each[0] for each in model.odds[:3]) < -2 < -0.3 < model.odds[3][0]


def plain_posterior(votes, rounds=300):
    """Expectation-maximisation over single documents, rule by rule."""
    sound = [(v.count(1) + 1) / (v.count(1) + v.count(-1) + 2) for v in votes]
    for _ in range(rounds):
        n1 = sum(sound)
        n0 = len(votes) - n1
        odds = [math.log((n1 + 1) / (n0 + 1))] * len(votes)
        for rule in range(len(votes[0])):
            for cast in (-1, 0, 1):
                on = [k for k, v in enumerate(votes) if v[rule] == cast]
                one, none = sum(sound[k] for k in on), sum(1 - sound[k] for k in on)
                for k in on:
                    odds[k] += math.log((one + 1) / (n1 + 3) / ((none + 1) / (n0 + 3)))
        new = [1 / (1 + math.exp(-o)) for o in odds]
        if max(abs(x - y) for x, y in zip(sound, new, strict=True)) < 1e-12:
            break
        sound = new
    return sound


def test_verdicts_match_em_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = q.judge(docs).collect()
    quality = [1.0] * len(rows)
    for names in q.FAMILIES.values():
        quality = [a * b for a, b in zip(quality, plain_posterior([tuple(r[f"vote_{n}"] for n in names) for r in rows]), strict=True)]
    assert [r.quality for r in rows] == pytest.approx(quality, abs=1e-4)
    assert [r.kept for r in rows] == [x >= 0.5 for x in quality]


def test_posterior_outvotes_single_rules_and_agrees_better_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    votes = [f"vote_{k}" for k in q.rules()]
    judged = q.judge(docs).withColumn("all_pass", F.least(*votes) >= 0).join(labels.groupBy("doc_id").agg(F.min("quality").alias("label")), "doc_id", "left")
    apart = judged.filter("kept <> all_pass")
    assert apart.count() >= 10 and apart.filter("label is not null").count() >= 5
    agree = judged.filter("label is not null").agg(F.avg(F.expr("int(kept = (label = 1))")).alias("kept"), F.avg(F.expr("int(all_pass = (label = 1))")).alias("all")).first()
    assert agree.kept > agree["all"] > 0.9


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    prose = [".\n".join(say(12) for _ in range(rng.randrange(8, 30))) + "." for _ in range(150)]
    junk = [" ".join(w.upper() + "!!" for w in say(120).split()) for _ in range(10)]
    junk += [" | ".join(say(120).split()) for _ in range(10)]
    junk += [" ".join(w + "%%%" for w in say(120).split()) for _ in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(prose + junk)], "doc_id long, text string")
    kept = {r.doc_id for r in q.verdicts(docs).filter("kept").collect()}
    assert kept == set(range(150))
