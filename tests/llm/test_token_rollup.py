import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointlake.llm import token_rollup as tr

SCHEMA = "source string, lang string, n long, tokens long"


def as_dict(totals):
    return {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in totals.collect()}


def test_random_changes_match_a_recount(spark, tmp_path):
    rng = random.Random(1)
    rollup = tr.TokenRollup(spark, str(tmp_path))
    assert as_dict(rollup.totals()) == {}
    live, batches = [], []
    for b in range(5):
        new = [(rng.choice(["hot"] * 5 + ["a", None]), rng.choice(["en", None]), rng.randrange(9), 0) for _ in range(30)]
        gone = [live.pop(rng.randrange(len(live))) for _ in range(min(len(live), 7))]
        revised = live[:5]
        live = [(s, lang, n + 3, t) for s, lang, n, t in revised] + live[5:] + new
        frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
        changes = (
            tr.inserts(frame(new), "v1", F.col("n"))
            .unionByName(tr.deletes(frame(gone), "v1", F.col("n")))
            .unionByName(tr.revisions(frame(revised), "v1", F.col("n"), F.col("n") + 3))
        )
        batches.append((f"b{b}", changes))
    assert rollup.commit_all(batches) == [True] * 5
    assert rollup.commit_all(batches) == [False] * 5
    want = Counter((s, lang, "v1") for s, lang, _, _ in live)
    got = as_dict(tr.TokenRollup(spark, str(tmp_path)).totals())
    assert {k: v[0] for k, v in got.items()} == dict(want)
    for key, (_, tokens) in got.items():
        assert tokens == sum(n for s, lang, n, _ in live if (s, lang, "v1") == key)


def test_empty_batches_zero_keys_and_bad_ids(spark, tmp_path):
    rollup = tr.TokenRollup(spark, str(tmp_path))
    one = spark.createDataFrame([("s", "en", 4, 0)], SCHEMA)
    assert rollup.commit("none", tr.inserts(one.limit(0), "v", F.col("n")))
    assert rollup.commit("in", tr.inserts(one, "v", F.col("n")))
    assert as_dict(rollup.totals()) == {("s", "en", "v"): (1, 4)}
    assert rollup.commit("out", tr.deletes(one, "v", F.col("n")))
    assert as_dict(rollup.totals()) == {}
    with pytest.raises(ValueError):
        rollup.commit("../x", one)


def test_a_failed_write_can_be_sent_again(spark, tmp_path):
    rollup = tr.TokenRollup(spark, str(tmp_path))
    one = spark.createDataFrame([("s", "en", 4, 0)], SCHEMA)
    with pytest.raises(Exception, match="boom"):
        rollup.commit("b", tr.inserts(one, "v", F.when(F.col("n") > 0, F.raise_error(F.lit("boom")).cast("long"))))
    assert rollup.batches() == []
    assert rollup.commit("b", tr.inserts(one, "v", F.col("n")))
    assert as_dict(rollup.totals()) == {("s", "en", "v"): (1, 4)}


def test_of_two_writers_of_one_batch_one_wins(spark, tmp_path):
    one = spark.createDataFrame([("s", "en", 4, 0)], SCHEMA)
    first, second = tr.TokenRollup(spark, str(tmp_path)), tr.TokenRollup(spark, str(tmp_path))
    # the second writer commits after the first has looked and before it marks
    mark, won = first._mark, []
    first._mark = lambda *a: won.append(second.commit("b", tr.inserts(one, "v", F.col("n")))) or mark(*a)
    assert first.commit("b", tr.inserts(one, "v", F.col("n"))) is False and won == [True]
    assert as_dict(first.totals()) == {("s", "en", "v"): (1, 4)}
    assert len(first._listed("batches")) == 1 and first._listed("drafts") == []


def test_compaction_changes_no_total(spark, tmp_path):
    rollup = tr.TokenRollup(spark, str(tmp_path))
    frame = lambda n: tr.inserts(spark.createDataFrame([("s", "en", n, 0), (None, "de", 1, 0)], SCHEMA), "v", F.col("n"))
    assert rollup.compact() and as_dict(rollup.totals()) == {}
    assert rollup.commit_all([("a", frame(2)), ("b", frame(3))]) == [True, True]
    want = {("s", "en", "v"): (2, 5), (None, "de", "v"): (2, 2)}
    assert as_dict(rollup.totals()) == want
    assert rollup.compact() and as_dict(rollup.totals()) == want and rollup._listed("batches") == []
    assert rollup.commit("a", frame(9)) is False and rollup.commit("c", frame(1))
    assert rollup.compact() and rollup.compact()
    assert as_dict(rollup.totals()) == {("s", "en", "v"): (3, 6), (None, "de", "v"): (3, 3)} and len(rollup._listed("sums")) == 1


def test_counts_of_a_real_tokenizer(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "A first text.", "en"), (None, "A first text.", "en"), (3, None, "en"), (3, "", None), (4, "Zwei Wörter " * 900, "de")]
    docs = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string")
    rollup = tr.TokenRollup(spark, str(tmp_path))
    counted = tr.with_token_counts(docs, path)
    assert counted.columns == [*docs.columns, "n_tokens"]
    assert rollup.commit("load", tr.inserts(counted, "word_bpe_49k", F.col("n_tokens")))
    library, want = Tokenizer.from_file(path), Counter()
    for _, text, lang in rows:
        want["s", lang, "word_bpe_49k"] += len(library.encode(text or "", add_special_tokens=False).ids)
    assert {k: n for k, (_, n) in as_dict(rollup.totals()).items()} == want


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "a b", "en", "s", 3), (1, None, None, None, None), (1, None, None, None, None), (2, "x", "en", "s", 1)]
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(2, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = as_dict(tr.rolled_up(docs, labels, str(tmp_path / "a")))
    assert got == {("s", "en", "words/1"): (1, 2), ("s", "en", "plain-words/1"): (1, 2), (None, None, "words/1"): (2, 0), (None, None, "plain-words/1"): (2, 0)}
    assert as_dict(tr.rolled_up(docs.limit(0), labels.limit(0), str(tmp_path / "b"))) == {}
