import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontam import naive_rows
from tests.llm.test_pii import plain_spans
from tests.llm.test_simhash import plain_similar_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(tmp_path, spark):
    rng = random.Random(21)
    syllables = {"en": ["th", "er", "ing", "wh", "ou"], "de": ["sch", "ung", "ß", "ein", "ver"]}
    say = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    items = [(k, say("en", 20)) for k in range(4)]
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        rows.append((i, say(lang, rng.randrange(30, 90)), lang))
    rows += [(200, rows[5][1], "en"), (201, rows[5][1], "en"), (5, rows[5][1], "en"), (202, rows[6][1] + " thing", "de")]
    rows += [(210, f"{say('en', 20)} {items[1][1]} {say('en', 20)}", "en")]
    rows += [(220, f"{say('en', 30)} write bob@mail.example.com or 10.1.2.3 {say('en', 9)}", None)]
    rows += [(230, None, "en"), (231, "", "en"), (232, "12 34 !!", "en"), (None, say("en", 40), "en"), (None, say("de", 40), "de")]
    docs = [(i, t, lang, "src0", len(t) if t is not None else None) for i, t, lang in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, items


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, items = make(tmp_path, spark)
    step = spark.createDataFrame(docs, SCHEMA)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "bpe"]

    def through(number, rows):
        frame = spark.createDataFrame(rows, SCHEMA)
        out = corpus_pipeline.STAGES[number][1](spark, frame, str(tmp_path))
        if number < 4:
            assert out.columns == step.columns
        return [tuple(r) for r in out.collect()]

    known = through(0, docs)
    gone = {d[0] for d in docs} - {d[0] for d in known}
    assert {230, 231, 232} <= gone and len(gone) <= 5
    assert next(d for d in known if d[0] == 220)[2] == "en"

    single = through(1, known)
    texts = {}
    for d in known:
        texts.setdefault(d[0] if d[0] is not None else 10**6 + len(texts), d[1])
    roots = set(plain_similar_components(texts).values())
    assert {200, 201, 202} & roots == set()
    assert sorted(d[0] for d in single if d[0] is not None) == sorted(r for r in roots if r < 10**6)
    assert len(single) == len(roots)

    clean = through(2, single)
    leaks = {w[0] for w in naive_rows([d[:2] for d in single], items, 5, 0.5)}
    assert leaks == {210}
    assert sorted(d[:1] for d in clean if d[0] is not None) == sorted(d[:1] for d in single if d[0] is not None and d[0] not in leaks)

    private = through(3, clean)
    before = {d[0]: d for d in clean}
    for d in private:
        if d[0] is not None:
            assert (d[1] == before[d[0]][1]) == (not plain_spans(before[d[0]][1])) and d[4] == len(d[1])
    assert "[EMAIL] or [IP]" in next(d for d in private if d[0] == 220)[1]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = through(4, private)
    want = {}
    for d in private:
        want.setdefault(d[0], []).append(library.encode(d[1], add_special_tokens=False).ids)
    assert len(encoded) == len(private)
    for doc_id, n, ids, decoded in encoded:
        assert ids in want[doc_id] and n == len(ids) and decoded == library.decode(ids, skip_special_tokens=False)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.ids) for r in whole) == sorted((str(e[0]), e[2]) for e in encoded)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_begin_with_executors_giving_memory_back(spark, tmp_path):
    make(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    sc = spark.sparkContext
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collections = lambda: sum(b.getCollectionCount() for b in beans())
    sc.setJobGroup("encode", "")
    try:
        before = collections()
        corpus_pipeline.encode(spark, docs, str(tmp_path))
        assert collections() > before
        jobs = sc.statusTracker().getJobIdsForGroup("encode")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert [s.numTasks for s in stages] == [sc.defaultParallelism]
