import random
import zlib

import pytest
import zstandard

from pointlake.llm import langid

SYLLABLES = {"en": ["th", "er", "ing", "wh", "ou"], "de": ["sch", "ung", "ß", "ein", "ver"], "fr": ["eau", "é", "que", "aux", "oi"]}


def corpus(n=240):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(6, 80))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    odd = [(1000, None, "en"), (1001, "", "de"), (1002, " 12 -- ! \u00b2 \u00bd \u2167", "fr"), (1003, "the wher thing", None), (None, "the", "en")]
    docs = spark.createDataFrame(rows + odd + rows[:2], "doc_id long, text string, lang string")
    got = langid.predictions(docs).collect()
    assert len(got) == len(rows) + len(odd) + 2
    by_id = {r.doc_id: r for r in got}
    held = [(by_id[i], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held)
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.97 * len(held)
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert by_id[1003].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got)
    assert not any(r.rejected for r, _ in held)


def test_predictions_do_not_see_labels(spark):
    rows = corpus(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, train=~langid.held_out())
    swapped = spark.createDataFrame([(i, t, "zz") for i, t, _ in rows], "doc_id long, text string, lang string")
    a = {r.doc_id: r.language for r in langid.identify(docs, model).collect()}
    b = {r.doc_id: r.language for r in langid.identify(swapped.selectExpr("*", "1 as language", "2 as c0"), model).collect()}
    assert a == b


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predictions(docs).collect()] == ["und"]
    assert langid.predictions(docs.limit(0)).count() == 0


def test_copies_under_other_ids_change_nothing(spark):
    rows = corpus(120)
    schema = "doc_id long, text string, lang string"
    once = langid.fit(spark.createDataFrame(rows, schema))
    thrice = langid.fit(spark.createDataFrame([(i + 1000 * k, t, lang) for i, t, lang in rows for k in range(3)], schema))
    assert once == thrice and [lang for lang, _ in once.dictionaries] and len(once.dictionaries) == 3


def test_no_language_with_a_letter_is_lost(spark):
    shared = "boilerplate line\nof every text"
    rows = [(1, shared, "aa"), (2, shared, "aa"), (3, shared, "bb"), (4, "1 " * 90_000 + "x", "cc"), (5, "x" + " 1" * 90_000, "dd"), (6, "9 8", "ee"), (7, None, "ff")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dictionary_bytes=64)
    assert [lang for lang, _ in model.dictionaries] == ["aa", "bb", "cc", "dd"]
    assert all(0 < len(d) <= 64 for _, d in model.dictionaries)


def test_scripts_of_many_bytes_keep_their_share(spark):
    rows = [(i, "".join(chr(0x4E00 + random.Random(i).randrange(2000)) for _ in range(900)), "zh") for i in range(10)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dictionary_bytes=6000)
    ((_, dictionary),) = model.dictionaries
    assert 5900 <= len(dictionary) <= 6010


def plain_sizes(model, text, level):
    """Bytes of the text's pieces under each dictionary, by the library."""
    data = text.lower().encode()
    out = []
    for _, d in model.dictionaries:
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=1 << 17, dict_size=len(d), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        content = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pieces = [data[k : k + model.piece_bytes] for k in range(0, len(data), model.piece_bytes)]
        out.append(sum(len(zstandard.ZstdCompressor(dict_data=content, compression_params=params).compress(p)) for p in pieces))
    return out


def test_predictions_match_brute_force(spark):
    rows = corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, train=~langid.held_out())
    got = {r.doc_id: r.language for r in langid.identify(docs, model).collect()}
    for i, text, _ in rows:
        sizes = plain_sizes(model, text, model.quick_level)
        low, second = sorted(sizes)[:2]
        if second - low < model.narrow * len(text.encode()):
            sizes = plain_sizes(model, text, model.fine_level)
            low, second = sorted(sizes)[:2]
        assert got[i].lang_pred == model.dictionaries[sizes.index(low)][0]
        assert got[i].margin == pytest.approx((second - low) / len(text.lower().encode()))
        assert got[i].score == pytest.approx(1 / sum(2.0 ** max(-60, low - s) for s in sizes))


def test_ties_go_to_the_more_frequent_then_the_lesser_name(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a", "c", "c"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert {r.language.lang_pred for r in found} == {"c"} and all(r.language.rejected for r in found)
    two = langid.fit(docs.filter("lang <> 'c'"))
    assert {r.language.lang_pred for r in langid.identify(docs, two).collect()} == {"a"}
