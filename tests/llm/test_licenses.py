import random

from pointlake.llm import licenses


def plain_base(text):
    words = licenses.plain_words(text)
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), places


def texts():
    rng = random.Random(7)
    pool = ["cc", "by", "CC-BY", "general", "Public", "license", "all", "rights", "reserved.", "ñ", "x1", "of the"]
    out = [None, "", "--", "CC BY", "cc by cc by cc by", "All RIGHTS reserved", "all rights \x7f reserved é", "ccby", "cc\x80by", "K cc by"]
    out += [" ".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(80)]
    return out


def test_base_matches_definitions(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(rows)] + [(3, "CC BY", "z"), (None, "cc by", "z")], "doc_id long, text string, row string")
    got = licenses.license_digest(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            continue
        n, places = plain_base(rows[r.doc_id])
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    assert licenses.license_digest(docs.limit(0)).count() == 0


def test_notices_survive_small_edits(spark):
    rows = [
        (1, "Some prose. Released under the MIT License. More prose."),
        (2, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:"),
        (3, "Licensed under the Apache License, Version 2.0 (the License)"),
        (4, "the license of the software is under the law and or the like with or without"),
        (5, "mit license the released under"),
        (6, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r.doc_id: r for r in licenses.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.labels for k, r in got.items()} == {1: "mit", 2: "bsd", 3: "apache-2.0", 4: "", 5: "", 6: "cc-by,cc-by-nc"}


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = licenses.license_digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def plain_notices(text, reach=4, coverage=0.9):
    """(label, first word, end word) of every notice, by the definition."""
    words, out = plain_words(text), set()
    for notice, label in licenses.NOTICES:
        t = notice.split()
        on = {}
        for i in range(len(words) - 1):
            for at in range(len(t) - 1):
                if words[i : i + 2] == t[at : at + 2]:
                    on.setdefault(i - at, set()).add(at)
        good = []
        for d in sorted(on):
            held = {x + k for e in on if abs(e - d) <= reach for x in on[e] for k in (0, 1)}
            if len(held) / len(t) >= coverage:
                good.append(d)
        while good:
            group = [good.pop(0)]
            while good and good[0] - group[-1] <= reach:
                group.append(good.pop(0))
            d = min(group, key=lambda g: (-len(on[g]), g))
            places = []
            for at in range(len(t) - 1):
                near = [(abs(e - d), e) for e in on if abs(e - d) <= reach and at in on[e]]
                if near:
                    places.append(min(near)[1] + at)
            out.add((label, min(places), max(places) + 2))
    return out


plain_words = licenses.plain_words


def edited_texts():
    rng = random.Random(17)
    out = ["released under the mit license" + " under the mit license" * 3, "released under the mit license " * 4, "the mit license " * 30]
    for _ in range(70):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += [rng.choice(["of", "the", "license", "under", "software", "x"]) for _ in range(rng.randrange(8))]
            notice = rng.choice(licenses.NOTICES)[0].split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(2)] = rng.choice([[], ["any"], ["the"]])
            words += notice
        out.append(" ".join(words))
    return out


def test_notices_match_a_naive_scan(spark):
    rows = [*edited_texts(), None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = 0
    for r in licenses.scan(docs).collect():
        want = plain_notices(rows[r.doc_id])
        assert {(s.label, s.first_word, s.end_word) for s in r.spans if not s.exact} == want
        found += len(want)
    assert found > 60
    labels = {r.doc_id: r.labels for r in licenses.license_digest(docs).collect()}
    assert labels[0] == labels[1] == "mit" and labels[2] == ""


def test_digest_matches_sql_on_edited_notices(spark, tmp_path):
    from tests.oracle import connect, same_rows

    rows = [*edited_texts(), *texts()]
    docs = spark.createDataFrame([*enumerate(rows), (0, rows[0]), (None, "cc by")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert same_rows(licenses.license_digest(docs), connect(tmp_path), licenses.digest_sql()) == len(rows) + 2


def test_own_templates(spark):
    own = [licenses.Template("own", ("some", "odd", "phrase"), True)]
    docs = spark.createDataFrame([(1, "Some odd phrase. cc by")], "doc_id long, text string")
    assert [[s.label for s in r.spans] for r in licenses.scan(docs, templates=own).collect()] == [["own"]]
