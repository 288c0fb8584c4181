import hashlib
import random
import re

from pyspark.sql import functions as F

from pointlake.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(11)
    out = [None, "", "a@b.c_d@e.f", "a@b.c.d@e.f", "x.y@z", "@a.b", "é@b.c x@é.c", "1.2.3.4.5.6.7.8", "001.2.0255.4 256.1.1.1 1.2.3",
           "4111 1111 1111 1111", "4111-1111-1111-1111 x4111111111111111", "+1 (415) 555-1234", "+1 (415) 555-1234   ", "++12345678", "+1" + " " * 50,
           "🙂 a@b.co 🙂 10.0.0.1", "1" * 400, "a" * 3000 + "@", "a.b@" * 5 + "c.d", "+49 30 1234567, +1-2", "4111 1111  1111 1111", "9.9.9.9@x.y+12345678"]
    alphabet = ["1", "23", "4", ".", "@", "-", " ", "+", "(", ")", "a", "é", "4111111111111111", "10.0.0.1", "x@y.zz", "_"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(400)]
    return out


def test_base_spans_match_python(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)] + [(2, rows[2], 1), (None, "a@b.c", 1)], "doc_id long, text string, spans int")
    got = pii.span_digest(docs).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = plain_spans(rows[r.doc_id] if r.doc_id is not None else "a@b.c")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (rows[r.doc_id or 0], r.spans, want)
        assert r.spans.startswith(",".join(want))
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(w.startswith(kind) for w in want)
    assert pii.span_digest(docs.limit(0)).count() == 0


def corpus():
    rows = []
    for i in range(400):
        filler = f"plain words number w{i} and the rest"
        if i % 10 == 0:
            rows.append((i, f"{filler} Kontakt: user{i}@mail.example.org, {filler}"))
        elif i % 10 == 1:
            rows.append((i, f"{filler} the {i % 250}.20.30.40 and the rest"))
        else:
            rows.append((i, filler))
    return rows


def test_revealing_terms_are_found_and_common_ones_left(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.span_digest(docs).collect()}
    for i, text in corpus():
        assert ("term" in got[i]) == (i % 10 == 0)
        if i % 10 == 0:
            at = text.index("Kontakt")
            assert f"term:{at}:{at + 7}" in got[i] and got[i].count("term") == 1


def test_sanitised_text_keeps_rows_and_columns(spark):
    rows = [*corpus(), (None, None), (5000, ""), (1, corpus()[1][1])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r.text for r in got}
    assert by_id[0] == "plain words number w0 and the rest [TERM]: [EMAIL], plain words number w0 and the rest"
    assert by_id[1] == "plain words number w1 and the rest the [IP] and the rest"
    assert by_id[2] == corpus()[2][1] and by_id[None] is None and by_id[5000] == ""


def test_overlaps_become_one(spark):
    df = spark.createDataFrame([("ab12345678cd",)], "text string")
    spans = F.expr("array(named_struct('kind','card','start',2,'end',8), named_struct('kind','phone','start',5,'end',10), named_struct('kind','ip','start',3,'end',4))")
    assert df.select(pii.redact(F.col("text"), spans)).first()[0] == "ab[CARD]cd"


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = pii.span_digest(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_rows_match_sql(spark, tmp_path):
    from tests.oracle import connect, same_rows

    rows = [*corpus(), *((1000 + i, t) for i, t in enumerate(texts()[:150])), (None, "a@b.c"), (1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert same_rows(pii.span_digest(docs), connect(tmp_path), pii.digest_sql()) == len(rows)


def test_revealing_terms_go_wherever_they_stand(spark):
    rows = corpus()
    far = "word " * 60
    rows += [(5000 + k, f"{far} KONTAKT, kontakt2 xKontakt Kontakt") for k in range(4)]
    rows += [(6000, f"{rows[0][1]} {far} kontakt kontakt@mail.example.org"), (6000, "Kontakt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in pii.sanitise(docs).collect()]
    got = dict(out)
    assert len(out) == len(rows)
    assert got[0] == "plain words number w0 and the rest [TERM]: [EMAIL], plain words number w0 and the rest"
    assert got[5000] == f"{far} [TERM], kontakt2 xKontakt [TERM]"
    assert sorted(t for i, t in out if i == 6000) == sorted([f"{got[0]} {far} [TERM] [EMAIL]", "[TERM]"])
    assert got[2] == rows[2][1]


def test_revealing_terms_count_however_far_they_stand(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["plain", "words", "and", "the", "rest"]) for _ in range(n))
    rows = [(i, f"Impressum {say(120)} mail a{i}@b.example {say(9)} impressum") if i % 9 == 0 else (i, f"{say(40)} w{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.span_digest(docs).collect()}
    for i, text in rows:
        assert ("term:0:9" in got[i]) == (i % 9 == 0) == (f"term:{len(text) - 9}:{len(text)}" in got[i])


def test_many_matches_are_placed_in_time(spark):
    one = "x 10.0.0.1 a@b.co, +4912345678 "
    docs = spark.createDataFrame([(1, one * 20_000), (2, "1" * 1_000_000), (3, "y" * 1_000_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digest(docs).collect()}
    assert (got[1].n_ip, got[1].n_email, got[1].n_phone) == (20_000, 20_000, 20_000) and got[2].spans == got[3].spans == ""
    assert got[1].base_sha256 == hashlib.sha256(",".join(plain_spans(one * 20_000)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == "x [IP] [EMAIL], [PHONE] " * 20_000 and len(clean[2]) == len(clean[3]) == 1_000_000
