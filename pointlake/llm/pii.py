"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Emails, IP addresses, payment cards and phone numbers are found by pattern and
check rules; they are the protected entities. A term of a document may reveal that
it holds one: over the whole corpus, the share of an entity kind's information content
that a term discloses is PMI(term, kind) / IC(kind), from the numbers of documents that
have the term, the kind, and both. All terms of all documents count, however far from
an entity they stand. Terms that disclose ``threshold`` or more, with ``support``
documents behind them, are spans of kind ``term`` and generalised like the entities.

Terms are lower-cased runs of letters, digits and non-ASCII characters with at least one
character that is no digit and no part in an entity. ``detect`` marks a term in the documents
with an entity of its kind; ``sanitise`` generalises it in every text.

Edge cases: null text counts as empty and stays null when sanitised; empty texts
have no span. Rows that share id and text share one result each; repeated rows
all keep their row. Of overlapping spans the first, then longer decides what a text
shows. Very long texts and runs are matched in linear time (possessive patterns
anchored at run starts), and their positions summed in blocks. An empty table gives
no rows. Extra columns pass through ``sanitise`` unchanged. U+FFFF, which is no
character, is never part of a term.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import bounded, cut, table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The kinds' patterns. A match starts at the start of a run, or where the last match
#: ended, which is where a leftmost search finds it without trying every position.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap necessary conditions, so that most texts are not searched.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
_OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$"
_SPAN = "struct<kind:string,start:int,end:int>"


#: Elements that a running fold goes through one by one.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element the fold of those before it: by blocks, so that long arrays are not copied once an element."""

    def carried(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), start, merge))
        first = F.struct(start.alias("at"), F.array(start).alias("out"))
        grow = lambda acc, x: _let(merge(acc["at"], x), lambda at: F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out")))
        return F.aggregate(blocks, first, grow, lambda acc: acc["out"])

    def folded(v: Column, carry: Column) -> Column:
        own = lambda k: F.aggregate(F.slice(v, F.floor(k / BLOCK).cast("int") * BLOCK + 1, k % BLOCK), F.get(carry, F.floor(k / BLOCK).cast("int")), merge)
        return F.transform(F.sequence(F.lit(0), F.size(v) - 1), own)

    empty = F.array().cast("array<int>")
    return _let(values, lambda v: F.when(F.size(v) > 0, _let(carried(v), lambda carry: folded(v, carry))).otherwise(empty))


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start,end,value>> of leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))

    def one(x: Column, at: Column) -> Column:
        return F.struct((at + x["g"]).cast("int").alias("start"), (at + x["g"] + F.char_length(x["m"])).cast("int").alias("end"), x["m"].alias("value"))

    def placed(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(m))
        pairs = F.zip_with(m, gaps, lambda value, gap: F.struct(value.alias("m"), F.char_length(gap).alias("g")))
        sizes = lambda both: F.transform(both, lambda x: F.char_length(x["m"]) + x["g"])
        return _let(pairs, lambda both: F.zip_with(both, _running(sizes(both), F.lit(0), lambda a, x: a + x), one))

    return _let(found, placed)


def _luhn(digits: Column) -> Column:
    def add(total: Column, at: Column) -> Column:
        d = F.substr(digits, at, F.lit(1)).cast("int")
        doubled = (F.char_length(digits) - at) % 2 == 1
        return total + F.when(doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def entities(text: Column) -> Column:
    """array<struct<kind,start,end>> of all base matches, by kind and then start."""
    parts = []
    for kind in KINDS:
        parts.append(F.when(HINTS[kind](text), _of_kind(text, kind)).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return F.concat(*parts)


def _of_kind(text: Column, kind: str) -> Column:
    kept = F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _only(kind: str) -> Column:
    return F.filter("spans", lambda s: s["kind"] == kind)


def _key(id_col: str, text: Column) -> Column:
    return F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"))


CHUNK = 4096


def _part(chunks: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` (from 0) on of a text in chunks, without going through all that stands before."""
    first = F.floor(start / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, F.floor((start + size) / CHUNK).cast("int") - first + 1), "")
    return F.when(size > 0, F.substr(near, start - first * CHUNK + 1, size)).otherwise(F.lit(""))


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``by(kind, its text)`` for each span.

    Of overlapping spans the first counts, then the longer; what another has beyond it has a null kind.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / CHUNK).cast("int")), lambda k: F.substr(text, k * CHUNK + 1, F.lit(CHUNK)))

    def put(c: Column, o: Column) -> Column:
        reached = _running(F.transform(o, lambda s: -s["back"]), F.lit(0), lambda a, x: F.greatest(a, x))

        def piece(s: Column, at: Column) -> Column:
            end = -s["back"]
            fresh = F.concat(_part(c, at, s["start"] - at), by(s["kind"], _part(c, s["start"], end - s["start"])))
            return F.when(s["start"] >= at, fresh).otherwise(by(F.lit(None).cast("string"), _part(c, at, end - at)))

        last = F.array_max(F.transform(o, lambda s: -s["back"]))
        rest = _let(last, lambda at: _part(c, at, F.char_length(text) - at))
        return F.concat(F.array_join(F.zip_with(o, reached, piece), ""), rest)

    done = _let(chunks, lambda c: _let(order, lambda o: put(c, o)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    return replaced(text, spans, lambda kind, _: F.coalesce(F.concat(F.lit("["), F.upper(kind), F.lit("]")), F.lit("")))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with U+FFFF for each letter, digit and non-ASCII character of the spans."""
    return replaced(text, spans, lambda _, own: F.regexp_replace(own, TERM_PATTERN.removesuffix("++"), MASK))


MASK = "\uffff"


def _terms(text: Column) -> Column:
    """The distinct runs of a masked text that are terms, as they are spelt."""
    return F.filter(F.array_distinct(F.split(text, SEPARATORS)), lambda v: v.rlike("[^0-9]") & ~v.contains(MASK))


def found_entities(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, spans, masked) for every row; the masked text only where there are spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.select(_key(id_col, text).alias("key"), text.alias("text"), entities(text).alias("spans"))
    return based.select("key", "spans", F.when(F.size("spans") > 0, masked(F.col("text"), F.col("spans"))).alias("masked"))


def revealing_terms(found: DataFrame, docs: DataFrame, text_col: str, threshold: float, support: int) -> DataFrame:
    """(term, kind, disclosure) of terms that disclose ``threshold`` of a kind's information."""
    totals = found.agg(
        F.count(F.lit(1)).alias("all"),
        *[F.count_if(F.size(_only(k)) > 0).alias(k) for k in KINDS],
    ).first()
    kinds = F.array_distinct(F.transform("spans", lambda s: s["kind"]))
    held = found.filter("masked is not null").select(kinds.alias("kinds"), F.array_distinct(F.transform(_terms(F.col("masked")), F.lower)).alias("terms"))
    together = held.select("kinds", F.explode("terms").alias("term")).select("term", F.explode("kinds").alias("kind"))
    often = cut(together.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= support))
    wanted = often.select("term").distinct()
    # only terms that may reveal something are counted over the corpus
    terms = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS))
    seen = docs.select(F.explode(terms).alias("term")).join(bounded(wanted, wanted.count()), "term", "left_semi")
    known = often.join(seen.groupBy("term").agg(F.count(F.lit(1)).alias("documents")), "term")
    information = {k: totals["all"] / max(1, totals[k]) for k in KINDS}
    rarity = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(float(information[k]))), KINDS, F).otherwise(F.lit(1.0))
    disclosure = F.when(F.col("rarity") > 1, F.log(F.col("together") / F.col("documents") * F.col("rarity")) / F.log("rarity"))
    return cut(known.withColumn("rarity", rarity).select("term", "kind", disclosure.alias("disclosure")).filter(F.col("disclosure") >= threshold))


def _term_spans(text: Column, values: Column) -> Column:
    """array<struct<kind,start,end>> of all whole runs of a masked text that are among ``values``."""
    edge = TERM_PATTERN.removesuffix("++")
    pattern = F.concat(F.lit(f"(?<!{edge})(?:"), F.array_join(values, "|"), F.lit(f")(?!{edge})"))
    return F.transform(matches(text, pattern), lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, support: int = 20) -> DataFrame:
    """(key, spans) for every row: base spans by kind and start, then ``term`` spans by start."""
    found = cut(found_entities(docs, id_col, text_col))
    terms = revealing_terms(found, docs, text_col, threshold, support)
    kinds = F.array_distinct(F.transform("spans", lambda s: s["kind"]))
    values = found.filter("masked is not null").select("key", kinds.alias("kinds"), F.explode(_terms(F.col("masked"))).alias("value")).withColumn("term", F.lower("value"))
    held = values.join(bounded(terms, terms.count()), "term").filter(F.array_contains("kinds", F.col("kind"))).groupBy("key").agg(F.collect_set("value").alias("values"))
    marks = F.when(F.col("values").isNotNull(), _term_spans(F.col("masked"), F.col("values"))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return found.join(held, "key", "left").select("key", F.concat("spans", marks).alias("spans"))


def texts_with(terms: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, values) of the rows that hold one of ``terms``; values are its spellings there."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = docs.select(_key(id_col, text).alias("key"), F.explode(_terms(text)).alias("value"))
    wanted = cut(terms.select("term").distinct())
    held = values.withColumn("term", F.lower("value")).join(bounded(wanted, wanted.count()), "term")
    return held.groupBy("key").agg(F.collect_set("value").alias("values"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, support: int = 20) -> DataFrame:
    """``docs`` with entities, and revealing terms wherever they stand, generalised in the text column."""
    found = cut(found_entities(docs, id_col, text_col))
    terms = revealing_terms(found, docs, text_col, threshold, support)
    based = found.filter(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"])
    if terms.isEmpty():
        marked = cut(based.withColumn("values", F.lit(None).cast("array<string>")))
    else:
        marked = cut(based.join(texts_with(terms, docs, id_col, text_col), "key", "full"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"c{k}" for k in range(len(docs.columns))]
    renamed = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], _key(id_col, text).alias("doc_key"))
    own = F.col(names[docs.columns.index(text_col)])
    joined = renamed.join(bounded(marked, marked.count(), 100_000), renamed.doc_key == marked.key, "left")
    none = F.array().cast(f"array<{_SPAN}>")
    base = F.coalesce("spans", none)
    staged = joined.withColumn("base", base).withColumn("shown", F.when(F.col("values").isNotNull(), masked(own, F.col("base"))))
    staged = staged.withColumn("all", F.concat("base", F.when(F.col("values").isNull(), none).otherwise(_term_spans(F.col("shown"), F.col("values")))))
    clean = F.when(F.size("all") == 0, own).otherwise(redact(own, F.col("all")))
    return staged.select(*[(clean if c == text_col else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """The registered query's rows, from the operator's spans."""
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return detect(docs).select(
        F.col("key.id").alias("doc_id"),
        *[F.size(_only(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(table(spark, sf_dir, "documents"))


def _places_sql(text: str, pattern: str) -> str:
    """DuckDB: list of (start, end, value) of the pattern's matches in an expression."""
    found, gaps = f"regexp_extract_all({text}, '{pattern}')", f"string_split_regex({text}, '{pattern}')"
    before = f"coalesce(list_sum(list_transform(({found})[1:i - 1], lambda x: length(x))), 0) + list_sum(list_transform(({gaps})[1:i], lambda x: length(x)))"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': CAST({before} AS BIGINT), 'e': CAST({before} + length(({found})[i]) AS BIGINT), 'v': ({found})[i]}})"


#: The contract's patterns, as plain leftmost regular expressions, and their checks.
_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(p.v, '.'), lambda x: TRY_CAST(x AS HUGEINT) <= 255))"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k: CASE WHEN (length(digits) - k) % 2 = 0 THEN CAST(digits[k] AS INT) "
        "WHEN CAST(digits[k] AS INT) > 4 THEN 2 * CAST(digits[k] AS INT) - 9 ELSE 2 * CAST(digits[k] AS INT) END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
}


def digest_sql(threshold: float = 0.8, support: int = 20) -> str:
    """DuckDB SQL for the rows of ``span_digest``."""
    kinds = " UNION ALL ".join(
        f"SELECT rid, {n} AS nth, '{kind}' AS kind, p.s AS s, p.e AS e FROM (SELECT rid, p, regexp_replace(p.v, '[^0-9]', '', 'g') AS digits "
        f"FROM (SELECT rid, unnest({_places_sql('text', pattern)}) AS p FROM docs WHERE regexp_matches(text, '{pattern}'))) WHERE {valid}"
        for n, (kind, (pattern, valid)) in enumerate(_SQL_KINDS.items())
    )
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in KINDS)
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
ent AS MATERIALIZED ({kinds}),
runs AS (
  SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS v, unnest(g[1:len(m)]) AS gap
  FROM (SELECT rid, regexp_extract_all(text, '{term}') AS m, string_split_regex(text, '{term}') AS g FROM docs WHERE rid IN (SELECT rid FROM ent))
),
placed AS (SELECT rid, v, sum(length(gap) + length(v)) OVER (PARTITION BY rid ORDER BY i) AS e FROM runs),
terms AS MATERIALIZED (
  SELECT rid, lower(v) AS term, e - length(v) AS s, e FROM placed p
  WHERE regexp_matches(v, '[^0-9]') AND NOT EXISTS (SELECT 1 FROM ent x WHERE x.rid = p.rid AND x.s < p.e AND p.e - length(p.v) < x.e)
),
kinds_of AS (SELECT DISTINCT rid, kind FROM ent),
together AS (
  SELECT term, kind, count(*) AS n FROM (SELECT DISTINCT rid, term FROM terms) JOIN kinds_of USING (rid) GROUP BY ALL HAVING count(*) >= {support}
),
known AS (
  SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{term}'))) AS term FROM docs)
  WHERE term IN (SELECT term FROM together) GROUP BY term
),
rarity AS (
  SELECT kind, (SELECT count(*) FROM docs)::DOUBLE / count(*) AS r FROM kinds_of GROUP BY kind
),
revealing AS (
  SELECT t.term, t.kind FROM together t JOIN known k ON k.term = t.term JOIN rarity USING (kind)
  WHERE r > 1 AND ln(t.n::DOUBLE / k.n * r) / ln(r) >= {threshold}
),
marks AS (
  SELECT rid, string_agg('{TERM}:' || s || ':' || e, ',' ORDER BY s) AS listed
  FROM (SELECT DISTINCT rid, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM terms JOIN kinds_of USING (rid) JOIN revealing USING (term, kind)) GROUP BY rid
),
base AS (
  SELECT rid, {sums}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY nth, s) AS listed FROM ent GROUP BY rid
)
SELECT doc_id, {counts}, sha256(coalesce(b.listed, '')) AS base_sha256, concat_ws(',', b.listed, m.listed) AS spans
FROM docs LEFT JOIN base b USING (rid) LEFT JOIN marks m USING (rid)
"""
