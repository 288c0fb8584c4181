"""Quality rules under weak supervision.

Each rule votes good (1) or bad (-1) on a document or abstains (0). Rules about one
kind of defect form a family. For each family expectation-maximisation over the table
of vote patterns estimates how often its rules cast each vote on sound and on
defective documents and how many documents are sound; a document's quality is the
probability that it has none of the defects, and it is kept from one half on. So a
single wrong vote is outvoted by the rest of its family, and a rule counts as much as
it agrees with them. The pattern table has at most 3 ** (number of rules) rows,
whatever the corpus, and is all that reaches the driver.

Edge cases: null, empty and wordless texts have zero counts and fail the base
rules. Repeated rows keep their own result row. A quality of just one half is kept.
Very long texts are counted whole. With no documents every quality is undefined and
no row is returned. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow_map, cut, table

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLOSERS = (".", "!", "?", ":", ";", '"', "'", ")", "…")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_letters", "n_upper", "n_shouts", "n_runs", "n_bare", "n_distinct")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in a window of ``width`` words that is found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    number: dict[tuple, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), np.int64, n)
    if len(number) == n:
        return 0
    twice = np.bincount(ids)[ids] > 1
    inside = np.zeros(len(words), bool)
    for k in range(width):
        inside[k : k + n] |= twice
    return int(inside.sum())


def counts(text: str) -> tuple[int, ...]:
    """The counts named in ``COUNTS``, over the whole text."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(line.rstrip(_SPACES).endswith(_CLOSERS) for line in lines),
        *_case(text),
        text.count("!"),
        sum(text.count(c + c) for c in _SYMBOLS + "!?"),
        _bare(words),
        len(set(words)),
    )


def _bare(words: list[bytes]) -> int:
    """Words of ASCII punctuation alone."""
    return sum(not w.strip(_PUNCTUATION) for w in words)


def _case(text: str) -> tuple[int, int]:
    """ASCII letters, and those of them in upper case."""
    raw = np.frombuffer(text.encode(), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    return upper + int(((raw >= 97) & (raw <= 122)).sum()), upper


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, then ``COUNTS`` as longs) for every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [counts(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *COUNTS])

        return step

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(slim, make, "id long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Votes as expressions over the count columns."""
    graded = lambda share, good, bad: _vote(share <= good, share > bad)
    length, closed, distinct, capitals = (_share(*of) for of in (("word_chars", "n_words"), ("n_closed_lines", "n_lines"), ("n_distinct", "n_words"), ("n_upper", "n_letters")))
    return {
        "symbols": graded(_share("n_symbols", "n_words"), 0.01, 0.1),
        "symbol_runs": graded(_share("n_runs", "n_words"), 0.01, 0.1),
        "bare_symbols": graded(_share("n_bare", "n_words"), 0.01, 0.1),
        "copied_lines": graded(_share("n_dup_lines", "n_lines"), 0.2, 0.25),
        "copied_words": graded(_share("n_repeat_words", "n_words"), 0.15, 0.2),
        "few_words": _vote(distinct >= 0.5, distinct < 0.45),
        "capitals": _vote((capitals >= 0.003) & (capitals <= 0.1), capitals > 0.3),
        "shouting": graded(_share("n_shouts", "n_words"), 0.02, 0.2),
        "closed_lines": _vote(closed >= 0.75, closed < 0.25),
        "word_length": _vote((length >= 3) & (length <= 9), (length < 2) | (length > 14)),
    }


#: The rules about each kind of defect.
FAMILIES = {
    "symbols": ("symbols", "symbol_runs", "bare_symbols"),
    "repetition": ("copied_lines", "copied_words", "few_words"),
    "case": ("capitals", "shouting", "symbol_runs"),
    "form": ("closed_lines", "word_length", "capitals"),
}


@dataclass(frozen=True)
class LabelModel:
    """Share of sound documents, and the log odds of sound that each rule's votes -1, 0 and 1 add.

    ``right`` is how often each rule's votes agree with the posterior.
    """

    prior: float
    odds: tuple[tuple[float, float, float], ...]
    right: tuple[float, ...]

    def probability(self, votes: list[Column]) -> Column:
        start = F.lit(float(np.log(self.prior / (1 - self.prior))))
        terms = [F.element_at(F.array(*map(F.lit, each)), vote + 2) for vote, each in zip(votes, self.odds, strict=True)]
        return 1 / (1 + F.exp(-reduce(add, terms, start)))


def estimate(patterns: np.ndarray, weights: np.ndarray, rounds: int = 300, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns (rows) and their counts.

    Starts from the majority of the votes; ``smooth`` is added to every count.
    """
    cast = np.stack([(patterns == v).astype(float) for v in (-1, 0, 1)])
    sound = ((cast[2].sum(1) + 1) / (cast[0].sum(1) + cast[2].sum(1) + 2)) if len(patterns) else np.empty(0)
    prior, odds, last = 0.5, np.zeros((3, patterns.shape[1])), None
    for _ in range(rounds):
        w1, w0 = weights * sound, weights * (1 - sound)
        prior = float((w1.sum() + smooth) / (weights.sum() + 2 * smooth))
        odds = np.log((w1 @ cast + smooth) / (w1.sum() + 3 * smooth)) - np.log((w0 @ cast + smooth) / (w0.sum() + 3 * smooth))
        now = np.log(prior / (1 - prior)) + np.einsum("vpr,vr->p", cast, odds)
        sound = 1 / (1 + np.exp(-now))
        if last is not None and np.abs(now - last).max(initial=0) < 1e-9:
            break
        last = now
    w1, w0 = weights * sound, weights * (1 - sound)
    right = (w1 @ cast[2] + w0 @ cast[0] + smooth) / (weights @ (cast[0] + cast[2]) + 2 * smooth)
    return LabelModel(prior, tuple(map(tuple, odds.T.tolist())), tuple(right.tolist()))


def fit(counted: DataFrame, votes: dict[str, Column], families: dict[str, tuple[str, ...]]) -> dict[str, LabelModel]:
    seen = counted.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().orderBy(*votes).collect()
    out = {}
    for family, names in families.items():
        many: dict[tuple[int, ...], int] = {}
        for r in seen:
            pattern = tuple(r[n] for n in names)
            many[pattern] = many.get(pattern, 0) + r["count"]
        out[family] = estimate(np.array(sorted(many), np.int64).reshape(-1, len(names)), np.array([many[p] for p in sorted(many)], float))
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """(id_col, counts, votes, quality, kept): ``quality`` is the probability of no defect."""
    counted = cut(document_counts(docs, id_col, text_col))
    votes = rules()
    models = fit(counted, votes, FAMILIES)
    voted = counted.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()])
    sound = [models[family].probability([F.col(f"vote_{n}") for n in names]) for family, names in FAMILIES.items()]
    return voted.withColumn("quality", reduce(mul, sound)).withColumn("kept", F.col("quality") >= keep_from)


def verdicts(docs: DataFrame) -> DataFrame:
    """The registered query's rows."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("kept")).alias("kept"),
        "quality",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
