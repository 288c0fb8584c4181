"""Language-model scores by context-tree weighting, beside a unigram base score.

The model predicts bytes of the lower-cased words joined by single spaces, then
one end byte. A byte is eight binary decisions; each decision has its own tree of
contexts of zero to five preceding bytes. Every context holds a
Krichevsky-Trofimov estimate, and context-tree weighting mixes the estimates of
all depths by how well each explained the training bytes. Every context that the
training texts have is a node, so the tree grows with the corpus.

The tree is a table of counts, dealt by the last three context bytes: all deeper
contexts of these meet in one task (at most 2**24 strings, whatever the corpus), and
the contexts of two bytes and less, of which there are 2**16, are summed up and held by
the driver. The ``frequent`` most frequent strings of context and byte are looked up in
a broadcast table; all others are answered by the table's tasks and joined by shuffle.

For the base score, words that make up at least 1 / ``frequent`` of the training
tokens (hence at most ``frequent`` words) are looked up in a broadcast table; all
others are joined by shuffle. The end of a text is a token of its own.

Edge cases: null text counts as empty: one token, the end. Every row has a number of
its own, so repeated rows keep their result row. With no training row every token has
count 0 and every byte decision chance one half. A null id is never trained on and is
held out. Very long texts are worked on whole, a megabyte of texts at a time. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import as_bytes, cut, doc_fold, table

DEPTH = 5
#: Context bytes by which the tree's table is dealt to tasks.
DEALT = 3
END = b"\n"
#: Key of a row that is no word, and code of one that is no string of bytes.
NO_WORD, NO_CODE = b"", -1


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, then the end."""
    return [*text.lower().split(), END]


def spelled(words: list[bytes]) -> bytes:
    """The bytes that the model predicts for ``tokens``."""
    return b" ".join(words[:-1]) + END


def _blocks(texts: list[bytes], block_bytes: int = 1_000_000) -> Iterator[tuple[int, int]]:
    start = size = 0
    for at, text in enumerate(texts):
        if at > start and size + len(text) > block_bytes:
            yield start, at
            start, size = at, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code of every byte of ``texts``, and each text's first place.

    A code is the context bytes, the latest highest, then the byte. Every text starts in
    the context of ``DEPTH`` end bytes.
    """
    lengths = np.array([len(t) for t in texts])
    buffer = np.frombuffer(END * DEPTH + (END * (DEPTH - 1)).join(texts), np.uint8).astype(np.int64)
    codes = buffer[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        codes |= buffer[DEPTH - back : -back] << 8 * (DEPTH + 1 - back)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    own = np.ones(len(codes), bool)
    pads = (np.cumsum(lengths)[:-1] + np.arange(len(texts) - 1) * (DEPTH - 1))[:, None] + np.arange(DEPTH - 1)
    own[pads.ravel()] = False
    return codes[own], starts


class _Counts:
    """Counts of one task, given out whenever they grow beyond ``room`` entries."""

    def __init__(self, room: int = 250_000):
        self.room, self.words, self.codes, self.held = room, Counter(), [], 0

    def add(self, texts: list[bytes]) -> None:
        spelt = []
        for text in texts:
            words = tokens(text)
            self.words.update(words)
            spelt.append(spelled(words))
        codes, many = np.unique(grams(spelt)[0], return_counts=True)
        self.codes.append((codes, many))
        self.held += len(codes)
        if self.held > 4 * self.room:
            self._merge()

    def _merge(self) -> None:
        codes, where = np.unique(np.concatenate([c for c, _ in self.codes]), return_inverse=True)
        many = np.bincount(where, np.concatenate([n for _, n in self.codes])).astype(np.int64)
        self.codes, self.held = [(codes, many)], len(codes)

    def full(self) -> bool:
        return len(self.words) > self.room or self.held > 2 * self.room and len(self.codes) == 1

    def give(self) -> pa.RecordBatch:
        words, codes, many = list(self.words), np.empty(0, np.int64), np.empty(0, np.int64)
        if self.codes:
            self._merge()
            codes, many = self.codes[0]
        key = pa.array(words + [NO_WORD] * len(codes), pa.binary())
        code = pa.array(np.concatenate([np.full(len(words), NO_CODE), codes]))
        n = pa.array(np.concatenate([np.fromiter(self.words.values(), np.int64, len(words)), many]))
        self.words, self.codes, self.held = Counter(), [], 0
        return pa.RecordBatch.from_arrays([key, code, n], names=["word", "code", "n"])


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, code, n): counts of all words, and of all strings of context and byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in _blocks(texts):
                counts.add(texts[a:b])
                if counts.full():
                    yield counts.give()
        yield counts.give()

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, code long, n long")
    return partial.groupBy("word", "code").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + k) for k in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of the counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _decisions(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions of the codes' bytes: its place (1 to 255) and its outcome."""
    byte = codes & 255
    for bit in range(8):
        yield 1 << bit | byte >> (8 - bit), byte >> (7 - bit) & 1


def _keys(codes: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Key of the node of ``depth`` context bytes and a decision's place."""
    return codes >> 8 * (DEPTH + 1 - depth) << 8 | places


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[first], *(np.add.reduceat(c[order], first) for c in columns)


@dataclass(frozen=True)
class Level:
    """Nodes of one depth: sorted keys, chance of a one, and the share of the mixture that stops here."""

    keys: np.ndarray
    one: np.ndarray
    share: np.ndarray


#: Sorted keys with zeros, ones and the log probability of what lies below.
Sums = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _level(sums: Sums, leaf: bool) -> tuple[Level, Sums]:
    """A depth's nodes, and the sums for their parents."""
    keys, zeros, ones, below = sums
    stop = _log_kt(zeros, ones)
    both = stop if leaf else np.logaddexp(stop, below)
    level = Level(keys, (ones + 0.5) / (zeros + ones + 1), np.exp(stop - both))
    return level, _summed(keys >> 16 << 8 | keys & 255, zeros, ones, both if leaf else both - math.log(2))


def _leaf_sums(codes: np.ndarray, n: np.ndarray) -> Sums:
    keys, zeros, ones = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0)]
    for places, outcome in _decisions(codes):
        keys.append(_keys(codes, places, DEPTH))
        zeros.append(n * (1.0 - outcome))
        ones.append(n * outcome.astype(float))
    k, z, o = _summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))
    return k, z, o, np.zeros(len(k))


def deep_levels(codes: np.ndarray, n: np.ndarray) -> tuple[list[Level], Sums]:
    """The levels from ``DEALT`` to ``DEPTH`` of some contexts' strings, and what they sum up to above."""
    sums, levels = _leaf_sums(codes, n), []
    for depth in range(DEPTH, DEALT - 1, -1):
        level, sums = _level(sums, depth == DEPTH)
        levels.insert(0, level)
    return levels, sums


def top_levels(sums: Sums) -> list[Level]:
    """The levels above ``DEALT``, from their lowest one's sums."""
    levels = []
    for _ in range(DEALT):
        level, sums = _level(sums, False)
        levels.insert(0, level)
    return levels


def log10_chances(codes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the chance of each code's byte in its context; ``levels`` are those of all depths."""
    out = np.zeros(len(codes))
    for places, outcome in _decisions(codes):
        chance = np.full(len(codes), 0.5)
        for depth in range(DEPTH, -1, -1):
            level, keys = levels[depth], _keys(codes, places, depth)
            if not len(level.keys):
                continue
            at = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
            mixed = level.share[at] * level.one[at] + (1 - level.share[at]) * chance
            chance = np.where(level.keys[at] == keys, mixed, chance)
        out += np.log10(np.where(outcome == 1, chance, 1 - chance))
    return out


def _by_context(rows: DataFrame, work, schema: str, per_task: int = 400_000, room: int = 200_000) -> DataFrame:
    """``work(codes, n)`` on rows (code, n) dealt by context, some whole contexts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size < room:
                continue
            codes, n = (np.concatenate(side) for side in zip(*held, strict=True))
            context = codes >> 8 * (DEPTH + 1 - DEALT)
            whole = int(np.searchsorted(context, context[-1])) if len(context) else 0
            if whole:
                yield work(codes[:whole], n[:whole])
            held, size = [(codes[whole:], n[whole:])], 0
        if held:
            yield work(*(np.concatenate(side) for side in zip(*held, strict=True)))

    parts = max(1, math.ceil(rows.count() / per_task), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, F.shiftright("code", 8 * (DEPTH + 1 - DEALT))).sortWithinPartitions("code")
    return dealt.select("code", "n").mapInArrow(run, schema)


def fit_top(coded: DataFrame) -> list[Level]:
    """The tree's levels above ``DEALT`` from (code, n); at most 255 numbers for each of 2**16 contexts are collected."""

    def work(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in deep_levels(codes, n)[1]], names=["key", "zeros", "ones", "below"])

    parts = _by_context(coded, work, "key long, zeros double, ones double, below double")
    found = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).orderBy("key").toArrow()
    return top_levels(tuple(found.column(c).to_numpy() for c in ("key", "zeros", "ones", "below")))


def code_chances(coded: DataFrame, wanted: DataFrame, top: list[Level]) -> DataFrame:
    """(code, log10) for each of the distinct ``wanted`` codes, whether training has them or not."""
    shared = coded.sparkSession.sparkContext.broadcast(top)

    def work(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        asked = codes[n == 0]
        levels = [*shared.value, *deep_levels(codes[n > 0], n[n > 0])[0]]
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(log10_chances(asked, levels))], names=["code", "log10"])

    return _by_context(coded.unionByName(wanted.select("code", F.lit(0).cast("long").alias("n"))), work, "code long, log10 double")


def frequent_codes(coded: DataFrame, most: int) -> DataFrame:
    """The codes of (code, n) in the highest sixteenths of a doubling of n that hold ``most`` codes at most."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = coded.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("codes")).orderBy(F.desc("step")).collect()
    least, total = 1 << 30, 0
    for r in sizes:
        total += r["codes"]
        if total > most:
            break
        least = r["step"]
    return coded.filter(step >= least).select("code")


@dataclass(frozen=True)
class Frequent:
    """Totals, log10 chances of the frequent words, and those of the frequent codes (sorted)."""

    total: int
    distinct: int
    words: dict[bytes, float]
    codes: np.ndarray
    log10: np.ndarray


def fit_frequent(counts: DataFrame, coded: DataFrame, top: list[Level], frequent: int = 1 << 20, longest: int = 64) -> Frequent:
    words = counts.filter(F.col("code") == NO_CODE)
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = words.filter((F.col("n") * frequent >= total) & (F.length("word") <= longest)).select("word", "n").toArrow()
    space = math.log10(total + distinct + 1)
    log10 = (np.log10(common.column("n").to_numpy() + 1.0) - space).tolist()
    known = code_chances(coded, frequent_codes(coded, frequent), top).orderBy("code").toArrow()
    codes, chances = known.column("code").to_numpy(), known.column("log10").to_numpy().astype(np.float32)
    return Frequent(total, distinct, dict(zip(common.column("word").to_pylist(), log10, strict=True)), codes, chances)


_ROW = "k long, id long, word binary, code long, tf long, n_tokens long, n_known long, base double, score double, n_bytes long"


def _scored_rows(docs: DataFrame, id_col: str, text_col: str, frequent: Frequent) -> DataFrame:
    """A head row for each document, and a row for each rare word and each rare code of it."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [c.split(" ")[0] for c in _ROW.split(", ")]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            keys, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            for a, b in _blocks(texts):
                split = [tokens(t) for t in texts[a:b]]
                spelt = [spelled(w) for w in split]
                codes, starts = grams(spelt)
                at = np.minimum(np.searchsorted(model.codes, codes), max(0, len(model.codes) - 1))
                hit = model.codes[at] == codes if len(model.codes) else np.zeros(len(codes), bool)
                known = np.where(hit, model.log10[at], 0.0).astype(np.float64) if len(model.codes) else np.zeros(len(codes))
                scores = np.add.reduceat(known, starts)
                out: list[tuple] = []
                for key, doc_id, words, score, text in zip(keys[a:b], ids[a:b], split, scores.tolist(), spelt, strict=True):
                    found = list(map(model.words.get, words))
                    rare = Counter(w for w, x in zip(words, found, strict=True) if x is None) if None in found else {}
                    n_known = len(words) - rare.total() if rare else len(words)
                    base = sum(x for x in found if x is not None) if rare else sum(found)
                    # a key of its own: no word holds the end byte
                    out.append((key, doc_id, END + key.to_bytes(8, "big"), NO_CODE, 0, len(words), n_known, base, score, len(text)))
                    out += [(key, None, w, NO_CODE, n, 0, 0, 0.0, 0.0, 0) for w, n in rare.items()]
                missed = np.nonzero(~hit)[0]
                if len(missed):
                    of = np.searchsorted(starts, missed, "right") - 1
                    each, many = np.unique(np.stack([of, codes[missed]], 1), axis=0, return_counts=True)
                    out += [(keys[a + d], None, NO_WORD, code, n, 0, 0, 0.0, 0.0, 0) for (d, code), n in zip(each.tolist(), many.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    numbered = docs.select(F.monotonically_increasing_id().alias("k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(run, _ROW)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 20) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row."""
    counts = cut(corpus_counts(docs.filter(train), text_col))
    coded = counts.filter(F.col("code") != NO_CODE).select("code", "n")
    top = fit_top(coded)
    model = fit_frequent(counts, coded, top, frequent)
    rows = cut(_scored_rows(docs, id_col, text_col, model))
    asked = rows.filter(F.col("code") != NO_CODE).select("code").distinct()
    answers = code_chances(coded, asked, top).select(F.lit(NO_WORD).alias("word"), "code", F.lit(None).cast("long").alias("n"), "log10")
    known = counts.filter(F.col("code") == NO_CODE).select("word", "code", "n", F.lit(None).cast("double").alias("log10"))
    space = F.lit(math.log10(model.total + model.distinct + 1))
    is_word = (F.col("tf") > 0) & (F.col("code") == NO_CODE)
    summed = (
        rows.join(known.unionByName(answers), ["word", "code"], "left")
        .select(
            "k", "id", "n_tokens", "n_bytes",
            (F.col("n_known") + F.when(is_word & F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
            (F.col("base") + F.when(is_word, F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - space)).otherwise(0.0)).alias("base"),
            (F.col("score") + F.when(F.col("code") != NO_CODE, F.col("tf") * F.col("log10")).otherwise(0.0)).alias("score"),
        )
        .groupBy("k")
        .agg(F.min("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")])
    )
    return summed.select(
        F.col("id").alias(id_col), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(doc_fold(id_col, 7) == 2, F.lit(True))


def document_scores(docs: DataFrame) -> DataFrame:
    """The registered query's rows."""
    found = score(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_scores(table(spark, sf_dir, "documents"))
