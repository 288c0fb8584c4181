"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed, a run of ``min_match`` words, are
joined. For each such pair the longest common unmarked runs of words are marked as
tiles, longest first, until none of ``min_match`` words is left; runs are found by a
running Karp-Rabin search over the window length. A pair counts as a leak when tiles
cover at least ``threshold`` of the item's words, in whatever order they stand in
the document.

Words are lower-cased; ASCII punctuation separates them. The seeds of the benchmark
are a table. Only a bitmap of their hashes, of a fixed size whatever the
benchmark, goes to all tasks; the document seeds that it lets pass meet the table by
an equi-join, and no more than the texts of pairs with enough seeds are compared.

Edge cases: null or empty texts match nothing. An item of fewer than ``min_match``
words is sought whole. Repeated documents and repeated items each give their own
rows. Ties between equally long runs go to the lesser item position, then document
position. Very long texts, of one word repeated too, cost time in proportion to
their length for each tile. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow_map, bounded, cut, table, text_key

_PUNCTUATION = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalnum()), b" " * sum(not chr(b).isalnum() for b in range(128)))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_hash = partial(xxhash.xxh64_intdigest, seed=1)
#: Rows that a query returns for each leaking pair.
PAIR_SCHEMA = "id long, item_id long, item_words int, matched_words int, n_tiles int, longest_tile int, coverage double, tiles array<struct<item_at:int,doc_at:int,words:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def word_ids(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(_hash, words_of(text)), np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]), dtype=np.uint64)


class Windows:
    """Karp-Rabin hashes, modulo 2**64, of all windows of a sequence for any length."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * _powers(_BASE, len(ids)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(ids))

    def hashes(self, k: int) -> np.ndarray:
        n = len(self.ids) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        return (self.sums[k:] - self.sums[:-k]) * self.back[:n]


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` ids."""
    return Windows(ids).hashes(k)


class _Free:
    """A sequence's unmarked words."""

    def __init__(self, ids: np.ndarray):
        self.windows, self.marked = Windows(ids), np.zeros(len(ids), bool)

    def starts(self, k: int) -> np.ndarray:
        """Starts of the windows of ``k`` that hold no marked word."""
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        return np.nonzero(taken[k:] == taken[:-k])[0] if k < len(taken) else np.empty(0, np.int64)


def _longest(item: _Free, doc: _Free, low: int, high: int) -> tuple[int, int, int] | None:
    """The longest common unmarked run of ``low`` to ``high`` words, as (item_at, doc_at, words)."""

    def shared(k: int) -> tuple[np.ndarray, np.ndarray] | None:
        i, j = item.starts(k), doc.starts(k)
        here, there = item.windows.hashes(k)[i], doc.windows.hashes(k)[j]
        i = i[np.isin(here, there)]
        return (i, j[np.isin(there, here)]) if len(i) else None

    best = None
    while low <= high:
        k = (low + high) // 2
        found = shared(k)
        if found:
            best, low = (k, *found), k + 1
        else:
            high = k - 1
    if best is None:
        return None
    k, i, j = best
    doc_hashes = doc.windows.hashes(k)[j]
    for at in i.tolist():
        for place in j[doc_hashes == item.windows.hashes(k)[at]].tolist():
            if np.array_equal(item.windows.ids[at : at + k], doc.windows.ids[place : place + k]):
                return at, place, k
    return None


def greedy_tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (item_at, doc_at, words) of greedy string tiling, longest first."""
    a, b, tiles = _Free(item.astype(np.uint64)), _Free(doc.astype(np.uint64)), []
    longest = min(len(item), len(doc))
    while found := _longest(a, b, min_match, longest):
        i, j, longest = found
        a.marked[i : i + longest] = b.marked[j : j + longest] = True
        tiles.append(found)
    return tiles


def shared_part(item: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``doc`` that stand in windows of ``width`` that the item has, and their places.

    Runs that are not next to each other are parted by a word that no text has.
    """
    hits = np.nonzero(np.isin(window_hashes(doc, width), window_hashes(item, width)))[0]
    inside = np.zeros(len(doc) + 1, np.int64)
    np.add.at(inside, hits, 1)
    np.add.at(inside, hits + width, -1)
    at = np.nonzero(np.cumsum(inside[:-1]) > 0)[0]
    gaps = np.nonzero(np.diff(at) > 1)[0] + 1
    return np.insert(doc[at], gaps, np.uint64(0)), np.insert(at, gaps, -1)


def tiles_of(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """``greedy_tiles``, looking only at the part of ``doc`` that can match."""
    width = min(min_match, len(item))
    part, places = shared_part(item, doc, width)
    return [(i, int(places[j]), n) for i, j, n in greedy_tiles(item, part, width)]


def _seeds(items: DataFrame, min_match: int) -> DataFrame:
    """(h, width, item, item_at, words): the seeds of (item, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[np.empty(0, np.uint64)], [], [], [], []]
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = word_ids(text)
                width = min(min_match, len(ids))
                if width:
                    hashes = window_hashes(ids, width)
                    out[0].append(hashes)
                    for column, values in zip(out[1:], ([width] * len(hashes), [item] * len(hashes), range(len(hashes)), [len(ids)] * len(hashes)), strict=True):
                        column += values
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            columns = [pa.array(np.concatenate(out[0]).view(np.int64)), *[pa.array(c, t) for c, t in zip(out[1:], types, strict=True)]]
            return pa.RecordBatch.from_arrays(columns, names=["h", "width", "item", "item_at", "words"])

        return step

    return arrow_map(items, make, "h long, width int, item long, item_at int, words int")


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """A bit for each residue modulo 2**``bits`` of the seeds' hashes: 2**``bits`` / 8 bytes at most reach the driver."""
    residue = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = residue.alias("r"), F.shiftright(residue, 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(r & 63 as int))")
    set_words = seeds.select(*words).groupBy("word").agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[set_words.column("word").to_numpy()] = set_words.column("bits").to_numpy()
    return out.view(np.uint64)


def _document_seeds(docs: DataFrame, widths: list[int], bitmap: np.ndarray) -> DataFrame:
    """(id, key, width, hits) of rows (id, key, text) with hashes that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    mask = np.uint64(len(bitmap) * 64 - 1)

    def make():
        known = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, found, each = [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                if not text:
                    continue
                windows = Windows(word_ids(text))
                for width in widths:
                    hashes = windows.hashes(width)
                    residue = hashes & mask
                    hashes = np.unique(hashes[known[residue >> np.uint64(6)] >> (residue & np.uint64(63)) & np.uint64(1) == 1])
                    if len(hashes):
                        row.append(at)
                        each.append(width)
                        found.append(hashes.view(np.int64))
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            rows = pa.array(row, pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(each, pa.int32()), hits]
            return pa.RecordBatch.from_arrays(columns, names=["id", "key", "width", "hits"])

        return step

    return arrow_map(docs, make, "id long, key binary, width int, hits array<long>")


def _tiled(texts: DataFrame, min_match: int, threshold: float) -> DataFrame:
    """Leaking (key, item, ...) of rows (key, item, text, item_text)."""

    def make():
        held: tuple = ("", np.empty(0, np.uint64))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal held
            rows = []
            for key, item, text, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held[0] != key:
                    held = key, word_ids(text)
                words = word_ids(item_text)
                tiles = tiles_of(words, held[1], min_match)
                matched = sum(n for _, _, n in tiles)
                if tiles and matched >= threshold * len(words):
                    listed = [{"item_at": i, "doc_at": j, "words": n} for i, j, n in tiles]
                    rows.append((key, item, len(words), matched, len(tiles), max(n for _, _, n in tiles), matched / len(words), listed))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            types = [pa.binary(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.list_(pa.struct([(n, pa.int32()) for n in ("item_at", "doc_at", "words")]))]
            names = ["key", "item", "item_words", "matched_words", "n_tiles", "longest_tile", "coverage", "tiles"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        return step

    return arrow_map(texts, make, "key binary, item long, " + PAIR_SCHEMA.split(", ", 2)[2], slice_rows=64)


def _leaks(docs: DataFrame, benchmark: DataFrame, min_match: int, threshold: float, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, key) of ``docs`` (id, key, text) with a seed; leaks (key, item, ...) of their texts; items (item, item_id)."""
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").withColumn("item", F.monotonically_increasing_id()))
    seeds = cut(_seeds(items.select("item", "text"), min_match))
    widths = sorted(r[0] for r in seeds.select("width").distinct().collect())
    rows = cut(_document_seeds(docs, widths, _bitmap(seeds, bits)))
    hits = rows.groupBy("key", "width").agg(F.max("hits").alias("hits")).select("key", "width", F.explode("hits").alias("h"))
    n = seeds.count()
    # a seed covers ``width`` words at most, so too few of them cannot cover enough
    enough = F.col("seeds") * F.col("width") >= threshold * F.col("words")
    pairs = hits.join(bounded(seeds, n), ["h", "width"]).groupBy("key", "item", "width", "words").agg(F.count(F.lit(1)).alias("seeds")).filter(enough)
    pairs = cut(pairs.select("key", "item"))
    keys = cut(pairs.select("key").distinct())
    texts = docs.join(bounded(keys, keys.count()), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    both = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").join(texts, "key")
    found = cut(_tiled(both.select("key", "item", "text", "item_text"), min_match, threshold))
    return rows.select("id", "key", "width"), found, items.select("item", "item_id")


def leaking_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_match: int = 5,
    threshold: float = 0.5,
    bitmap_bits: int = 26,
) -> DataFrame:
    """One row for each (document, item) whose tiles cover ``threshold`` of the item."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows, found, items = _leaks(slim, benchmark, min_match, threshold, bitmap_bits)
    # a row stands once for each seed width; one of them speaks for it
    first = rows.join(rows.groupBy("key").agg(F.min("width").alias("width")), ["key", "width"])
    out = first.join(found, "key").join(items, "item")
    return out.select(F.col("id").alias(id_col), *[c.split(" ")[0] for c in PAIR_SCHEMA.split(", ")[1:]])


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = 5, threshold: float = 0.5, bitmap_bits: int = 26) -> DataFrame:
    """``docs`` without the rows whose text leaks an item."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    key = text_key(F.col(text_col)).alias("key")
    _, found, _ = _leaks(docs.select(F.lit(0).cast("long").alias("id"), key, F.col(text_col).alias("text")), benchmark, min_match, threshold, bitmap_bits)
    leaks = cut(found.select(F.col("key").alias("leak")).distinct())
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], key)
    kept = rows.join(bounded(leaks, leaks.count()), F.col("key") == F.col("leak"), "left_anti")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = leaking_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.drop("tiles")
