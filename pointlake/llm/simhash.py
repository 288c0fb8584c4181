"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are compared exactly: within a tile pair every pair of
fingerprints is XOR-ed and its bits counted in numpy, and tile pairs whose
population counts differ by more than the radius are skipped. Two
fingerprints within radius r agree on at least one of r + 1 bit bands, so
tiles are dealt to tasks by band value without losing a pair; buckets of few
fingerprints are compared by shifted copies instead of tiles.

``near_duplicates`` links by fingerprint alone. ``near_duplicate_texts`` links all
texts whose shingle sets are similar, whatever their fingerprints: fingerprint links
and the leaders of shared shingles are verified first, which joins large groups of
copies, and an exact prefix filter finds the pairs that are still apart.

Edge cases: null or empty text, or text without a word, has fingerprint zero
and links like any other. Repeated rows keep their own result row. A null id
never becomes a component id unless its whole component has none. Of several
possible links the least nodes win, so results do not depend on order. Very long
texts are fingerprinted whole, hashes 16,384 at a time. An empty table gives no
rows. Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.common import arrow_map, as_bytes, bounded, cut, frugal, join_rows, release, table, text_key
from pointlake.llm.graph import connected_components

BITS = 64
SEED = 42
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of ASCII-lower-cased, white-space-split words, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(_hash, grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): ``fp`` is the fingerprint's bits as a signed long."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = [fingerprint(t, shingle) for t in as_bytes(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["id", "fp"])

        return step

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(slim, make, "id long, fp long")


def _merge(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least reachable position for each of ``n`` positions under the given links."""
    label = np.arange(n)
    while len(left):
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def tile_links(prints: np.ndarray, radius: int, tile: int = 2048) -> np.ndarray:
    """For each fingerprint the position of the least one it is linked to, through any chain.

    ``prints`` (uint64) must be sorted by population count.
    """
    n = len(prints)
    ones = np.bitwise_count(prints).astype(np.int16)
    kept_left, kept_right = [], []
    for i in range(0, n, tile):
        a, a_ones = prints[i : i + tile], ones[i : i + tile]
        for j in range(i, n, tile):
            if int(ones[j]) - int(a_ones[-1]) > radius:
                break
            b = prints[j : j + tile]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            x, y = x + i, y + j
            apart = x != y
            if apart.any():
                both, where = np.unique(np.concatenate([x[apart], y[apart]]), return_inverse=True)
                label = _merge(len(both), where[: apart.sum()], where[apart.sum() :])
                moved = label != np.arange(len(both))
                kept_left.append(both[moved])
                kept_right.append(both[label[moved]])
    if not kept_left:
        return np.arange(n)
    return _merge(n, np.concatenate(kept_left), np.concatenate(kept_right))


def _small_bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """``tile_links`` for many short runs of equal ``keys`` at once, by comparing shifted copies."""
    left, right = [], []
    ones = np.bitwise_count(prints).astype(np.int16)
    for d in range(1, len(keys)):
        at = np.nonzero(keys[d:] == keys[:-d])[0]
        if not len(at):
            break
        at = at[ones[at + d] - ones[at] <= radius]
        at = at[np.bitwise_count(prints[at] ^ prints[at + d]) <= radius]
        left.append(at)
        right.append(at + d)
    if not left:
        return np.arange(len(keys))
    return _merge(len(keys), np.concatenate(left), np.concatenate(right))


def _bucket_edges(radius: int, short: int = 64):
    """mapInArrow body over rows (bucket, fp) sorted by bucket and population count."""

    def edges_of(bucket: np.ndarray, prints: np.ndarray) -> pa.RecordBatch | None:
        first = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
        size = np.diff(np.append(first, len(bucket)))
        of = np.repeat(size, size)
        out = []
        for rows in [np.nonzero((of > 1) & (of <= short))[0]] + [
            np.arange(s, s + k) for s, k in zip(first, size, strict=True) if k > short
        ]:
            if not len(rows):
                continue
            here = prints[rows]
            label = tile_links(here, radius) if size[np.searchsorted(first, rows[0], "right") - 1] > short else _small_bucket_links(bucket[rows], here, radius)
            moved = np.nonzero(label != np.arange(len(rows)))[0]
            if len(moved):
                out.append((here[moved].view(np.int64), here[label[moved]].view(np.int64)))
        if not out:
            return None
        a, b = (np.concatenate(side) for side in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            open_from = int(np.argmax(bucket == bucket[-1]))
            if held and held[-1][0][-1] != bucket[0] or open_from:
                ready = [*held, (bucket[:open_from], prints[:open_from])]
                done = edges_of(*(np.concatenate(side) for side in zip(*ready, strict=True)))
                held = []
                if done is not None:
                    yield done
            held.append((bucket[open_from:], prints[open_from:]))
        if held:
            done = edges_of(*(np.concatenate(side) for side in zip(*held, strict=True)))
            if done is not None:
                yield done

    return run


def link_edges(prints: DataFrame, radius: int = 3, bands: int | None = None, flips: int = 0, piece_rows: int = 32768) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` exactly as all links do.

    Each fingerprint is dealt to one bucket for each bit band and, with ``flips`` = 1, to
    those of all values one bit away. Two fingerprints within the radius then share a
    bucket if radius < bands * (2 * flips + 1), as some band differs in so few bits that
    flips on either side make up for it. A bucket of more than ``piece_rows`` rows is split
    into pieces, and every pair of its pieces is dealt to a task of its own, so no task
    ever holds more than two pieces.
    """
    bands = bands or radius + 1
    if flips not in (0, 1) or radius >= bands * (2 * flips + 1):
        raise ValueError("these bands and flips would miss links")
    edges = [round(k * BITS / bands) for k in range(bands + 1)]
    cuts = []
    for band, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        values = [value, *(value.bitwiseXOR(F.lit(1 << k)) for k in range(hi - lo) if flips)]
        cuts += [v.bitwiseOR(F.lit(band << 40)) for v in values]
    dealt = prints.select("fp", F.explode(F.array(*cuts)).alias("value"))
    large = cut(dealt.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece_rows))
    found = large.count()
    if found:
        pieces = large.select("value", F.ceil(F.col("n") / F.lit(piece_rows)).cast("long").alias("pieces"))
        split = dealt.join(bounded(pieces, found), "value", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("pieces"))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1))
        pairs = split.withColumn("mine", mine).select("fp", "value", "mine", others.alias("other"))
        bucket = F.xxhash64("value", F.least("mine", "other"), F.greatest("mine", "other"))
        spread = pairs.select(bucket.alias("bucket"), "fp")
    else:
        spread = dealt.select(F.xxhash64("value").alias("bucket"), "fp")
    sorted_rows = spread.repartition("bucket").sortWithinPartitions("bucket", F.bit_count("fp"))
    return sorted_rows.mapInArrow(frugal(_bucket_edges(radius)), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    piece_rows: int = 32768,
) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the least id in the
    connected component of fingerprints linked at ``radius`` or fewer differing bits.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    stars = connected_components(link_edges(distinct.select("fp"), radius, piece_rows=piece_rows))
    joined = stars.join(distinct, stars.node == distinct.fp).select("node", "root", "first_id")
    least = joined.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = joined.join(least, "root").select(F.col("node").alias("fp"), "least_id")
    by_print = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("least_id", "first_id").alias("component_id"))
    return join_rows(rows, cut(by_print), "fp", "n", rows.count()).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of a shorter text, of all its words."""
    split = text.lower().split()
    if not split:
        return np.empty(0, np.int64)
    grams = [b" ".join(split)] if len(split) < words else map(b" ".join, zip(*(split[k:] for k in range(words)), strict=False))
    return np.unique(np.fromiter(map(_hash, grams), np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least ``least``; empty sets are equal."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    if not large:
        return True
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (small + large - common)


def frequent_shingles(docs: DataFrame, words: int, share: int = 16, least: int = 8, most: int = 1 << 18) -> np.ndarray:
    """Hashes of shingles that many texts have, the rarest first, seen in one text of ``share``.

    They only order shingles: any list gives the same pairs, this one gives few candidates.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_hashes(t, words) for t in as_bytes(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], names=["h"])

        return step

    some = arrow_map(docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text"), make, "h long", slice_rows=128)
    counts = some.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).select("h").toArrow()
    return top.column("h").to_numpy()[::-1]


def prefix(shingles: np.ndarray, hot: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in the common order, as many as two sets of similarity ``least`` must share one of.

    The order is by hash, with the shingles in ``hot`` (sorted) last and by ``rank``.
    """
    n = len(shingles)
    if not n:
        return shingles
    known = np.zeros(n, bool)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        known = hot[at] == shingles
        late = shingles[known][np.argsort(rank[at[known]])]
        shingles = np.concatenate([shingles[~known], late])
    return shingles[: n - int(np.ceil(n * (least - 1e-9))) + 1]


SKETCH_BITS = 256


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each residue of the hashes modulo 256, whether their number is odd, as 32 bytes.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    return np.packbits(np.bincount(shingles & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1)


def long_sketch(shingles: np.ndarray) -> np.ndarray:
    """``sketch`` with two to four times as many residues as there are hashes, 1,024 at least."""
    bits = max(1024, 1 << int(2 * len(shingles)).bit_length())
    return np.packbits(np.bincount(shingles & (bits - 1), minlength=bits) & 1)


def sketches_apart(left: bytes, right: bytes) -> int:
    """In how many bits two long sketches differ, the longer one folded; the sets differ in as many shingles or more."""
    a, b = sorted((np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _signatures(docs: DataFrame, words: int, shingle: int, least: float, frequent: np.ndarray) -> DataFrame:
    """(id, key, fp, n, sketch, mark, heads) of rows (id, key, text).

    ``n`` is the number of shingles, ``mark`` their long sketch and ``heads`` their prefix.
    """
    rank = np.argsort(frequent, kind="stable")
    hot = frequent[rank]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = as_bytes(batch.column("text"))
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            sets = [shingle_hashes(t, words) for t in texts]
            heads = [prefix(s, hot, rank, least) for s in sets]
            offsets = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *heads])))
            marks = [pa.array([make_mark(s).tobytes() for s in sets], pa.binary()) for make_mark in (sketch, long_sketch)]
            n = pa.array([len(s) for s in sets], pa.int32())
            columns = [batch.column("id"), batch.column("key"), pa.array(prints), n, *marks, listed]
            return pa.RecordBatch.from_arrays(columns, names=["id", "key", "fp", "n", "sketch", "mark", "heads"])

        return step

    return arrow_map(docs, make, "id long, key binary, fp long, n int, sketch binary, mark binary, heads array<long>", slice_rows=128)


def near_pairs(prints: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, least: float, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y), x < y, of sets that meet and may be similar and are not of one component.

    ``prints`` (rows of uint64) are sketches, sorted by population count; ``n`` are the sets'
    sizes and ``at`` the places of the shingle that they meet by. Sets of similarity ``least``
    differ in (1 - least) / (1 + least) of their summed sizes at most, so in no more bits;
    tile pairs whose population counts differ by more are skipped.
    """
    ones = np.bitwise_count(prints).sum(1, dtype=np.int32)
    share, after = (1 - least) / (1 + least), n - at
    for i in range(0, len(n), tile):
        a = slice(i, i + tile)
        for j in range(i, len(n), tile):
            b = slice(j, j + tile)
            if ones[j] - ones[a][-1] > share * (n[a].max() + n[b].max()) + 1e-6:
                continue
            sizes = n[a][:, None] + n[b][None, :]
            fits = np.minimum(after[a][:, None], after[b][None, :]) >= sizes * (least / (1 + least)) - 1e-6
            fits &= comp[a][:, None] != comp[b][None, :]
            if i == j:
                fits &= ~np.tri(*fits.shape, dtype=bool)
            x, y = np.nonzero(fits)
            apart = np.bitwise_count(prints[a][x] ^ prints[b][y]).sum(1, dtype=np.int32)
            close = apart <= share * sizes[x, y] + 1e-6
            if close.any():
                yield x[close] + i, y[close] + j


def _short_pairs(bucket: np.ndarray, prints: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``near_pairs`` within many short runs of equal ``bucket`` at once, by comparing shifted copies."""
    here = np.arange(len(bucket))
    for d in range(1, len(bucket)):
        here = here[here + d < len(bucket)]
        here = here[bucket[here + d] == bucket[here]]
        if not len(here):
            return
        x, y = here, here + d
        sizes = n[x] + n[y]
        fits = (np.minimum(n[x] - at[x], n[y] - at[y]) >= sizes * (least / (1 + least)) - 1e-6) & (comp[x] != comp[y])
        x, y, sizes = x[fits], y[fits], sizes[fits]
        close = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int32) <= sizes * ((1 - least) / (1 + least)) + 1e-6
        yield x[close], y[close]


def nearest_pairs(x: np.ndarray, y: np.ndarray, apart: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which pairs are the closest of the group of either side; ``group`` is by position, ties go to the least (x, y)."""
    order = np.lexsort((y, x, apart))
    best = np.full(int(group.max()) + 1, len(order))
    for side in (x, y):
        np.minimum.at(best, group[side[order]], np.arange(len(order)))
    return order[np.unique(best[best < len(order)])]


def _meetings(least: float, nearest: bool, short: int = 64):
    """mapInArrow body over rows (bucket, node, n, at, comp, sketch) sorted by bucket: pairs that may be similar.

    With ``nearest``, of a bucket only each component's pair of least sketch distance.
    """

    def pairs_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        bucket, node, n, at, comp = (rows.column(c).to_numpy() for c in ("bucket", "node", "n", "at", "comp"))
        prints = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
        _, group = np.unique(np.stack([bucket, comp], 1), axis=0, return_inverse=True)

        def links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            x, y = (np.concatenate(side) for side in zip(*found, strict=True))
            if nearest and len(x):
                apart = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int32)
                kept = nearest_pairs(x, y, apart / (n[x] + n[y]), group.ravel())
                x, y = x[kept], y[kept]
            both = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        first = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0]
        size = np.diff(np.append(first, len(bucket)))
        small = np.nonzero(np.repeat(size <= short, size))[0]
        found = [(small[x], small[y]) for x, y in _short_pairs(bucket[small], prints[small], n[small], at[small], comp[small], least)]
        for start, many in zip(first[size > short], size[size > short], strict=True):
            own = start + np.argsort(np.bitwise_count(prints[start : start + many]).sum(1), kind="stable")
            found += [(own[x], own[y]) for x, y in near_pairs(prints[own], n[own], at[own], comp[own], least)]
            if sum(len(x) for x, _ in found) > 500_000:
                yield links(found)
                found = []
        if found:
            yield links(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = batch.column(0).to_numpy()
            open_from = int(np.argmax(bucket == bucket[-1]))
            if held and (held[-1].column(0)[-1].as_py() != bucket[0] or open_from):
                yield from pairs_of([*held, batch.slice(0, open_from)])
                held = []
            elif open_from:
                yield from pairs_of([batch.slice(0, open_from)])
            held.append(batch.slice(open_from))
        if held:
            yield from pairs_of(held)

    return run


def _close_sketches(least: float):
    """mapInArrow body over rows (a, b, n, m, left, right): pairs not shown to be apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [sketches_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            good = np.array(apart, np.int64) <= sizes * ((1 - least) / (1 + least)) + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _shingled(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_hashes(t, words) for t in as_bytes(batch.column(1))]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            return pa.RecordBatch.from_arrays([batch.column(0), shingles], names=["node", "shingles"])

        return step

    return arrow_map(texts, make, "node long, shingles array<long>", slice_rows=128)


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose texts' whole shingle sets are similar.

    ``texts`` has (node, id, key, n, mark) of each distinct text, ``docs`` the rows (id, key,
    text). Long sketches, which lose no similar pair, are compared before whole sets.
    """
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    own = cut(texts.join(bounded(nodes, nodes.count()), "node", "left_semi").select("node", "n", "mark"))
    left = own.select(F.col("node").alias("a"), "n", F.col("mark").alias("left"))
    right = own.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("mark").alias("right"))
    marked = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "left", "right")
    pairs = cut(marked.mapInArrow(frugal(_close_sketches(least)), "a long, b long"))
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = texts.join(nodes, "node", "left_semi").select("node", F.col("id").alias("own_id"), F.col("key").alias("own_key"))
    met = docs.join(bounded(wanted, nodes.count()), (F.col("key") == F.col("own_key")) & F.col("id").eqNullSafe(F.col("own_id")))
    # rows that repeat id and text give one set
    sets = cut(_shingled(met.select("node", "text"), words).groupBy("node").agg(F.first("shingles").alias("shingles")))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("left", "right")))
    return cut(both.filter(F.col("common") >= least * (F.size("left") + F.size("right") - F.col("common"))).select("a", "b"))


def near_duplicate_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    words: int = 5,
    similarity: float = 0.8,
    piece: int = 256,
) -> DataFrame:
    """(id_col, key, component_id, component_key): each row's component of similar texts.

    Two texts link if the Jaccard similarity of their ``words``-word shingle sets is at
    least ``similarity``; equal texts always do. ``key`` is the text's 128-bit key;
    (component_id, component_key) is the least such pair of the component, null ids last.

    Candidates come from three sources, in three rounds. First the tiled comparison of
    fingerprints at ``radius``, and for each shingle of the texts' prefixes the text with
    the least node that has it: what these links verify makes components. Then texts of
    different components that share a prefix shingle are compared by sketches in tiles:
    first only each component's nearest pair of a shingle is verified, which joins groups
    whose copies are alike by chains, then all close pairs of what are still different
    components, which hold every similar pair that is left. The
    texts of a shared shingle are split into as many pieces as the square root of their
    number over ``piece``, and every pair of pieces is work of its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("key"), text.alias("text"))
    signed = _signatures(slim, words, shingle, similarity, frequent_shingles(slim, words))
    one = signed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("fp", "n", "sketch", "mark", "heads")])
    # numbered once, in a written table
    texts = cut(one.withColumn("node", F.monotonically_increasing_id()))

    prints = cut(texts.groupBy("fp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")))
    by_print = prints.select(F.col("fp").alias("a"), F.col("node").alias("x"))
    near = link_edges(prints.select("fp"), radius).join(by_print, "a").join(by_print.toDF("b", "y"), "b").select("x", "y")
    same = texts.select("fp", "node").join(prints.filter("n > 1").select("fp", F.col("node").alias("first")), "fp").select("node", "first")
    # dealt by shingle once, for the count and the join
    slots = texts.select("node", "n", F.posexplode("heads").alias("at", "h")).repartition("h")
    shared = slots.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("leader")).filter("texts > 1")
    met = cut(slots.join(shared, "h"))
    lead = met.filter("node = leader").select("h", F.col("n").alias("m"), F.col("at").alias("lead_at"))
    after = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("lead_at"))
    led = met.filter("node <> leader").join(lead, "h").filter(after >= (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-6)
    found = near.toDF("a", "b").unionAll(same).unionAll(led.select("node", "leader")).filter("a <> b")
    first = cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(docs.sparkSession)
    known = texts.select("node", "id", "key", "n", "mark")
    stars = connected_components(verified(first, known, slim, words, similarity))

    pieces = F.ceil(F.sqrt(F.col("texts") / F.lit(piece))).cast("long")
    mine = F.pmod(F.xxhash64("node"), F.col("pieces"))
    for nearest in (True, False):
        slot = met.select("h", "texts", "node", "n", "at").join(stars, "node", "left").withColumn("comp", F.coalesce("root", "node"))
        mixed = slot.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("h")
        slot = slot.join(mixed, "h").join(texts.select("node", "sketch"), "node")
        dealt = slot.withColumn("pieces", pieces).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        bucket = F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other"))
        rows = dealt.select(bucket.alias("bucket"), "node", "n", "at", "comp", "sketch")
        met_now = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_meetings(similarity, nearest)), "a long, b long")
        more = verified(cut(met_now.distinct()), known, slim, words, similarity)
        stars = connected_components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
        release(docs.sparkSession)

    owner = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    member = texts.select("node", owner.alias("own")).join(stars, "node")
    least = member.groupBy("root").agg(F.min("own").alias("least"))
    by_node = member.join(least, "root").select("node", "least")
    by_text = texts.select("node", "key", "rows", owner.alias("own")).join(by_node, "node", "left")
    found = by_text.select("key", "rows", F.coalesce("least", "own").alias("least")).select("key", "rows", F.col("least.id").alias("component_id"), F.col("least.key").alias("component_key"))
    every = slim.select("id", "key")
    total = texts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_rows(every, cut(found), "key", "rows", total).select(F.col("id").alias(id_col), "key", "component_id", "component_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component of similar texts: that with the least id, then text key.

    Rows without an id come last. Of rows that repeat both, that with the least values in
    the other columns stays.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    key = [F.col(id_col).cast("long").alias("own_id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("own_key")]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], *key)
    groups = near_duplicate_texts(docs, id_col, text_col, **options).withColumnRenamed(id_col, "id")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    fates = cut(groups.groupBy("id", "key").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")).filter("not stays or n > 1"))
    many = fates.count()
    own = lambda side: F.col("own_id").eqNullSafe(side["id"]) & (F.col("own_key") == side["key"])
    once = rows.join(bounded(fates, many), own(fates), "left_anti")
    repeated = fates.filter("stays")
    several = rows.join(bounded(repeated, many), own(repeated), "left_semi").groupBy("own_id", "own_key").agg(F.min(F.struct(*names)).alias("row"))
    back = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return once.select(*names).unionAll(several.select("row.*")).select(*back)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
