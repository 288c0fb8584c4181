"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the encoding of that prefix ends in one token, which
does not depend on what follows. Vocabulary tokens that end at a position come
from a suffix-matching automaton; the one that belongs there is the one whose
predecessor (already known for the shorter prefix) it can stand next to. Back
pointers from the end of the word then give the ids. No merge is ever replayed
over the text.

The tokenizer file's bytes are read by the driver and broadcast (a vocabulary's
size does not follow the corpus). Normalising and splitting into words use the
file's own settings: a file whose settings are ``_WORD_SETTINGS`` is split at white
space and cached by chunk, any other goes whole texts through the file's own
normaliser and splitter. Settings that the dynamic programme does not cover
(dropout, unknown tokens, added tokens that strip or are normalised) raise ValueError.

Edge cases: null text counts as empty; empty text gives no ids and an empty decoded
string, and so does white space alone where the file drops it. Very long texts and
words are encoded whole, in memory in proportion to them. Extra columns are ignored;
repeated rows keep their own result row. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointlake.llm.common import arrow_map, table

END = ""
#: Characters that Python calls white space and the tokenizer's pattern does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The file's own word pattern, for text below U+0250, where composing changes nothing.
_PLAIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN_BELOW = "\u0250"


#: The settings for which the short cuts of ``encode`` and ``_pieces`` hold.
_WORD_SETTINGS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_MODEL_SWITCHES = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
_TOKEN_SWITCHES = ("single_word", "lstrip", "rstrip", "normalized")


def _require_covered(parsed: dict) -> None:
    """ValueError for a file that the dynamic programme would encode otherwise than the library."""
    model = parsed["model"]
    if model.get("type") != "BPE":
        raise ValueError(f"a BPE model is needed, not {model.get('type')!r}")
    for name in _MODEL_SWITCHES:
        if model.get(name):
            raise ValueError(f"model setting {name}={model[name]!r} is not covered")
    for token in parsed["added_tokens"]:
        for name in _TOKEN_SWITCHES:
            if token.get(name):
                raise ValueError(f"added token {token['content']!r} with {name} is not covered")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte, keyed by the byte's Latin-1 code point."""
    shown = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class BpeModel:
    """Vocabulary, merges and the dynamic programme over words."""

    def __init__(self, spec: bytes):
        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(spec)
        _require_covered(parsed)
        model = parsed["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        #: Whether words end at white space, so that texts may be taken apart there.
        self.word_wise = all(parsed.get(k) == v for k, v in _WORD_SETTINGS.items()) and all(t.startswith("<|") and not _SPACES.search(t) for t in self.special)
        self.own_decoder = parsed.get("decoder") is not None
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.ids = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        made = [self.ids[a + b] for a, b in pairs]
        #: Rank at which a token is made; single symbols are there from the start.
        self.rank = dict.fromkeys(self.ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for at, ((a, b), token) in enumerate(zip(pairs, made, strict=True)):
            pair = (self.ids[a], self.ids[b])
            self.merge_rank[pair] = at
            if token not in self.parts:
                self.parts[token], self.rank[token] = pair, at
        #: By left << 32 | right, which takes less room than a pair.
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, token in self.ids.items():
            ends = bool(self.suffix) and text.endswith(self.suffix)
            plain = text.removesuffix(self.suffix) if ends else text
            if len(plain) == 1 or token in self.parts:
                key = plain + END if ends else plain
                self.automaton.add_word(key, (len(key), token))
        self.automaton.make_automaton()
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def _boundary_holds(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge crosses the boundary, going back in time from (left, right).

        ``limit``: only a crossing merge of a lower rank would have come first. Of two
        merges of one rank the one further left comes first.
        """
        rank, parts, crossing = self.rank, self.parts, self.merge_rank
        while True:
            across = crossing.get((left, right))
            if across is not None and across < limit:
                return False
            if rank[left] > rank[right]:
                limit, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, parts[right][0]
            else:
                return True

    def whole(self, token: int) -> bool:
        """Whether the token's own text encodes as that token alone."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                a, b = self.parts[token]
                known = self.whole(a) and self.whole(b) and self._boundary_holds(a, b, self.rank[token])
            self._whole[token] = known
        return known

    def fits(self, left: int, right: int, room: int = 1 << 18) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        known = self._fits.get(left << 32 | right)
        if known is None:
            known = self.whole(right) and self._boundary_holds(left, right, float("inf"))
            if len(self._fits) >= room:
                self._fits.clear()
            self._fits[left << 32 | right] = known
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-tokenised word (byte-level characters)."""
        marked = word + END if self.suffix else word
        n = len(marked)
        last, width = [-1] * (n + 1), [0] * (n + 1)
        fits = self._fits
        for at, (size, token) in self.automaton.iter(marked):
            at += 1
            if last[at] >= 0:
                continue
            before = at - size
            if before == 0:
                ok = self.whole(token)
            elif last[before] < 0:
                ok = False
            else:
                ok = fits.get(last[before] << 32 | token)
                if ok is None:
                    ok = self.fits(last[before], token)
            if ok:
                last[at], width[at] = token, size
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary cannot spell {word!r}")
            out.append(last[at])
            at -= width[at]
        return tuple(out[::-1])

    def _pieces(self, chunk: str) -> list[str]:
        if self.word_wise and chunk.isprintable() and max(chunk) < _PLAIN_BELOW:
            words = _PLAIN.findall(chunk.lower())
            return words if chunk.isascii() else [w.encode().decode("latin-1").translate(_LETTERS) for w in words]
        normal = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        if not self.tokenizer.pre_tokenizer:
            return [normal] if normal else []
        return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_chunk(self, chunk: str, room: int = 100_000) -> tuple[int, ...]:
        """Ids of a run of text that is encoded without regard to its neighbours."""
        split = self._special_split and (not self.word_wise or "<|" in chunk)
        spans = self._special_split.split(chunk) if split else [chunk]
        out: list[int] = []
        for span in spans:
            if span in self.special:
                out.append(self.special[span])
            elif span:
                for word in self._pieces(span):
                    ids = self.words.get(word)
                    if ids is None:
                        if len(self.words) >= room:
                            self.words.clear()
                        ids = self.words[word] = self.encode_word(word)
                    out += ids
        return tuple(out)

    def encode(self, text: str, room: int = 100_000) -> list[int]:
        """Ids of a whole text. Words seen before in this process come from bounded caches."""
        if not self.word_wise:
            return list(self.encode_chunk(text, room))
        split = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        known, out = self.chunks, []
        for chunk in split:
            ids = known.get(chunk)
            if ids is None:
                if not chunk:
                    continue
                ids = self.encode_chunk(chunk, room)
                if len(known) < room and len(chunk) <= 64:
                    known[chunk] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        """By the file's decoder; without one, the tokens' texts joined by spaces."""
        if self.own_decoder:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.text_of.__getitem__, ids))


_loaded: dict[str, BpeModel] = {}


def load(spec: bytes) -> BpeModel:
    """The model of a tokenizer file's bytes, made once in each process."""
    digest = hashlib.sha256(spec).hexdigest()
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = BpeModel(spec)
    return _loaded[digest]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded string) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def make():
        model = load(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            decoded = pa.array(map(model.decode, rows), pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], names=["id", "ids", "decoded"])

        return step

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(slim, make, "id long, ids array<int>, decoded string", slice_rows=256).withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) from the operator's ids and texts."""
    return encode_documents(docs, tokenizer_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
