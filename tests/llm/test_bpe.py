import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return bpe.load(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


HARD = [
    "", " ", "\t\n", "a", "A", "aaaaaaaaaaaaaaaaaaaaaaaaa", "it's IT'S 'll can't  won''t", "<|endoftext|>", "x<|startoftext|>Y <|", "<|END|>",
    "ΑΣ ΣΑΣ", "İstanbul ıI", "é Å K", "日本語テキスト 한국어", "1234 ٣٤ ½ Ⅷ", "a\x1cb \x1d\x1e!", "\x00\x01 \x7f", "a\xa0b c​d",
    "🙂👩‍👩‍👧 ok", "----====____!!!???", " xy", "ﬁ ǅ", "ñandú añó", "</w> a</w>b", "﻿bom", "à̧́b", "x" * 3000,
]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(model, library, text):
    want = library.encode(text, add_special_tokens=False)
    got = model.encode(text)
    assert got == want.ids
    assert model.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_random_texts(model, library):
    rng = random.Random(2)
    alphabets = ["ab", "abcdefghijklmnop'", "aeéèñü ", "<|>/w ", "0123.,- ", "Łøßäöç漢字🙂 "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in (rng.randrange(0x20, 0x3000) for _ in range(40))) for _ in range(300)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for text, ids in zip(texts, want, strict=True):
        assert model.encode(text) == ids, text


def test_every_token_text(model, library):
    words = [t.removesuffix("</w>") for t in list(model.ids)[::17]]
    for word in words:
        if word.isascii():
            assert model.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_every_latin_character(model, library):
    for c in map(chr, range(0x300)):
        text = f"a{c}B{c}{c} {c}9"
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_another_file_goes_its_own_way():
    """Byte-level BPE that keeps case and white space: none of the word file's short cuts hold."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, library = bpe.load(open(path, "rb").read()), Tokenizer.from_file(path)
    assert not model.word_wise
    rng = random.Random(4)
    texts = HARD + ["  two  spaces\n\n\tTab ", "a <|endoftext|> b<|endoftext|>", "CamelCase  É1234"]
    texts += ["".join(rng.choice("abcDE é漢\n  '1.") for _ in range(rng.randrange(80))) for _ in range(500)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def _edited(change):
    parsed = json.loads(open(PATH, "rb").read())
    change(parsed)
    return json.dumps(parsed).encode()


def test_changed_settings_lose_the_short_cuts():
    spec = _edited(lambda p: p["normalizer"]["normalizers"].pop())
    model, library = bpe.BpeModel(spec), Tokenizer.from_str(spec.decode())
    assert not model.word_wise
    for text in HARD:
        assert model.encode(text) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(
    "change",
    [
        lambda p: p["model"].update(dropout=0.1),
        lambda p: p["model"].update(ignore_merges=True),
        lambda p: p["added_tokens"][0].update(lstrip=True),
    ],
)
def test_settings_not_covered_raise(change):
    with pytest.raises(ValueError, match="not covered"):
        bpe.BpeModel(_edited(change))


def test_query_rows(spark, library):
    import hashlib

    texts = [None, "", "Hello, World", "Hello, World", " \n", "ñ" * 2000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.token_digests(docs, PATH).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(docs.limit(0), PATH).count() == 0
