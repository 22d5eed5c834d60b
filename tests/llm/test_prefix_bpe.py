import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tunewright.llm import prefix_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "aa", "the", "ing", " ", "  ", "\n", "é", "日", "👩‍", "1", "23", "'s", "'", "!!", "<|endoftext|>", "<|endof", "\t", "\x00",
         " ", "́", "zzzz", "ABAB", "\x85", "\x1c", "_", "==", "----", "İ", " ", "'LL", "'ll"]


@pytest.fixture(scope="module")
def coder():
    return prefix_bpe.PrefixBpe(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def decoded(coder, ids):
    return coder.decode(np.array(ids, dtype=np.int32), np.array([0, len(ids)]))[0]


def same(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode([text])[0].tolist() == ids, text[:60]
    assert decoded(coder, ids) == library.decode(ids, skip_special_tokens=False)


def test_random_texts(coder, library):
    rng = random.Random(1)
    for _ in range(4_000):
        same(coder, library, "".join(rng.choice(PARTS) for _ in range(rng.randrange(14))))


def test_several_texts_at_once(coder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(500)]
    ids = coder.encode(texts)
    assert [i.tolist() for i in ids] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
    assert coder.decode(np.concatenate(ids), offsets) == texts


def test_long_words(coder, library):
    rng = random.Random(2)
    for text in ["a" * 30_001, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "=" * 3_001, " " * 999,
                 "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(5_000)), "-" * 20_000 + "x"]:
        same(coder, library, text)


def test_words_of_the_vocabulary_and_their_pairs(coder):
    """Each stable pair decodes to bytes that encode to the pair again; an unstable one does not."""
    rng = random.Random(3)
    tokens = [t for t in coder.bytes_of if t not in coder.special.values()]
    for _ in range(5_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert (coder.word_ids(coder.bytes_of[a] + coder.bytes_of[b]) == [a, b]) == coder.pair_is_stable(a, b)


def test_broken_utf8_decodes_like_the_library(coder, library):
    rng = random.Random(4)
    for _ in range(2_000):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(6))]
        assert decoded(coder, ids) == library.decode(ids, skip_special_tokens=False)


def test_forgetting_words_and_pairs_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(prefix_bpe, "PAIRS", 5)
    coder = prefix_bpe.PrefixBpe(PATH)
    for text in ["some words in here", "here are other words again", "some more of them and others"] * 3:
        same(coder, library, text)


def test_query_columns(documents, library):
    texts = [None, "", "Hello world", "é<|endoftext|>x", "long " * 20_000, "Hello world"]
    df = documents([*enumerate(texts), (None, "no id")], ids="x", decoded=1, _row=2)
    out = prefix_bpe.round_trip(df, PATH).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 7
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == (text or "")
    text = prefix_bpe.encode(df, PATH).select("_row.doc_id", prefix_bpe.ids_text(prefix_bpe.F.col("ids")).alias("t")).collect()
    assert {r.doc_id: r.t for r in text}[2] == ",".join(map(str, got[2].ids)) and {r.doc_id: r.t for r in text}[0] == ""


def test_empty_table(documents):
    assert prefix_bpe.round_trip(documents([]), PATH).collect() == []
