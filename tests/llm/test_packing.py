import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tunewright.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [None, "", " ", "Hello  World\n\n\tit's 2,024!", "é é ΣΑΣ İ  x y\x1cz\x85", "<|endoftext|>a <|startoftext|>", "x" * 9_000,
         "word " * 9_000, "日本語 text", "á ́b", "'S 'll don't", "emoji 👩‍👩‍👧 ok", "\r\n a\rb", "tab\tjoined\x0bwords\x0cpage"]


def ids_of(words, texts):
    """Each text's ids, as a list per text."""
    flat, lengths = words.ids(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(flat, np.cumsum(lengths)[:-1])] if texts else []


def test_ids_are_the_library_s(library):
    words = tokens.WordIds(PATH)
    assert ids_of(words, []) == [] and ids_of(words, ["a b", "", "a"])[2] == ids_of(words, ["a"])[0]
    for text in TEXTS[1:]:
        assert ids_of(words, [text])[0] == library.encode(text, add_special_tokens=False).ids, text[:40]
    assert ids_of(words, TEXTS[1:]) == [library.encode(t, add_special_tokens=False).ids for t in TEXTS[1:]]


def test_letters_that_fall_apart_and_special_words(library):
    words = tokens.WordIds(PATH)
    for text in ["İstanbul İİ plain Words, W. ... ?! a.b, ÀÉ. ſ ﬁ Å", "<|ENDOFTEXT|> <|endoftext|>. x", "ΑΣ, ΑΣ Σ. ß ẞ", "한국어. 각 각", "ab;cd; 5. v5.",
                 "H\u0331 h\u0331. T\u0308 I\u0307. e\u0301. E\u0301.", "dogs' don't. x'** it's!? Été*** (a) [b]. c\\ d` e^ \u00d7. 5,6, 7-", "a.\nb!\n\nc"]:
        assert ids_of(words, [text])[0] == library.encode(text, add_special_tokens=False).ids, text


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    words = tokens.WordIds(PATH)
    for text in ["a b c d e", "e d x y", "a b x q r s", "a b c"] * 3:
        assert ids_of(words, [text])[0] == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aBzÉéßΣ5. ,'!*-<|\n\t\u0301\u0331\u00d7漢ـHTi\u0307>endoftext", max_size=40))
def test_any_text(text):
    if "words" not in _kept:
        _kept.update(words=tokens.WordIds(PATH), library=Tokenizer.from_file(PATH))
    assert ids_of(_kept["words"], [text])[0] == _kept["library"].encode(text, add_special_tokens=False).ids


_kept = {}


def test_runs_of_texts(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHARS", 20)
    texts = ["one two", "", "three " * 30, "four.", "", "five six seven eight nine"]
    got = []
    for first, ids, lengths in tokens.documents(PATH, pa.array(texts), 7):
        assert first == len(got)
        got += [p.tolist() for p in np.split(ids, np.cumsum(lengths)[:-1])]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_another_tokenizer_file(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.laid_out_by_words(PATH) and not tokens.laid_out_by_words(path)
    rows = list(enumerate(TEXTS))
    got = packing.packed_documents(documents(rows), path).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == \
        expected(Tokenizer.from_file(path), rows)


def expected(library, rows, capacity=4096):
    out = []
    for doc_id, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(rows, capacity):
    taken = {}
    for r in rows:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in taken.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(taken)


def test_pieces_and_places(documents, library):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (3, TEXTS[3]), (None, "no id")]
    df = documents(rows, piece="p", length=1, salt=2, number=3, sequence_id=4)
    got = packing.packed_documents(df, PATH).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == expected(library, rows)
    check(got, 4096)


def test_empty_table(documents):
    assert packing.packed_documents(documents([]), PATH).collect() == []


def test_ids_on_request(documents, library):
    got = packing.packed_documents(documents([(1, "Hello World " * 3_000)]), PATH, with_ids=True).collect()
    ids = [i for r in sorted(got, key=lambda r: r.piece) for i in r.ids]
    assert ids == [*library.encode("Hello World " * 3_000, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", range(20))
def test_plan_uses_every_piece_once_and_few_bins(seed):
    rng = random.Random(seed)
    capacity = 100
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for _ in range(rng.randrange(1, 400)):
        counts[min(capacity, 1 + int(rng.expovariate(1 / rng.choice([5, 20, 40]))))] += rng.choice([1, 1, 7])
    patterns = packing.best_two_fit(counts, capacity)
    used = np.zeros_like(counts)
    for times, lengths in patterns:
        assert sum(lengths) <= capacity and times > 0
        for size in lengths:
            used[size] += times
    assert (used == counts).all()
    total = int((counts * np.arange(capacity + 1)).sum())
    assert sum(t for t, _ in patterns) <= 1.25 * -(-total // capacity) + 2


def test_two_pieces_replace_the_smallest():
    # Greedy alone takes 6, then 3 (gap 1); 2 + 2 fit the wider gap of 4 exactly.
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3]] = 1
    counts[2] = 2
    assert packing.best_two_fit(counts, 10)[0] == (1, [6, 2, 2])
