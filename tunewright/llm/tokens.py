"""Token ids of whole texts, by the batch: words are told apart and counted in columns, the library sees new words only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a Python worker remembers at most, in each of two generations.
REMEMBERED = 400_000
#: Characters of text that are encoded together.
CHARS = 4_000_000
#: Words that the library is asked for at once.
ASKED = 10_000

# What a tokenizer file must say for its texts to be encoded word by word (fixed values of that kind of file).
WORD_END = "</w>"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
BLANKS_TO_ONE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: A letter or digit, punctuation at the end of its word: the punctuation is a piece of its own.
ENDED = "([a-z0-9À-ÖØ-öø-ɏ])([!-/:-@\\[-`{-~]+)( |$)"
#: Texts in which lower-casing A-Z first could make a difference: a mark upon a capital, a special token in capitals.
DELICATE = "[A-Z][̀-ͯ]|<\\|"


def laid_out_by_words(path: str) -> bool:
    """Whether the file drops white space, lower-cases, and marks the end of words."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    steps = (told.get("normalizer") or {}).get("normalizers") or []
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [s["type"] for s in steps] == NORMALIZERS and steps[1] == BLANKS_TO_ONE
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": WORD_PATTERN} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
        and told["model"]["type"] == "BPE" and told["model"]["end_of_word_suffix"] == WORD_END
        and not told["model"].get("continuing_subword_prefix")
        and all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])
                for t in told.get("added_tokens") or [])
    )


def largest_id(path: str) -> int:
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    return max([*told["model"]["vocab"].values(), *(t["id"] for t in told.get("added_tokens") or [])])


def joined(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class Known:
    """Ids per word: a word's row, and the place of each row's ids in one array."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.uint32)
        self.starts = np.empty(0, dtype=np.int64)
        self.lengths = np.empty(0, dtype=np.int64)

    def add(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])


class TextIds:
    """Ids of whole texts by the library itself, for any tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def asked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter((i for ids in got for i in ids), dtype=np.uint32, count=int(lengths.sum())), lengths

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's."""
        return self.asked(texts.to_pylist())


class WordIds(TextIds):
    """Ids by words, for files that are ``laid_out_by_words``.

    Words are cut at spaces and line feeds only; any other white space is left to the library. Frequent words are
    remembered in two generations, so memory is bounded whatever the vocabulary of the corpus.
    """

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[token for text, token in vocab.items() if text.endswith(WORD_END)]] = True
        self.young, self.old = Known(), Known()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        delicate = pc.match_substring_regex(texts, DELICATE).to_numpy(zero_copy_only=False)
        if delicate.any():
            # Rare: these texts go to the library whole.
            whole, whole_lengths = self.asked(texts.filter(pa.array(delicate)).to_pylist())
            plain, plain_lengths = self._by_words(texts.filter(pa.array(~delicate)))
            lengths = np.empty(len(texts), dtype=np.int64)
            lengths[delicate], lengths[~delicate] = whole_lengths, plain_lengths
            starts = np.empty(len(texts), dtype=np.int64)
            starts[delicate] = np.cumsum(whole_lengths) - whole_lengths
            starts[~delicate] = len(whole) + np.cumsum(plain_lengths) - plain_lengths
            return joined(np.concatenate([whole, plain]), starts, lengths), lengths
        return self._by_words(texts)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        split = pc.split_pattern(pc.replace_substring_regex(flat, ENDED, "\\1 \\2\\3"), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.young.rows]
        if new:
            if len(self.young.rows) + len(new) > REMEMBERED:
                self.young, self.old, new = Known(), self.young, distinct
            self._remember(new)
        rows = np.fromiter(map(self.young.rows.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        each = rows[words.indices.to_numpy()]
        lengths = self.young.lengths[each]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        return joined(self.young.flat, self.young.starts[each], lengths), np.diff(ends[places])

    def _remember(self, words: list[str]) -> None:
        """Put words into the young generation, from the old one or the library."""
        known = [w for w in words if w in self.old.rows]
        if known:
            rows = np.fromiter(map(self.old.rows.__getitem__, known), dtype=np.int64, count=len(known))
            lengths = self.old.lengths[rows]
            self.young.add(known, joined(self.old.flat, self.old.starts[rows], lengths), lengths)
            words = [w for w in words if w not in self.old.rows]
        plain, other = [], []
        for word in words:
            (plain if word.isalpha() else other).append(word)
        for at in range(0, len(plain), ASKED):
            part = plain[at:at + ASKED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self.young.add(part, ids, np.diff(ends, prepend=0))
            else:
                # A letter that the normalizer takes apart made two pieces of a word.
                other += part
        for at in range(0, len(other), ASKED):
            part = other[at:at + ASKED]
            self.young.add(part, *self.asked(part))


_tokenizers: dict[str, TextIds] = {}


def tokenizer(path: str) -> TextIds:
    """One per file and Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path) if laid_out_by_words(path) else TextIds(path)
    return _tokenizers[path]


def documents(path: str, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts, CHARS long or one text: the first one's number, all ids with ``end_id`` after each text, their numbers."""
    known = tokenizer(path)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    # A text goes with the run in which it starts.
    runs = (np.cumsum(sizes) - sizes) // CHARS
    firsts = np.flatnonzero(np.diff(runs, prepend=-1))
    for first, after in zip(firsts, [*firsts[1:], len(runs)]):
        ids, lengths = known.ids(texts.slice(first, after - first))
        yield int(first), np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
