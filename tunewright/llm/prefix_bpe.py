"""Byte-level BPE by one forward pass: each prefix of a word has exactly one last token.

A suffix automaton over the vocabulary names, at every position, all tokens that end there. Among them exactly one is
the last token of the prefix's encoding: the one whose pair with the last token of the prefix before it is stable, that
is, the merges of the two tokens put side by side never cross their border. Back-pointers from the end give the ids. The
cost is linear in the length of the word, also for words of many thousand bytes.

Documents stay where they are (``mapInArrow``, no exchange); each Python worker builds the automaton once and remembers
the ids of frequent words within a fixed bound.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import beside, text_of, with_results

# Fixed value: the published pattern that cuts text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers at most, in each of two generations.
REMEMBERED = 300_000
#: Pairs of tokens whose stability a worker remembers at most.
PAIRS = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else spare))
        spare += byte not in plain
    return letters


class SuffixAutomaton:
    """All factors of the vocabulary; ``tokens_at[state]`` lists (length, token) of the tokens among a state's suffixes."""

    def __init__(self, words: list[tuple[bytes, int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: dict[int, list[tuple[int, int]]] = {}
        for word, _ in words:
            last = 0
            for byte in word:
                last = self._extend(last, byte)
        for word, token in words:
            state = 0
            for byte in word:
                state = self.next[state][byte]
            own.setdefault(state, []).append((len(word), token))
        # Longest suffixes first; a state inherits the tokens of its suffix links.
        self.tokens_at: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.tokens_at[state] = (*sorted(own.get(state, ()), reverse=True), *self.tokens_at[self.link[state]])

    def _extend(self, last: int, byte: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(byte)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            state = self._state({}, length[last] + 1)
            at = last
            while at != -1 and byte not in nexts[at]:
                nexts[at][byte] = state
                at = link[at]
            if at == -1:
                link[state] = 0
                return state
            known = nexts[at][byte]
            if length[known] == length[at] + 1:
                link[state] = known
                return state
            link[state] = self._split(at, byte, known)
            return state
        return self._split(last, byte, known)

    def _state(self, nexts: dict[int, int], length: int) -> int:
        self.next.append(nexts)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, byte: int, known: int) -> int:
        copy = self._state(dict(self.next[known]), self.length[at] + 1)
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at != -1 and self.next[at].get(byte) == known:
            self.next[at][byte] = copy
            at = self.link[at]
        return copy


class PrefixBpe:
    """Exact ids and texts for a byte-level BPE vocabulary file (the JSON form of the tokenizers library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.bytes_of: dict[int, bytes] = {}
        for text, token in model["vocab"].items():
            self.bytes_of[token] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        # rank of a merge, and the parts of the token it makes
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        vocab = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            if whole not in self.parts:
                self.parts[whole] = (left, right)
                self.made_at[whole] = rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, token in self.special.items():
            self.bytes_of[token] = content.encode("utf-8")
        most = max(self.bytes_of) + 1
        self.token_sizes = np.array([len(self.bytes_of.get(t, b"")) for t in range(most)], dtype=np.int64)
        self.token_starts = np.concatenate(([0], np.cumsum(self.token_sizes)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(t, b"") for t in range(most)), dtype=np.uint8)
        single = {vocab[letter] for letter in byte_letters() if letter in vocab}
        usable = [(self.bytes_of[t], t) for t in vocab.values()
                  if t not in self.special.values() and (t in single or t in self.parts)]
        self.automaton = SuffixAutomaton(usable)
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.stable: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pair_is_stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together gives back exactly these two tokens.

        The merges of the two are undone from the latest to the earliest. At each moment the tokens that touch the
        border must not have had a merge that came before the one undone next, else it would have crossed the border.
        """
        key = left << 32 | right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            known = self.stable[key] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        never = len(self.rank)
        # Time at which the state (left, right) ends: when either side was merged further.
        until = never
        while True:
            crossing = self.rank.get((left, right), never)
            if crossing < until:
                return False
            # Of equal merges the left-hand one came first, so on a tie the right side is undone before.
            of_left, of_right = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                until, left = of_left, self.parts[left][1]
            else:
                until, right = of_right + 1, self.parts[right][0]

    def word_ids(self, word: bytes) -> list[int]:
        """Ids of one word: the unique last token of every prefix, then the way back."""
        nexts, link, length, tokens_at = (self.automaton.next, self.automaton.link, self.automaton.length,
                                          self.automaton.tokens_at)
        stable, check = self.stable, self.pair_is_stable
        last = [-1] * (len(word) + 1)  # last token of each prefix
        size = [0] * (len(word) + 1)
        state = matched = 0
        for end, byte in enumerate(word, 1):
            while byte not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state][byte]
            matched += 1
            for n, token in tokens_at[state]:
                if n > matched:
                    continue
                start = end - n
                if start == 0:
                    found = True
                else:
                    before = last[start]
                    found = stable.get(before << 32 | token)
                    if found is None:
                        found = check(before, token)
                if found:
                    last[end], size[end] = token, n
                    break
        ids = []
        at = len(word)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _remember(self, words: set[str]) -> None:
        """Put the ids of words into the young generation."""
        young, old = self.young, self.old
        for word in words:
            known = old.get(word)
            if known is None:
                ids = self.word_ids(word.encode("utf-8"))
                known = struct.pack(f"<{len(ids)}i", *ids)
            young[word] = known

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts without special tokens; their words are looked up together."""
        split = [self.words.findall(text) for text in texts]
        wanted = set().union(*split)
        missing = wanted.difference(self.young)
        if missing:
            if len(self.young) + len(missing) > REMEMBERED:
                self.old, self.young = self.young, {}
                missing = wanted
            self._remember(missing)
        known = self.young.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the strings of special tokens become their ids."""
        parts, marks = [], []
        for text in texts:
            at, found = 0, []
            if any(special in text for special in self.special):
                for match in self.cut.finditer(text):
                    parts.append(text[at:match.start()])
                    found.append(struct.pack("<i", self.special[match[0]]))
                    at = match.end()
            parts.append(text[at:])
            marks.append(found)
        coded = iter(self._plain(parts))
        return [np.frombuffer(b"".join([next(coded), *(x for mark in found for x in (mark, next(coded)))]), dtype="<i4")
                for found in marks]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of consecutive id lists, specials as their strings; broken UTF-8 as replacement characters."""
        sizes = self.token_sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        # Byte k of a token lies k places behind the token's start in the table of all tokens' bytes.
        places = np.repeat(self.token_starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        data = self.token_bytes[places].tobytes()
        cuts = ends[offsets].tolist()
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(cuts, cuts[1:])]


_loaded: dict[str, PrefixBpe] = {}


def coder(path: str) -> PrefixBpe:
    if path not in _loaded:
        _loaded[path] = PrefixBpe(path)
    return _loaded[path]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.array([], np.int32)]), pa.int32()))


#: Bytes of text, or ids, that are worked on at once.
PART = 1_000_000


def _cuts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` together, at least one row each."""
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode(docs: DataFrame, path: str, carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the columns in ``carry``, or all) and ids (array of int) of each document; null text: no ids.

    Rows stay in their partitions.
    """
    df = beside(docs, carry, text=text_of())
    schema = df.select("_row").withColumn("ids", F.array().cast("array<int>")).schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for start, end in _cuts(sizes, PART):
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(bpe.encode(part.column(1).to_pylist()))],
                                                 names=["_row", "ids"])

    return df.mapInArrow(coded, schema)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """The columns of ``coded`` (``_row`` and ids) and ``decoded``, the text of the ids."""
    schema = coded.withColumn("decoded", F.lit("")).schema
    names = coded.columns
    at = names.index("ids")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for start, end in _cuts(pc.list_value_length(batch.column(at)).to_pylist(), PART):
                part = batch.slice(start, end - start)
                lists = part.column(at)
                offsets = lists.offsets.to_numpy()
                ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
                found = bpe.decode(ids, offsets - offsets[0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*names, "decoded"])

    return coded.mapInArrow(texts, schema)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")


def round_trip(docs: DataFrame, path: str, carry: list[str] | None = None) -> DataFrame:
    """The documents' columns (those in ``carry``, or all) with ids and decoded.

    Null or empty text: no ids, empty decoded. Repeated rows: each alike. Empty table: empty result. An input column
    named like a result is replaced by the result.
    """
    return decode(encode(docs, path, carry), path).select(
        *with_results(docs.columns if carry is None else carry, {"ids": F.col("ids"), "decoded": F.col("decoded")}))
