import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tunewright.llm import mixture

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(got, rows, library, capacity):
    """Every id of every document in one piece, sequences without gaps, padding nowhere; tokens by (window, source)."""
    wanted = Counter()
    for doc_id, text, _, source in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        wanted[doc_id, source, len(ids)] += 1
    by_doc, by_sequence, shares = defaultdict(list), defaultdict(list), Counter()
    for r in got:
        by_doc[r.doc_id, r.source, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length, r.window))
        shares[r.window, r.source] += r.length
    texts = {(d, s): t for d, t, _, s in rows}
    assert by_doc.keys() == wanted.keys()
    for (doc_id, source, n), parts in by_doc.items():
        copies = wanted[doc_id, source, n]
        covered = Counter(i for r in parts for i in range(r.start, r.start + r.length))
        assert covered == {i: copies for i in range(n)}
        ids = np.array([*library.encode(texts[doc_id, source] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    used = {}
    for sequence, parts in by_sequence.items():
        end = 0
        for offset, length, _ in sorted(parts):
            assert offset == end and length > 0
            end += length
        used[sequence] = end
        assert len({w for *_, w in parts}) == 1
    assert sorted(used) == list(range(len(used)))
    short = [n for n in used.values() if n != capacity]
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    return shares


def make(sizes, seed=0):
    rng = random.Random(seed)
    rows = []
    for source, (documents, words) in sizes.items():
        for _ in range(documents):
            text = " ".join(rng.choice(["plain", "Words", "of", "text,", "and", "2024."]) for _ in range(rng.randrange(2 * words + 1)))
            rows.append((len(rows), text, "en", source))
    rng.shuffle(rows)
    return rows


def test_windows_hold_each_source_s_share(documents, library, monkeypatch):
    monkeypatch.setattr(mixture, "RUN", 3)
    rows = make({"a": (120, 40), "b": (30, 90), None: (15, 20), "tiny": (1, 3)})
    df = documents(rows, queue="q", part=1, at=2, n=3, ids="x", base=4).repartition(4)
    got = mixture.mixed_sequences(df, PATH, capacity=64, window=4).collect()
    shares = check(got, rows, library, 64)
    tokens = Counter()
    for (_, source), n in shares.items():
        tokens[source] += n
    total = sum(tokens.values())
    for window in range(total // 256):
        for source, n in tokens.items():
            assert abs(shares[window, source] - 256 * n / total) <= 2


def test_targets_hold_until_a_source_runs_dry(documents, library):
    rows = make({"a": (60, 50), "b": (60, 50), "c": (20, 20)}, 1)
    got = mixture.mixed_sequences(documents(rows), PATH, {"a": 0.2, "b": 0.5}, capacity=64, window=4).collect()
    shares = check(got, rows, library, 64)
    tokens = Counter()
    for (_, source), n in shares.items():
        tokens[source] += n
    # c has no target and gets the rest; it runs dry first, then b.
    for window in range(int(tokens["c"] / 0.3) // 256):
        for source, share in (("a", 0.2), ("b", 0.5), ("c", 0.3)):
            assert abs(shares[window, source] - 256 * share) <= 2
    last = sum(tokens.values()) // 256 - 1
    assert shares[last, "a"] == 256 and shares[last, "b"] == shares[last, "c"] == 0


def test_odd_rows(documents, library):
    rows = [(1, None, "en", "s"), (2, "", None, None), (2, "", None, None), (None, "no id", "en", "s"), (3, "word " * 9_000, "en", "t"),
            (4, "É ß\n日本 <|endoftext|>", "en", "")]
    got = mixture.mixed_sequences(documents(rows), PATH).collect()
    check(got, rows, library, 4096)
    assert mixture.mixed_sequences(documents([]), PATH).collect() == []


def test_more_sources_than_queues(documents, library, monkeypatch):
    monkeypatch.setattr(mixture, "QUEUES", 5)
    monkeypatch.setattr(mixture, "SHARED", 2)
    rows = make({f"s{i}": (3 + i % 4, 8) for i in range(12)}, 2)
    got = mixture.mixed_sequences(documents(rows).repartition(3), PATH, capacity=32, window=2).collect()
    check(got, rows, library, 32)


def test_sums_too_many_to_broadcast_and_ids(documents, library, monkeypatch):
    monkeypatch.setattr(mixture, "BROADCAST_SUMS", 0)
    rows = make({"a": (30, 30), "b": (10, 60)}, 3)
    got = mixture.mixed_sequences(documents(rows).repartition(3), PATH, capacity=128, window=2, with_ids=True).collect()
    check(got, rows, library, 128)
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        assert r.ids == [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2][r.start:r.start + r.length]


@pytest.mark.parametrize("seed", range(12))
def test_schedule_runs_meet_and_use_every_token(seed):
    rng = random.Random(seed)
    counts = [rng.choice([1, 2, 7, 300, 5_000, 40_000]) for _ in range(rng.randrange(1, 12))]
    weights = counts if seed % 2 else [rng.randrange(1, 1000) for _ in counts]
    plan = mixture.Schedule(counts, weights, 16, 4, 5)
    place, given, run = 0, [0] * len(counts), 0
    while place < plan.total:
        starts, places = plan.windows(run)
        assert starts[0].tolist() == given
        assert (np.diff(starts, axis=0) >= 0).all()
        for before, after, at in zip(starts, starts[1:], places):
            for s in range(len(counts)):
                assert at[s] == place
                place += after[s] - before[s]
            assert place % 64 == 0 or place == plan.total
        given, run = starts[-1].tolist(), run + 1
    assert given == counts
    for s, n in enumerate(counts):
        for token in {0, n // 2, n - 1}:
            starts, _ = plan.windows(plan.run_of(s, token))
            assert starts[0, s] <= token < starts[-1, s]


def test_deficits_carry_parts_of_tokens():
    # Three queues of a third of 16 tokens each: no window may drift from its share by more than a token.
    plan = mixture.Schedule([1_000, 1_000, 1_000], [1, 1, 1], 16, 1, 64)
    starts, _ = plan.windows(0)
    for k, row in enumerate(starts):
        assert max(abs(3 * g - 16 * k) for g in row.tolist()) <= 3
