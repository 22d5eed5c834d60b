import random
import re
from collections import Counter

import numpy as np

from tunewright.llm import quality_rules

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or".split()


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


def prose(rng, n, form="{}"):
    return " ".join(form.format(rng.choice(WORDS) + rng.choice(WORDS)) for _ in range(n))


def run(df):
    return quality_rules.quality_rules(df)


def test_statistics(documents):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "word " * 40, prose(rng, 100), prose(rng, 19), prose(rng, 20), "a b c d e f g h " * 2,
             "x y z # $ é|ü", "same\nsame\n\n\nother\nsame \nsame", prose(rng, 5_000) + "\n" + prose(rng, 3_000)]
    part = prose(rng, 30)
    texts += [f"{part} {prose(rng, 200)} {part}", f"{part} {part} {part[:40]}", "\x0b\x0c\r".join("abcdefghijabcdefghij" * 3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                          "base_failed")) for r in run(documents(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_outliers_go_and_ordinary_documents_stay(documents):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(60, 300)), "en", f"s{i % 3 if i % 2 else 0}") for i in range(300)]
    rows += [(1_000 + i, prose(rng, 100, "{}###"), "en", "s0") for i in range(20)]
    rows += [(2_000 + i, prose(rng, 100), None, None) for i in range(3)]
    got = {r.doc_id: r.kept for r in run(documents(rows)).collect()}
    assert all(got[i] for i in range(300)) and all(got[2_000 + i] for i in range(3))
    assert not any(got[1_000 + i] for i in range(20))


def test_distances_match_plain_concentration_steps(documents, spark):
    """One group: the same steps in numpy, on the same grid."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(40, 200)) + " #" * rng.randrange(3) + "\nq" * rng.randrange(3)) for i in range(200)]
    out = quality_rules.judge(documents(rows)).filter("NOT base_failed").collect()
    x = np.array([[r.x0, r.x1, r.x2, r.x3] for r in out])
    noise = np.diag(np.square(quality_rules.NOISE))

    def grid(column, share):
        cells = np.sort(np.floor(column * quality_rules.START_CELLS))
        return (cells[int(np.ceil(share * len(cells))) - 1] + 0.5) / quality_rules.START_CELLS

    mean = np.array([grid(c, 0.5) for c in x.T])
    scatter = np.diag([((grid(c, 0.75) - grid(c, 0.25)) / 1.349) ** 2 for c in x.T])

    def distance():
        return np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(scatter + noise), x - mean)

    for _ in range(quality_rules.STEPS):
        cells = np.floor(quality_rules.CELLS * np.log2(distance() + 2.0 ** -10))
        order = np.sort(cells)
        last = max(c for c in set(cells) if (order < c).sum() < quality_rules.CORE * len(cells))
        core = x[cells <= last]
        # The language's mean sums are those of this only group: the prior changes nothing.
        mean, scatter = core.mean(0), quality_rules.CONSISTENCY * np.cov(core.T, bias=True)
    np.testing.assert_allclose([r.d2 for r in out], distance(), rtol=1e-6, atol=1e-9)
    assert [r.kept for r in out] == list(distance() <= quality_rules.CUT)


def test_empty_table_clashing_columns_and_repeated_rows(documents):
    assert run(documents([])).collect() == []
    rng = random.Random(4)
    text = prose(rng, 50)
    df = documents([(1, text), (1, text), (None, text)], n_words=7, salt=1, m0="m", text2="t", kept="no", d2=0)
    out = run(df).collect()
    assert [r.n_words for r in out] == [50] * 3 and [r.kept for r in out] == [True] * 3
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 3


def test_repeated_lines_or_repeated_words_alone_reject(documents):
    rng = random.Random(5)
    text = lambda n: "\n".join(prose(rng, 10) for _ in range(n // 10))
    rows = [(i, text(rng.randrange(60, 300)), "en", "s") for i in range(300)]
    # Twenty short lines per hundred words are repeats; no run of eight words is.
    rows += [(1_000 + i, "\n".join(f"{rng.choice(['of the', 'by that'])}\n{prose(rng, 8)}" for _ in range(20)), "en", "s")
             for i in range(20)]
    # A passage of nine words three times in a hundred words: 27 % repeated words on lines that all differ.
    passage = prose(rng, 9)
    rows += [(2_000 + i, "\n".join(f"{prose(rng, 24)} {passage}" for _ in range(3)) + " the", "en", "s") for i in range(20)]
    # One repeated line, one passage found twice.
    rows += [(3_000 + i, f"{(line := prose(rng, 2))}\n{text(60)}\n{line}", "en", "s") for i in range(20)]
    rows += [(4_000 + i, f"{(part := prose(rng, 8))} {prose(rng, 60)} {part}", "en", "s") for i in range(20)]
    got = {r.doc_id: r for r in run(documents(rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[2_000 + i].n_dup_lines == 0 and got[1_000 + i].n_repeat_words == 0 for i in range(20))
    assert [i for i in got if not got[i].kept] == [i for i in got if 1_000 <= i < 3_000]
