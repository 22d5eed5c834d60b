import math
import random
from collections import Counter

import pytest

from tunewright.llm import ngram_quality


def discount(counts):
    n = [sum(c == k for c in counts) for k in range(1, 5)]
    held = []
    for k in (1, 2, 3):
        value = k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1] if n[k - 1] and n[0] else 0.5 * k
        held.append(max(0.1, min(float(k), value)))
    return lambda c: min(held[min(c, 3) - 1], c)


def grams(text):
    whole = "\x02\x02" + (text or "") + "\x03"
    return [whole[i:i + 3] for i in range(len(whole) - 2)]


def brute_model(texts):
    three = Counter(g for t in texts for g in grams(t))

    def level(counts, context):
        cut = discount(counts.values())
        total, freed = Counter(), Counter()
        for g, c in counts.items():
            total[context(g)] += c
            freed[context(g)] += cut(c)
        return {g: (c - cut(c)) / total[context(g)] for g, c in counts.items()}, {x: freed[x] / total[x] for x in total}

    two = Counter(g[1:] for g in three)
    one = Counter(g[1] for g in two)
    s3, b3 = level(three, lambda g: g[:2])
    s2, b2 = level(two, lambda g: g[0])
    s1, b1 = level(one, lambda g: "")

    def p(g):
        low = s1.get(g[2], 0) + b1[""] / (len(one) + 1)
        return s3.get(g, 0) + b3.get(g[:2], 1) * (s2.get(g[1:], 0) + b2.get(g[1], 1) * low)

    return p


def run(documents, spark, rows, ids, **more):
    marked = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r.doc_id: r for r in ngram_quality.quality_by_perplexity(documents(rows, **more), marked).collect()}


def test_perplexity_equals_a_plain_model(documents, spark, monkeypatch):
    monkeypatch.setattr(ngram_quality, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(ngram_quality, "PART", 500)
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lang = ["en", "fr", None][i % 3]
        words = [rng.choice(["ab", "bac", "cabé", "日本", "dd", "e"]) for _ in range(rng.randrange(0, 40))]
        rows.append((i, " ".join(words), lang, "s"))
    rows += [(100, None, "en", "s"), (101, "", "fr", "s"), (102, "QZ##", "en", "s"), (103, "x", "xx", "s"), (104, "é" * 3_000, "fr", "s")]
    trusted = [i for i in range(60) if i % 4] + [3, 3, None, 999]
    got = run(documents, spark, rows, trusted, block=1, code="c", bits=2, trusted="t")
    for lang in ("en", "fr", None):
        own = [r for r in rows if r[2] == lang]
        p = brute_model([t for i, t, *_ in own if i in trusted])
        for i, text, *_ in own:
            mean = -sum(math.log2(p(g)) for g in grams(text)) / len(grams(text))
            assert got[i].perplexity == pytest.approx(2 ** mean, rel=1e-5)
            assert got[i].n_grams == len(grams(text))
    assert got[103].perplexity is None and got[103].kept


def test_probabilities_of_a_context_sum_to_one():
    p = brute_model(["abracadabra", "banana band"])
    letters = {c for t in ("abracadabra", "banana band") for c in t} | {"\x03"}
    # One unit of the uniform share is left for characters never seen.
    for context in ("ab", "ra", "zz", "na"):
        total = sum(p(context + c) for c in letters) + p(context + "?")
        assert total == pytest.approx(1)


def test_junk_goes_and_held_out_prose_stays(documents, spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "water", "stone", "river", "under", "there", "light"]
    prose = lambda: " ".join(rng.choice(words) for _ in range(80))
    junk = lambda: "".join(chr(rng.randrange(33, 126)) for _ in range(300))
    rows = [(i, prose()) for i in range(200)] + [(1_000 + i, junk()) for i in range(20)]
    got = run(documents, spark, rows, range(100))
    assert sum(got[i].kept for i in range(100, 200)) >= 97
    assert not any(got[1_000 + i].kept for i in range(20))


def test_empty_tables_and_repeated_rows(documents, spark):
    assert run(documents, spark, [], [1]) == {}
    assert run(documents, spark, [(1, "abc")], [])[1].perplexity is None
    marked = spark.createDataFrame([(1,)], "doc_id long")
    rows = ngram_quality.quality_by_perplexity(documents([(1, "abc"), (1, "abc"), (None, "abc")]), marked).collect()
    assert len(rows) == 3 and len({r.perplexity for r in rows}) == 1
