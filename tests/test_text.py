"""Text index and search against a plain Python computation."""

import math
import re

import pytest

from tunewright.operators import text

DOCS = {
    1: "Red fish, blue fish. The RED sea!", 2: "a b c", 3: "", 4: "blue sea blue sea blue", 5: "Éclair ñandú_2 éclair 12",
    6: "red fish", 7: "red fish",
}


def grams(words):
    t = re.findall(r"(?u)\b\w\w+\b", words.lower())
    return t + [f"{a} {b}" for a, b in zip(t, t[1:])]


def model(max_terms=30_000):
    counts = {d: {} for d in DOCS}
    for d, words in DOCS.items():
        for g in grams(words):
            counts[d][g] = counts[d].get(g, 0) + 1
    cf, df = {}, {}
    for c in counts.values():
        for g, n in c.items():
            cf[g] = cf.get(g, 0) + n
            df[g] = df.get(g, 0) + 1
    kept = sorted(cf, key=lambda g: (-cf[g], g))[:max_terms]
    idf = {g: math.log((1 + len(DOCS)) / (1 + df[g])) + 1 for g in kept}

    def weigh(c):
        w = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / length for g, x in w.items()} if length else {}
    return idf, {d: weigh(c) for d, c in counts.items()}, weigh


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, d, t) for d, t in DOCS.items()], "song_id bigint, song_ord bigint, text string")


@pytest.mark.parametrize("max_terms", [30_000, 6])
def test_weights_and_search(spark, docs, max_terms):
    idf, weights, weigh = model(max_terms)
    index = text.build_text_index(docs, max_terms=max_terms)
    assert {r["term"]: pytest.approx(r["idf"]) for r in index["vocabulary"].collect()} == idf
    got = {}
    for r in index["postings"].collect():
        got.setdefault(r["song_id"], {})[r["term"]] = r["weight"]
    assert got == {d: pytest.approx(w) for d, w in weights.items() if w}
    asked = {10: "red fish", 11: "nothing known here", 12: "blue blue SEA", 13: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    for blocks in ({}, {"item_rows": 2}):
        for pad in (True, False):
            hits = text.text_search(queries, index["vocabulary"], index["documents"], docs, hits=3, pad=pad, **blocks)
            found = {}
            for r in hits.collect():
                found.setdefault(r["query_id"], []).append((r["pos"], r["song_id"], r["score"]))
            for q, words in asked.items():
                c = {}
                for g in grams(words):
                    c[g] = c.get(g, 0) + 1
                qv = weigh(c)
                scores = {d: round(sum(x * weights[d].get(g, 0) for g, x in qv.items()), 9) for d in DOCS}
                want = sorted(DOCS, key=lambda d: (-scores[d], d))[:3]
                if not pad:
                    want = [d for d in want if scores[d] > 0]
                assert [d for _, d, _ in sorted(found.get(q, []))] == want
                for _, d, s in found.get(q, []):
                    assert s == pytest.approx(scores[d], abs=1e-8)


def test_postings_have_unit_length(docs):
    index = text.build_text_index(docs)
    sums = index["postings"].groupBy("song_id").agg({"weight": "count"}).count()
    assert sums == 6 - 1  # the empty text and the one-letter words have no postings
    for r in index["documents"].collect():
        assert not r["weights"] or sum(w * w for w in r["weights"]) == pytest.approx(1.0)


def test_pooled_scores_are_sums_over_queries(spark, docs):
    index = text.build_text_index(docs)
    queries = spark.createDataFrame([(1, "red fish"), (2, "blue fish")], "query_id int, text string")
    pooled = text.pooled_query(queries, index["vocabulary"])
    got = {r["song_id"]: r["score"] for r in text.score_docs(text.query_join_postings(pooled, index["postings"])).collect()}
    hits = text.text_search(queries, index["vocabulary"], index["documents"], docs, hits=10, pad=False)
    want = {}
    for r in hits.collect():
        want[r["song_id"]] = want.get(r["song_id"], 0) + r["score"]
    assert got == {d: pytest.approx(s, abs=1e-8) for d, s in want.items()}


@pytest.fixture(scope="module")
def many(spark):
    words = ["ab", "cd", "Éf", "x", "12", "_q", "zz", "𝒳𝒴", "𝒳"]
    rows = [(i, " ".join(words[(i * j + j * j) % (3 + i % 7)] for j in range(i % 40)) + ("-rare%d" % i) * (i % 3)) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None), (301, " ,"), (302, "tail")], "song_id long, text string").repartition(5)


def test_spaced_words_are_the_tokens(many):
    import pyarrow as pa

    found = text.spaced(many, "song_id", "text").join(many.select("song_id", text.tokenize("text").alias("t")).withColumnRenamed(
        "song_id", "key"), "key").orderBy("key").collect()
    tokens, lengths = text.word_lists(pa.array([r["words"] for r in found], pa.string()))
    assert lengths.tolist() == [len(r["t"] or []) for r in found]
    assert tokens.to_pylist() == [w for r in found for w in r["t"] or []]


@pytest.mark.parametrize("max_terms", [5, 20])
def test_rough_counts_leave_out_rare_terms_only(many, max_terms):
    rough = text.term_stats(many, max_terms=max_terms, rough_docs=0)
    every = text.term_stats(many)
    assert text.most_frequent(rough, max_terms).collect() == text.most_frequent(every, max_terms).collect()
    assert rough.count() < every.count()


def test_known_terms_are_weighed_without_an_exchange(many):
    vocab = text.session.settle(text.vocabulary(many, max_terms=30), "vocabulary")
    lists = text.tfidf_weights(text.term_counts(many, vocab=vocab), vocab)
    rows = text.tfidf_weights(text.term_counts(many), vocab)
    keyed = lambda df: {(r["song_id"], r["term"]): round(r["weight"], 12) for r in df.collect()}
    assert keyed(lists) == keyed(rows) and keyed(rows)
    assert "hashpartitioning" not in lists._jdf.queryExecution().executedPlan().toString()


def test_few_terms_are_counted_once(many, monkeypatch):
    counted, count = [], text._bucket_stats
    monkeypatch.setattr(text, "_bucket_stats", lambda *a: counted.append(a) or count(*a))
    rough = text.term_stats(many, max_terms=30_000, rough_docs=0)
    assert len(counted) == 1
    every = count(many, "song_id", "text")
    assert sorted(map(tuple, rough.collect())) == sorted(map(tuple, every.collect()))


def test_descriptions_are_made_once_by_all_cores(spark, monkeypatch):
    from tunewright.plans import jobs
    from tunewright.sources import bindings as b

    rows = [(i, f"red item{i % 7}", "B#1", "PROMO", i % 50, 900.0 + i % 90) for i in range(300)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    monkeypatch.setattr(b, "table", lambda *a: part.coalesce(1))
    seen, build = [], text.build_text_index
    monkeypatch.setattr(text, "build_text_index", lambda docs, *a: seen.append(docs) or build(docs, *a))
    index = jobs.build_text_index(b.songs(spark, ""))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "descriptions-" in "".join(seen[0].inputFiles()) and "Project" not in plan
    assert len(seen[0].inputFiles()) == spark.sparkContext.defaultParallelism
    want = build(jobs.describe_songs(b.songs(spark, "")))
    listed = lambda i: sorted((r["song_id"], r["term"], round(r["weight"], 9)) for r in i["postings"].collect())
    assert listed(index) == listed(want)
