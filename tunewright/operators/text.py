"""TF-IDF index over words and word pairs, and exact ranked search."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import fixed
from tunewright.operators import postings as search_blocks
from tunewright.sources import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens that are counted together.
RUN_TOKENS = 1_000_000
#: Documents from which terms are counted roughly first; counts by the leading bits of a term's hash, in chunks.
ROUGH_DOCS, BUCKET_BITS, CHUNKS = 20_000, 22, 64


def tokenize(text: Column | str) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN_PATTERN), F.lit(0))


def ngrams_1_2(tokens: Column | str) -> Column:
    """The tokens followed by every pair of neighbours joined by a blank."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    following = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
    leading = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
    return F.concat(t, F.zip_with(leading, following, lambda a, b: F.concat(a, F.lit(" "), b)))


def spaced(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, words``: the lower-cased text with one blank for all between words, as ``word_lists`` cuts it.

    Texts are dealt anew only where they lie in fewer pieces than there are cores.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores, key)
    return docs.select(F.col(key).alias("key"), F.regexp_replace(F.lower(text), fixed.TOKEN_GAP, " ").alias("words"))


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens (see ``tokenize``) of spaced texts, one after the other, and their number per text."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    kept = pc.greater_equal(pc.utf8_length(words), 2)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    upto = np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False)))[np.append(0, ends)]
    return words.filter(kept), np.diff(upto)


class Grams(NamedTuple):
    """Counted words and word pairs of the documents ``start`` to ``stop`` of a batch, sorted by document."""

    start: int
    stop: int
    owner: np.ndarray  # document of each entry, from 0
    gram: np.ndarray  # number of its term in ``names``
    tf: np.ndarray
    names: pa.Array


class Words(NamedTuple):
    """The tokens of the documents ``start`` to ``stop`` of a batch as numbers of ``names``."""

    start: int
    stop: int
    owner: np.ndarray  # document of each token, from 0
    code: np.ndarray
    inside: np.ndarray  # whether the next token is of the same document
    names: pa.Array


def numbered_words(texts: pa.Array) -> Iterator[Words]:
    """Runs of spaced documents of some RUN_TOKENS tokens."""
    tokens, lengths = word_lists(texts)
    before = np.cumsum(lengths) - lengths
    firsts = np.flatnonzero(np.diff(before // RUN_TOKENS, prepend=-1)).tolist()
    for start, stop in zip(firsts, [*firsts[1:], len(lengths)]):
        words = tokens.slice(before[start], lengths[start:stop].sum()).dictionary_encode()
        owner = np.repeat(np.arange(stop - start), lengths[start:stop])
        yield Words(start, stop, owner, words.indices.to_numpy().astype(np.int64), owner[1:] == owner[:-1], words.dictionary)


def gram_buckets(run: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token and of each pair: the same for the same term in every task."""
    odd, other, last = (np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

    def leading(x: np.ndarray) -> np.ndarray:
        return (((x ^ (x >> np.uint64(29))) * last) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    word = np.fromiter((zlib.crc32(w.encode()) for w in run.names.to_pylist()), np.uint64, len(run.names))
    first, second = (word * odd)[run.code[:-1][run.inside]], (word * other)[run.code[1:][run.inside]]
    return leading(word * odd)[run.code], leading(first ^ second)


def counted_grams(texts: pa.Array, heavy: np.ndarray | None = None) -> Iterator[Grams]:
    """Terms per document; words are numbered, pairs are pairs of numbers, strings come last.

    With ``heavy``, one flag per bucket, terms of other buckets are left out.
    """
    for run in numbered_words(texts):
        n, code, inside = len(run.names), run.code, run.inside
        owner, pairs, pair_owner = run.owner, n + code[:-1][inside] * n + code[1:][inside], run.owner[1:][inside]
        if heavy is not None:
            single, double = (heavy[at] for at in gram_buckets(run))
            owner, code, pairs, pair_owner = owner[single], code[single], pairs[double], pair_owner[double]
        distinct, gram = np.unique(np.concatenate([code, pairs]), return_inverse=True)
        entries, tf = np.unique(np.concatenate([owner, pair_owner]) * len(distinct) + gram, return_counts=True)
        paired = distinct[np.searchsorted(distinct, n):] - n
        single = run.names.take(pa.array(distinct[:len(distinct) - len(paired)]))
        double = pc.binary_join_element_wise(
            run.names.take(pa.array(paired // max(n, 1))), run.names.take(pa.array(paired % max(n, 1))), " ")
        names = pa.concat_arrays([single, double])
        yield Grams(run.start, run.stop, entries // max(len(distinct), 1), entries % max(len(distinct), 1), tf, names)


def term_rows(docs: DataFrame, key: str = "song_id", text: str = "text") -> DataFrame:
    """``key, term, tf, opens``: a document's terms and their numbers, counted where the document is.

    Documents are unique by key, so nothing is exchanged. ``opens`` marks one row
    per document; a document without terms keeps that row, with a null term.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in counted_grams(batch.column("words")):
                bare = np.setdiff1d(np.arange(run.stop - run.start), run.owner)
                opens = np.concatenate([np.diff(run.owner, prepend=-1) > 0, np.ones(len(bare), dtype=bool)])
                owner = pa.array(run.start + np.concatenate([run.owner, bare]))
                terms = pa.concat_arrays([run.names.take(pa.array(run.gram)), pa.nulls(len(bare), run.names.type)])
                tf = pa.concat_arrays([pa.array(run.tf, pa.int64()), pa.nulls(len(bare), pa.int64())])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(owner), terms, tf, pa.array(opens)],
                                                 names=[key, "term", "tf", "opens"])

    kind = docs.schema[key].dataType.simpleString()
    return spaced(docs, key, text).mapInArrow(rows, f"`{key}` {kind}, term string, tf bigint, opens boolean")


def term_stats(docs: DataFrame, key: str = "song_id", text: str = "text", max_terms: int | None = None,
               rough_docs: int | None = None) -> DataFrame:
    """``term, cf, df``: occurrences and documents per term, added up within a run of documents before they are exchanged.

    With ``max_terms``, terms that are not among so many most frequent ones may be missing. Most terms are rare: a first
    pass over many documents counts buckets of terms, and no term occurs more often than its bucket. The second one
    counts the terms of the fullest buckets. As many as are wanted must reach the count of the least of these buckets,
    else more buckets are taken.
    """
    if max_terms is None or docs.count() < (ROUGH_DOCS if rough_docs is None else rough_docs):
        return _bucket_stats(docs, key, text)
    spark = docs.sparkSession
    rough = session.settle(rough_counts(docs, key, text), "rough-counts")
    sizes = session.settle(_count_sizes(rough), "rough-sizes")
    buckets = 2 * max_terms
    while 4 * buckets <= 1 << BUCKET_BITS:
        least = _least_count(sizes, buckets).first()[0]
        if least is None or sizes.where(F.col("cf") >= least).agg(F.sum("terms")).first()[0] * 4 > 1 << BUCKET_BITS:
            break
        stats = session.settle(_bucket_stats(docs, key, text, spark.sparkContext.broadcast(_full_buckets(rough, least))), "term-stats")
        # Where no bucket holds less, all terms are counted, however few they are.
        if least == sizes.agg(F.min("cf")).first()[0] or stats.where(F.col("cf") >= least).count() >= max_terms:
            return stats
        buckets *= 4
    return _bucket_stats(docs, key, text)


def _bucket_stats(docs: DataFrame, key: str, text: str, heavy=None) -> DataFrame:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if heavy is None else np.unpackbits(np.frombuffer(heavy.value, np.uint8)).astype(bool)
        for batch in batches:
            for run in counted_grams(batch.column("words"), flags):
                n = len(run.names)
                yield pa.RecordBatch.from_arrays(
                    [run.names, pa.array(np.bincount(run.gram, run.tf, n).astype(np.int64)), pa.array(np.bincount(run.gram, minlength=n))],
                    names=["term", "cf", "df"])

    parts = spaced(docs, key, text).mapInArrow(sums, "term string, cf bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def rough_counts(docs: DataFrame, key: str = "song_id", text: str = "text") -> DataFrame:
    """``chunk, counts``: occurrences of all terms of a bucket, for the buckets of each chunk; one row per task and chunk is exchanged."""
    buckets = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for run in numbered_words(batch.column("words")):
                for at in gram_buckets(run):
                    counts += np.bincount(at, minlength=buckets)
        if counts.any():
            for chunk, part in enumerate(counts.reshape(CHUNKS, -1)):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.list_(pa.int64()))], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(part.flatten().to_numpy().reshape(-1, buckets // CHUNKS).sum(axis=0) for part in table.column("counts").chunks)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "counts": pa.array([total], pa.list_(pa.int64()))})

    kind = "chunk int, counts array<bigint>"
    return spaced(docs, key, text).mapInArrow(count, kind).groupBy("chunk").applyInArrow(add, kind)


def _count_sizes(rough: DataFrame) -> DataFrame:
    """``cf, terms``: how many buckets have each count."""
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in np.unique(batch.column("counts").flatten().to_numpy(), return_counts=True)], names=["cf", "terms"])

    return rough.mapInArrow(sizes, "cf bigint, terms bigint").where("cf > 0").groupBy("cf").agg(F.sum("terms").alias("terms"))


def _full_buckets(rough: DataFrame, least: int) -> bytes:
    """One bit per bucket, set from ``least`` occurrences on: half a megabyte, however much text there is."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column("counts").flatten().to_numpy().reshape(batch.num_rows, -1) >= least
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())], names=["chunk", "bits"])

    return b"".join(bytes(row["bits"]) for row in sorted(rough.mapInArrow(bits, "chunk int, bits binary").collect()))


def term_counts(docs: DataFrame, key: str = "song_id", text: str = "text", vocab: DataFrame | None = None) -> DataFrame:
    """``key, term, tf``; with a vocabulary that can be sent to every worker only its terms, as the lists of ``known_counts``."""
    if vocab is not None and vocab.count() <= BROADCAST_TERMS:
        return known_counts(docs, vocab, key, text)
    return term_rows(docs, key, text).where(F.col("term").isNotNull()).select(key, "term", "tf")


def document_count(docs: DataFrame) -> Column:
    return docs.agg(F.count(F.lit(1)).alias("n")).scalar()


def vocab_stats(counts: DataFrame, max_terms: int = fixed.MAX_TERMS) -> DataFrame:
    """``term, cf, df`` of the most frequent terms; ties go to the smaller term."""
    return most_frequent(counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")), max_terms)


def most_frequent(stats: DataFrame, max_terms: int = fixed.MAX_TERMS) -> DataFrame:
    """The ``max_terms`` rows of ``term, cf, df`` with the highest cf, then smallest term.

    The count that the last term must have is found among the distinct counts;
    only terms that reach it are sorted.
    """
    stats = session.settle(stats, "term-stats")
    # One row per distinct count: far fewer than terms.
    sizes = stats.groupBy("cf").agg(F.count(F.lit(1)).alias("terms"))
    return stats.where(F.col("cf") >= _least_count(sizes, max_terms).scalar()).orderBy(F.desc("cf"), "term").limit(max_terms)


def _least_count(sizes: DataFrame, rows: int) -> DataFrame:
    """The count that the last of the ``rows`` most frequent has, from ``cf, terms``."""
    before = F.sum("terms").over(Window.orderBy(F.desc("cf")).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < rows).agg(F.min("cf"))


def with_idf(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """Adds ``idf = ln((1 + documents) / (1 + df)) + 1``."""
    ratio = (F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))
    return vocab.withColumn("idf", F.log(ratio) + F.lit(1.0))


def vocabulary(docs: DataFrame, key: str = "song_id", max_terms: int = fixed.MAX_TERMS) -> DataFrame:
    """``term, cf, df, idf, term_id``: at most ``max_terms`` rows, numbered by term."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    chosen = with_idf(most_frequent(term_stats(docs, key, max_terms=max_terms), max_terms), n_docs)
    # Bounded by max_terms, so a window without a key is safe here.
    number = F.row_number().over(Window.orderBy("term")) - 1
    return chosen.withColumn("term_id", number)


#: Vocabulary rows up to which it is broadcast (some 20 MB); a larger one is joined as Spark sees fit.
BROADCAST_TERMS = 300_000


def _beside_terms(vocab: DataFrame, *columns: str) -> DataFrame:
    """Columns of the vocabulary for a join, broadcast where its size is checked."""
    chosen = vocab.select(*columns)
    return F.broadcast(chosen) if vocab.count() <= BROADCAST_TERMS else chosen


def tfidf_weights(counts: DataFrame, vocab: DataFrame, key: str = "song_id") -> DataFrame:
    """``key, term, term_id, weight``: (1 + ln tf) * idf, scaled to length 1 per document.

    Counts that lie in lists per document are weighed where they lie.
    """
    if "tfs" in counts.columns:
        rows = _list_weights(counts, vocab, key).select(key, F.explode(F.arrays_zip("terms", "weights")).alias("e"))
        rows = rows.select(key, F.col("e.terms").alias("term_id"), F.col("e.weights").alias("weight"))
        return rows.join(_beside_terms(vocab, "term_id", "term"), "term_id").select(key, "term", "term_id", "weight")
    raw = counts.join(_beside_terms(vocab, "term", "term_id", "idf"), "term").withColumn(
        "raw", (F.lit(1.0) + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "term_id", (F.col("raw") / length).alias("weight"))


def _list_weights(lists: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """The lists of ``known_counts`` with ``weights`` in place of ``tfs``."""
    known = vocab.select("term_id", "idf").toArrow().combine_chunks()
    sent = lists.sparkSession.sparkContext.broadcast(known)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf = (sent.value.column(c).to_numpy() for c in ("term_id", "idf"))
        idf_of = np.zeros(int(ids.max(initial=-1)) + 1)
        idf_of[ids] = idf
        for batch in batches:
            terms, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            lengths = terms.value_lengths().to_numpy()
            owner, flat = np.repeat(np.arange(len(terms)), lengths), terms.flatten()
            raw = (1.0 + np.log(tf)) * idf_of[flat.to_numpy()]
            weights = raw / np.sqrt(np.bincount(owner, raw * raw, len(terms)))[owner]
            offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, pa.array(weights))],
                names=[key, "terms", "weights"])

    kind = lists.schema[key].dataType.simpleString()
    return lists.mapInArrow(weigh, f"`{key}` {kind}, terms array<int>, weights array<double>")


def known_terms(terms: list[str], ids: list[int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a vocabulary, each one's term id as a term of its own (else -1), and its pairs, rising, with their ids."""
    split = [t.split(" ") for t in terms]
    names = list(dict.fromkeys(w for words in split for w in words))
    at = {w: i for i, w in enumerate(names)}
    single = np.full(len(names), -1, dtype=np.int64)
    pairs = []
    for words, number in zip(split, ids):
        if len(words) == 1:
            single[at[words[0]]] = number
        elif len(words) == 2:
            pairs.append((at[words[0]] * len(names) + at[words[1]], number))
    pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    return pa.array(names, pa.string()), single, pairs[:, 0], pairs[:, 1]


def known_counts(docs: DataFrame, vocab: DataFrame, key: str = "song_id", text: str = "text") -> DataFrame:
    """``key, terms, tfs``: per document the numbers of its terms in the vocabulary, rising, and how often each occurs.

    The texts are read where they lie, other terms are never written out, and
    nothing is exchanged; a document without any known term has no row.
    """
    known = vocab.select("term", "term_id").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(known_terms(known.column("term").to_pylist(), known.column("term_id").to_pylist()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, single, pairs, pair_ids = sent.value
        most = int(max(single.max(initial=-1), pair_ids.max(initial=-1))) + 1
        for batch in batches:
            for run in numbered_words(batch.column("words")):
                word = pc.index_in(run.names, value_set=names).fill_null(-1).to_numpy().astype(np.int64)[run.code]
                alone = np.append(single, -1)[word]
                both = run.inside & (word[:-1] >= 0) & (word[1:] >= 0)
                pair = word[:-1][both] * len(names) + word[1:][both]
                at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                met = pairs[at] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
                owner = np.concatenate([run.owner[alone >= 0], run.owner[1:][both][met]])
                term = np.concatenate([alone[alone >= 0], pair_ids[at[met]]])
                entries, tf = np.unique(owner * max(most, 1) + term, return_counts=True)
                owner, term = entries // max(most, 1), entries % max(most, 1)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                offsets = pa.array(np.append(first, len(owner)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(run.start + owner[first])),
                     pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], names=[key, "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return spaced(docs, key, text).mapInArrow(count, f"`{key}` {kind}, terms array<int>, tfs array<bigint>")


def weighted_documents(docs: DataFrame, vocab: DataFrame, key: str = "song_id") -> DataFrame:
    """One row per document with parallel ``terms`` and ``weights`` arrays; none for one without any known term.

    The texts are read where they lie and nothing is exchanged, as long as the
    vocabulary is small enough to be sent to every worker.
    """
    if vocab.count() > BROADCAST_TERMS:
        return weighted_rows(term_rows(docs, key), vocab, key)
    return _list_weights(term_counts(docs, key, "text", vocab), vocab, key)


def weighted_rows(rows: DataFrame, vocab: DataFrame, key: str = "song_id") -> DataFrame:
    """The weighted documents of ``term_rows``.

    Terms are replaced by their numbers; a document's entries are gathered
    before they are exchanged. It has at most as many entries as the vocabulary;
    one without any known term has no row.
    """
    known = rows.join(_beside_terms(vocab, "term", "term_id", "idf"), "term")
    raw = known.select(key, "term_id", ((F.lit(1.0) + F.log("tf")) * F.col("idf")).alias("raw"))
    gathered = raw.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_id", "raw"))).alias("entries"))
    square = F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["raw"] * e["raw"])
    return gathered.select(key, "entries", F.sqrt(square).alias("length")).select(
        key,
        F.col("entries.term_id").alias("terms"),
        F.zip_with(F.col("entries.raw"), F.array_repeat("length", F.size("entries")),
                   lambda x, n: x / n).alias("weights"))


def postings(documents: DataFrame, vocab: DataFrame, key: str = "song_id") -> DataFrame:
    """Inverted form ``term, key, weight`` of the weighted documents."""
    rows = documents.select(key, F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(
        key, F.col("e.terms").alias("term_id"), F.col("e.weights").alias("weight"))
    return rows.join(_beside_terms(vocab, "term_id", "term"), "term_id").select("term", key, "weight")


def build_text_index(docs: DataFrame, path: str | None = None, key: str = "song_id",
                     max_terms: int = fixed.MAX_TERMS) -> dict[str, DataFrame]:
    """Vocabulary, weighted documents, search blocks and postings, each written before the next one reads it.

    The texts are read twice, once for the vocabulary and once for the weights;
    what lies between is smaller than they are.
    """
    spark = docs.sparkSession
    path = path or session.shared_path(spark, "text-index")
    vocab = tables.write_through(vocabulary(docs, key, max_terms), f"{path}/vocabulary")
    documents = tables.write_through(weighted_documents(docs, vocab, key), f"{path}/documents")
    tables.write_through(search_blocks.build_blocks(documents, key), f"{path}/blocks")
    tables.write_postings(postings(documents, vocab, key), f"{path}/postings", key)
    return tables.read_text_index(spark, path)


def query_vectors(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """Queries weighted like documents; unknown terms are ignored, an empty query keeps a row."""
    known = weighted_documents(queries, vocab, "query_id")
    none = F.array().cast("array<double>")
    return queries.select("query_id").join(known, "query_id", "left").select(
        "query_id",
        F.coalesce("terms", none.cast("array<int>")).alias("terms"),
        F.coalesce("weights", none).alias("weights"))


def pooled_query(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """``term, weight`` summed over all queries: at most one row per vocabulary term."""
    asked = query_vectors(queries, vocab)
    terms = asked.select(F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    summed = terms.groupBy(F.col("e.terms").alias("term_id")).agg(F.sum("e.weights").alias("asked"))
    return summed.join(_beside_terms(vocab, "term_id", "term"), "term_id").select("term", "asked")


def query_join_postings(pooled: DataFrame, index: DataFrame, key: str = "song_id") -> DataFrame:
    """Contribution of every posting whose term occurs in the pooled query.

    The pooled side is bounded by the vocabulary: below ``BROADCAST_TERMS`` rows
    postings are not shuffled, and a frequent term never meets each query on its
    own.
    """
    pooled = session.settle(pooled, "pooled-query")
    return index.join(_beside_terms(pooled, "term", "asked"), "term").select(
        key, "term", (F.col("weight") * F.col("asked")).alias("contribution"))


def score_docs(contributions: DataFrame, key: str = "song_id") -> DataFrame:
    return contributions.groupBy(key).agg(F.sum("contribution").alias("score"))


def text_search(queries: DataFrame, vocab: DataFrame, documents: DataFrame, orders: DataFrame,
                hits: int = fixed.SEARCH_HITS, pad: bool = True, item_rows: int | None = None) -> DataFrame:
    """``indexed_search`` over weighted documents whose blocks are built here, ``item_rows`` documents to a shard."""
    documents = session.settle(documents, "weighted-documents")
    blocks = session.settle(search_blocks.build_blocks(documents, shard_docs=item_rows), "blocks")
    return indexed_search(queries, {"vocabulary": vocab, "blocks": blocks}, orders, hits, pad)


def indexed_search(queries: DataFrame, index: dict[str, DataFrame], orders: DataFrame, hits: int = fixed.SEARCH_HITS,
                   pad: bool = True) -> DataFrame:
    """``query_id, song_id, score, pos``: the best documents per query, ties by ``song_ord``.

    ``orders`` gives ``song_id, song_ord`` of the documents offered. With ``pad``
    a query always gets ``min(hits, documents)`` rows, those without a common
    term scoring 0.0.
    """
    asked = session.settle(query_vectors(queries, index["vocabulary"]), "query-vectors")
    found, _ = search_blocks.search(asked, index["blocks"], orders, hits)
    found = found.select("query_id", "song_id", "score", "pos")
    if not pad:
        return found
    found = session.settle(found, "found")
    # What is missing comes from the first documents by order: as many as there are hits hold enough without a score.
    first = orders.select(F.struct(F.col("song_ord"), F.col("song_id")).alias("s")).orderBy("s.song_ord").limit(hits)
    filler = first.agg(F.sort_array(F.collect_list("s")).alias("first"))
    have = found.groupBy("query_id").agg(F.max("pos").alias("have"))
    short = asked.select("query_id").join(have, "query_id", "left").where(F.coalesce("have", F.lit(0)) < hits)
    offered = short.select("query_id", F.coalesce("have", F.lit(0)).alias("have"), F.explode(filler.scalar()).alias("s")).select(
        "query_id", "have", "s.song_id", "s.song_ord")
    free = offered.join(found.select("query_id", "song_id"), ["query_id", "song_id"], "left_anti")
    place = F.col("have") + F.row_number().over(Window.partitionBy("query_id").orderBy("song_ord"))
    padded = free.withColumn("pos", place).where(F.col("pos") <= hits)
    return found.unionByName(padded.select("query_id", "song_id", F.lit(0.0).alias("score"), "pos"))


def search_cost(queries: DataFrame, index: dict[str, DataFrame], orders: DataFrame, hits: int = fixed.SEARCH_HITS) -> DataFrame:
    """Per query with a known term: shards that hold one, shards met, blocks in those, and blocks read."""
    asked = session.settle(query_vectors(queries, index["vocabulary"]), "query-vectors")
    return search_blocks.search(asked, index["blocks"], orders, hits)[1]
