"""Quality by perplexity: an interpolated modified Kneser-Ney model of character trigrams, trained on trusted text.

Texts move once, packed, into blocks of bounded size. Each block names its distinct trigrams and counts those of its
trusted texts; the counts of all blocks are added per trigram (sharded by it), the model's terms are worked out per
(language, middle character) and joined as tables, and the log probabilities go back to the blocks that asked for them,
where the texts are scored. Counts cover all trusted text; nothing is sampled, and no task or broadcast holds the model.

Counting and scoring are one query, so that both read the same exchange of the texts. It stays one because every reader
of an exchange takes all its columns.

A document is rejected if its mean log probability lies far above what trusted text of its language shows: as far above
the upper quantile as that lies above the median.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright.llm.common import beside, text_of
from tunewright.session import settle

# Choices of this library.
BLOCK_BYTES = 128 * 1024 * 1024
UPPER = 0.99
#: Cells of the perplexity grid per bit.
CELLS = 1_000
#: Code points that stand for the start and the end of a text; 21 bits hold any code point.
START, END, BITS = 2, 3, 21
#: Stands for a null language inside the job, so that languages are joined by plain equality.
NO_LANG = "\x00"
#: Characters whose trigrams are written out at once.
PART = 1_000_000


def trigrams(texts: Iterator[str]) -> Iterator[np.ndarray]:
    """Codes of the trigrams of each text: two starts, its code points, an end."""
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        whole = np.concatenate(([START, START], points, [END]))
        yield (whole[:-2] << 2 * BITS) | (whole[1:-1] << BITS) | whole[2:]


def counted(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of all texts and their counts, with at most about PART codes waiting."""
    total = (np.array([], np.int64), np.array([], np.int64))
    waiting, size = [], 0

    def add(total: tuple[np.ndarray, np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = np.unique(np.concatenate(parts), return_counts=True)
        both = np.concatenate([total[0], codes])
        merged, at = np.unique(both, return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate([total[1], counts])).astype(np.int64)
        return merged, sums

    for codes in trigrams(texts):
        waiting.append(codes)
        size += len(codes)
        if size >= PART:
            total, waiting, size = add(total, waiting), [], 0
    return add(total, waiting) if waiting else total


def in_blocks(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, doc_id, lang, packed text) of each row, the only exchange of texts; and (block, doc_id) of trusted ids."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    df = beside(docs, doc_id=F.col("doc_id").cast("long"), lang=F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)),
                text=text_of()).drop("_row")
    # Rows without id are spread by their text; they are never trusted.
    block = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(blocks))
    df = df.select(block.alias("block"), "doc_id", "lang", "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = pa.array([pack(t) for t in batch.column(3).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], names=["block", "doc_id", "lang", "packed"])

    df = df.mapInArrow(packed, "block long, doc_id long, lang string, packed binary").repartition(blocks, "block")
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    ids = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id")
    return df, ids


def block_counts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(block, lang, code, seen): each block's distinct trigrams; ``seen`` counts them in its trusted texts."""

    def counts(texts: pa.Table, trusted: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        known = set(trusted.column("doc_id").to_pylist())
        place: dict[str, tuple[list[int], list[int]]] = {}
        for at, (doc_id, lang) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("lang").to_pylist(), strict=True)):
            place.setdefault(lang, ([], []))[doc_id in known].append(at)
        packed = texts.column("packed")
        out = {"block": [], "lang": [], "code": [], "seen": []}
        for lang, parts in place.items():
            other, own = (counted(unpack(packed[at].as_py()).decode("utf-8") for at in part) for part in parts)
            codes = np.union1d(other[0], own[0])
            seen = np.zeros(len(codes), np.int64)
            seen[np.searchsorted(codes, own[0])] = own[1]
            out["block"].append(pa.array(np.full(len(codes), texts.column("block")[0].as_py())))
            out["lang"].append(pa.array([lang]).take(pa.array(np.zeros(len(codes), np.int32))))
            out["code"].append(pa.array(codes))
            out["seen"].append(pa.array(seen))
        types = {"block": pa.int64(), "lang": pa.string(), "code": pa.int64(), "seen": pa.int64()}
        return pa.table({name: pa.chunked_array(out[name], kind) for name, kind in types.items()})

    return rows.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(
        counts, "block long, lang string, code long, seen long")


def _kinds(codes: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one (language, middle character): the trigrams seen, their counts, first and last characters, and each
    distinct last character with its number of different first ones."""
    own = seen > 0
    codes, seen = codes[own], seen[own]
    last, kinds = np.unique(codes & ((1 << BITS) - 1), return_counts=True)
    return codes, seen, codes >> 2 * BITS, codes & ((1 << BITS) - 1), last, kinds


def level_statistics(totals: DataFrame) -> DataFrame:
    """(lang, level, key, value): for levels 3 and 2 the number of entries counted ``key`` = 1 to 4 times, for level 1
    the number of different characters before the character ``key``. ``totals`` has lang, middle, code, seen, blocks."""

    def statistics(key: tuple, table: pa.Table) -> pa.Table:
        _, seen, _, _, last, kinds = _kinds(table.column("code").to_numpy(), table.column("seen").to_numpy())
        rows = [(3, k, int((seen == k).sum())) for k in range(1, 5)] + [(2, k, int((kinds == k).sum())) for k in range(1, 5)]
        rows += [(1, c, 1) for c in last.tolist()]
        level, number, value = zip(*rows, strict=True)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(rows), pa.string()), "level": pa.array(level, pa.int32()),
                         "key": pa.array(number, pa.int64()), "value": pa.array(value, pa.int64())})

    found = totals.groupBy("lang", "middle").applyInArrow(statistics, "lang string, level int, key long, value long")
    return found.groupBy("lang", "level", "key").agg(F.sum("value").alias("value"))


def discounts(times: DataFrame) -> list[Column]:
    """d1, d2, d3 from columns n1 to n4, the numbers of entries counted once to four times."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def held(k: int) -> Column:
        # Where a number is missing, half a count per step; never more than the count itself.
        value = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))
        return F.greatest(F.lit(0.1), F.least(F.lit(float(k)), F.coalesce(value, F.lit(0.5 * k))))

    return [held(k) for k in (1, 2, 3)]


def level_discounts(statistics: DataFrame, level: int) -> DataFrame:
    """(lang, cuts): the three discounts of a level per language."""
    key = F.col("key") if level > 1 else F.col("value")
    value = F.col("value") if level > 1 else F.lit(1)
    own = statistics.filter(F.col("level") == level).groupBy("lang").agg(
        *[F.sum(F.when(key == k, value).otherwise(0)).cast("double").alias(f"n{k}") for k in range(1, 5)])
    return own.select("lang", F.array(*discounts(own)).alias("cuts"))


def first_level(statistics: DataFrame) -> DataFrame:
    """(lang, character, share, floor): what a character gets by itself, and what any character gets at least."""
    one = statistics.filter("level = 1")
    cuts = level_discounts(statistics, 1)
    one = one.join(cuts, "lang")
    cut = F.least(F.get("cuts", F.least(F.col("value"), F.lit(3)).cast("int") - 1), F.col("value").cast("double"))
    one = one.select("lang", "key", "value", cut.alias("cut"))
    sums = one.groupBy("lang").agg(F.sum("value").cast("double").alias("total"), F.sum("cut").alias("freed"),
                                   F.count(F.lit(1)).alias("letters"))
    return one.join(sums, "lang").select(
        "lang", F.col("key").alias("character"), ((F.col("value") - F.col("cut")) / F.col("total")).alias("share"),
        (F.col("freed") / F.col("total") / (F.col("letters") + 1)).alias("floor"))


def higher_levels(totals: DataFrame, statistics: DataFrame) -> DataFrame:
    """(lang, code, own, rest): p(c | a b) = own + rest * p(c), for every trigram in ``totals``, seen or not."""
    three = level_discounts(statistics, 3).withColumnRenamed("cuts", "cuts3")
    cuts = three.join(level_discounts(statistics, 2).withColumnRenamed("cuts", "cuts2"), "lang")

    def shares(counts: np.ndarray, cuts: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each entry's share after discounting; per distinct context the mass kept back."""
        cut = np.minimum(cuts[np.minimum(counts, 3) - 1], counts)
        names, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(names))
        freed = np.bincount(at, weights=cut, minlength=len(names))
        return (counts - cut) / total[at], names, freed / total

    def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def terms(key: tuple, table: pa.Table) -> pa.Table:
        asked = table.column("code").to_numpy()
        codes, seen, first, _, last, kinds = _kinds(asked, table.column("seen").to_numpy())
        cuts3, cuts2 = np.array(table.column("cuts3")[0].as_py()), np.array(table.column("cuts2")[0].as_py())
        share3, contexts, back3 = shares(seen, cuts3, first)
        share2, _, back2 = shares(kinds, cuts2, np.zeros(len(kinds), np.int64))
        order = np.argsort(codes)
        own3 = looked_up(codes[order], share3[order], asked, 0.0)
        rest3 = looked_up(contexts, back3, asked >> 2 * BITS, 1.0)
        own2 = looked_up(last, share2, asked & ((1 << BITS) - 1), 0.0)
        rest2 = float(back2[0]) if len(back2) else 1.0
        return pa.table({"lang": table.column("lang"), "code": table.column("code"), "own": pa.array(own3 + rest3 * own2),
                         "rest": pa.array(rest3 * rest2)})

    return totals.join(cuts, "lang").groupBy("lang", "middle").applyInArrow(
        terms, "lang string, code long, own double, rest double")


def log_probabilities(counts: DataFrame) -> DataFrame:
    """(lang, code, bits): -log2 p(c | a b) of each trigram in ``counts`` (block, lang, code, seen), seen or not.

    Languages without trusted text get no rows.
    """
    mask = F.lit((1 << BITS) - 1)
    totals = counts.groupBy("lang", "code").agg(F.sum("seen").alias("seen"), F.count("block").alias("blocks"))
    totals = totals.withColumn("middle", F.shiftright("code", BITS).bitwiseAND(mask))
    statistics = level_statistics(totals)
    one = first_level(statistics).select(F.col("lang").alias("_lang"), F.col("character").alias("_character"), "share")
    least = first_level(statistics).groupBy(F.col("lang").alias("_llang")).agg(F.max("floor").alias("floor"))
    df = higher_levels(totals, statistics).withColumn("last", F.col("code").bitwiseAND(mask))
    df = df.join(one, (F.col("lang") == F.col("_lang")) & (F.col("last") == F.col("_character")), "left")
    df = df.join(least, F.col("lang") == F.col("_llang"))
    p = F.col("own") + F.col("rest") * (F.coalesce("share", F.lit(0.0)) + F.col("floor"))
    return df.select("lang", "code", (-F.log2(p)).alias("bits"))


def scored(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_grams and bits (mean per trigram; null without a model of the language) of each row.

    ``trusted`` has the doc_ids of trusted text, each once.
    """
    rows, ids = in_blocks(docs, trusted)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # Joins ask for rows without nulls: asked here, the question is the same for all readers of the exchange.
    counts = block_counts(rows, ids).filter("block IS NOT NULL AND lang IS NOT NULL AND code IS NOT NULL")
    counts = counts.repartition(parts, "lang", "code")
    model = log_probabilities(counts).withColumnsRenamed({"lang": "_lang", "code": "_code"})
    wanted = counts.join(model, (F.col("lang") == F.col("_lang")) & (F.col("code") == F.col("_code"))).select(
        "block", "lang", "code", "seen", F.col("bits").cast("float").alias("bits"))

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        tables = {}
        langs = known.column("lang").combine_chunks().dictionary_encode()
        codes, bits = known.column("code").to_numpy(), known.column("bits").to_numpy().astype(np.float64)
        names = langs.indices.to_numpy() if len(langs) else np.array([], np.int32)
        for number, lang in enumerate(langs.dictionary.to_pylist()):
            own = np.flatnonzero(names == number)
            own = own[np.argsort(codes[own])]
            tables[lang] = (codes[own], bits[own])
        n, means = [], []
        for lang, packed in zip(texts.column("lang").to_pylist(), texts.column("packed"), strict=True):
            own = tables.get(lang)
            [found] = trigrams(iter([unpack(packed.as_py()).decode("utf-8")]))
            n.append(len(found))
            if own is None:
                means.append(None)
            else:
                distinct, times = np.unique(found, return_counts=True)
                means.append(float(own[1][np.searchsorted(own[0], distinct)] @ times) / len(found))
        return pa.table([texts.column("doc_id"), texts.column("lang"), pa.array(n, pa.int64()),
                         pa.array(means, pa.float64())], names=["doc_id", "lang", "n_grams", "bits"])

    out = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
        score, "doc_id long, lang string, n_grams long, bits double")
    return out.withColumn("lang", F.when(F.col("lang") != NO_LANG, F.col("lang")))


def limits(rows: DataFrame, upper: float = UPPER) -> DataFrame:
    """(lang, most): the bits beyond which a document of the language is rejected, from its trusted rows on a grid."""
    cells = rows.filter("coalesce(trusted, false) AND bits IS NOT NULL").groupBy("lang", F.floor(F.col("bits") * CELLS).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang")
    upto = own.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.select("lang", "cell", F.sum("n").over(upto).alias("upto"), F.sum("n").over(own).alias("total"))

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= share * F.col("total"), (F.col("cell") + 1) / CELLS))

    return ranked.groupBy("lang").agg((2 * quantile(upper) - quantile(0.5)).alias("most"))


def quality_by_perplexity(docs: DataFrame, trusted: DataFrame, upper: float = UPPER) -> DataFrame:
    """doc_id, lang, n_grams, perplexity, kept of each document row.

    ``trusted``: doc_id of trusted documents (repeats and nulls are ignored). Null or empty text: the end of text alone is
    scored. Null lang: a language like any other. A language without trusted text: perplexity null, kept. Repeated rows:
    each alike, and a trusted one counts as often as it occurs. Empty table: empty result. Further columns are not carried.
    """
    ids = settle(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct(), "trusted")
    rows = settle(scored(docs, ids), "perplexity")
    named = ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("trusted"))
    rows = rows.join(named, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    most = settle(limits(rows, upper), "perplexity-limits").withColumnRenamed("lang", "_lang")
    df = rows.join(most, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = F.coalesce(F.col("bits") <= F.col("most"), F.lit(True))
    return df.select("doc_id", "lang", "n_grams", F.pow(F.lit(2.0), "bits").alias("perplexity"), inside.alias("kept"))
