import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tunewright.llm import merkle
from tunewright.llm.queries import CHECKS


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf(row):
    out = ""
    for value in row:
        text = None if value is None else str(value)
        out += "-" if text is None else f"{len(text.encode('utf-8'))}:{text}"
    return h(out)


def climb(hashes):
    """Levels of hashes, from the leaves to the single last one."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1:first + 16]))
        at //= 16
    return out


def expected(rows):
    """(doc_id, source, lang, n_chars, text) rows to the manifest's."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode("utf-8")))
    trees, order = {}, {}
    for name in names:
        order[name] = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = climb([leaf(r) for r in order[name]])
    top = climb([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for at, row in enumerate(order[name]):
            path = siblings(trees[name], at) + siblings(top, place)
            node = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                node = leaf((*row[:4], lowered))
            for before, after in path:
                node = h(*before, node, *after)
            out.append((row[0], leaf(row), trees[name][-1][0], top[-1][0], h(*[x for b, a in path for x in (*b, *a)]), node,
                        node == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return sorted((tuple(r) for r in merkle.tampered_manifest(df).select(*COLUMNS).collect()), key=str)


def rows_of(sizes, seed=0):
    rng = random.Random(seed)
    ids = iter(rng.sample(range(100_000), sum(sizes.values())))
    return [(next(ids), name, rng.choice(["en", "de", None]), rng.randrange(99), rng.choice(["Some Text", "plain", "É ß\n日本", ""]))
            for name, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {"a": 257, None: 33, "": 2, "é": 16, "Z": 15},
    {f"s{i}": 1 + i % 3 for i in range(40)},
])
def test_against_plain_python(spark, sizes):
    rows = rows_of(sizes)
    assert run(spark, rows, grp="x", idx=1, size=2, parent=3, hash="h", part=4) == expected(rows)


def test_three_levels(spark):
    rows = rows_of({"big": 4_200, "small": 3}, 1)
    assert run(spark, rows) == expected(rows)


def test_nulls_repeated_rows_and_long_text(spark):
    rows = [(5, "a", None, None, None), (5, "a", "en", 4, "Text"), (5, "a", "en", 4, "Text"), (None, "a", None, None, "No Id"),
            (None, None, None, None, None), (7, None, "en", 0, ""), (8, "a", "en", 900_000, "Long Text " * 90_000)]
    rows += [(11, "copies", "en", 1, "Same")] * 40
    assert run(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_tampering_shows(spark):
    rows = [(i, "s", "en", 5, "Upper") for i in range(60)]
    got = run(spark, rows)
    altered = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert altered and {r[0] for r in got if not r[6]} == altered


def test_sql_check_agrees(spark, tmp_path):
    rows = rows_of({"a": 300, None: 20, "b": 1}, 3)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({CHECKS['op12_merkle_manifest']})").fetchall()
    assert sorted(got, key=str) == expected(rows)
