import random
import re

import numpy as np
import pytest
import xxhash

from tunewright.llm import simhash


def brute_print(text, shingle=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [words] if len(words) < shingle else [words[i:i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if label[i] != label[j] and (prints[i] ^ prints[j]).bit_count() <= radius:
                    low, high = sorted((label[i], label[j]))
                    label = [low if x == high else x for x in label]
                    changed = True
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def run(documents, rows, **more):
    out = simhash.simhash_groups(documents(rows, **more))
    named = out.select("doc_id", simhash.hex_of(out["print"]).alias("f"), "component_id").collect()
    return sorted((tuple(r) for r in named), key=str)


WORDS = [f"w{i}" for i in range(500)]


def test_components_equal_brute_force(documents):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(30, 200))]
        for copy in range(rng.randrange(1, 12)):
            changed = list(words)
            for _ in range(rng.randrange(0, 3)):
                changed[rng.randrange(len(changed))] = rng.choice(WORDS)
            rows.append((base * 100 + copy, " ".join(changed)))
    rows += [(9_000, None), (9_001, ""), (9_002, " \n"), (9_003, "one"), (9_004, "ONE"), (9_005, "a b c"), (9_006, "a b\x0bC"),
             (9_007, "a b c É d"), (None, "one"), (None, "alone here is a text of some words"), (9_003, "one")]
    assert run(documents, rows, cell=1, a="x", node=2, component="c") == brute_groups(rows)


def test_empty_table(documents):
    assert run(documents, []) == []


def test_very_long_text(documents):
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    assert run(documents, [(1, text)])[0][1] == f"{brute_print(text):016x}"


@pytest.mark.parametrize("cell_bits", [0, 3, 7])
def test_cells_together_find_every_link(cell_bits, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4_000)
    rng = np.random.default_rng(cell_bits)
    centres = rng.integers(0, 2**64, 20, dtype=np.uint64)
    prints = []
    for c in centres:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.append(int(c) ^ sum(1 << int(b) for b in flips))
    prints = np.unique(np.array(prints, dtype=np.uint64))
    forest = simhash.Forest(len(prints))
    place = {int(p): i for i, p in enumerate(prints)}
    low = np.uint64((1 << cell_bits) - 1)
    for cell in range(1 << cell_bits):
        near = np.bitwise_count((prints & low) ^ np.uint64(cell)) <= 2
        for a, b in simhash.cell_links(prints[near], cell, cell_bits):
            assert (a ^ b).bit_count() <= 4
            forest.join(place[a], place[b])
    for i in range(len(prints)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= 4:
                assert forest.root(i) == forest.root(j)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + i) for i in range(1, 300)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.node: r.component for r in got}
    assert len({label[i] for i in range(201)}) == 1 and len({label[1_000 + i] for i in range(300)}) == 1
    assert label[0] != label[1_000]


def test_one_of_each_group_stays(documents):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "something else in here today"), (None, "only null has this text here"),
            (None, "only null has this text here"), (4, None), (5, ""), (1, "a b c d e f")]
    df = documents(rows, row_key="k", component_id=1)
    for grouped in (simhash.simhash_groups(df), simhash.similar_groups(df)):
        kept = simhash.keep_one(df, grouped)
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, r.text.lower() if r.text else r.text) for r in kept.collect()), key=str)
        assert got == sorted([(1, "a b c d e f"), (2, rows[2][1]), (None, rows[3][1]), (4, None)], key=str)


def test_similar_texts_meet_and_others_stay_apart(documents):
    """Copies with up to 2 % of the words changed (a similarity of 0.8 and more) meet; half-changed ones do not."""
    rng = random.Random(9)
    rows, base_of = [], {}
    for base in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(80, 400))]
        rows.append((base * 10, " ".join(words)))
        for copy in range(1, 4):
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                changed[at] = rng.choice(WORDS)
            rows.append((base * 10 + copy, " ".join(changed)))
        half = list(words)
        for at in rng.sample(range(len(words)), len(words) // 5):
            half[at] = rng.choice(WORDS)
        rows.append((base * 10 + 9, " ".join(half)))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows, cell=1, table="t", node=2)).collect()}
    copies = [i for i in got if i % 10 in (1, 2, 3)]
    assert sum(got[i] == i // 10 * 10 for i in copies) >= 0.98 * len(copies)
    assert all(got[i] == i for i in got if i % 10 in (0, 9))


def test_signatures_of_long_texts(documents):
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    hashes = simhash.shingle_hashes(text, 5)
    for table, found in enumerate(simhash.signature(text, tables=2)):
        mixed = simhash._mixed(np.array(hashes, dtype=np.uint64), table).tolist()
        bits = [sum(h >> b & 1 for h in mixed) for b in range(64)]
        assert int(found) == sum(1 << b for b in range(64) if 2 * bits[b] > len(mixed))
    assert simhash.similar_groups(documents([])).collect() == []


def test_copies_inside_a_template_group(documents):
    """Texts of one template meet in many tables and fail on all bits; the pairs that hold are linked all the same."""
    rng = random.Random(4)
    template = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for base in range(300):
        words = list(template)
        for at in rng.sample(range(200), 4):
            words[at] = f"own{base}x{at}"
        rows.append((base * 10, " ".join(words)))
        if base % 3 == 0:
            for at in rng.sample(range(5, 195), 3):
                words[at] = f"copy{base}x{at}"
            rows.append((base * 10 + 1, " ".join(words)))
    signs = np.stack([simhash.signature(t) for _, t in rows])
    cut = signs >> np.uint64(simhash.BITS - simhash.TABLE_BITS)
    forest = simhash.Forest(len(rows))
    failing = 0
    for i in range(len(rows)):
        met = (np.bitwise_count(cut[:i] ^ cut[i]) <= simhash.RADIUS).any(axis=1)
        holds = np.bitwise_count(signs[:i] ^ signs[i]).sum(axis=1, dtype=int) <= simhash.most_bits(simhash.SIMILARITY)
        failing += int((met & ~holds).sum())
        for j in np.flatnonzero(met & holds).tolist():
            forest.join(i, j)
    # The rows are in the order of their ids, so the least id of a component is its root's.
    expected = {rows[i][0]: rows[forest.root(i)][0] for i in range(len(rows))}
    assert failing > len(rows)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(documents(rows)).collect()} == expected
