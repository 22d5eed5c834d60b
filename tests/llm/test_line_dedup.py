from collections import defaultdict

from tunewright.llm import line_dedup
from tunewright.llm.common import BLANKS

LONG = "This line is long enough to be counted as common"


def brute(rows):
    held = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            docs = held.get(key(line), ())
            top = max((d for d in docs if d is not None), default=None)
            if len(docs) < 5 or doc_id == top:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(documents, rows, **more):
    out = line_dedup.line_dedup(documents(rows, **more))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=str)


def test_common_lines_stay_in_the_largest_document(documents):
    rows = [(i, f"own {i}\n \t{LONG}\x0b\nÉtait {LONG.upper()}") for i in range(6)]
    rows += [(6, LONG.upper()), (7, f"{LONG}\n{LONG}\nend"), (8, "É" * 40), (9, None), (10, ""), (11, "\n\n")]
    rows += [(20 + i, "é" * 40 + "\r\n" + "É" * 39) for i in range(5)]
    assert run(documents, rows) == brute(rows)


def test_four_documents_are_not_enough_and_repeated_rows_count_once(documents):
    rows = [(i, LONG) for i in range(4)] + [(3, LONG), (3, LONG)]
    assert run(documents, rows) == brute(rows)


def test_null_ids_are_one_document_below_all_others(documents):
    rows = [(None, LONG), (None, LONG + "\nx")] + [(i, LONG) for i in range(4)]
    assert run(documents, rows) == brute(rows)


def test_short_of_the_limit_by_one_code_point(documents):
    rows = [(i, "𝒳" * 39 + "\n" + "𝒳" * 40) for i in range(5)]
    assert run(documents, rows) == brute(rows)


def test_empty_table_and_clashing_columns(documents):
    assert run(documents, []) == []
    rows = [(i, LONG + f"\n{i}") for i in range(7)]
    clash = {"position": 3, "hash": "h", "n_lines": -1, "row_key": "k", "dropped": "d", "_row": "r", "keep": 0}
    assert run(documents, rows, **clash) == brute(rows)


def test_runs_rebuild_the_text(documents):
    rows = [(i, f"a\n{LONG}\nb\nc\n{LONG}") for i in range(5)]
    out = {r.doc_id: r for r in line_dedup.line_dedup(documents(rows)).collect()}
    assert [(r.start, r.length) for r in out[0].keep] == [(0, 1), (2, 2)]
    assert [(r.start, r.length) for r in out[4].keep] == [(0, 5)]


def test_very_long_text(documents):
    rows = [(i, "\n".join([LONG, "x" * 50, "y"] * 2_000 + [str(i)])) for i in range(5)]
    assert run(documents, rows) == brute(rows)


def test_first_occurrences_are_streamed_in_range_order(documents, spark, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, label)

    settle = line_dedup.settle
    monkeypatch.setattr(line_dedup, "settle", noted)
    line = "a line of more than forty code points, again and again"
    got = line_dedup.keep_bitmaps(documents([(i, f"{line}\n{i}\n{line}") for i in range(6)])).collect()
    assert len(got) == 5 and all(r.dropped == [0, 2] for r in got)
    [common] = [plan for plan in plans if "rangepartitioning" in plan]
    # One exchange of lines, by range; the order by position is used above it.
    below = common[:common.index("rangepartitioning")]
    assert "Window" in below and "Sort" in below and "hashpartitioning(hash" in below and below.count("Exchange") == 2
