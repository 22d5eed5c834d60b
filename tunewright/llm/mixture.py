"""Mixture-controlled packing: deficit round-robin over one queue per source.

A window is a number of whole sequences. In each window every queue is credited its target share of the window's tokens,
gives as many tokens as its deficit (credit not yet used) allows, and carries the rest of its deficit on; tokens left over
by rounding or by queues that ran dry go to the largest deficits, or are credited again to the queues that still have
some. Documents are cut wherever a window, a queue's part of it or a sequence ends, so nothing is padded: the tokens that
fill no whole sequence at the very end go into sequences of falling powers of two.

The schedule depends on the number of tokens per queue alone. Every run of windows starts from a state in closed form
(what each queue has given after so many tokens, and its deficit there), so any task can work out the runs it needs, and
all tasks agree: deficits are whole numbers of 2 ** -32 tokens. A document's place in its queue comes from running sums
within the task that encoded it and the sums of the tasks before; only those sums are exchanged, ids never are.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunewright.llm import tokens
from tunewright.llm.common import text_of
from tunewright.session import settle

CAPACITY, END_ID = 4096, 2
#: Sequences per window, and windows that are scheduled together.
WINDOW, RUN = 64, 64
#: Queues at most, and those of them that sources beyond that number share.
QUEUES, SHARED = 4_096, 256
#: Rows of (queue, task) sums up to which they are broadcast (some 50 MB); more are joined as Spark sees fit.
BROADCAST_SUMS = 1_000_000
#: Units of a token in which deficits are kept.
BITS = 32
#: Scheduled entries (queues times windows) that a worker remembers.
REMEMBERED = 4_000_000
#: Share that sources without a target get together at least, where targets are given.
REST = 0.01


class Schedule:
    """Where each queue's tokens go, from the number of tokens and the weight of each queue."""

    def __init__(self, counts: list[int], weights: list[int], capacity: int = CAPACITY, window: int = WINDOW, run: int = RUN):
        self.counts, self.weights = counts, weights
        self.capacity, self.window, self.run = capacity, window * capacity, run
        self.total = sum(counts)
        self.stride = self.window * run
        # Queues run dry in the order of tokens per weight; before each such moment: tokens of dry queues, weight of the others.
        dry = sorted((Fraction(c, w), s) for s, (c, w) in enumerate(zip(counts, weights, strict=True)))
        self.dry, self.used, self.active, self.reached = [], [], [], []
        used, active = 0, sum(weights)
        for moment, s in dry:
            self.dry.append(moment)
            self.used.append(used)
            self.active.append(active)
            self.reached.append(used + active * moment)
            used, active = used + counts[s], active - weights[s]
        # Beyond the last whole sequence: powers of two, largest first.
        self.whole = self.total // capacity
        edges = [self.whole * capacity]
        rest = self.total - edges[0]
        while rest:
            size = 1 << (rest.bit_length() - 1)
            edges.append(edges[-1] + size)
            rest -= size
        self.tail = np.array(edges, dtype=np.int64)
        self._states: dict[int, tuple[list[int], list[int]]] = {}
        self._runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def state(self, run: int) -> tuple[list[int], list[int]]:
        """Tokens that each queue has given before a run, and its deficit there."""
        if run not in self._states:
            position = min(run * self.stride, self.total)
            at = min(bisect.bisect_left(self.reached, position), len(self.dry) - 1)
            # Every queue has had credit of its weight times this moment, up to all it has.
            moment = Fraction(position - self.used[at], self.active[at])
            a, b = moment.numerator, moment.denominator
            given = [min(c, w * a // b) for c, w in zip(self.counts, self.weights, strict=True)]
            missing = position - sum(given)
            following = [(Fraction(g + 1, w), s) for s, (g, c, w) in enumerate(zip(given, self.counts, self.weights, strict=True)) if g < c]
            heapq.heapify(following)
            for _ in range(missing):
                _, s = following[0]
                given[s] += 1
                if given[s] < self.counts[s]:
                    heapq.heapreplace(following, (Fraction(given[s] + 1, self.weights[s]), s))
                else:
                    heapq.heappop(following)
            deficits = [min(c << BITS, (w * a << BITS) // b) - (g << BITS)
                        for g, c, w in zip(given, self.counts, self.weights, strict=True)]
            if len(self._states) * len(self.counts) > REMEMBERED:
                self._states.clear()
            self._states[run] = (given, deficits)
        return self._states[run]

    def windows(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows + 1, queues): tokens that each queue has given before each window of the run; (windows, queues): the
        place of its part of the window."""
        if run not in self._runs:
            given, deficits = (list(x) for x in self.state(run))
            ends = self.state(run + 1)[0]
            position, last = run * self.stride, min((run + 1) * self.stride, self.total)
            starts, places = [list(given)], []
            while position < last:
                before = list(given)
                self._fill(min(self.window, last - position), given, deficits, ends)
                place = []
                for b, g in zip(before, given, strict=True):
                    place.append(position)
                    position += g - b
                starts.append(list(given))
                places.append(place)
            if len(self._runs) * self.run * len(self.counts) > REMEMBERED:
                self._runs.clear()
            self._runs[run] = (np.array(starts, dtype=np.int64), np.array(places, dtype=np.int64))
        return self._runs[run]

    def _fill(self, room: int, given: list[int], deficits: list[int], ends: list[int]) -> None:
        """One window: queues give ``room`` tokens, none beyond its end of the run."""
        unit = 1 << BITS
        while room:
            active = [s for s, end in enumerate(ends) if given[s] < end]
            weight, credited = sum(self.weights[s] for s in active), room
            for s in active:
                deficits[s] += (credited * self.weights[s] << BITS) // weight
                take = min(room, ends[s] - given[s], max(0, deficits[s] >> BITS))
                given[s] += take
                deficits[s] -= take << BITS
                room -= take
            # Parts of a token: the largest deficits give one more and owe it to the next window.
            for s in sorted((s for s in active if given[s] < ends[s]), key=lambda s: (-deficits[s], s))[:room]:
                given[s] += 1
                deficits[s] -= unit
                room -= 1

    def run_of(self, queue: int, token: int) -> int:
        """The run in which a queue gives a token."""
        moment = token / self.weights[queue]
        position = sum(min(c, w * moment) for c, w in zip(self.counts, self.weights, strict=True))
        run = max(0, min(int(position // self.stride), -(-self.total // self.stride) - 1))
        while self.state(run)[0][queue] > token:
            run -= 1
        while self.state(run + 1)[0][queue] <= token:
            run += 1
        return run

    def parts(self, queue: int, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Where a queue's tokens of a run are cut (first token of each part, and the end), and the parts' places."""
        starts, places = self.windows(run)
        starts, places = starts[:, queue], places[:, queue]
        lengths = np.diff(starts)
        # The sequence ends inside a window's part.
        first, last = places // self.capacity + 1, (places + lengths - 1) // self.capacity
        inner = np.maximum(0, last - first + 1) * (lengths > 0)
        whose = np.repeat(np.arange(len(lengths)), inner)
        edges = (first[whose] + np.arange(len(whose)) - np.repeat(np.cumsum(inner) - inner, inner)) * self.capacity
        for edge in self.tail[1:-1]:
            hit = np.flatnonzero((places < edge) & (edge < places + lengths))
            whose, edges = np.concatenate([whose, hit]), np.concatenate([edges, np.full(len(hit), edge)])
        full = lengths > 0
        at = np.concatenate([starts[:-1][full], starts[whose] + edges - places[whose]])
        place = np.concatenate([places[full], edges])
        order = np.argsort(at, kind="stable")
        return np.append(at[order], starts[-1]), place[order]

    def sequence(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each place."""
        sequence = place // self.capacity
        offset = place - sequence * self.capacity
        late = place >= self.tail[0]
        step = np.searchsorted(self.tail, place[late], side="right") - 1
        sequence[late], offset[late] = self.whole + step, place[late] - self.tail[step]
        return sequence, offset


def queue_names(docs: DataFrame) -> DataFrame:
    """``docs`` with ``queue``: the source's name (never null), or a shared name for the smaller ones of too many sources."""
    named = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))
    docs = docs.withColumn("queue", named)
    sizes = docs.groupBy("queue").count().orderBy(F.desc("count"), "queue")
    largest = [r["queue"] for r in sizes.limit(QUEUES + 1).collect()]
    if len(largest) <= QUEUES:
        return docs
    own = docs.sparkSession.createDataFrame([(q,) for q in largest[:QUEUES - SHARED]], "own string")
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(SHARED)).cast("string"))
    # At most QUEUES names.
    joined = docs.join(F.broadcast(own), F.col("queue") == F.col("own"), "left")
    return joined.withColumn("queue", F.coalesce("own", shared)).drop("own")


def id_kind(tokenizer_path: str, end_id: int) -> np.dtype:
    """The narrower of two types that holds every id."""
    return np.dtype("<u2" if max(tokens.largest_id(tokenizer_path), end_id) < 1 << 16 else "<u4")


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(queue, source, doc_id, part, before, n, ids): a document's ids and end id as bytes, and the number of tokens of its
    queue that the same task has met before it. Written, as the tasks' numbers must not change."""
    kind = id_kind(tokenizer_path, end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), {}
        for batch in batches:
            for first, ids, lengths in tokens.documents(tokenizer_path, batch.column("text"), end_id):
                here = batch.slice(first, len(lengths))
                before = []
                for queue, n in zip(here.column("queue").to_pylist(), lengths.tolist(), strict=True):
                    before.append(met.get(queue, 0))
                    met[queue] = before[-1] + n
                places = np.concatenate([[0], np.cumsum(lengths) * kind.itemsize]).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(places), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [here.column("queue"), here.column("source"), here.column("doc_id"), pa.array([part] * len(lengths), pa.int32()),
                     pa.array(before, pa.int64()), pa.array(lengths, pa.int64()), data],
                    names=["queue", "source", "doc_id", "part", "before", "n", "ids"])

    columns = docs.select("queue", "source", "doc_id", "text")
    return settle(columns.mapInArrow(encode, "queue string, source string, doc_id long, part int, before long, n long, ids binary"), "encoded")


def weights_of(counts: dict[str, int], targets: dict[str | None, float] | None) -> list[int]:
    """Whole weights per queue: its tokens, or the targets, with the rest shared by tokens among sources without one."""
    if not targets:
        return list(counts.values())
    by_queue = {"" if s is None else f"+{s}": share for s, share in targets.items()}
    if min(by_queue.values()) <= 0:
        raise ValueError("targets are positive shares")
    free = sum(c for q, c in counts.items() if q not in by_queue)
    rest = max(1 - sum(by_queue.values()), REST)
    return [max(1, round(10**9 * (by_queue[q] if q in by_queue else rest * c / free))) for q, c in counts.items()]


SCHEMA = ("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "window long")


def mixed_sequences(docs: DataFrame, tokenizer_path: str, targets: dict[str | None, float] | None = None,
                    capacity: int = CAPACITY, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, window (and ids on request).

    ``targets`` gives shares of a window's tokens by source; without them each source has its share of all tokens in
    every window. A source that has run dry leaves its share to the others. Beyond QUEUES sources the smaller ones share
    queues, by the hash of their name. Null or empty text: the end id alone. Null source: a queue of its own. Null doc_id
    and repeated rows: packed like any other. Empty table: empty result. Further input columns are not carried.
    """
    spark = docs.sparkSession
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_of().alias("text"))
    rows = encoded(queue_names(chosen), tokenizer_path, end_id)
    sums = settle(rows.groupBy("queue", "part").agg(F.sum("n").alias("tokens")), "queue-sums")
    # One row per queue, at most QUEUES.
    counts = {r["queue"]: int(r["tokens"]) for r in sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")).orderBy("queue").collect()}
    if not counts:
        return spark.createDataFrame([], schema)
    numbers = {q: i for i, q in enumerate(counts)}
    schedule = Schedule(list(counts.values()), weights_of(counts, targets), capacity, window)
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_SUMS:
        bases = F.broadcast(bases)
    placed = rows.join(bases, ["queue", "part"]).select(
        "queue", "source", "doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    names = [c.split()[0] for c in schema.split(", ")]
    kind = id_kind(tokenizer_path, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            queue = np.array([numbers[q] for q in batch.column("queue").to_pylist()], dtype=np.int64)
            found = []
            for q in np.unique(queue):
                mine = np.flatnonzero(queue == q)
                mine = mine[np.argsort(at[mine], kind="stable")]
                run = schedule.run_of(int(q), int(at[mine[0]]))
                while True:
                    cuts, places = schedule.parts(int(q), run)
                    found.append((mine[at[mine] < cuts[-1]], cuts, places))
                    # A document that goes beyond the run is met again in the next.
                    mine = mine[np.searchsorted(at[mine] + n[mine], cuts[-1], side="right"):]
                    if not len(mine):
                        break
                    run = run + 1 if at[mine[0]] < cuts[-1] else schedule.run_of(int(q), int(at[mine[0]]))
            yield from pieces(batch, at, n, found)

    def pieces(batch: pa.RecordBatch, at: np.ndarray, n: np.ndarray, found: list) -> Iterator[pa.RecordBatch]:
        """The parts of documents that lie in the found runs."""
        out = []
        for docs_, cuts, places in found:
            low, high = np.maximum(at[docs_], cuts[0]), np.minimum(at[docs_] + n[docs_], cuts[-1])
            first = np.searchsorted(cuts, low, side="right") - 1
            last = np.searchsorted(cuts, high, side="left") - 1
            number = last - first + 1
            whose = np.repeat(np.arange(len(docs_)), number)
            part = first[whose] + np.arange(len(whose)) - np.repeat(np.cumsum(number) - number, number)
            start = np.maximum(low[whose], cuts[part])
            length = np.minimum(high[whose], cuts[part + 1]) - start
            out.append((docs_[whose], start - at[docs_][whose], length, places[part] + start - cuts[part]))
        row, start, length, place = (np.concatenate(c) for c in zip(*out, strict=True))
        sequence, offset = schedule.sequence(place)
        # One array of 32-bit ids for the batch, as its documents lie.
        ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind).astype("<u4")
        begin = (np.cumsum(n) - n)[row] + start
        sums_ = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist())), dtype=np.int64, count=len(row))
        taken = pa.array(row)
        columns = [batch.column("doc_id").take(taken), batch.column("source").take(taken), pa.array(start), pa.array(length),
                   pa.array(sums_), pa.array(n[row]), pa.array(sequence), pa.array(offset), pa.array(place // schedule.window)]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(ends, pa.array(tokens.joined(ids, begin, length).astype(np.int32))))
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return placed.mapInArrow(cut, schema)
