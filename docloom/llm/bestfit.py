"""Best-fit packing of tokenised documents into sequences, bulk-synchronous.

A document is its token ids and an end id. One longer than a sequence is cut into whole sequences, after a
shorter first piece if it doesn't divide; all other documents stay whole.

1. Texts are tokenised by a narrow map; what goes on is a row of a few numbers for each piece.
2. Pieces are range-sorted by length over all tasks, and get their rank among the pieces of their length:
   running numbers within a task, and the totals of the tasks before it.
3. Rounds. Unplaced pieces and open gaps are range-sorted by size together and dealt over tasks. In a successor sweep, from the widest
   down, every piece goes to the smallest gap at hand that holds it; where several pieces want one gap the lowest
   rank gets it and the others move on to the next. Each task sweeps its range of sizes; what a range leaves over, pieces too
   wide for its gaps and gaps too wide for its pieces, is matched over all ranges in a last sweep. Gaps are updated, new sequences are opened
   for the pieces that are wider than all gaps, and the round is repeated until no piece is left.
   As a gap or length has one of at most `capacity` values, both sorted sides are runs of equal values: a sweep matches runs, not
   rows, with work and memory that don't grow with the corpus, and gives moves (length, ranks) -> (sequences, offset). Between rounds
   the driver holds these runs only.
4. Each task looks up its pieces' moves by length and rank. The moves are bounded by the square of `capacity`
   (a few thousand in practice) and are the only thing that is broadcast.

This is best-fit decreasing but for two things: a range's pieces don't see gaps that wider pieces of other ranges leave in the same round, and the
pieces wider than all gaps open sequences together. In tests it needs as many sequences, rarely one more.

Defined cases: a null text is empty, and an empty one is the end id alone; rows that repeat a doc_id are packed
each, as pieces of that doc_id; a null doc_id is kept; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from docloom.llm.common import cut, slices

#: Runs of white space from which tiktoken's regular expressions might overflow (they do at a million).
LONG_RUN = 100_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Token ids of the tokenizers library for a byte-level BPE file.

    The same vocabulary runs in tiktoken, which gives the same ids several times faster; texts with special tokens go to
    the library itself, and so do those with very long runs of white space.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        from docloom.llm.bpe_count import PATTERN, byte_alphabet

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.fast = tiktoken.Encoding("docloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if any(s in text for s in self.special) or len(text) >= LONG_RUN and _RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def _pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = Encoder(tokenizer_path)
        encode = _ENCODERS[tokenizer_path].ids
        for batch in slices(batches):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    part = ids[4 * start : 4 * (first if k == 0 else start + capacity)]
                    rows.append((doc, k, start, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
            cols = list(zip(*rows)) or [()] * (5 + with_ids)
            types = [to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# A run is (kind, size, first, n, used): for PIECE, the pieces of that length with ranks from first on; for GAP, sequences from
# first on, each with that gap. Sweeps give back runs of both kinds, and moves (MOVE, length, first rank, ranks, first sequence, offset).
PIECE, GAP, MOVE = range(3)
RUN = "kind int, size int, first long, n long, to long, offset int"
#: Runs of a task in a sweep.
TASK_RUNS = 512


def sweep(runs: list[tuple], capacity: int) -> list[tuple]:
    """One successor sweep over runs in any order: moves, and the runs left over.

    From the widest down, so that the gaps passed and still open are a stack with the narrowest on top: the successor of the
    piece that is next. An updated gap goes back on top if it holds that piece, else it waits for its size to come.
    """
    out: list[tuple] = []
    stack: list[tuple[int, int, int]] = []  # gap, first, n
    # a gap comes before the pieces that just fill it
    events = [(-size, -kind, first, n) for kind, size, first, n, *_ in runs]
    heapq.heapify(events)
    while events:
        size, kind, first, n = heapq.heappop(events)
        size = -size
        if kind == -GAP:
            stack.append((size, first, n))
            continue
        while n and stack:
            gap, sequence, m = stack.pop()
            take = min(m, n)
            out.append((MOVE, size, first, take, sequence, capacity - gap))
            first, n = first + take, n - take
            if take < m:
                stack.append((gap, sequence + take, m - take))
            if gap - size >= size:
                stack.append((gap - size, sequence, take))
            elif gap > size:
                heapq.heappush(events, (size - gap, -GAP, sequence, take))
        if n:
            out.append((PIECE, size, first, n, 0, 0))
    return out + [(GAP, *g, 0, 0) for g in stack]


def sweep_round(spark: SparkSession, runs: list[tuple], capacity: int) -> list[tuple]:
    """A sweep of each range of sizes in its own task, and one of what these leave over."""
    schema = to_arrow_schema(StructType.fromDDL(RUN))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        yield batch([r for r in rows if r[0] == MOVE] + sweep([r for r in rows if r[0] != MOVE], capacity))

    parts = -(-len(runs) // TASK_RUNS)
    table = spark.createDataFrame(pa.Table.from_batches([batch(runs)]))
    if parts > 1:
        table = table.repartitionByRange(parts, "size").mapInArrow(swept, RUN)
    # what is left over are runs: at most a few for each size, however many rows they stand for
    return [tuple(r) for r in table.repartition(1).mapInArrow(swept, RUN).collect()]


def plan_moves(spark: SparkSession, counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Bulk-synchronous best fit over runs: (length, first rank, ranks, first sequence, offset) of every move.

    The pieces of that length with ranks [first, first + ranks) go to the sequences from the first one on, one
    each, at the offset.
    """
    runs = [(PIECE, length, 0, n, 0, 0) for length, n in counts.items() if n]
    moves: list[tuple[int, int, int, int, int]] = []
    opened = 0
    while pieces := [r for r in runs if r[0] == PIECE]:
        widest = max(r[1] for r in pieces)
        # the widest piece fits nowhere: it and those of which no more go into a sequence open new ones
        room = max((r[1] for r in runs if r[0] == GAP), default=0)
        if widest > room:
            fit = capacity // widest
            new = -(-sum(r[3] for r in pieces if r[1] > room and capacity // r[1] == fit) // fit)
            runs.append((GAP, capacity, opened, new, 0, 0))
            opened += new
        runs = sweep_round(spark, runs, capacity)
        moves += [r[1:] for r in runs if r[0] == MOVE]
        # gaps that hold no piece any more are closed
        least = min((r[1] for r in runs if r[0] == PIECE), default=capacity + 1)
        runs = [r for r in runs if r[0] == PIECE or r[0] == GAP and r[1] >= least]
    return moves


def pack(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; its ids as little-endian words if asked for."""
    pieces = cut(_pieces(docs, tokenizer_path, capacity, end_id, with_ids))

    names = pieces.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            length = batch.column("length").to_numpy()
            start = np.flatnonzero(np.diff(length, prepend=last if len(length) else 0))
            base = np.zeros(len(length), np.int64)
            base[start] = start
            within = np.arange(len(length)) - np.maximum.accumulate(base)
            if len(length):
                upto = start[0] if len(start) else len(length)
                within[:upto] += seen
                seen = int(within[-1]) + 1
                last = int(length[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(within)], names=[*names, "part", "within"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    ranged = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    numbered = cut(ranged.mapInArrow(number, f"{fields}, part int, within long"))
    # a row for each task and length in it: tasks hold ranges of lengths, so tasks + capacity rows at most
    totals = numbered.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = totals.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).collect()
    counts: dict[int, int] = {}
    for r in before:
        counts[r.length] = counts.get(r.length, 0) + r.n
    moves = sorted(plan_moves(docs.sparkSession, counts, capacity))
    shipped = docs.sparkSession.sparkContext.broadcast((np.array(moves, np.int64).reshape(-1, 5), {(r.length, r.part): r.before for r in before}))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shipped.value
        start_of = dict(zip(*np.unique(table[:, 0], return_index=True))) if len(table) else {}
        end_of = {length: at + n for (length, at), n in zip(start_of.items(), np.unique(table[:, 0], return_counts=True)[1])} if len(table) else {}
        for batch in batches:
            length, part, within = (batch.column(c).to_numpy() for c in ("length", "part", "within"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one, task in {*zip(length.tolist(), part.tolist())}:
                rows = np.flatnonzero((length == one) & (part == task))
                rank = within[rows] + base[one, task]
                own = table[start_of[one] : end_of[one]]
                move = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                sequence[rows], offset[rows] = move[:, 3] + rank - move[:, 1], move[:, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array of int) of every sequence, from pieces packed with their ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in sorted(x, key=lambda p: p["offset"])), "<u4").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    # a sequence has `capacity` pieces at most
    return packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("p")).mapInArrow(join, "sequence_id long, ids array<int>")
