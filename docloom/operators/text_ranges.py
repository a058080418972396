"""Text and CSV files of any size, split by many tasks: paragraphs and rows with the index and total they have in the whole file.

Spark reads a file in blocks (`spark.sql.files.maxPartitionBytes`), a line going with the block in which it begins. Tasks join the lines of a
block to runs between blank lines. A run at a block's edge may go on in the next one: a summary of a few narrow rows for each block says which do,
where each began, and how many paragraphs come before the block in its file. Whole runs take their index from it without a shuffle; only the
runs at edges, two for each block at most, are shuffled, by the block in which they began, and joined. So a file is read twice and never
meets one task or row; a paragraph does.

Results equal `text_split.split_paragraphs` and `split_csv_rows` of the file's text, for every size of the blocks. Defined cases: an empty or
blank file has no rows; a carriage return at a line's end goes in CSV, also at that of the file; a compressed file is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docloom.functions.text import trim_controls
from docloom.sources.scratch import cut

#: Bytes of a relation of blocks or files up to which it may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes counted for a row of it, besides its texts.
ROW_BYTES = 128
HEAD, INNER, TAIL, WHOLE, END = range(5)
_RUNS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("role", pa.int32()), ("rank", pa.int64()), ("solid", pa.bool_()), ("text", pa.string())])
_RUN_COLUMNS = "path string, block long, role int, rank long, solid boolean, text string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block, line: in the order of the file within a block."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(path, block) and its lines, as many pieces as they come in."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block, line = batch.columns
        codes = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = block.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield (path[int(a)].as_py(), int(starts[a])), line.slice(a, b - a)


class _Block:
    """The runs of one block, piece by piece."""

    def __init__(self, key: tuple[str, int]):
        self.key, self.rank, self.first, self.open, self.from_start = key, 0, True, [], False

    def _rows(self, texts: pa.Array, role: int) -> pa.RecordBatch:
        solid = pc.match_substring_regex(texts, r"[^\x00-\x20]")
        n = len(texts)
        if role == INNER:
            ranks = self.rank + np.cumsum(solid.to_numpy(zero_copy_only=False)) - 1
            self.rank = int(ranks[-1]) + 1
        else:
            ranks = np.full(n, self.rank)
        return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * n), pa.array([self.key[1]] * n), pa.array([role] * n, pa.int32()), pa.array(ranks, pa.int64()), solid, texts], schema=_RUNS)

    def _close(self, role: int | None = None) -> pa.RecordBatch:
        lines = pa.chunked_array(self.open).combine_chunks()
        text = pa.array(["\n".join(lines.to_pylist())])
        done = self._rows(text, (HEAD if self.from_start else INNER) if role is None else role)
        self.open, self.from_start = [], False
        return done

    def take(self, lines: pa.Array, inner: bool) -> Iterator[pa.RecordBatch]:
        blank = pc.match_substring_regex(lines, r"^[ \t\n\x0b\f\r]*$").to_numpy(zero_copy_only=False)
        full = np.concatenate([[False], ~blank, [False]])
        starts, ends = np.flatnonzero(full[1:-1] & ~full[:-2]), np.flatnonzero(full[1:-1] & ~full[2:]) + 1
        n = len(lines)
        if self.open and (blank[0] or ends[0] < n):  # what was open ends in this piece
            if not blank[0]:
                self.open.append(lines.slice(0, ends[0]))
            yield self._close()
            if not blank[0]:
                starts, ends = starts[1:], ends[1:]
        elif self.open:
            self.open.append(lines)
            starts, ends = starts[1:], ends[1:]
        elif self.first and len(starts) and starts[0] == 0:
            self.from_start = True
            self.open = [lines.slice(0, ends[0])]
            if ends[0] < n:
                yield self._close()
            starts, ends = starts[1:], ends[1:]
        self.first = False
        if len(starts) and ends[-1] == n:
            self.open = [lines.slice(starts[-1], n - starts[-1])]
            starts, ends = starts[:-1], ends[:-1]
        if len(starts):
            kept = lines.filter(pa.array(~blank))
            before = np.concatenate([[0], np.cumsum(~blank)])
            spans = pa.ListArray.from_arrays(pa.array(np.append(before[starts], before[ends[-1]]), pa.int32()), kept)
            texts = pc.binary_join(spans, "\n")
            rows = self._rows(texts, INNER)
            if inner:
                yield rows

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._close(WHOLE if self.from_start else TAIL)
        yield self._rows(pa.array([None], pa.string()), END)


def _runs(lines: DataFrame, inner: bool) -> DataFrame:
    """The runs of all blocks, and a row for the end of each; without those inside a block if only edges are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Block | None = None
        for key, piece in _segments(batches):
            if now is None or now.key != key:
                if now is not None:
                    yield from now.end()
                now = _Block(key)
            for rows in now.take(piece, inner):
                if inner or rows.column("role")[0].as_py() != INNER:
                    yield rows
        if now is not None:
            yield from now.end()

    return lines.mapInArrow(run, _RUN_COLUMNS)


def small_side(df: DataFrame) -> DataFrame:
    """A relation for one side of a join, made once: broadcast if its bytes, counted, allow that."""
    made, held = cut(df), F.lit(ROW_BYTES)
    for name, kind in df.dtypes:
        if kind == "string":
            held = held + F.coalesce(F.octet_length(name), F.lit(0))
    return F.broadcast(made) if (made.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES else made


def block_plan(lines: DataFrame) -> DataFrame:
    """path, block, offset, total, headed (the first run counts here), n_inner, joined (the first run goes on from before), owner (the block where it
    began), goes_on (the last run goes on in the next block)."""
    has = lambda *roles: F.max(F.col("role").isin(*roles))
    solid = lambda *roles: F.coalesce(F.max(F.when(F.col("role").isin(*roles), F.col("solid"))), F.lit(False))
    blocks = _runs(lines, False).groupBy("path", "block").agg(
        has(HEAD, WHOLE).alias("head"), has(WHOLE).alias("whole"), has(TAIL, WHOLE).alias("tail"), solid(HEAD, WHOLE).alias("head_solid"), solid(TAIL, WHOLE).alias("tail_solid"), F.max(F.when(F.col("role") == END, F.col("rank"))).alias("n_inner")
    )
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    linked = blocks.withColumn("joined", F.col("head") & F.coalesce(F.lag("tail").over(order), F.lit(False)))
    linked = linked.withColumns({"owner": F.when(F.col("joined"), F.last(F.when(~(F.col("joined") & F.col("whole")), F.col("block")), True).over(before)), "goes_on": F.coalesce(F.lead("joined").over(order), F.lit(False))})
    more = linked.where("joined").groupBy("path", F.col("owner").alias("block")).agg(F.max("head_solid").alias("more"))
    full = linked.join(more, ["path", "block"], "left")
    headed = F.col("head") & ~F.col("joined") & ~F.col("whole") & F.col("head_solid")
    starts = F.col("tail") & ~(F.col("whole") & F.col("joined")) & (F.col("tail_solid") | F.coalesce("more", F.lit(False)))
    counted = full.withColumns({"headed": headed.cast("int"), "n": headed.cast("int") + F.col("n_inner") + starts.cast("int")})
    return counted.select("path", "block", "headed", "n_inner", "joined", "owner", "goes_on", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("path")).alias("total"))


def split_paragraph_files(spark: SparkSession, path: str) -> DataFrame:
    """path, index, label, total, text of the paragraphs of text files."""
    lines = read_lines(spark, path)
    found = _runs(lines, True).where(F.col("role") != END).join(small_side(block_plan(lines)), ["path", "block"])
    role = F.col("role")
    edge = F.when(role == HEAD, F.col("joined")).when(role == TAIL, F.col("goes_on")).when(role == WHOLE, F.col("joined") | F.col("goes_on")).otherwise(False)
    at = F.col("offset") + F.when(role == HEAD, 0).when(role == INNER, F.col("headed") + F.col("rank")).otherwise(F.col("headed") + F.col("n_inner"))
    found = found.select("path", "block", "text", "total", "solid", at.alias("index"), edge.alias("edge"), F.when(F.col("joined") & role.isin(HEAD, WHOLE), F.col("owner")).otherwise(F.col("block")).alias("began"))
    whole = found.where("NOT edge AND solid").select("path", "index", "total", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n")
    # the pieces of one paragraph, which is one value anyway
    pieces = found.where("edge").groupBy("path", "began").agg(joined.alias("text"), F.min_by("index", "block").alias("index"), F.first("total").alias("total"), F.max("solid").alias("solid"))
    both = whole.unionByName(pieces.where("solid").select("path", "index", "total", "text"))
    return both.select("path", F.col("index").cast("int").alias("index"), F.concat(F.lit("Paragraph "), (F.col("index") + 1).cast("string")).alias("label"), F.col("total").cast("int").alias("total"), trim_controls(F.col("text")).alias("text"))


def _numbered(lines: DataFrame, texts: bool) -> DataFrame:
    """path, block, rank, text of lines that aren't blank, the file's first one left out; or, without texts, path, block, n of them, head: that first line."""
    ended = lambda a: pc.replace_substring_regex(a, r"\r$", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank = None, 0
        for now, piece in _segments(batches):
            head = pa.array([None], pa.string())
            if now != key:
                key, rank = now, 0
                if now[1] == 0:
                    head, piece = ended(piece.slice(0, 1)), piece.slice(1)
            kept = piece.filter(pc.match_substring_regex(piece, r"[^\x00-\x20]"))
            n = len(kept)
            if not texts:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([n], pa.int64()), head], ["path", "block", "n", "head"])
            elif n:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n), pa.array(np.arange(rank, rank + n)), ended(kept)], ["path", "block", "rank", "text"])
            rank += n

    return lines.mapInArrow(run, "path string, block long, rank long, text string" if texts else "path string, block long, n long, head string")


def split_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """path, index, label, total, text of the rows of CSV files, each under its file's first line."""
    lines = read_lines(spark, path)
    whole = Window.partitionBy("path")
    order = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = _numbered(lines, False).groupBy("path", "block").agg(F.sum("n").alias("n"), F.max("head").alias("head"))
    plan = blocks.select("path", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"), F.max("head").over(whole).alias("head"))
    found = _numbered(lines, True).join(small_side(plan), ["path", "block"])
    index = (F.col("offset") + F.col("rank")).cast("int")
    return found.select("path", index.alias("index"), F.concat(F.lit("Row "), (index + 2).cast("string")).alias("label"), F.col("total").cast("int").alias("total"), F.concat("head", F.lit("\n"), "text").alias("text"))
