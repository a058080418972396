"""Benchmark decontamination by pigeonhole edit matching.

Texts and benchmark items are normalised alike: lower case, runs of white space to one space, ends trimmed. An
item of n characters may be found with up to k = floor(n * ERROR_RATE) insertions, deletions and
replacements. It is cut into k + 1 pieces: whatever the k edits, one piece stays whole, so every such
passage has an exact hit of a piece. The same holds of halves: pieces joined in pairs, fours and so on may hold as many
errors as they have pieces, less one, and some hit passes at every level; hits that fail at one of the two lowest are dropped early. All pieces of a block of items form one Aho-Corasick machine,
through which every whole text is streamed; around each hit the window where the item would lie is
verified with Myers' bit-parallel algorithm for the smallest distance of the item to any substring.

The items go to the workers in blocks of at most BLOCK_CHARS characters: however large the benchmark, a
machine is bounded, and each block is one more narrow pass over the documents.

Defined cases: null and empty items and texts match nothing; items that are equal after normalisation share their hits, each
under its own item_id; a null item_id or doc_id is reported as null; items of which the budget leaves pieces
shorter than MIN_PIECE get fewer errors, so that pieces stay selective, and an item shorter than MIN_ITEM characters
is only matched exactly and as whole words; repeated rows are matched each; other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.common import slices

ERROR_RATE = 0.1
MIN_PIECE = 8
MIN_ITEM = 24
BLOCK_CHARS = 4_000_000
#: Entries a worker keeps of joined pieces prepared for Myers' algorithm; emptied when full.
NODE_ENTRIES = 100_000


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int) -> int:
    """Edits allowed in an item of n characters."""
    return 0 if n < MIN_ITEM else max(0, min(int(n * ERROR_RATE), n // MIN_PIECE - 1))


def pieces(item: str) -> list[tuple[int, str]]:
    """(start, piece): budget + 1 pieces of nearly equal length."""
    parts = budget(len(item)) + 1
    edges = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def ancestors(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the smallest node above it, and the one above that, in a tree of halves, without the root."""
    above: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
            for j in range(a, b):
                if b - a < n:
                    above[j].append((a, b))
    return [sorted(x, key=lambda e: e[1] - e[0])[:2] for x in above]


class Pattern:
    """An item prepared for Myers' algorithm: one bit a character in a Python integer."""

    def __init__(self, item: str):
        self.n, self.k = len(item), budget(len(item))
        self.top = 1 << (self.n - 1)
        self.mask = (1 << self.n) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, window: str) -> tuple[int, int]:
        """(distance, end) of the substring of the window nearest to the item; the first end if there are several."""
        plus, minus, score, mask, top, get = self.mask, 0, self.n, self.mask, self.top, self.at.get
        best, end = self.n, 0
        for i, c in enumerate(window):
            eq = get(c, 0)
            x = eq | minus
            d0 = (((eq & plus) + plus) ^ plus) | x
            up = minus | (mask & ~(d0 | plus))
            down = plus & d0
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            # the item may start anywhere: no carry into the first row
            up, down = up << 1, down << 1
            plus = (down | ~(d0 | up)) & mask
            minus = up & d0 & mask
            if score < best:
                best, end = score, i + 1
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]]):
        self.items: dict[str, list[int | None]] = {}
        for item_id, text in items:
            if text:
                self.items.setdefault(text, []).append(item_id)
        self.patterns = {t: Pattern(t) for t in self.items}
        self.nodes: dict[tuple[str, int, int], Pattern] = {}
        found: dict[str, list[tuple[str, int, tuple]]] = {}
        for t in self.items:
            edges = [a for a, _ in pieces(t)] + [len(t)]
            for j, above in enumerate(ancestors(len(edges) - 1)):
                spans = tuple((edges[a], edges[b], b - a - 1) for a, b in above)
                found.setdefault(t[edges[j] : edges[j + 1]], []).append((t, edges[j], spans))
        self.machine = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.machine.add_word(piece, (len(piece), uses))
        if found:
            self.machine.make_automaton()
        self.empty = not found

    def _passes(self, item: str, origin: int, above: tuple, norm: str) -> bool:
        """Whether the joined pieces around a hit can be there."""
        for a, b, k in above:
            window = norm[max(0, origin + a - k) : max(0, origin + b + k)]
            if item[a:b] not in window:
                if (node := self.nodes.get((item, a, b))) is None:
                    if len(self.nodes) >= NODE_ENTRIES:
                        self.nodes.clear()
                    node = self.nodes[item, a, b] = Pattern(item[a:b])
                if node.best(window)[0] > k:
                    return False
        return True

    def match(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normalised text) of every item found, its nearest place each."""
        norm = normalise(text)
        if not norm or self.empty:
            return []
        spots: dict[str, set[int]] = {}
        for end, (length, uses) in self.machine.iter(norm):
            for item, start, above in uses:
                origin = end + 1 - length - start
                if self._passes(item, origin, above, norm):
                    spots.setdefault(item, set()).add(origin)
        out = []
        for item, starts in spots.items():
            p = self.patterns[item]
            best, at = p.k + 1, 0
            # windows that overlap are searched as one
            windows: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - p.k), min(len(norm), s + p.n + p.k)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = max(b, windows[-1][1])
                else:
                    windows.append([a, b])
            for a, b in windows:
                if p.n < MIN_ITEM:
                    i = norm.find(item, a, b)
                    while i >= 0:
                        if (i == 0 or norm[i - 1] == " ") and (i + p.n == len(norm) or norm[i + p.n] == " "):
                            best, at = 0, i + p.n
                            break
                        i = norm.find(item, i + 1, b)
                    continue
                i = norm.find(item, a, b)
                d, end = (0, i - a + p.n) if i >= 0 else p.best(norm[a:b])
                if d < best:
                    best, at = d, a + end
            if best <= p.k:
                out += [(item_id, best, at) for item_id in self.items[item]]
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The normalised items in blocks of at most BLOCK_CHARS characters (one item at least), streamed to the driver."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        text = normalise(r[1])
        if block and held + len(text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((r[0], text))
        held += len(text)
    if block:
        yield block


#: The matcher that a worker built last, by its block; the next tasks of that block take it again.
_MATCHER: dict[str, Matcher] = {}


def _matcher(key: str, block: list[tuple[int | None, str]]) -> Matcher:
    if key not in _MATCHER:
        _MATCHER.clear()
        _MATCHER[key] = Matcher(block)
    return _MATCHER[key]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, end_char of every benchmark item found in a document; a narrow pass for each block of items."""
    context = docs.sparkSession.sparkContext
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, end_char long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = []
    for block in item_blocks(benchmark):
        shipped = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shipped.value)
            for batch in slices(batches):
                rows = [(doc, *m) for doc, text in zip(*(c.to_pylist() for c in batch.columns)) for m in matcher.match(text)]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], item_type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["doc_id", "item_id", "distance", "end_char"])

        parts.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item. Rows with a null doc_id are judged too, and stay if clean."""
    names = docs.columns
    out = docs
    for block in item_blocks(benchmark):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shipped.value)
            at = names.index("text")
            for batch in slices(batches):
                yield batch.filter(pa.array([not matcher.match(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
