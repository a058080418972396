"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles, each a 64-bit hash. Its parity sketch is a row of
m blocks; a shingle belongs to one block by its hash and flips one bit of it, so that the XOR of the
shingles is the block's content (blocks have 2^64 positions and are kept as the XOR of 64-bit codes). Each
shingle in just one of two sets changes one block at most, so two documents of symmetric difference d differ
in at most d of m blocks. A Jaccard similarity of 0.8 or more is d <= (|A| + |B|) / 9, exactly.

Size bands grow by 5/4, so the larger of two linked documents is in the band of the smaller or the next. The
pairs whose larger document is in a band share that band's m, which exceeds the largest d there. A document
of bound d puts out the d + 1 of its m blocks that come first in an order common to all documents (most shingles
first): as m - d blocks are equal at least, two linked documents meet in one that both put out.

1. Equal texts are one document: only their smallest doc_id takes part.
2. Blocks are shuffled and sorted by key; in each run of a key every document is tied to the run's first
   (linear in the run, whatever its length; tasks tie the blocks they put out among themselves first, so that a key that is everywhere
   is a few rows for each task). Ties are candidate evidence, not links; linked documents are connected by ties.
3. Each document is verified on whole sets against the smallest one it is tied to. These links are a forest, whose
   trees are found by pointer jumping; of a large group of near copies one tree is left.
4. Ties between different trees make the candidate clusters: components of trees, in which other links may be. Within a cluster the
   largest tree needs no comparison with itself: the others, and it, are dealt into blocks of at most about BLOCK_DOCS documents and
   BLOCK_SHINGLES shingles, and each pair of blocks that aren't both of the largest tree is a task's group: pairs of one tree are skipped, pairs
   whose 2048-bit parity sketches differ in more bits than d allows are out, the others are verified on their whole sets. A
   group gives the edges of a spanning forest, never all pairs.
5. Components of the trees under these edges are the result.

Defined cases: null and wordless texts have no shingles and are linked with nothing, not even each other; a text of
fewer than five words is one shingle; rows that repeat a doc_id are one document (n_shingles is the largest of
theirs), each returned; a null doc_id has its n_shingles and a null component; other columns are not returned.
Two shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import connected_components, cut, join_blobs, key_side, slices

SHINGLE_WORDS = 5
BLOCK_DOCS = 1500
BLOCK_SHINGLES = 1 << 20
SKETCH_BITS = 2048
#: Blocks beyond d + 1 in a sketch, as a share of d: room for blocks without shingles.
SLACK = 0.3
#: Blocks that a task holds to tie those of one key among themselves.
EMIT_ROWS = 400_000
#: Entries a worker keeps of words and their hashes, and of ties seen; emptied when full.
CACHE_ENTRIES = 200_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words: two rounds of shift, XOR and odd multiplication."""
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: str | None, hashes: dict, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, n)
    width = min(n, size)
    total = np.full(n - width + 1, width, _U)
    for k in range(width):
        total = total * _STEP + h[k : n - width + 1 + k]
    return np.unique(mix(total))


def sketch(sets: np.ndarray) -> np.ndarray:
    """The parity of the shingles at each of SKETCH_BITS positions, packed."""
    odd = np.bincount((sets & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


class Bands:
    """Size bands from 4 shingles on; smaller sets are linked with equal ones only."""

    def __init__(self, upto: int = 1 << 40):
        lows = [4]
        while lows[-1] < upto:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * 5 // 4)))
        self.lows = np.array(lows)

    def structures(self, n: int) -> list[tuple[int, int, int]]:
        """(band, blocks m, bound d) of the sketches that a set of n shingles takes part in."""
        if n < 4:
            return []
        j = int(np.searchsorted(self.lows, n, "right")) - 1
        out = []
        for band in (j, j + 1):
            low, high = int(self.lows[band]), int(self.lows[band + 1]) - 1
            largest = min(high, n * 5 // 4)
            if largest >= low and (d := (n + largest) // 9):
                most = 2 * high // 9
                out.append((band, most + 1 + max(2, int(np.ceil(SLACK * most))), d))
        return out


def block_keys(sets: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the blocks a set puts out, and the key of the set itself."""
    keys = [mix(np.array([np.bitwise_xor.reduce(sets) ^ _U(len(sets))], _U))]
    for band, m, d in bands.structures(len(sets)):
        block = ((sets >> _U(16)) % _U(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        count = np.bincount(block, minlength=m)
        content = np.zeros(m, _U)
        full = count > 0
        content[full] = np.bitwise_xor.reduceat(sets[order], (np.cumsum(count) - count)[full])
        key = mix(content ^ mix((np.arange(m, dtype=_U) << _U(16)) + _U(band + 1)))
        keys.append(key[np.lexsort((key, -count))[: d + 1]])
    return np.concatenate(keys)


def _combined(keys: list[np.ndarray], docs: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """Rows (key, doc, n) with one document, the smallest, for each key; the others are tied to it.

    A tie is a row of the document (as key too, so that ties of one leader are spread) whose n is less than 0: leader - doc.
    Rows that carry a size stay.
    """
    key, doc, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, docs, sizes))
    key = key.view(np.int64)
    order = np.lexsort((doc, key))
    key, doc, n = key[order], doc[order], n[order]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    first = doc[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))] if len(key) else doc
    kept = start | (n > 0)
    pairs = np.unique(np.stack((doc[~kept], first[~kept])), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    out = (np.concatenate(x) for x in ((key[kept], pairs[0]), (doc[kept], pairs[0]), (n[kept], pairs[1] - pairs[0])))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["key", "doc", "n"])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (key, doc, n); n is the set's size with the set's own key, 0 with other keys, less than 0 for ties."""
    hashes, bands = _WordHashes(), Bands()
    keys, docs, sizes = [], [], []
    held = 0
    for batch in slices(batches):
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = shingles(text, hashes)
            if len(found):
                k = block_keys(found, bands)
                n = np.zeros(len(k), np.int64)
                n[0] = len(found)
                keys.append(k)
                docs.append(np.full(len(k), doc, np.int64))
                sizes.append(n)
                held += len(k)
                if held > EMIT_ROWS:
                    yield _combined(keys, docs, sizes)
                    keys, docs, sizes, held = [], [], [], 0
    yield _combined(keys, docs, sizes)


def _tie_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc) to ties (first of the run, doc, 0), and (doc, doc, n) for sizes."""
    last_key, leader = None, 0
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        key, doc, n = (c.to_numpy() for c in batch.columns)
        ready = n < 0
        pairs = set(zip((doc[ready] + n[ready]).tolist(), doc[ready].tolist()))
        key, doc, n = key[~ready], doc[~ready], n[~ready]
        if len(key):
            start = np.empty(len(key), bool)
            start[0] = True
            np.not_equal(key[1:], key[:-1], out=start[1:])
            at = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
            first = doc[at]
            if last_key is not None and key[0] == last_key:
                first[at == 0] = leader
            last_key, leader = key[-1], first[-1]
            tied = first != doc
            pairs.update(zip(first[tied].tolist(), doc[tied].tolist()))
        pairs -= seen
        if len(seen) + len(pairs) > CACHE_ENTRIES:
            seen = set()
        seen |= pairs
        sized = n > 0
        a = [p[0] for p in pairs] + doc[sized].tolist()
        b = [p[1] for p in pairs] + doc[sized].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([0] * len(pairs) + n[sized].tolist(), pa.int64())], names=["a", "b", "n"])


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in slices(batches):
        text = batch.column("text").to_pylist()
        sets = [shingles(t, hashes).tobytes() for t in text]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "s"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted distinct hashes, link."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= 80 * (len(both) - same)


def _verify_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of b, set of a) to the pairs that link."""
    hashes = _WordHashes()
    for batch in slices(batches):
        linked = []
        for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = shingles(text, hashes), np.frombuffer(other, _U)
            linked.append(10 * len(y) >= 8 * len(x) and 10 * len(x) >= 8 * len(y) and similar(x, y))
        yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))


def _verify(group: pa.Table) -> pa.Table:
    """Spanning edges between the trees of documents of two blocks (or within one) of a cluster."""
    part = group.column("blk").to_numpy()
    tree, label = np.unique(group.column("tree").to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x, _U) for x in group.column("s").to_pylist()]
    n = np.array([len(x) for x in sets])
    within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    bits = np.stack([sketch(x) for x in sets])
    own = label.copy()
    left = np.arange(len(n)) if within else np.flatnonzero(part == part.min())
    right = np.arange(len(n)) if within else np.flatnonzero(part != part.min())
    a, b = [], []
    if len(right):
        for x in left:
            other = right[label[right] != label[x]]
            near = np.bitwise_count(bits[other] ^ bits[x]).sum(1, dtype=np.int64) <= (n[other] + n[x]) // 9
            for y in other[near]:
                if label[x] != label[y] and similar(sets[x], sets[y]):
                    label[label == label[y]] = label[x]
                    a.append(tree[own[x]])
                    b.append(tree[own[y]])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _trees(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a parent, of a forest (node, up) with up < node, by pointer jumping."""
    forest = cut(links.select("node", F.col("up").alias("root")).distinct())
    while True:
        above = forest.select("root").distinct().join(forest.select(F.col("node").alias("root"), F.col("root").alias("over")), "root")
        above = cut(above)
        if above.isEmpty():
            return forest
        forest = cut(forest.join(key_side(above), "root", "left").select("node", F.coalesce("over", "root").alias("root")))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every row of docs(doc_id, text)."""
    own = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # two hashes under different seeds, and the length, stand for the text
    hashed = own.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), F.length("text").alias("len"))
    copies = cut(hashed.groupBy("h1", "h2", "len").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    members = cut(hashed.join(copies, ["h1", "h2", "len"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))
    later = key_side(cut(members.where("doc_id <> rep").select("doc_id")))
    single = own.join(later, "doc_id", "left_anti")

    keyed = single.mapInArrow(_emit_keys, "key long, doc long, n long")
    tied = cut(keyed.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_tie_runs, "a long, b long, n long"))
    sizes = tied.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.max("n").alias("n_shingles"))
    ties = cut(tied.where("a <> b").select("a", "b").distinct())

    # 3: the smallest partner of each document
    pairs = cut(ties.groupBy("b").agg(F.min("a").alias("a")))
    leaders = cut(single.join(key_side(cut(pairs.select(F.col("a").alias("doc_id")).distinct())), "doc_id").select(F.col("doc_id").alias("a"), "text").mapInArrow(_emit_sets, "a long, s binary")).withColumnRenamed("s", "sa")
    # texts, not sets, meet the leaders' sets: one Python worker for each task
    others = single.join(key_side(pairs.withColumnRenamed("b", "doc_id")), "doc_id").select("a", F.col("doc_id").alias("b"), "text")
    both = join_blobs(others, leaders, "a", "sa", pairs.select("a")).select("a", "b", "text", "sa")
    forest = _trees(both.mapInArrow(_verify_ties, "a long, b long").select(F.col("b").alias("node"), F.col("a").alias("up")))
    root = key_side(forest)

    # 4: clusters of trees, and the trees' documents in blocks
    def rooted(df: DataFrame, node: str, name: str) -> DataFrame:
        found = root.select(F.col("node").alias(node), F.col("root").alias(name))
        return df.join(found, node, "left").withColumn(name, F.coalesce(name, node))

    between = rooted(rooted(ties, "a", "ta"), "b", "tb").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    clusters = connected_components(between)
    placed = rooted(sizes.withColumnRenamed("rep", "doc_id"), "doc_id", "tree").join(key_side(clusters).select(F.col("node").alias("tree"), F.col("component").alias("cluster")), "tree")
    placed = cut(placed.select("doc_id", "tree", "cluster", F.col("n_shingles").alias("n")))
    per = placed.groupBy("cluster", "tree").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    blocks = lambda n, docs: F.greatest(F.ceil(n / BLOCK_SHINGLES), F.ceil(docs / BLOCK_DOCS)).cast("int")
    sums = per.groupBy("cluster").agg(F.max(F.struct("n", "docs", "tree")).alias("top"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = cut(sums.select("cluster", F.col("top.tree").alias("top"), blocks(F.col("top.n"), F.col("top.docs")).alias("nt"), blocks(F.col("n") - F.col("top.n"), F.col("docs") - F.col("top.docs")).alias("nb")))
    dealt = placed.join(key_side(sums), "cluster").withColumn("in_top", F.col("tree") == F.col("top"))
    # blocks of the largest tree come after the nb blocks of the others, and meet these only
    blk = F.when(F.col("in_top"), F.col("nb") + F.pmod(F.xxhash64("doc_id"), "nt")).otherwise(F.pmod(F.xxhash64("doc_id"), "nb")).cast("int")
    dealt = cut(dealt.select("doc_id", "tree", "cluster", blk.alias("blk"), F.when(F.col("in_top"), F.col("nb")).otherwise(F.col("nb") + F.col("nt")).alias("meets")))
    sets = single.join(key_side(dealt), "doc_id").select("tree", "cluster", "blk", "meets", "text").mapInArrow(_emit_sets, "tree long, cluster long, blk int, meets int, s binary")
    copies = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1))).select("cluster", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "tree", "blk", "s")
    found = connected_components(copies.groupBy("cluster", "i", "j").applyInArrow(_verify, "a long, b long"))

    # 5
    known = rooted(sizes, "rep", "tree").join(found.withColumnRenamed("node", "tree"), "tree", "left").select("rep", "n_shingles", F.coalesce("component", "tree").alias("component"))
    n = F.coalesce("n_shingles", F.lit(0).cast("long"))
    result = members.join(known, "rep", "left").select("doc_id", n.alias("n_shingles"), F.when(n == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
    nameless = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sizes_only, "doc_id long, n_shingles long, component_id long")
    return result.unionByName(nameless)


def _sizes_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in slices(batches):
        n = [len(shingles(t, hashes)) for t in batch.column(1).to_pylist()]
        none = pa.nulls(len(n), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one document of each component: the one with the smallest doc_id.

    Rows with a null doc_id stay.
    """
    found = link_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(key_side(cut(found)), "doc_id", "left_anti").select(*docs.columns)
