"""The trie of conversation prefixes: which beginnings conversations share, and the text that sharing saves.

A conversation is a sequence of turns; each distinct sequence of its first d turns is a node of depth d, the root has none. Work is done on
narrow rows, a turn being the SHA-256 of the role's length, a colon, role and text; texts are never shuffled.

1. Turns are sorted by range over (conversation, place), however long one conversation is, and numpy scans of the sorted runs give each
   turn its depth, the polynomial fingerprint of its prefix (sum of turn hash times BASE^depth, modulo 2^61 - 1) and the bytes up to it. What a
   conversation had before a run begins is carried over from a summary of one row for each run.
2. Turns of equal (depth, fingerprint) are one candidate group. Its representative is the smallest conversation; every other way in which
   members come to this prefix (parent's group and digest of the turn) is compared with the representative's. As parents are compared in
   the same manner, equal ways mean equal prefixes, turn by turn. A group in which they differ is a collision: the members that differ
   leave it, with their deeper turns, and form groups of their own, until all agree.
3. The smallest member of a node is that of its deeper nodes too where it goes on, so each conversation owns one run of nodes, its
   own last ones. Sums over subtrees are then sums over member turns: a leaf counts once, at its owner, in each of the owner's prefixes;
   bytes count for members that do not own the node. So the rollup is one aggregate, linear in the turns, whatever the depth.

Groups are aggregated map-side before a shuffle, so a first turn that a third of all conversations share is a row for each task; joins with
such nodes are left to adaptive skew handling. The ids of conversations that end at a node are sorted by range, joined in chunks and hashed as a stream.

Defined cases: a null role or text is the empty string; turns go by number, nulls first, equal numbers by the SHA-256 of role and text;
repeated rows are turns each; rows without conv_id are left out; no rows at all give no node; other columns are not used and not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docloom.llm.common import cut

PRIME = (1 << 61) - 1
BASE = 1_164_259_118_733_713_573
#: The first this many turns at most are taken over from another conversation.
HEAD_TURNS = 8
#: Ids in a chunk of those that are hashed as a stream.
CHUNK_IDS = 512
NODE = ["depth", "print", "split"]


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo PRIME of numbers below it, in 31-bit halves."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    return _reduce(_reduce(np.uint64(2) * (ah * bh)) + (mid >> np.uint64(30)) + _reduce((mid & np.uint64((1 << 30) - 1)) << half) + _reduce(al * bl))


def powers(first: int, n: int) -> np.ndarray:
    """BASE^first, ..., BASE^(first + n - 1), by doubling."""
    out = np.array([pow(BASE, first, PRIME)], np.uint64)
    while len(out) < n:
        out = np.concatenate([out, mul(out, np.full(len(out), pow(BASE, len(out), PRIME), np.uint64))])
    return out[:n]


def _running(values: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME."""
    low = np.uint64((1 << 31) - 1)
    return _reduce(mul(_reduce(np.cumsum(values >> np.uint64(31))), np.full(len(values), 1 << 31, np.uint64)) + _reduce(np.cumsum(values & low)))


def _batch(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Scan:
    """Depths, prefix fingerprints and bytes of sorted turns, batch after batch; `conv, depth, print, bytes` are where it stands."""

    def __init__(self, conv: int | None = None, depth: int = 0, print_: int = 0, bytes_: int = 0):
        self.conv, self.depth, self.print, self.bytes = conv, depth, print_, bytes_

    def step(self, conv: np.ndarray, turn: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(conv)
        new = np.concatenate([[conv[0] != self.conv], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where the row's conversation begins in the batch
        carried = np.cumsum(new) == 0
        depth = np.arange(n) - start + 1 + np.where(carried, self.depth, 0)
        power = powers(1, n)[np.arange(n) - start]
        if carried.any():
            power[carried] = mul(power[carried], np.full(carried.sum(), pow(BASE, self.depth, PRIME), np.uint64))
        total = _running(mul(turn, power))
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        prints = _reduce(total + (np.uint64(PRIME) - before))
        prints = np.where(carried, _reduce(prints + np.uint64(self.print)), prints)
        so_far = np.cumsum(size)
        held = so_far - np.where(start > 0, so_far[start - 1], 0) + np.where(carried, self.bytes, 0)
        self.conv, self.depth, self.print, self.bytes = int(conv[-1]), int(depth[-1]), int(prints[-1]), int(held[-1])
        return depth, prints, held


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    conv, turn, size = (batch.column(k).to_numpy() for k in ("conv", "hash", "bytes"))
    return conv, _reduce(turn.view(np.uint64) >> np.uint64(2)), size


def prefix_rows(turns: DataFrame, mask: int = PRIME) -> DataFrame:
    """conv, depth, print, parent_print, bytes, held (bytes up to and with this turn), digest of turns (conv, part, turn, digest, bytes).

    turns is ordered by (part, turn, digest) within a conversation, nulls first. mask keeps some bits of a fingerprint, for tests of collisions.
    """
    order = ["conv", "part", F.asc_nulls_first("turn"), "digest"]
    named = turns.withColumn("hash", F.xxhash64("digest"))
    runs = cut(named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()).select("run", "conv", "hash", "bytes", "digest"))

    end_schema = pa.schema([("run", pa.int32()), *((c, pa.int64()) for c in ("first", "conv", "depth", "print", "bytes"))])

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, run, first = Scan(), None, None
        for batch in batches:
            if batch.num_rows:
                conv, turn, size = _columns(batch)
                if run is None:
                    run, first = batch.column("run")[0].as_py(), int(conv[0])
                scan.step(conv, turn, size)
        if run is not None:
            yield _batch([[v] for v in (run, first, scan.conv, scan.depth, scan.print, scan.bytes)], end_schema)

    # a row for each run: their number is that of shuffle partitions
    ends = sorted(runs.select("run", "conv", "hash", "bytes").mapInArrow(summary, "run int, first long, conv long, depth long, print long, bytes long").collect())
    carry, now = {}, (None, 0, 0, 0)
    for run, first, conv, depth, print_, size in ends:
        carry[run] = now
        if first == conv == now[0]:  # the run holds nothing but what began before it
            now = conv, now[1] + depth, (now[2] + print_ * pow(BASE, now[1], PRIME)) % PRIME, now[3] + size
        else:
            now = conv, depth, print_, size
    schema = "conv long, depth long, print long, parent_print long, bytes long, held long, digest binary"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if scan is None:
                scan = Scan(*carry[batch.column("run")[0].as_py()])
            conv, turn, size = _columns(batch)
            was = scan.conv, scan.print
            depth, prints, held = scan.step(conv, turn, size)
            parents = np.concatenate([np.array([was[1] if conv[0] == was[0] else 0], np.uint64), prints[:-1]])
            parents[depth == 1] = 0
            kept = np.uint64(mask)
            columns = [conv, depth, (prints & kept).astype(np.int64), (parents & kept).astype(np.int64), size, held]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column("digest")], ["conv", "depth", "print", "parent_print", "bytes", "held", "digest"])

    return runs.mapInArrow(scanned, schema)


def _settle(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their groups' numbers (`split`, `parent_split`) such that all members of a group have the same prefix; and the nodes.

    members is checkpointed. Without a collision, which is all but certain, it is returned as it is after one look at the nodes.
    """
    way = ["parent_print", "parent_split", "digest"]
    settled, open_ = None, members.withColumns({"split": F.lit(0), "parent_split": F.lit(0)})
    for split in range(1, 1 << 30):
        ways = cut(open_.groupBy(*NODE, *way).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("held").alias("held")))
        clash = ways.groupBy(*NODE).agg(F.count("*").alias("ways"), F.min_by(F.struct(*way), "conv").alias("kept")).where("ways > 1")
        if clash.isEmpty():
            return (open_, ways) if settled is None else (cut(settled.unionByName(open_)), None)
        other = ways.join(clash, NODE).where(F.struct(*way) != F.col("kept")).select(*NODE, *way)
        # where a conversation first differs from a representative; a way that differs may have many members, they are joined by adaptive skew handling
        leave = open_.join(other, [*NODE, *way]).groupBy("conv").agg(F.min("depth").alias("from"))
        marked = open_.join(leave, "conv", "left").withColumn("out", F.coalesce(F.col("depth") >= F.col("from"), F.lit(False)))
        marked = cut(marked.withColumn("parent_split", F.when(F.col("depth") > F.col("from"), split).otherwise(F.col("parent_split"))).drop("from"))
        stay = marked.where(~F.col("out")).drop("out")
        settled = stay if settled is None else settled.unionByName(stay)
        open_ = marked.where("out").drop("out").withColumn("split", F.lit(split))
    raise AssertionError


def _id_hashes(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of ends (NODE, conv): the hash of the ids in ascending order, joined by commas.

    Sorted by range, so that the ids of one node may lie in many tasks, which join them in chunks; a node's chunks are hashed one after the other.
    """

    node_schema = [("depth", pa.int64()), ("print", pa.int64()), ("split", pa.int32())]
    hash_schema = pa.schema([*node_schema, ("ends_sha256", pa.string())])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in (*NODE, "conv"))))
            out, at = [], 0
            while at < len(rows):
                key, to = rows[at][:3], at + 1
                while to < len(rows) and to - at < CHUNK_IDS and rows[to][:3] == key:
                    to += 1
                out.append((*key, rows[at][3], ",".join(str(r[3]) for r in rows[at:to])))
                at = to
            if out:
                yield _batch(zip(*out), pa.schema([*node_schema, ("first", pa.int64()), ("ids", pa.string())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            out = []
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids"))):
                if node != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield _batch(zip(*out), hash_schema)
        if key is not None:
            yield _batch([[v] for v in (*key, state.hexdigest())], hash_schema)

    kind = "depth long, print long, split int"
    sorted_ = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    chunks = sorted_.mapInArrow(chunked, f"{kind}, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(hashed, f"{kind}, ends_sha256 string")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest, bytes of each row that has a conv_id."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def build_trie(turns: DataFrame, convs: DataFrame, mask: int = PRIME) -> DataFrame:
    """Nodes of the conversations `convs` (conv, distinct), whose turns are given as to `prefix_rows`."""
    none = F.lit(0).cast("long")
    root = convs.select("conv", none.alias("depth"), none.alias("print"), none.alias("parent_print"), none.alias("bytes"), none.alias("held"), F.lit(b"").alias("digest"))
    members, ways = _settle(cut(prefix_rows(turns, mask).unionByName(root)))
    up = [F.col("parent_print").alias("print"), F.col("parent_split").alias("split")]
    if ways is None:
        ways = members.groupBy(*NODE, "parent_print", "parent_split", "digest").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"), F.first("held").alias("held"))
    children = ways.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *up).agg(F.count("*").alias("n_children"))
    nodes = cut(ways.drop("digest").join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", none)))
    # a conversation owns its nodes from some depth on; before that, its turns are those of an owner with a smaller id
    owned = nodes.groupBy("conv").agg((F.min_by("held", "depth") - F.min_by("bytes", "depth")).alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    last = cut(members.groupBy("conv").agg(F.max(F.struct("depth", "print", "split", "held")).alias("e")).select("conv", "e.*"))
    per_conv = last.select("conv", "held").join(owned, "conv", "left").select("conv", F.coalesce("shared", "held").alias("shared"), F.coalesce("leaf", none).alias("leaf"))
    # bytes from this turn to the last one that the conversation does not own
    saved = F.greatest(F.col("shared") - (F.col("held") - F.col("bytes")), none)
    sums = members.select("conv", *NODE, "bytes", "held").join(per_conv, "conv").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("parent_print"), F.col("split").alias("parent_split"), F.col("conv").alias("parent_conv_id"))
    found = nodes.join(sums, NODE).join(_id_hashes(last), NODE, "left")
    found = found.join(parents, ["depth", "parent_print", "parent_split"], "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, mask: int = PRIME) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = turn_rows(conversations)
    return build_trie(turns.withColumn("part", F.lit(0)), turns.select("conv").distinct(), mask)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of the conversations rebuilt: the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9.

    Repeated rows are one run with a count, so that turns are told apart by what they are; only the first runs of a conversation are numbered.
    """
    runs = cut(turn_rows(conversations).groupBy("conv", "turn", "digest", "bytes").agg(F.count("*").alias("times")))
    convs = cut(runs.select("conv").distinct().withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD_TURNS + 1), "base": F.col("conv") - F.col("conv") % 5}))
    in_order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    # no more than HEAD_TURNS rows of a conversation leave a map task (window group limit)
    first = runs.withColumn("at", F.row_number().over(in_order)).where(F.col("at") <= HEAD_TURNS)
    heads = cut(first.withColumn("before", F.sum("times").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("times")))
    taken = F.greatest(F.least(F.col("h") - F.col("before"), F.col("times")), F.lit(0))
    copies = convs.where("base <> conv").join(heads.withColumnRenamed("conv", "base"), "base").select("conv", F.lit(0).alias("part"), "turn", "digest", "bytes", taken.alias("times"))
    lost = heads.join(convs.where("base <> conv"), "conv").select("conv", F.col("turn").alias("t"), "digest", taken.alias("lost")).where("lost > 0")
    own = runs.alias("r").join(lost.alias("l"), (F.col("r.conv") == F.col("l.conv")) & F.col("r.turn").eqNullSafe(F.col("l.t")) & (F.col("r.digest") == F.col("l.digest")), "left")
    own = own.select("r.conv", F.lit(1).alias("part"), "r.turn", "r.digest", "r.bytes", (F.col("times") - F.coalesce("lost", F.lit(0))).alias("times"))
    turns = copies.unionByName(own).where("times > 0").select("conv", "part", "turn", "digest", "bytes", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
    return turns, convs.select("conv")


def rebuilt_trie(conversations: DataFrame, mask: int = PRIME) -> DataFrame:
    return build_trie(*rebuilt(conversations), mask)
