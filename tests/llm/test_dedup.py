import random
import re
import time
from collections import defaultdict

import pytest

from docloom.llm import common, parity_join
from docloom.llm.common import connected_components
from docloom.llm.line_dedup import dedup_documents, line_report
from docloom.llm.parity_join import Bands, link_components, one_of_each
from tests.llm.common import odd_documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (5, 6), (6, 5), (200, 201)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_trees(spark):
    rnd = random.Random(8)
    up = {n: rnd.randrange(max(0, n - 3), n) for n in range(1, 90) if n % 11}

    def top(n):
        return top(up[n]) if n in up else n

    assert dict(rows(parity_join._trees(spark.createDataFrame(list(up.items()), "node long, up long")))) == {n: top(n) for n in up}
    assert rows(parity_join._trees(spark.createDataFrame([], "node long, up long"))) == []


def test_links_that_no_leader_has(spark):
    """Documents tied to one that links with none of them, and a large tree beside small ones."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**6)}"
    shared = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        body = [word() for _ in range(200)]
        for _ in range(rnd.randrange(1, 12)):
            t = list(body)
            for _ in range(rnd.randrange(0, 8)):
                t[rnd.randrange(200)] = word()
            texts.append(" ".join(shared + t))
    texts.insert(0, " ".join(shared))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {d: c for d, _, c in rows(link_components(docs))} == components(range(len(texts)), links)


def test_bands_hold_every_linked_pair():
    """The bound of each set covers any partner, and both of a linked pair take part in a common band with more blocks than bound."""
    bands = Bands()
    for a in range(1, 400):
        for b in range(a, int(a * 1.25) + 1):
            if (d := (a + b) // 9) and a >= 4:
                x, y = ({band: (m, bound) for band, m, bound in bands.structures(n)} for n in (a, b))
                shared = set(x) & set(y)
                assert any(x[k][1] >= d and y[k][1] >= d and x[k][0] == y[k][0] > d for k in shared), (a, b)


@pytest.mark.parametrize("tiny", [False, True])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, tiny):
    docs = odd_documents(spark)
    if tiny:  # clusters of many blocks, no broadcast, leaders with more documents than a part takes
        for module, name, value in ((parity_join, "BLOCK_DOCS", 2), (parity_join, "BLOCK_SHINGLES", 300), (common, "BROADCAST_BYTES", 0), (common, "HOT_ROWS", 2)):
            monkeypatch.setattr(module, name, value)
    sets = defaultdict(list)
    for d, t in rows(docs.select("doc_id", "text")):
        if d is not None:
            sets[d].append(shingle_set(t))
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b for x in sets[a] for y in sets[b] if x and 100 * len(x & y) >= 80 * len(x | y)]
    want = components(ids, links)
    got = rows(link_components(docs))
    assert len(got) == docs.count()
    for d, n, c in got:
        assert (c is None) if d is None else (n, c) == (max(map(len, sets[d])), want[d])
    assert sorted(n for d, n, _ in got if d is None) == sorted(len(shingle_set(t)) for d, t in rows(docs.select("doc_id", "text")) if d is None)
    assert rows(link_components(docs.limit(0))) == []
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == sorted(set(want.values()))


def close(a, b, least=10):
    if a == b:
        return True
    n, m = len(a), len(b)
    if min(n, m) < least or abs(n - m) > 1:
        return False
    p = s = 0
    while p < min(n, m) and a[p] == b[p]:
        p += 1
    while s < min(n, m) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(n, m) - 1


def line_decisions(pairs):
    lines = {}
    for d, t in pairs:
        if d is not None and t is not None:
            for i, x in enumerate(t.split("\n")):
                if w := re.findall(r"[^ \t\x0b\f\r]+", x.lower()):
                    lines[d, i] = w
    return {at for at, w in lines.items() if any(o < at and close(v, w) for o, v in lines.items())}


def test_line_dedup_equals_brute_force(spark):
    docs = odd_documents(spark)
    extra = [(1000, "a b c d e f g h i j k\nshort line", ), (1001, "a b c d e X g h i j k"), (1002, "a b c d e g h i j k"), (1003, "q a b c d e f g h i j k"), (1004, "Short \t  line\nb c d e f g h i j k a"), (1005, "other line")]
    docs = docs.unionByName(spark.createDataFrame([(*x, None, None, None, None, None, None, None) for x in extra], docs.schema))
    pairs = rows(docs.select("doc_id", "text"))
    gone = line_decisions(pairs)
    assert {(1001, 0), (1002, 0), (1003, 0), (1004, 0)} <= gone and (1005, 0) not in gone

    def want(d, t):
        if t is None:
            return d, 0, 0, None
        parts = t.split("\n")
        out = [(d, i) in gone for i in range(len(parts))]
        return d, len(parts), sum(out), "\n".join(x for x, g in zip(parts, out) if not g) if any(out) else t

    assert sorted(rows(line_report(docs)), key=str) == sorted((want(d, t) for d, t in pairs), key=str)
    assert rows(line_report(docs.limit(0))) == []
    left = dedup_documents(docs)
    assert left.columns == docs.columns
    whole = [(d, t) for d, n, k, t in (want(*p) for p in pairs) if not k or t.strip(" \t\n\x0b\f\r")]
    assert sorted(rows(left.select("doc_id", "text")), key=str) == sorted(whole, key=str)


def test_lines_of_one_long_document_take_linear_time(spark):
    """A quadratic step would take minutes here."""
    n = 240_000
    docs = spark.range(1).selectExpr("id AS doc_id", f"concat(repeat('the same line again\n', {n}), 'last') AS text", "1 AS n")
    start = time.perf_counter()
    got = line_report(docs).first()
    assert (got.n_lines, got.n_removed, got.text) == (n + 1, n - 1, "the same line again\nlast")
    assert time.perf_counter() - start < 40
