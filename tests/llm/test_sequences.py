"""Prefix trie, fill-in-the-middle, language identification."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import langid, prefix_trie as trie
from docloom.llm.fim import MARKERS, digests, fill_in_middle
from tests.llm.common import odd_documents, rows

CONVERSATIONS = "conv_id long, turn int, role string, text string, depth string, split int, Conv string"


def odd_conversations(spark, seed=3):
    rnd = random.Random(seed)
    found = []
    for c in [*range(0, 24), 31, 33, 47, 1003, -3]:
        first = rnd.choice(("hello", "hi", "system: be brief"))
        for t in range(rnd.randrange(1, 12)):
            found.append((c, t, rnd.choice(("user", "assistant")) if t else "user", first if t == 0 else rnd.choice(("yes", "no", "é ß 中文", "")), "x", 1, "y"))
    found += [(5, t, "user", f"turn {t}", None, None, None) for t in range(3000)]  # one conversation longer than all others together
    found += [(7, None, None, None, None, None, None), (8, 1, None, "yes", None, None, None), (9, 2, "user", None, None, None, None), (None, 0, "user", "nobody", None, None, None)]
    found += [found[4]] * 3 + [(10, 2, "user", "tie a", None, None, None), (10, 2, "user", "tie b", None, None, None)]
    rnd.shuffle(found)
    return spark.createDataFrame(found, CONVERSATIONS)


def sequences(conversations):
    by = defaultdict(list)
    for r in conversations.collect():
        if r[0] is not None:
            role, text = r[2] or "", r[3] or ""
            by[r[0]].append(((r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    return {c: [x for _, x in sorted(t)] for c, t in by.items()}


def brute_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


def rebuilt(seqs):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in seqs}
    base = lambda c: c - int(math.fmod(c, 5))
    return {c: seqs.get(base(c), [])[: h[c]] + s[h[c] :] for c, s in seqs.items()}


def short(conversations):
    return conversations.where("turn < 12 OR turn IS NULL")


def test_trie_equals_brute_force(spark):
    table = short(odd_conversations(spark))
    assert sorted(rows(trie.prefix_trie(table))) == brute_trie(sequences(table))
    got = sorted(rows(trie.rebuilt_trie(table)))
    assert got == brute_trie(rebuilt(sequences(table)))
    assert [r[3] for r in got if r[1] == 0] == [29]


def test_trie_with_one_very_long_conversation(spark):
    table = odd_conversations(spark)
    seqs = rebuilt(sequences(table))
    got = rows(trie.rebuilt_trie(table))
    assert len(got) == len({tuple(s[:d]) for s in seqs.values() for d in range(len(s) + 1)})
    root = next(r for r in got if r[1] == 0)
    assert (root[0], root[3], root[5]) == (min(seqs), len(seqs), sum(r[4] == 0 for r in got))
    assert max(r[1] for r in got) == max(map(len, seqs.values()))


@pytest.mark.parametrize("mask", [0, 3])
def test_trie_splits_collisions(spark, mask):
    table = short(odd_conversations(spark)).where("conv_id BETWEEN 11 AND 18 AND coalesce(turn, 0) < 4")
    assert sorted(rows(trie.prefix_trie(table, mask))) == brute_trie(sequences(table))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert rows(trie.prefix_trie(none)) == rows(trie.rebuilt_trie(none)) == []


def test_ids_of_a_large_group_are_hashed_in_order(spark):
    ids = list(range(0, 6000, 2))
    got = rows(trie.prefix_trie(spark.createDataFrame([(i, 0, "user", "same") for i in ids], "conv_id long, turn int, role string, text string")))
    assert sorted(got)[1][-1] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_scan_in_batches_equals_integers():
    rnd = np.random.default_rng(1)
    conv = np.sort(rnd.integers(0, 9, 500))
    turn, size = rnd.integers(0, trie.PRIME, 500, dtype=np.uint64), rnd.integers(0, 1 << 40, 500)
    want, at = [], {}
    for c, t, s in zip(conv.tolist(), turn.tolist(), size.tolist()):
        d, p, b = at.get(c, (0, 0, 0))
        at[c] = d + 1, (p + t * pow(trie.BASE, d + 1, trie.PRIME)) % trie.PRIME, b + s
        want.append(at[c])
    for cuts in ([], [1], [37, 38, 200], list(range(1, 500, 7))):
        scan, got = trie.Scan(), []
        for a, b in zip([0, *cuts], [*cuts, 500]):
            got += zip(*(x.tolist() for x in scan.step(conv[a:b], turn[a:b], size[a:b])))
        assert got == want
    a, b = rnd.integers(0, trie.PRIME, (2, 1000), dtype=np.uint64)
    assert trie.mul(a, b).tolist() == [x * y % trie.PRIME for x, y in zip(a.tolist(), b.tolist())]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in MARKERS) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_brute_force(spark):
    docs = odd_documents(spark)
    more = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(["a <P> b", "<M>", "<S", "x<S>", " lead", "tail \n", "a<", "<", "\x0b\x0c a\x1c b", "   x"] * 8)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    key = lambda r: tuple((v is not None, v) for v in r)
    want = sorted((brute_fim(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    got = fill_in_middle(docs)
    assert sorted(rows(got), key=key) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = Counter((r["doc_id"], sha(r["text"] or "")) for r in docs.collect())
    hashed = rows(digests(got))
    assert Counter((r[0], r[6]) for r in hashed) == texts  # the text is rebuilt from output and form
    assert Counter(r[:6] for r in hashed) == Counter((*w[:5], sha(w[5])) for w in want)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_fim_shares_and_empty_table(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'a b c d' AS text")
    forms = Counter(r[2] for r in rows(fill_in_middle(docs, seed=7, cut_percent=100, spm_percent=0)))
    assert forms == {"psm": 400}
    assert rows(fill_in_middle(docs.limit(0))) == []


def made_corpus(spark, n=240):
    rnd = random.Random(5)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ter"], "cc": ["бо", "ра", "ни", "ко"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(2, 5)))
    text = lambda lang, k: " ".join(word(lang) for _ in range(k))
    found = [(i, text(lang := "abc"[i % 3] * 2, 20), lang, "s") for i in range(n)]
    found += [(n, text("aa", 60) + ".\n" + text("bb", 40), None, "s"), (n + 1, None, "aa", None), (n + 2, " 12 - \n", "bb", None), (n + 3, "", None, None), (None, text("cc", 9), "cc", None), found[0]]
    found += [(n + 4, text("bb", 30_000), None, None)]
    return spark.createDataFrame(found, "doc_id long, text string, lang string, Languages string")


def test_languages_of_a_made_corpus(spark):
    docs = made_corpus(spark)
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert model.names == ["aa", "bb", "cc"]
    for r in docs.where("lang IS NOT NULL AND doc_id < 240").collect():
        assert got[r["doc_id"]]["lang_pred"] == r["lang"]
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    mixed = got[240]
    assert {x["lang"] for x in mixed["languages"]} == {"aa", "bb"} and abs(mixed["languages"][0]["share"] - 0.5) < 0.2
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (241, 242, 243))
    assert got[244]["lang_pred"] == "bb" and len(got[244]["languages"]) == 1
    assert (got[None]["lang_pred"], got[None]["held_out"]) == ("cc", False)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(docs, model).count() == docs.count()


def test_training_counts_equal_brute_force(spark):
    docs = made_corpus(spark)
    model = langid.train(docs)
    want = np.zeros((3, model.buckets))
    for r in docs.collect():
        if r["lang"] and r["text"] and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            padded = [f" {w} " for w in re.findall(r"[^\W\d_]+", r["text"].lower())]
            for w in padded:
                for n in (1, 2, 3):
                    for k in range(len(w) - n + 1):
                        if (g := w[k : k + n]) != " " and " " not in g[1:-1]:
                            want[model.names.index(r["lang"]), _bucket(g, model.buckets)] += 1
    want += langid.SMOOTHING
    assert np.allclose(model.p.T, want / want.sum(1, keepdims=True), rtol=1e-5)


def _bucket(gram, buckets):
    h = 0
    for k, c in enumerate(gram):
        h = ord(c) if k == 0 else ((h ^ (h >> 29)) * 0xD6E8FEB86659FD93 + ord(c)) % 2**64
    return (h * 0x9E3779B97F4A7C15 % 2**64 >> 33) % buckets


def test_mixture_equals_plain_expectation_maximisation():
    rnd = np.random.default_rng(2)
    p, c = rnd.random((40, 3)), rnd.integers(1, 9, 40).astype(float)
    share = [1 / 3] * 3
    for _ in range(langid.STEPS):
        was = share
        share = [sum(c[g] * was[k] * p[g, k] / sum(was[j] * p[g, j] for j in range(3)) for g in range(40)) / c.sum() for k in range(3)]
        if max(abs(a - b) for a, b in zip(was, share)) < langid.SETTLED:
            break
    got, fit = langid.Mixture.shares(p, c)
    assert np.allclose(got, share) and abs(fit - sum(c[g] * math.log(p[g] @ got) for g in range(40))) < 1e-6


def test_long_texts_are_sliced_without_loss(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdé ,.\n中ß1") for _ in range(5000))
    whole = langid.gram_counts(text, 1 << 18)
    monkeypatch.setattr(langid, "SLICE_CHARS", 64)
    assert all(map(np.array_equal, whole, langid.gram_counts(text, 1 << 18)))


def test_nothing_learned_and_too_many_languages(spark):
    docs = made_corpus(spark)
    none = langid.train(docs.limit(0))
    assert none.names == [] and {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert rows(langid.identify(docs.limit(0), none)) == []
    with pytest.raises(ValueError, match="languages"):
        langid.buckets_for(langid.MAX_LANGUAGES + 1)
