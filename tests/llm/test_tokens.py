import random

import public_tokenizers
from tokenizers import Tokenizer

from docloom.llm import bestfit
from docloom.llm.bestfit import GAP, PIECE, Encoder, assemble, pack, plan_moves, sweep
from docloom.llm.bpe_count import TokenCounter, token_counts
from tests.llm.common import odd_documents, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab Z'st  \n\t\x0b\x1c\x85\xa0 　é中1٣²½.,!😀́​\x00"


def odd_texts(n=4000):
    rnd = random.Random(3)
    tails = ["", " ", "  ", "<|endoftext|>", "'ll", " \n ", "\n\n x", "<|endoftext"]
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(14))) + rnd.choice(tails) for _ in range(n)] + [" " * 1_000_000, " " * 100_000, "a" * 20_000, "\n" * 3000 + "x"]


def test_counts_and_ids_are_those_of_the_library():
    library, counter, encoder = Tokenizer.from_file(PATH), TokenCounter(PATH), Encoder(PATH)
    texts = odd_texts()
    for text, found in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert counter.count(text) == len(found.ids), text[:50]
        assert encoder.ids(text).tolist() == found.ids, text[:50]


def test_token_counts_of_odd_rows(spark):
    docs = odd_documents(spark)
    library = Tokenizer.from_file(PATH)
    want = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows(docs.select("doc_id", "text"))), key=str)
    assert sorted(rows(token_counts(docs, PATH, 1024)), key=str) == want
    assert rows(token_counts(docs.limit(0), PATH, 1024)) == []


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    return sorted(gaps)


def check_plan(moves, counts, capacity):
    """Every rank of every length is placed once, at the end of its sequence; the number of sequences."""
    used, seen = {}, {}
    for length, rank, n, first, offset in moves:
        for k in range(n):
            assert rank + k not in seen.setdefault(length, set())
            seen[length].add(rank + k)
            assert used.get(first + k, 0) == offset
            used[first + k] = offset + length
    assert {k: len(v) for k, v in seen.items()} == counts and max(used.values()) <= capacity
    return len(used)


def test_a_sweep_gives_each_piece_its_successor():
    """One piece a run and gap: what a sweep does is what taking the pieces by size, each to the smallest gap, does."""
    rnd = random.Random(6)
    for _ in range(300):
        pieces = [rnd.randrange(1, 40) for _ in range(rnd.randrange(9))]
        gaps = [rnd.randrange(1, 60) for _ in range(rnd.randrange(9))]
        out = sweep([(PIECE, n, k, 1, 0, 0) for k, n in enumerate(pieces)] + [(GAP, g, k, 1, 0, 0) for k, g in enumerate(gaps)], 60)
        left, unplaced = sorted(gaps), []
        for n in sorted(pieces, reverse=True):
            fit = next((g for g in left if g >= n), None)
            if fit is None:
                unplaced.append(n)
            else:
                left.remove(fit)
                left = sorted(left + [fit - n] * (fit > n))
        assert sorted(r[1] for r in out if r[0] == GAP) == left
        assert sorted((r[1] for r in out if r[0] == PIECE), reverse=True) == unplaced


def test_plan_is_as_good_as_best_fit_decreasing(spark, monkeypatch):
    rnd, extra = random.Random(5), 0
    cases = [(capacity, [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 120))]) for capacity in (10, 37, 64) * 3]
    cases.append((512, [rnd.randrange(1, 500) for _ in range(1500)]))
    monkeypatch.setattr(bestfit, "TASK_RUNS", 40)  # several ranges even for small cases
    for capacity, lengths in cases:
        counts = {n: lengths.count(n) for n in set(lengths)}
        extra += check_plan(plan_moves(spark, counts, capacity), counts, capacity) - len(best_fit_decreasing(lengths, capacity))
    assert extra <= 1
    assert plan_moves(spark, {}, 9) == []


def test_pack_keeps_every_token(spark):
    docs, library, capacity = odd_documents(spark), Tokenizer.from_file(PATH), 512
    out = pack(docs, PATH, capacity, with_ids=True).cache()
    import zlib

    place, want = {}, sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in rows(docs.select("doc_id", "text")))
    for r in out.collect():
        assert 0 < r.length <= capacity and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(map(len, want))
    assert len(place) <= 1.1 * -(-total // capacity)
    unique = {tuple(w) for w in want if len(w) <= capacity}
    import numpy as np

    whole = {tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in out.where("start = 0").collect()}
    assert unique <= whole
    joined = assemble(out)
    assert sum(len(r.ids) for r in joined.collect()) == total
    assert rows(pack(docs.limit(0), PATH, capacity)) == []
