"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores sigmoid(bias + sum of its words' feature weights); a
document is toxic if any sentence is: P = 1 - prod(1 - p_sentence), the noisy-or. Only documents
carry labels; gradient descent on the noisy-or's likelihood spreads them to the sentences, so that
the sentences that make a document toxic can be named: all whose own probability is SENTENCE_P or more.

The model is fitted on the driver on at most SAMPLE_DOCS labelled documents of SAMPLE_BYTES in all, drawn by the hash of
their id (a document counts once, with the greatest of its texts if its id is repeated). A word's features are itself and its beginnings; the model keeps those whose document frequency differs between the classes by SELECT_Z
standard errors. Scoring covers every whole text and is a narrow map.

Defined cases: a null or wordless text is one empty sentence; labels that are null are left out, and
a document labelled more than once is toxic if any label says so; with no labelled document, or
labels of one class only, every score is the class's share (0 without labels); repeated rows are
scored each; other columns are not used and not returned.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docloom.llm.common import map_rows

SAMPLE_DOCS = 6000
SAMPLE_BYTES = 64 << 20
SELECT_Z = 3.5
MIN_DOCS = 4
STEPS = 400
SENTENCE_P = 0.5
PREFIXES = (4, 5, 6, 7)
#: Entries a worker keeps of words and their weights; the dictionary is emptied when full.
CACHE_ENTRIES = 400_000

_BLANK = bytes(c if chr(c).isalnum() or c >= 128 or c in b"'.!?\n" else 32 for c in range(256))
_SENTENCE = re.compile(rb"[^.!?\n]*[^.!?\n ][^.!?\n]*")


def sentences_of(text: str | None) -> list[bytes]:
    """Runs between full stops, exclamation and question marks and line ends, lower-cased, other punctuation blanked."""
    return _SENTENCE.findall(text.lower().encode("utf-8", "replace").translate(_BLANK)) if text else []


def features_of(word: bytes) -> list[str]:
    """The word itself and its beginnings, so that unseen endings of a stem are known too."""
    w = word.decode("utf-8", "replace")
    return [f"{w}$", *(w[:k] for k in PREFIXES if len(w) > k)]


class _WordWeights(dict):
    """word -> sum of the weights of its features; made on first use, emptied when full."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        got = self.weights.get
        value = sum(got(f, 0.0) for f in features_of(word))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


class NoisyOr:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.word = _WordWeights(weights)
        self.calm = float(np.logaddexp(0.0, bias))  # -log(1 - p) of a sentence without known words

    def score(self, text: str | None) -> tuple[float, int | None]:
        """The document's score, and the index of its worst sentence (null if no sentence has known words)."""
        return self.locate(text)[:2]

    def locate(self, text: str | None) -> tuple[float, int | None, list[tuple[int, float]]]:
        """As score, and (index, probability) of every sentence of SENTENCE_P or more, in order."""
        found = sentences_of(text)
        total, worst, at, bad = self.calm * max(1, len(found)), 0.0, None, []
        calm_p = -float(np.expm1(-self.calm))
        known = found and any(map(self.word.__getitem__, b" ".join(found).split()))
        if known or calm_p >= SENTENCE_P:
            for i, s in enumerate(found):
                words = list(map(self.word.__getitem__, s.split()))
                p = calm_p
                if any(words):
                    soft = float(np.logaddexp(0.0, self.bias + sum(words)))
                    p, hit = -float(np.expm1(-soft)), soft - self.calm
                    total += hit
                    if hit > worst:
                        worst, at = hit, i
                if p >= SENTENCE_P:
                    bad.append((i, p))
        return -float(np.expm1(-max(0.0, total))), at, bad


def fit(texts: list[str | None], labels: list[int]) -> NoisyOr:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return NoisyOr({}, float(np.log(np.expm1(-np.log1p(-min(share, 1 - 1e-9))) or 1e-12)) if share else -27.0)
    known = lru_cache(None)(features_of)
    bags = [[[f for w in s.split() for f in known(w)] for s in sentences_of(t)] or [[]] for t in texts]
    seen, toxic = Counter(), Counter()
    for bag, label in zip(bags, labels):
        words = {w for s in bag for w in s}
        seen.update(words)
        if label:
            toxic.update(words)
    n, n1 = len(y), y.sum()
    vocab = []
    for w, k in seen.items():
        if k >= MIN_DOCS:
            p1, p0, p = toxic[w] / n1, (k - toxic[w]) / (n - n1), k / n
            if abs(p1 - p0) > SELECT_Z * np.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1))):
                vocab.append(w)
    at = {w: i for i, w in enumerate(sorted(vocab))}
    calm = np.array([sum(not any(w in at for w in s) for s in bag) for bag in bags], float)  # their sentences differ by the bias only
    owner, word, row = [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            ids = [at[w] for w in s if w in at]
            if ids:
                owner.append(d)
                word += [(row, i) for i in ids]
                row += 1
    owner = np.array(owner, np.int64)
    r, c = (np.array(word, np.int64).reshape(-1, 2)).T
    theta = np.concatenate([np.zeros(len(at)), [np.log(y.mean() / max(1.0, np.mean([len(b) for b in bags])))]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):  # Adam on the mean negative log likelihood, with a light ridge on the weights
        z = theta[-1] + np.bincount(r, theta[c], minlength=row)
        soft = np.logaddexp(0.0, z)
        soft0, sig, sig0 = np.logaddexp(0.0, theta[-1]), np.exp(z - soft), 1 / (1 + np.exp(-theta[-1]))
        s = np.maximum(np.bincount(owner, soft, minlength=n) + calm * soft0, 1e-9)
        push = (1 - y) - y / np.expm1(s)
        dz = push[owner] * sig
        grad = np.concatenate([np.bincount(c, dz[r], minlength=len(at)), [dz.sum() + (push * calm).sum() * sig0]]) / n
        grad[:-1] += 1e-4 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return NoisyOr({w: float(theta[i]) for w, i in at.items()}, float(theta[-1]))


def held_out(doc_id) -> F.Column:
    """The fold kept from training: crc32 of the id's decimal text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> NoisyOr:
    """Fits on labelled documents outside the held-out fold, `sample_docs` of them at most, with `sample_bytes` of text at most."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = (
        labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(*order).limit(sample_docs)
    )
    # sample_docs rows at most: this side is bounded by the parameter, and so is the window
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    held = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(*order))
    rows = found.withColumn("held", held).where(F.col("held") <= sample_bytes).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r[0])
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score_documents(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_sentence (its index, from 0), toxic_sentences (all of SENTENCE_P or more) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(cols, fitted):
        ids, folds, texts = cols
        found = [fitted.locate(t) for t in texts]
        scores = [min(1.0, max(0.0, s)) for s, _, _ in found]
        bad = [[{"sentence": i, "score": p} for i, p in b] for _, _, b in found]
        yield {"doc_id": ids, "held_out": folds, "score": scores, "predicted": [int(s >= 0.5) for s in scores], "worst_sentence": [w for _, w, _ in found], "toxic_sentences": bad}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)), "text"), score, f"doc_id {kind}, held_out boolean, score double, predicted int, worst_sentence int, toxic_sentences array<struct<sentence: int, score: double>>", lambda: NoisyOr(*shipped.value))
