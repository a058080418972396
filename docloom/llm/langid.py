"""Language identification by mixture inference: a document is a mixture of languages, its n-grams drawn from them.

Every language is a multinomial over hashed character n-grams: 1 to MAX_GRAM successive letters of a word, case folded, the space before and
after a word being one of them. Expectation-maximisation finds the proportions of all languages in a document. Languages, in the order of these proportions,
are then taken into the document's set as long as that raises the penalised likelihood (half the logarithm of the n-gram count for each
more language, for n-grams overlap times MAX_GRAM); the first is the prediction, the set's own proportions are returned beside it.

Counts cover every n-gram of every training text: tasks add up a table of languages and buckets, Spark adds up the tables. The table has
at most MODEL_ENTRIES entries whatever the input (fewer buckets for more languages), so that it may be broadcast; scoring is a narrow map.
Texts are read in slices of SLICE_CHARS, so that memory does not grow with their length.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing was learned; rows with a null id or
language teach nothing, and null ids are scored as not held out; repeated rows count, and are returned, each; ties go to the language
that is first in code point order; other columns are not used and not returned. More than MAX_LANGUAGES languages are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import cut, map_rows, slices

MAX_GRAM = 3
MODEL_ENTRIES = 1 << 22
MAX_BUCKETS = 1 << 18
MAX_LANGUAGES = 4096
#: Added to every count.
SMOOTHING = 0.1
STEPS = 15
#: A proportion that no step changes by more than this has settled.
SETTLED = 1e-3
SLICE_CHARS = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def buckets_for(languages: int) -> int:
    """Buckets of the table: the power of two that MODEL_ENTRIES allows, MAX_BUCKETS at most."""
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} languages to learn, {MAX_LANGUAGES} at most")
    return min(MAX_BUCKETS, 1 << int(np.log2(MODEL_ENTRIES / max(1, languages))))


def grams(text: str, buckets: int) -> np.ndarray:
    """The buckets of a text's n-grams: those of its words, each between two spaces, that have a letter and no space inside."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first one stays, as the space
    keep[0] = True
    letter = letter[keep]
    points = np.where(letter, points[keep], np.uint32(32)).astype(np.uint64)
    found = [np.zeros(0, np.int32)]
    for n in range(1, MAX_GRAM + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        if n == 1:
            mixed, valid = points, letter
        else:  # either end may be a space, what is between must be letters
            mixed = (mixed[:size] ^ (mixed[:size] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + points[n - 1 :]
            valid = np.ones(size, bool) if n == 2 else valid[:size] & letter[n - 2 : n - 2 + size]
        found.append(((mixed[valid] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32))
    return np.concatenate(found)


def _pieces(text: str) -> Iterator[str]:
    """A text's parts of about SLICE_CHARS, cut where no letter stands; a run of so many letters is cut too, as two words."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = next((k for k in range(at + SLICE_CHARS, min(len(text), at + 2 * SLICE_CHARS)) if not text[k].isalpha()), min(len(text), at + 2 * SLICE_CHARS))
        yield text[at:end]
        at = end
    yield text[at:]


def gram_counts(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, ascending, and their counts."""
    if text is None or len(text) <= SLICE_CHARS:
        return np.unique(grams(text or "", buckets), return_counts=True)
    table = np.zeros(buckets, np.int64)
    for piece in _pieces(text):
        table += np.bincount(grams(piece, buckets), minlength=buckets)
    at = np.flatnonzero(table)
    return at, table[at]


def held_out(doc_id: str) -> F.Column:
    """The fold kept from training: crc32 of the id's decimal text, mod 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


class Mixture:
    """The learned languages and their n-gram probabilities, (buckets, languages)."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names, self.buckets = names, counts.shape[1]
        smooth = counts + SMOOTHING
        self.p = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T, np.float32)

    @staticmethod
    def shares(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the columns of p that make the counts c likeliest, by expectation-maximisation, and the log likelihood there."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        n = c.sum()
        for _ in range(STEPS if p.shape[1] > 1 else 0):
            was, share = share, share * ((c / (p @ share)) @ p) / n
            if np.abs(share - was).max() < SETTLED:
                break
        return share, float(c @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Prediction, its share among all languages, and the selected set with its shares, largest first."""
        at, c = gram_counts(text, self.buckets)
        if not len(at) or not self.names:
            return UNKNOWN, 0.0, []
        p, c = self.p[at].astype(np.float64), c.astype(np.float64)
        full, _ = self.shares(p, c)
        order = np.argsort(-full, kind="stable")
        best, price = None, 0.5 * MAX_GRAM * np.log(max(2.0, c.sum()))
        for k in range(1, len(order) + 1):
            if k > 1 and full[order[k - 1]] * c.sum() < MAX_GRAM:  # less than one place of the text
                break
            share, fit = self.shares(p[:, order[:k]], c)
            if best is not None and fit - price * k <= best[0]:
                break
            best = fit - price * k, share
        by_share = np.argsort(-best[1], kind="stable")
        picked = [(self.names[order[i]], float(best[1][i])) for i in by_share]
        return picked[0][0], min(1.0, float(full[order[by_share[0]]])), picked


def train(docs: DataFrame) -> Mixture:
    """Counts of all n-grams of all rows (doc_id, text, lang) outside the held-out fold that have a language."""
    rows = docs.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    buckets = buckets_for(len(names))
    place = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(names), buckets), np.int64)
        for batch in batches:
            for part in slices([batch]):
                for text, lang in zip(*(c.to_pylist() for c in part.columns)):
                    row = table[place[lang]]
                    for piece in _pieces(text):
                        row += np.bincount(grams(piece, buckets), minlength=buckets)
        lang, bucket = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(table[lang, bucket])], ["lang", "bucket", "n"])

    # languages times buckets at most, whatever the input
    sums = cut(rows.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))) if names else None
    counts = np.zeros((len(names), buckets), np.int64)
    if names:
        got = sums.toArrow()
        counts[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Mixture(names, counts)


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages (the selected set with its proportions) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def infer(cols, mixture):
        ids, folds, texts = cols
        found = [mixture.infer(t) for t in texts]
        sets = [[{"lang": n, "share": s} for n, s in f[2]] for f in found]
        yield {"doc_id": ids, "held_out": folds, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "languages": sets}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)), "text"), infer, f"doc_id {kind}, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>", lambda: shipped.value)
