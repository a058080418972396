"""Quality rules with cross-document line frequency.

Each line is normalised (A-Z lower-cased, its words joined by one space) and hashed. For each host
the distinct documents with a line are counted over all documents. A line is above the limit if
more than MIN_LINE_DOCS documents of the host have it, and more than LINE_SHARE of the host's documents or MAX_LINE_DOCS of them, whatever its size;
it is removed from all of them but the one with the smallest doc_id, so that the only text of a much copied
document is not lost. A document is rejected if it fails the base rules, or if under KEEP_SHARE of
its words are left.

Defined cases: a null text has no words, and base_failed; a null host is a host of its own; lines
without words are neither counted nor removed; a repeated doc_id counts as one document, and each
of its rows is judged; other columns pass through `clean_documents` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import cut, fresh, key_side, map_rows, slices, small

MIN_LINE_DOCS = 20
#: A line is above the limit in more than MIN_LINE_DOCS documents of a host and more than this share of them, or than MAX_LINE_DOCS.
LINE_SHARE = 0.02
MAX_LINE_DOCS = 100
KEEP_SHARE = 0.5
#: Lines above the limit up to which every task gets all of them: about 20 MB.
ABOVE_LINES = 100_000

# The base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def line_key(line: bytes) -> tuple[int, int]:
    """(hash of the normalised line, its words); a line without words has (0, 0)."""
    words = line.lower().split()
    if not words:
        return 0, 0
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63), len(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None)))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(upto, i)
            upto = i + 3
    return covered


def base_features(text: str | None) -> dict:
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, repeat = len(words), repeated_words(words)
    per: dict[int, int] = {}
    for x in lines:
        key, k = line_key(x)
        per[key] = per.get(key, 0) + k
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")) if text else 0,
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat,
        "base_failed": n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n,
        "lines": list(per), "line_words": list(per.values()),
    }


_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _measured(docs: DataFrame, host: str) -> DataFrame:
    def measure(cols):
        rows = [base_features(t) for t in cols[3]]
        yield {"doc_id": cols[0], "host": cols[1], "hash": cols[2]} | {k: [r[k] for r in rows] for k in (*_FEATURES, "lines", "line_words")}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, host string, hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<long>, line_words array<long>"
    return cut(map_rows(docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")), F.xxhash64("text"), "text"), measure, schema))


def _lines(measured: DataFrame) -> DataFrame:
    return measured.select("doc_id", "hash", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("doc_id", "hash", "host", F.col("l.lines").alias("key"), F.col("l.line_words").alias("words"))


def _above(measured: DataFrame) -> DataFrame:
    """(host, key, first_doc) of the lines above the limit."""
    lines = _lines(measured)
    hosts = measured.groupBy("host").agg(F.count_distinct("doc_id").alias("host_docs"))
    counted = (
        lines.groupBy("host", "key", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("host", "key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
        .where(F.col("docs") > MIN_LINE_DOCS)
    )
    return cut(counted.join(hosts, "host").where(F.col("docs") > F.least(F.col("host_docs") * F.lit(LINE_SHARE), F.lit(float(MAX_LINE_DOCS)))).select("host", "key", "first_doc"))


def _excess(measured: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id, hash, gone (keys), n_removed_words of the texts with lines to be removed."""
    found = _lines(measured).join(key_side(above), ["host", "key"]).where("doc_id <> first_doc").select("doc_id", "hash", "key", "words").distinct()
    return found.groupBy("doc_id", "hash").agg(F.collect_set("key").alias("gone"), F.sum("words").alias("n_removed_words"))


def judge_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, the base features, base_failed, kept, n_removed_words of every row.

    Texts are read once by a narrow map; only hashes of lines are shuffled, counted map-side first.
    """
    measured = _measured(docs, host)
    lost = _excess(measured, _above(measured)).select("doc_id", "hash", "n_removed_words")
    joined = measured.join(lost, ["doc_id", "hash"], "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_removed_words")
    return joined.select("doc_id", *_FEATURES, (~F.col("base_failed") & (left >= F.col("n_words") * F.lit(KEEP_SHARE))).alias("kept"), "n_removed_words")


def clean_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of kept documents, all columns, their texts without the lines above the limit.

    If the lines above the limit are ABOVE_LINES at most (they are counted first), each task gets all of them and the texts
    are cleaned where they are read; else what is to be removed is joined to the texts.
    """
    measured = _measured(docs, host)
    above = _above(measured)
    names, at = docs.columns, docs.columns.index("text")
    if small(above, ABOVE_LINES):
        limits = docs.sparkSession.sparkContext.broadcast({(r.host, r.key): r.first_doc for r in above.collect()})
        host_name = fresh(docs, "__host")
        hosted = docs.withColumn(host_name, F.coalesce(F.col(host).cast("string"), F.lit("")))
        doc_at = names.index("doc_id")

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = limits.value
            for batch in slices(batches):
                texts, kept = [], []
                for doc, own, t in zip(batch.column(doc_at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(at).to_pylist()):
                    f = base_features(t)
                    gone = {} if doc is None else {k: n for k, n in zip(f["lines"], f["line_words"]) if first.get((own, k), doc) != doc}
                    kept.append(not f["base_failed"] and f["n_words"] - sum(gone[k] for k in gone) >= f["n_words"] * KEEP_SHARE)
                    texts.append(_without(t, gone) if gone and kept[-1] else t)
                cols = list(batch.columns[: len(names)])
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(kept, pa.bool_()))

        return hosted.mapInArrow(clean, docs.schema)
    lost = _excess(measured, above)
    left = F.col("n_words") - F.coalesce("n_removed_words", F.lit(0).cast("long"))
    passed = measured.where(~F.col("base_failed")).join(lost, ["doc_id", "hash"], "left").where(left >= F.col("n_words") * F.lit(KEEP_SHARE))
    # a decision for each text of an id
    out, doc, text_hash = fresh(docs, "__gone"), fresh(docs, "__doc"), fresh(docs, "__hash")
    decided = passed.groupBy(F.col("doc_id").alias(doc), F.col("hash").alias(text_hash)).agg(F.first("gone").alias(out))
    joined = docs.join(decided, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(text_hash))).select(*[F.col(f"`{c}`") for c in names], out)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [_without(t, set(gone)) if gone else t for t, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(strip, docs.schema)


def _without(text: str, gone) -> str:
    return "\n".join(x for x in text.split("\n") if not (k := line_key(x.encode("utf-8", "replace")))[1] or k[0] not in gone)
