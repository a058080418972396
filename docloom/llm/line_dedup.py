"""Line deduplication by a deletion-neighbourhood join. DataFrame operations only.

A line is the sequence of its words, lower-cased, split at ASCII white space. Lines are ordered by
(doc_id, line number). A line goes if an earlier line equals it or lies within the edit bound:
one word inserted, removed or replaced, if the shorter line has MIN_WORDS words or more; for shorter lines only
equal ones go. Lines without words are never removed. The rule looks at every earlier line, kept or not, so
the result doesn't depend on the order of work.

1. Equal lines are grouped by two 64-bit hashes; the first place of each distinct line is kept.
2. Two lines within one edit agree in their first or last floor(m / 2) words, m the words of the shorter.
   Lines that share no such half with another line can't have a partner and are set aside; this
   loses nothing, and leaves few lines to make variants of.
3. Each other distinct line puts out its variants as hashed keys: itself, and itself without its word p for each p. A
   variant's hash is the XOR of hashes of (place, word), so all of a line come from running XORs in one
   window. Lines with an equal variant at an equal p differ in the word p only; a line that equals
   another's variant lacks its word p. Per (variant, p), and per variant, the earliest line is found by a
   minimum, never by pairing the group, so that thousands of lines of one pattern cost as many rows.
4. The edit distance to that earliest line is verified on the words themselves.

Defined cases: a null text stays null; an empty one stays; rows that repeat a doc_id are one document (a
line is earliest in all of them or none); rows with a null doc_id stay as they are and remove nothing; a document that
had words and has none left goes in `dedup_documents`; other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from docloom.llm.common import cut, fresh, key_side

MIN_WORDS = 10

_KEYS = ("first0", "last0", "first1", "last1")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, norm) of every line with words; texts are normalised before they are split, so once."""
    # most texts have no white space that the pattern would change, and skip it
    odd = reduce(or_, (F.contains("text", F.lit(s)) for s in ("  ", "\t", "\x0b", "\f", "\r")))
    text = F.when(odd, F.regexp_replace(F.lower("text"), "[ \\t\\x0b\\f\\r]*[\\t\\x0b\\f\\r][ \\t\\x0b\\f\\r]*|  +", " ")).otherwise(F.lower("text"))
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    split = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split(F.trim(text), "\n", -1)).alias("line_no", "norm"))
    return split.where("norm <> ''")


def _hashed(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, n, h1, h2) and the keys of the line's halves.

    A half is the first or last floor(m / 2) words, for m the line's words and one word less; null for short lines.
    """
    n = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    counted = lines.select("doc_id", "line_no", "norm", n.alias("n"))

    def key(less: int, first: bool) -> F.Column:
        m = F.col("n") - less
        k = F.floor(m / 2).cast("int")
        words = F.call_function("substring_index", F.col("norm"), F.lit(" "), k if first else -k)
        return F.when(F.col("n") >= MIN_WORDS, F.xxhash64(F.lit(first), m, words))

    keys = [key(less, first).alias(name) for name, (less, first) in zip(_KEYS, ((0, True), (0, False), (1, True), (1, False)))]
    return counted.select("doc_id", "line_no", "n", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"), *keys)


def _variants(near: DataFrame) -> DataFrame:
    """(doc_id, line_no, key, p): each line without its word p, and whole (p = -1), of near(h1, h2, doc_id, line_no, n, words)."""
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = near.select("h1", "h2", "doc_id", "line_no", "n", F.posexplode("words").alias("p", "w"))
    word = word.select("h1", "h2", "doc_id", "line_no", "n", "p", F.xxhash64("p", "w").alias("here"), F.xxhash64(F.col("p") - 1, "w").alias("shifted"))
    runs = word.select(
        "doc_id", "line_no", "n", "p", "here",
        F.bit_xor("here").over(upto).alias("here_upto"), F.bit_xor("shifted").over(upto).alias("shifted_upto"),
        F.bit_xor("here").over(line).alias("here_all"), F.bit_xor("shifted").over(line).alias("shifted_all"),
    )
    # words before p at their places, words after it one place earlier
    without = F.col("here_upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("shifted_all")).bitwiseXOR(F.col("shifted_upto"))
    each = F.struct(F.xxhash64(without, F.col("n") - 1).alias("key"), F.col("p"))
    whole = F.struct(F.xxhash64("here_all", "n").alias("key"), F.lit(-1).alias("p"))
    return runs.select("doc_id", "line_no", "n", F.explode(F.when(F.col("p") == 0, F.array(each, whole)).otherwise(F.array(each))).alias("v")).select("doc_id", "line_no", "n", "v.*")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, keeper_doc, keeper_line) of every line that goes, and an earlier line within the bound of it."""
    hashed = cut(_hashed(_lines(docs)))
    place = F.struct("doc_id", "line_no")

    # 1: the first place of each distinct line
    first = hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    first = cut(first.select("h1", "h2", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"), "copies"))

    # 2: halves that two different lines have
    halves = hashed.where(F.col("first0").isNotNull()).select("h1", F.explode(F.array(*_KEYS)).alias("half"))
    shared = cut(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"))
    likely = halves.join(key_side(shared), "half", "left_semi").select("h1").distinct()
    likely = cut(likely.join(first, "h1").select("h1", "h2", "doc_id", "line_no"))

    # 3: variants of those lines, at their first places
    some = docs.select("doc_id", "text").join(key_side(likely.select("doc_id").distinct()), "doc_id", "left_semi")
    near = _lines(some).join(key_side(likely), ["doc_id", "line_no"]).where(F.xxhash64("norm") == F.col("h1")).dropDuplicates(["h1", "h2"])
    near = cut(near.select("h1", "h2", "doc_id", "line_no", F.split("norm", " ").alias("words")).withColumn("n", F.size("words")))
    # most variants are of one line only
    variants = _variants(near)
    met = cut(variants.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    variants = cut(variants.join(key_side(met), "key", "left_semi").select(place.alias("at"), "n", "key", "p"))

    # the earliest line of a variant at one place, of its makers at any place, and of the lines that equal it
    same = variants.groupBy("key", "p").agg(F.min(F.struct("at", "p")).alias("best"), F.count("*").alias("lines"))
    replaced = same.where("p >= 0 AND lines > 1").select("key", "p", "best")
    makers = same.where("p >= 0").groupBy("key").agg(F.min("best").alias("best"))
    equals = same.where("p = -1").select("key", "best")
    pairs = [
        variants.where(F.col("p") >= 0).join(replaced, ["key", "p"]),  # replaced words
        variants.where(F.col("p") == -1).join(makers, "key"),  # lacks a word of an earlier line
        variants.where((F.col("p") >= 0) & (F.col("n") > MIN_WORDS)).join(equals, "key"),  # has a word more than an earlier line
    ]
    hits = [x.where(F.col("best.at") < F.col("at")).select("at", "p", F.col("best.at").alias("kept"), F.col("best.p").alias("q")) for x in pairs]
    # any witness will do: the earliest
    witness = hits[0].unionByName(hits[1]).unionByName(hits[2]).groupBy("at").agg(F.min(F.struct("kept", "p", "q")).alias("w")).select("at", "w.*")

    # 4: verify on the words
    own = near.select("h1", "h2", place.alias("at"), "words")
    others = near.select(place.alias("kept"), F.col("words").alias("others"))
    without = lambda c, k: F.when(F.col(k) >= 0, F.concat(F.slice(c, F.lit(1), F.greatest(F.col(k), F.lit(0))), F.slice(c, F.greatest(F.col(k) + 2, F.lit(1)), F.size(c)))).otherwise(F.col(c))
    verified = cut(own.join(witness, "at").join(others, "kept").where(without("words", "p") == without("others", "q")).select("h1", "h2", "kept"))

    # every place of a line that isn't its first, and first places with a witness
    doubtful = first.join(key_side(verified), ["h1", "h2"], "left").where("copies > 1 OR kept IS NOT NULL")
    doubtful = cut(doubtful.select("h1", "h2", place.alias("first"), "kept"))
    out = hashed.select("doc_id", "line_no", "h1", "h2").join(key_side(doubtful), ["h1", "h2"]).where((place > F.col("first")) | F.col("kept").isNotNull())
    keeper = F.when(place > F.col("first"), F.col("first")).otherwise(F.col("kept"))
    return out.select("doc_id", "line_no", keeper.alias("k")).select("doc_id", "line_no", F.col("k.doc_id").alias("keeper_doc"), F.col("k.line_no").alias("keeper_line"))


def _without(text: str, gone: str) -> F.Column:
    """The text without the lines of sorted numbers: the runs of lines between them, sliced out of lines that are split once."""

    def run(lines: F.Column, k: F.Column) -> F.Column:
        last = F.coalesce(F.get(F.col(gone), k - 1), F.lit(-1))
        return F.slice(lines, last + 2, F.coalesce(F.get(F.col(gone), k), F.size(lines)) - last - 1)

    def join(lines: F.Column) -> F.Column:
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: run(lines, k))), "\n")

    # the array of one element binds the lines, so that they are not split again for each run
    return F.get(F.transform(F.array(F.split(text, "\n", -1)), join), F.lit(0))


def _stripped(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the sorted numbers of the lines that go (null: none) and the text without them; the names of these columns."""
    gone, left = fresh(docs, "__gone"), fresh(docs, "__left")
    numbers = removed_lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias(gone))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_without("text", gone))
    return docs.join(numbers, "doc_id", "left").withColumn(left, kept), gone, left


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, of every row."""
    out, gone, left = _stripped(docs.select("doc_id", "text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"), F.col(left).alias("text"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with their texts stripped; without documents of which nothing is left."""
    out, gone, left = _stripped(docs)
    some = out.where(F.col(gone).isNull() | F.col(left).rlike(r"[^ \t\n\x0b\f\r]"))
    return some.select(*[F.col(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
