"""Fill-in-the-middle transformation, as relations over the units of a text.

A text is cut into units, each a word with the white space before it (white space at the end is one more). Two cuts, drawn by a hash of
seed and id, fall after so many units; what lies between them is the middle. The three parts are written in one of two orders, prefix first
(psm) or suffix first (spm), with a marker before each, or the text stays plain.

Units are rows: the matches of a document are exploded with their ordinals, a window sums their lengths from the first one on, the
document's cut requests meet them by ordinal, and the two sums found give the offsets for `substring`. Only documents that are to be
cut take that way, with as many units as their second cut needs; plain ones are a narrow projection. The cut texts are shuffled once, by
a SHA-256 of id and text, equal rows collapsed before; explode, window, join and aggregate all keep that partitioning.

Defined cases: a null text is the empty text, which is plain with n = 0; a null id is hashed as the empty string; repeated rows are
returned each; a text that holds a marker stays plain; other columns are not used and not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEED = 42
#: Percent of documents that are cut, and percent of those that are written suffix first.
CUT_PERCENT, SPM_PERCENT = 50, 80
MARKERS = ("<P>", "<S>", "<M>")
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the first groups of eight digits of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def n_units(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))).cast("long")


def cut_offsets(docs: DataFrame, key: str) -> DataFrame:
    """key, prefix_end, middle_end (code points) of documents (key, text, first, second), first <= second being unit ordinals.

    The key is unique and not null; nothing is shuffled if docs is partitioned by it. Documents whose cuts are both at 0 have no row.
    """
    needed = docs.where(F.col("second") > 0)
    units = needed.select(key, F.posexplode(F.slice(F.transform(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)), F.length), F.lit(1), F.col("second").cast("int"))).alias("at", "size"))
    sums = units.withColumn("ends", F.sum("size").over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    requests = needed.select(key, "first", "second")
    met = sums.join(requests, key).where((F.col("at") + 1 == F.col("first")) | (F.col("at") + 1 == F.col("second")))
    pick = lambda cut: F.max(F.when(F.col("at") + 1 == F.col(cut), F.col("ends")))
    return met.groupBy(key).agg(pick("first").alias("prefix_end"), pick("second").alias("middle_end"))


def output_text(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    p, s, m = map(F.lit, MARKERS)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))


def restored_text(form: Column, output: Column) -> Column:
    """The text again, from output and form alone: each part begins after its marker and ends before the next one."""
    p, s, m = MARKERS

    def part(of: str, until: str | None) -> Column:
        start = F.instr(output, of) + len(of)
        return F.substring(output, start, (F.instr(output, until) if until else F.length(output) + 1) - start)

    parts = F.when(form == "psm", F.concat(part(p, s), part(m, None), part(s, m))).when(form == "spm", F.concat(part(p, m), part(m, None), part(s, p)))
    return F.when(form == "plain", output).otherwise(parts)


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output of every row."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(text, F.lit(m))
    form = F.when((text == "") | marked | (h3 % 100 >= cut_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    base = docs.select("doc_id", text.alias("text")).withColumn("form", form)
    none = F.lit(None).cast("long")
    plain = base.where("form = 'plain'").select("doc_id", n_units(F.col("text")).alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    row_key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256))
    cut = base.where("form <> 'plain'").where(row_key.isNotNull()).groupBy(row_key.alias("row_key")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times"))
    # all uses of these rows have the same columns and conditions (a join asks for keys that are not null), so that the texts are shuffled once for all
    cut = cut.where("times > 0").withColumn("n", n_units(F.col("text")))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = cut.withColumns({"form": F.when(h4 % 100 < spm_percent, "spm").otherwise("psm"), "first": F.least(a, b), "second": F.greatest(a, b)})
    found = cut.join(cut_offsets(cut, "row_key"), "row_key", "left")
    x, y = F.coalesce("prefix_end", F.lit(0)).cast("int"), F.coalesce("middle_end", F.lit(0)).cast("int")
    t = F.col("text")
    parts = F.substring(t, F.lit(1), x), F.substring(t, x + 1, y - x), F.substring(t, y + 1, F.length(t))
    done = found.select("doc_id", "n", "form", x.cast("long").alias("prefix_chars"), (y - x).cast("long").alias("middle_chars"), output_text(F.col("form"), *parts).alias("output"), "times")
    again = done.select("*", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "col")
    return plain.unionByName(again)


def digests(df: DataFrame) -> DataFrame:
    """The contract's columns: hashes of the output and of the text rebuilt from it."""
    restored = restored_text(F.col("form"), F.col("output"))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))
