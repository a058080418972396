"""Queries over files that Spark writes from the tables: sinks and sources, texts of many blocks, mixed types, character sets, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import charset, mime as M
from docloom.operators import archive
from docloom.operators.mixed import convert_mixed
from docloom.operators.text_ranges import split_csv_files, split_paragraph_files
from docloom.queries import _PARTS, query, sha, table
from docloom.sources.archives import read_archives, whole_entries
from docloom.sources.information import read_information
from docloom.sources.scratch import shared_folder
from docloom.sources.sink import commit_files
from docloom.streaming.ingest import drain
from docloom.streaming.ordered import ordered_chunks

#: Documents in a file: a file is one value where it is made.
PER_FILE = 100


def _bucket() -> Column:
    return F.floor(F.col("doc_id") / PER_FILE).cast("long")


def _bucket_of(path: str) -> Column:
    return F.regexp_extract(path, r"b(\d+)\.\w+$", 1).cast("long")


def _archives(spark, d) -> str:
    """The documents as ZIP archives of PER_FILE entries, committed to a shared folder."""
    docs = table(spark, d, "documents").select(_bucket().alias("bucket"), F.col("doc_id").alias("index"), F.concat(F.lit("t/"), "doc_id", F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    folder = shared_folder(spark, "archives")
    commit_files(archive.zip_fragments(docs, ["bucket"]).withColumn("filename", F.concat(F.lit("b"), "bucket", F.lit(".zip"))), folder)
    return folder


def _text_files(spark, d, line: Column, between: str, extension: str, head: str = "") -> str:
    """A file of PER_FILE documents' lines."""
    docs = table(spark, d, "documents").select(_bucket().alias("bucket"), F.struct("doc_id", line.alias("t")).alias("s"))
    texts = docs.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), between).alias("t"))
    folder = shared_folder(spark, extension)
    commit_files(texts.select(F.concat(F.lit("b"), "bucket", F.lit(f".{extension}")).alias("filename"), F.encode(F.concat(F.lit(head), "t"), "UTF-8").alias("content")), folder)
    return folder


@query(f"SELECT doc_id // {PER_FILE} AS bucket, doc_id, CAST(row_number() OVER (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id) - 1 AS INT) AS index, 'text/plain' AS mime, sha256(text) AS hash FROM documents")
def archive_source(spark, d) -> DataFrame:
    found = whole_entries(read_archives(spark, _archives(spark, d)))
    return found.select(_bucket_of("path").alias("bucket"), F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("doc_id"), "index", "mime", sha(F.col("content")).alias("hash"))


@query(f"SELECT doc_id // {PER_FILE} AS bucket, 'application/zip' AS mime, CAST(count(*) AS INT) AS entries, CAST(count(*) AS INT) AS parts, true AS little FROM documents GROUP BY 1")
def file_information(spark, d) -> DataFrame:
    found = read_information(spark, _archives(spark, d))
    return found.select(_bucket_of("path").alias("bucket"), "mime", "entries", "parts", (F.col("bytes_read") <= F.greatest(F.lit(200_000), F.col("size") / 2)).alias("little"))


@query(f"""WITH t AS (SELECT doc_id // {PER_FILE} AS bucket, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1), p AS (SELECT bucket, {_PARTS.format("text")} AS l FROM t)
SELECT bucket, CAST(i - 1 AS INT) AS index, 'Paragraph ' || i AS label, CAST(len(l) AS INT) AS total, l[i] AS text FROM p, unnest(range(1, len(l) + 1)) AS u(i)""")
def paragraph_files(spark, d) -> DataFrame:
    return split_paragraph_files(spark, _text_files(spark, d, F.col("text"), "\n\n", "txt")).select(_bucket_of("path").alias("bucket"), "index", "label", "total", "text")


@query(f"""SELECT doc_id // {PER_FILE} AS bucket, CAST(row_number() OVER w - 1 AS INT) AS index, 'Row ' || (row_number() OVER w + 1) AS label, CAST(count(*) OVER (PARTITION BY doc_id // {PER_FILE}) AS INT) AS total,
'doc_id,lang' || chr(10) || doc_id || ',' || lang AS text FROM documents WINDOW w AS (PARTITION BY doc_id // {PER_FILE} ORDER BY doc_id)""")
def csv_files(spark, d) -> DataFrame:
    folder = _text_files(spark, d, F.concat_ws(",", "doc_id", "lang"), "\r\n", "csv", "doc_id,lang\r\n")
    return split_csv_files(spark, folder).select(_bucket_of("path").alias("bucket"), "index", "label", "total", "text")


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, sha256(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '<table><tr><td>id</td><td>lang</td></tr><tr><td>' || doc_id || '</td><td>' || lang || '</td></tr></table>' WHEN 2 THEN text
WHEN 4 THEN '<html xmlns="http://www.w3.org/1999/xhtml"><head><title></title></head><body><p>' || replace({_ESCAPED.format("text")}, chr(10), '</p><p>') || '</p></body></html>' END) AS hash,
CASE WHEN doc_id % 5 = 3 THEN 'UnsupportedConversion' END AS error FROM documents""")
def mixed_types(spark, d) -> DataFrame:
    """Text, CSV, text in another character set, JSON to PDF, and text to XML, in one table and one plan."""
    k, text = F.col("doc_id") % 5, F.encode("text", "UTF-8")
    plain, xml = M.SHORT["plain"], "application/xml"
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    content = F.when(k == 1, F.encode(F.concat(F.lit("id,lang\n"), "doc_id", F.lit(","), "lang"), "UTF-8")).when(k == 2, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))).otherwise(text)
    docs = table(spark, d, "documents").select("doc_id", content.alias("content"), pick(plain, M.SHORT["csv"], M.SHORT["markdown"], M.SHORT["json"], plain).alias("mime"), pick(plain, M.SHORT["html"], plain, M.SHORT["pdf"], xml).alias("target"))
    return convert_mixed(docs).select("doc_id", sha(F.col("result")).alias("hash"), F.col("error.type").alias("error"))


@query("""SELECT kind, status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 6 IN (0, 1, 2) THEN 'Parse' WHEN doc_id % 6 IN (3, 4) THEN 'UnsupportedConversion' END AS kind,
CASE WHEN doc_id % 6 IN (0, 1, 2) THEN 400 WHEN doc_id % 6 IN (3, 4) THEN 415 END AS status FROM documents) GROUP BY ALL""")
def failure_status(spark, d) -> DataFrame:
    """Documents that fail for what they are: no workbook, an archive cut short, nothing, no route, no text; and some that don't."""
    k, text = F.col("doc_id") % 6, F.encode("text", "UTF-8")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    content = F.when(k == 1, F.concat(F.lit(b"PK\x03\x04"), text)).when(k == 2, F.lit(b"")).when(k == 4, F.concat(F.lit(b"\x00\x01\x02"), text)).otherwise(text)
    mimes = pick(M.SHORT["xlsx"], M.SHORT["zip"], M.SHORT["pdf"], M.SHORT["json"], M.OCTET, M.OCTET)
    docs = table(spark, d, "documents").select(content.alias("content"), mimes.alias("mime"), F.when(k == 3, M.SHORT["png"]).otherwise(M.SHORT["plain"]).alias("target"))
    done = convert_mixed(docs)
    return done.groupBy(F.col("error.type").alias("kind"), F.col("error.http_status").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'utf-16-le' WHEN doc_id % 5 = 2 THEN 'utf-16-be' WHEN doc_id % 5 = 4 AND NOT regexp_matches(text, '^[\\x00-\\x7F]*$') THEN 'windows-1252' ELSE 'utf-8' END AS charset, sha256(text) AS hash FROM documents""")
def decoded_texts(spark, d) -> DataFrame:
    """Texts written in five ways, without saying which, and read again."""
    k = F.col("doc_id") % 5
    wide = F.translate("text", charset.table("windows-1252"), "".join(map(chr, range(128, 256))))
    content = F.when(k == 1, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))).when(k == 2, F.encode("text", "UTF-16BE")).when(k == 3, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")))
    docs = table(spark, d, "documents").select("doc_id", content.when(k == 4, F.encode(wide, "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    named = docs.select("doc_id", "content", charset.charset(F.col("content")).alias("charset"))
    return named.select("doc_id", "charset", F.sha2(F.encode(charset.decode_text(F.col("content"), F.col("charset")), "UTF-8"), 256).alias("hash"))


@query("SELECT conv_id AS key, sha256(string_agg(text, chr(10) ORDER BY turn) || chr(10)) AS hash FROM conversations GROUP BY conv_id")
def chunk_stream(spark, d) -> DataFrame:
    """Each turn a chunk, dealt over three batches in no order, put together by a state for each conversation."""
    turns = table(spark, d, "conversations")
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("end"))
    chunks = turns.join(ends, "conv_id").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.encode("text", "UTF-8").alias("chunk"), (F.col("turn") == F.col("end")).alias("last"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)).alias("batch"))
    folder = shared_folder(spark, "chunks")
    for b in range(3):
        chunks.where(F.col("batch") == b).drop("batch").coalesce(4).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(chunks.drop("batch").schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    drain(ordered_chunks(stream, lambda: b"", lambda s, c: s + c + b"\n", lambda s: s), f"{folder}/out", f"{folder}/check", timers=True)
    return spark.read.parquet(f"{folder}/out").select("key", sha(F.col("result")).alias("hash"))
