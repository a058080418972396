"""The opN_ queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table
from docloom.llm.line_dedup import MIN_WORDS as LINE_WORDS
from docloom.llm.quality_lines import KEEP_SHARE, LINE_SHARE, MAX_LINE_DOCS, MAX_REPEAT_PERCENT, MIN_LINE_DOCS, MIN_WORDS

# Fixed values of the contracts.
TOKEN_LIMIT = 1024
SEQUENCE_TOKENS = 2048


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.html_template import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.bpe_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), TOKEN_LIMIT)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.quality_lines import judge_documents

    return judge_documents(table(spark, sf_dir, "documents"))


def op7_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.bestfit import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.parity_join import link_components

    return link_components(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.fim import digests, fill_in_middle

    return digests(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_template, op2_toxicity, op3_token_counts, op4_decontamination, op5_warc, op6_quality_lines, op7_bestfit, op8_line_dedup, op9_licenses, op10_parity_join,
        op11_prefix_trie, op12_fill_in_middle, op13_language_id,
    )
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op6_quality_lines": rf"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, {_WORDS.format("text")} AS ws FROM d),
        tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
        dup AS (SELECT doc_id, a, b, c FROM tri GROUP BY ALL HAVING count(*) > 1),
        pos AS (SELECT DISTINCT doc_id, i + k AS p FROM tri JOIN dup USING (doc_id, a, b, c), (VALUES (0), (1), (2)) v(k)),
        rep AS (SELECT doc_id, count(*) AS n_repeat FROM pos GROUP BY 1),
        lines AS (SELECT * FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS ln FROM d) WHERE regexp_matches(ln, '[^\x20\x09-\x0D]')),
        dl AS (SELECT doc_id, count(*) - count(DISTINCT ln) AS n_dup FROM lines GROUP BY 1),
        norm AS (SELECT doc_id, host, {_WORDS.format(f"translate(ln, '{_UP}', '{_LOW}')")} AS lw FROM lines),
        per AS (SELECT doc_id, host, lw, sum(len(lw)) AS words FROM norm GROUP BY ALL),
        hosts AS (SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY 1),
        above AS (SELECT host, lw, min(doc_id) AS f FROM per JOIN hosts USING (host) GROUP BY host, lw, n HAVING count(DISTINCT doc_id) > {MIN_LINE_DOCS} AND count(DISTINCT doc_id) > least(n * {LINE_SHARE}, {MAX_LINE_DOCS})),
        lost AS (SELECT doc_id, sum(words) AS gone FROM per JOIN above USING (host, lw) WHERE doc_id <> f GROUP BY 1),
        b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
              CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
              CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed_words
              FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
        c AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
        SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * {KEEP_SHARE} AS kept FROM c""",
    "op8_line_dedup": rf"""
        WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS ln FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
        w AS (SELECT doc_id, i, regexp_extract_all(lower(ln), '[^ \t\x0b\f\r]+') AS ws FROM l),
        f AS (SELECT ws, len(ws) AS n, min((doc_id, i)) AS spot FROM w WHERE len(ws) > 0 GROUP BY ws),
        v AS (SELECT spot, n, p, array_to_string(ws[:p - 1] || ws[p + 1:], ' ') AS k FROM f, unnest(range(1, n + 1)) AS u(p) WHERE n >= {LINE_WORDS}),
        own AS (SELECT spot, n, array_to_string(ws, ' ') AS k FROM f WHERE n >= {LINE_WORDS}),
        same AS (SELECT n, p, k, min(spot) AS best FROM v GROUP BY ALL HAVING count(*) > 1),
        near AS (SELECT v.spot FROM v JOIN same USING (n, p, k) WHERE same.best < v.spot
                 UNION SELECT own.spot FROM own JOIN v ON own.k = v.k AND v.n = own.n + 1 WHERE v.spot < own.spot
                 UNION SELECT v.spot FROM own JOIN v ON own.k = v.k AND v.n = own.n + 1 WHERE own.spot < v.spot),
        gone AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.ws = f.ws LEFT JOIN near ON f.spot = near.spot WHERE len(w.ws) > 0 AND ((w.doc_id, w.i) <> f.spot OR near.spot IS NOT NULL))
        SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(ln, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
        FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id""",
    "op10_parity_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN c ca ON ca.doc_id = x JOIN c cb ON cb.doc_id = y WHERE 100 * k >= 80 * (ca.n + cb.n - k)),
        r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
        SELECT w.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.y), w.doc_id)) AS component_id
        FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN r ON r.x = w.doc_id GROUP BY w.doc_id""",
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS newest FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN newest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN newest <> page_id THEN newest END AS refers_to FROM r""",
    "op11_prefix_trie": """
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS n FROM t),
        bits AS (SELECT DISTINCT c, flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: [256 + ascii(substr(c::VARCHAR, i, 1)), 0, 0, 0, 0, 0, 0, 0, 0])) AS b FROM t),
        crc AS (SELECT c, xor(4294967295, list_reduce(list_prepend(4294967295, b::BIGINT[]), lambda a, y: CASE WHEN y > 0 THEN xor(a, y - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS k FROM bits),
        ids AS (SELECT c, k % 9 AS h FROM crc),
        re AS (SELECT ids.c, 0 AS part, n, r, x FROM ids JOIN o ON o.c = ids.c - ids.c % 5 AND n <= h UNION ALL SELECT c, 1, n, r, x FROM o JOIN ids USING (c) WHERE n > h),
        full_ AS (SELECT ids.c, count(n) AS len, coalesce(list({'r': r, 'x': x} ORDER BY part, n) FILTER (n IS NOT NULL), []) AS l FROM ids LEFT JOIN re ON re.c = ids.c GROUP BY ids.c),
        m AS (SELECT c, len, d, l[1:d] AS p, CASE WHEN d > 0 THEN l[1:d - 1] END AS up FROM full_, unnest(range(0, len + 1)) AS u(d)),
        node AS (SELECT p, d, any_value(up) AS up, min(c) AS c, count(*) AS n, coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len)), sha256('')) AS ends,
                 CASE WHEN d > 0 THEN octet_length(encode(p[d].x)) ELSE 0 END AS bytes FROM m GROUP BY p, d),
        kids AS (SELECT up AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY up),
        tree AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids ON kids.p = node.p),
        under AS (SELECT tree.p[1:e] AS p, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * bytes) AS saved FROM tree, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
        SELECT tree.c AS conv_id, tree.d AS depth, par.c AS parent_conv_id, tree.n AS n_convs, tree.k AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, tree.ends AS ends_sha256
        FROM tree JOIN under ON under.p = tree.p LEFT JOIN node par ON par.p = tree.up""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, [('0x' || substr(s, 8 * i + 1, 8))::BIGINT for i in [0, 1, 2, 3]] AS h FROM d),
        c AS (SELECT *, len(us) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
              least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b FROM u),
        p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
