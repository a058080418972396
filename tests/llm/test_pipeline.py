import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm.decontam import budget, normalise
from tests.llm.common import odd_documents, prose, rows
from tests.llm.test_dedup import components, line_decisions, shingle_set
from tests.llm.test_text_ops import features, substring_distance
from tests.llm.test_tokens import best_fit_decreasing


def test_stages_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    docs = odd_documents(spark)
    spark.createDataFrame([(1, docs.where("doc_id = 3").first().text), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    now, names = docs, docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.count()
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/stage{k}.parquet")
        now = spark.read.parquet(f"{folder}/stage{k}.parquet")
        if k < 4:
            assert now.columns == names and now.count() <= before
            assert now.where("n_chars <> length(text)").count() == 0
    packed = {tuple(r) for r in now.select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert packed and packed == {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def judged(docs):
    """Quality rules by definition: (doc_id, text, source) rows to the kept rows, lines above the limit taken out."""
    norm = lambda line: tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in line).split(" ")) if line.strip(" ") else ()
    holders, hosts = defaultdict(set), defaultdict(set)
    for d, t, s in docs:
        hosts[s].add(d)
        for line in (t or "").split("\n"):
            if norm(line):
                holders[s, norm(line)].add(d)
    above = {k: min(x) for k, x in holders.items() if len(x) > 20 and len(x) > min(0.02 * len(hosts[k[0]]), 100)}
    out = []
    for d, t, s in docs:
        n, _, _, _, repeat = features(t)
        lines = (t or "").split("\n")
        left = [x for x in lines if above.get((s, norm(x)), d) == d]
        lost = sum(len(norm(x)) for x in lines) - sum(len(norm(x)) for x in left)
        if n >= 50 and 100 * repeat <= 50 * n and n - lost >= n * 0.5:
            out.append((d, "\n".join(left), s))
    return out


def stripped(docs):
    gone = line_decisions([(d, t) for d, t, _ in docs])
    out = []
    for d, t, s in docs:
        left = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        if len(left) == t.count("\n") + 1 or "".join(left).strip():
            out.append((d, "\n".join(left), s))
    return out


def single(docs):
    sets = {d: shingle_set(t) for d, t, _ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    own = components(sets, links)
    return [r for r in docs if own[r[0]] == r[0]]


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against its definition; then the packing of what is left."""
    rnd, folder = random.Random(21), str(tmp_path)
    fresh = lambda n: prose(rnd, n, 4000)
    docs = [(i, fresh(70) + "\nall of this host share this one line", "hot") for i in range(30)]
    docs += [(100 + i, "\n".join(["all of this host share this one line"] * 9 + [fresh(55)]), "hot") for i in range(3)]
    long_line = fresh(14)
    docs += [(200 + i, fresh(60) + "\n" + " ".join("other" if k == 3 + i else w for k, w in enumerate(long_line.split())) + "\nshort one " + str(i % 2), "b") for i in range(6)]
    base = fresh(80).split()
    docs += [(300 + i, " ".join(f"e{i}" if k in (20, 21)[: i % 3] else w for k, w in enumerate(base)), "c") for i in range(8)]
    item = fresh(24)
    edited = item[:40] + "XY" + item[43:]
    docs += [(400, f"{fresh(40)} {edited} {fresh(20)}", "d"), (401, f"{fresh(60)} {item.upper()}", "d"), (402, fresh(60), "d"), (403, "few words", "d"), (404, " ".join(["again and again"] * 40), "d")]
    want = docs
    now = spark.createDataFrame(docs, "doc_id long, text string, source string")
    now.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, fresh(20))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    def clean(docs):
        items = [normalise(t) for t in (item, *(r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 3").collect()))]
        return [r for r in docs if all(substring_distance(t, normalise(r[1])) > budget(len(t)) for t in items)]

    sizes = [len(docs)]
    for (_, stage), plain in zip(corpus_pipeline.STAGES, (judged, stripped, single, clean)):
        want = plain(want)
        now = stage(spark, now, folder)
        assert sorted(rows(now)) == sorted(want)
        sizes.append(len(want))
        now = spark.createDataFrame(want, now.schema)
    assert sizes[0] > sizes[1] > sizes[3] > sizes[4] and {402} <= {d for d, _, _ in want} and not {400, 401} & {d for d, _, _ in want}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t, _ in want}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in packed) == Counter(ids.keys())
    for r in packed:
        raw = b"".join(i.to_bytes(4, "little") for i in ids[r.doc_id])
        assert (r.piece, r.start, r.length, r.ids_crc32) == (0, 0, len(ids[r.doc_id]), zlib.crc32(raw))
    assert len({r.sequence_id for r in packed}) == len(best_fit_decreasing([len(x) for x in ids.values()], 2048))
