import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from importlib import resources

import pytest

from docloom.llm import decontam, licenses, quality_lines, toxicity
from docloom.llm.decontam import Matcher, budget, decontaminate, find_leaks, normalise
from docloom.llm.licenses import NOTICES, PHRASES, Automaton, scan_licenses, scan_text, templates
from docloom.llm.quality_lines import base_features, clean_documents, judge_documents
from docloom.llm.toxicity import fit, score_documents, train
from tests.llm.common import odd_documents, prose, rows


# --- quality rules ---


def features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)})
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat


def test_base_features():
    rnd = random.Random(2)
    texts = [None, "", "a a a a", "a b c a b c", "x\nx\n\n x\n", "#<>é|é"] + [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) + "\n" * rnd.randrange(3) for _ in range(500)]
    for t in texts:
        f = base_features(t)
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == features(t), t


@pytest.mark.parametrize("listed", [True, False])
def test_lines_above_the_limit(spark, monkeypatch, listed):
    if not listed:
        monkeypatch.setattr(quality_lines, "ABOVE_LINES", 0)
    rnd = random.Random(4)
    banner = "accept all cookies on this site to go on reading now"
    docs = [(i, prose(rnd, 120, 5000) + "\n" + banner, "a") for i in range(60)]
    docs += [(100 + i, prose(rnd, 60, 5000), "a") for i in range(20)] + [(200, "\n".join([banner.upper()] * 9), "a"), (201, banner, "b"), (202, prose(rnd, 80, 5000) + "\n" + banner, "b")]
    # depleted: most of it is the banner, in copies that differ
    docs += [(300, "\n".join(banner + " " * k for k in range(8)) + "\n" + prose(rnd, 30, 5000), "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in judge_documents(df).collect()}
    assert got[0].n_removed_words == 0 and got[1].n_removed_words == 11 and got[1].kept
    assert not got[201].kept and got[202].kept and got[202].n_removed_words == 0
    assert got[300].n_removed_words == 88 and not got[300].kept
    clean = {r.doc_id: r.text for r in clean_documents(df).collect()}
    assert set(clean) == {d for d, r in got.items() if r.kept}
    assert banner in clean[0] and banner not in clean[1] and banner in clean[202]


def test_a_hot_host_has_the_same_limit(spark, monkeypatch):
    """A line in a hundredth of a host's documents is above the limit once it is in MAX_LINE_DOCS of them."""
    monkeypatch.setattr(quality_lines, "MAX_LINE_DOCS", 30)
    rnd = random.Random(14)
    docs = [(i, prose(rnd, 60, 5000) + ("\nshared by some of the many" if i % 100 == 0 else "\nshared by few of the many" if i % 160 == 0 else ""), "hot") for i in range(4000)]
    got = {r.doc_id: r for r in judge_documents(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("doc_id % 100 = 0 OR doc_id % 160 = 0").collect()}
    assert [d for d, r in got.items() if r.n_removed_words] == [d for d in got if d % 100 == 0 and d]
    assert got[160].n_removed_words == 0


def test_quality_of_odd_rows(spark, monkeypatch):
    docs = odd_documents(spark)
    got = judge_documents(docs)
    assert got.count() == docs.count()
    by_id = dict(rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text")))
    for r in got.collect():
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == features(by_id[r.doc_id])
    assert clean_documents(docs).columns == docs.columns
    assert clean_documents(docs).count() == got.where("kept").count()
    monkeypatch.setattr(quality_lines, "ABOVE_LINES", -1)
    assert clean_documents(docs).count() == got.where("kept").count()
    assert rows(judge_documents(docs.limit(0))) == [] and rows(clean_documents(docs.limit(0))) == []


# --- toxicity ---


def bags(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        s = [prose(rnd, 8) for _ in range(rnd.randrange(1, 20))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(2):
                s[rnd.randrange(len(s))] += " " + rnd.choice(("vile", "nastyness", "nastyfoo", "nastybar"))
        out.append((". ".join(s), int(bad)))
    return out


def test_noisy_or_finds_documents_and_sentences():
    train_rows, test_rows = bags(1500, 1), bags(600, 2)
    model = fit([t for t, _ in train_rows], [y for _, y in train_rows])
    right = sum((model.score(t)[0] >= 0.5) == bool(y) for t, y in test_rows)
    assert right > 0.97 * len(test_rows)
    score, at = model.score("w1 w2 w3. a vile w4 nastynew. w5 w6")
    assert score > 0.5 and at == 1
    assert 0 <= model.score(None)[0] < 0.5 and model.score("")[0] == model.score(None)[0]


def test_every_toxic_sentence_is_named(spark):
    found = bags(1500, 1)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(found)] + [(5000, "w1 vile w2. w3 w4! nastybar w5\nw6 w7. w8 vile"), (5001, "w1 w2. w3"), (5002, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(found)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_documents(docs, train(docs, labels)).where("doc_id >= 5000").collect()}
    assert [x.sentence for x in got[5000].toxic_sentences] == [0, 2, 4] and all(0.5 <= x.score <= 1 for x in got[5000].toxic_sentences)
    assert got[5000].worst_sentence in (0, 2, 4) and got[5001].toxic_sentences == [] == got[5002].toxic_sentences
    # every sentence is toxic where every label is
    sure = score_documents(docs, train(docs, labels.where("toxic = 1"))).where("doc_id = 5001").first()
    assert [x.sentence for x in sure.toxic_sentences] == [0, 1]


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    out = score_documents(docs, train(docs, labels))
    assert out.count() == docs.count()
    for r in out.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    for some in (labels.limit(0), labels.where("toxic = 1")):
        assert score_documents(docs, train(docs, some)).count() == docs.count()
    assert rows(score_documents(docs.limit(0), train(docs, labels))) == []


def test_training_sample_is_bounded(spark, monkeypatch):
    found = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: found.append(texts))
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(20) for _ in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    train(docs, labels, sample_docs=3)
    train(docs, labels, sample_bytes=550)
    assert list(map(len, found)) == [3, 5]


# --- licences ---


def test_automaton_gives_matching_statistics():
    rnd = random.Random(7)
    templates = [("t", " ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12)))) for _ in range(5)]
    machine = Automaton(templates, {"a b": "x", "c": "y"})
    words = [[w.decode() for w in t.encode().split()] for t in [x for _, x in templates] + ["a b", "c"]]
    for _ in range(200):
        text = [rnd.choice("abcz") for _ in range(rnd.randrange(30))]
        matches, found = machine.stream([w.encode() for w in text])

        def longest(end):
            return max((k for k in range(end + 1) if any(w[i : i + k] == text[end - k : end] for w in words for i in range(len(w) - k + 1))), default=0)

        best = [longest(e) for e in range(len(text) + 1)]
        want = {(e - best[e], e) for e in range(1, len(text) + 1) if best[e] > 1 and (e == len(text) or best[e + 1] != best[e] + 1)}
        assert {(a, b) for a, b, _ in matches} == want
        places = {(i, i + len(p)) for p in (["a", "b"], ["c"]) for i in range(len(text)) if text[i : i + len(p)] == p}
        assert {(a, b) for a, b, _ in found} == places and len(found) == len(places)


def test_chains_equal_brute_force(monkeypatch):
    """The best chain of one template's matches, over all subsets of them."""
    rnd, seen = random.Random(12), 0
    monkeypatch.setattr(licenses, "MIN_MATCH", 2)
    monkeypatch.setattr(licenses, "MAX_GAP", 3)
    monkeypatch.setattr(licenses, "MIN_COVER", 0.5)
    for _ in range(400):
        template = [rnd.choice("abcdef") for _ in range(rnd.randrange(4, 9))]
        machine = Automaton([("t", " ".join(template))], {})
        text = [w for w in template * 2 if rnd.random() < 0.8]
        for _ in range(rnd.randrange(3)):
            text.insert(rnd.randrange(len(text) + 1), rnd.choice("abcdefz"))
        matches, _ = machine.stream([w.encode() for w in text])
        own = sorted((a, b, e - (b - a), e) for a, b, state in matches for _, e in machine.ends[state] if b - a >= 2)
        best = 0
        for k in range(1, len(own) + 1) if len(own) <= 9 else ():
            for chain in itertools.combinations(own, k):
                fits = all(y[0] - x[1] <= 3 and x[1] <= y[0] + 2 and x[3] <= y[3] and x[2] < y[2] and x[0] < y[0] for x, y in itertools.pairwise(chain))
                if fits:
                    best = max(best, sum(y[3] - max(y[2], x[3]) for x, y in itertools.pairwise(chain)) + chain[0][3] - chain[0][2])
        if len(own) <= 9:
            found = max((s[3] for s in machine.spans([w.encode() for w in text], matches)), default=0)
            assert found == (min(1.0, best / len(template)) if best >= 0.5 * len(template) else 0), (template, text)
            seen += best > 0
    assert seen > 200


def test_licence_labels():
    r = scan_text("Intro. All RIGHTS, reserved! cc-by and cc by; x General Public License")
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 1, 10, "cc-by,gpl,reserved")
    mit = next(t for label, t in NOTICES if label == "mit")
    edited = mit.replace("free of charge", "for free").replace("sublicense, ", "")
    r = scan_text("foo bar " + edited + " the end")
    assert r["labels"] == "mit" and 0.6 <= r["score"] < 1 and r["base_labels"] == ""
    assert scan_text("the license of the software")["labels"] == ""
    for label, t in templates():
        r = scan_text(t)
        assert r["score"] == 1.0 and label in r["labels"].split(","), label
    assert scan_text(None) == scan_text("") and scan_text("")["score"] == 0.0


def test_full_texts_are_told_apart():
    """Each licence's own text, whole and with one word in twenty changed, gets its label and no other's."""
    rnd = random.Random(13)
    full = templates()[: len(list((resources.files("docloom.llm") / "licence_texts").iterdir()))]
    assert len(full) >= 30 and len({label for label, _ in full}) == len(full)
    for label, t in full:
        changed = " ".join(f"x{rnd.randrange(99)}" if rnd.random() < 0.05 else w for w in t.split())
        for text in (t, changed):
            assert {s["label"] for s in scan_text(f"before {text} after")["spans"]} == {label}
    both = full[0][1] + " and " + full[1][1]
    assert [s["label"] for s in scan_text(both)["spans"]] == [full[0][0], full[1][0]]


def test_licences_of_odd_rows(spark):
    docs = odd_documents(spark)
    out = scan_licenses(docs)
    assert out.count() == docs.count() and rows(scan_licenses(docs.limit(0))) == []
    text = dict(rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text")))
    for r in out.where("doc_id IS NOT NULL").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text[r.doc_id] or ""))
        assert r.n_words == len(words)
        assert r.n_base == sum(words[i : i + len(p.split())] == p.split() for p in PHRASES for i in range(len(words)))


# --- decontamination ---


def substring_distance(a, b):
    row = [0] * (len(b) + 1)
    for x, ca in enumerate(a, 1):
        new = [x]
        for y, cb in enumerate(b, 1):
            new.append(min(row[y] + 1, new[y - 1] + 1, row[y - 1] + (ca != cb)))
        row = new
    return min(row)


def test_every_passage_within_the_budget_is_found():
    rnd = random.Random(9)
    items = [(i, normalise(prose(rnd, rnd.randrange(8, 40), 5000))) for i in range(12)]
    m = Matcher(items)
    for _ in range(300):
        i, t = rnd.choice(items)
        s = list(t)
        for _ in range(rnd.randrange(0, budget(len(t)) + 4)):
            p, how = rnd.randrange(len(s)), rnd.randrange(3)
            if how == 0:
                s[p] = rnd.choice("w123 x")
            elif how == 1:
                del s[p]
            else:
                s.insert(p, rnd.choice("w123 x"))
        text = normalise(prose(rnd, 20, 5000) + " " + "".join(s) + " " + prose(rnd, 9, 5000))
        d = substring_distance(t, text)
        found = {x: k for x, k, _ in m.match(text)}
        assert (i in found) == (d <= budget(len(t))) and found.get(i, d) == d


@pytest.mark.parametrize("block_chars", [None, 150])
def test_leaks_of_odd_rows(spark, monkeypatch, block_chars):
    if block_chars:  # several blocks of items
        monkeypatch.setattr(decontam, "BLOCK_CHARS", block_chars)
    docs = odd_documents(spark)
    texts = rows(docs.select("doc_id", "text"))
    long = [t for _, t in texts[:30] if len(t.split()) > 50]
    items = [(1, " ".join(long[0].split()[:30]).upper()), (2, None), (3, ""), (4, "one"), (None, long[1]), (6, long[1]), (7, "nowhere to be found in any of these documents")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(set)
    for r in find_leaks(docs, bench).collect():
        got[r.item_id].add(r.doc_id)
    norm = [(d, normalise(t)[:3000]) for d, t in texts]  # the long texts hold none
    dirty = [False] * len(norm)
    for item, t in items:
        short = t is not None and len(normalise(t)) < 24
        hit = [t and (t in x.split() if short else substring_distance(normalise(t), x) <= budget(len(normalise(t)))) for _, x in norm]
        dirty = [a or bool(b) for a, b in zip(dirty, hit)]
        assert got[item] == {d for (d, _), h in zip(norm, hit) if h}, item
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=str) == sorted((d for (d, _), h in zip(norm, dirty) if not h), key=str)
    assert rows(find_leaks(docs, bench.limit(0))) == [] and decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert rows(find_leaks(docs.limit(0), bench)) == []
