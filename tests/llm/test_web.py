import gzip
import hashlib
import io
import json
import zlib

from docloom.llm import common
from docloom.llm.html_template import CLOSE, TEXT, Page, Template, extract, main_text, path_key, template_of, templates, text_key
from docloom.llm.warc import inflated, normalise, parse_record, read_index, record, records, round_trip
from tests.llm.common import rows


def page(i, body, host="a.example"):
    return (i, f"http://{host}/p/{i}", f"<!DOCTYPE html><html><head><title>t{i}</title><script>var x='</p>';</script></head><body class='no-ads'><nav><ul><li><a href='/'>Home</a></li></ul></nav>{body}<footer>&copy; x</footer></body></html>")


def test_template_slots(spark):
    pages = [page(i, f"<div class='wrap'><div class='post'><header><h2>Title {i}</h2></header><p>Body&nbsp;text  {i} &amp; more\n words {i * 7}<br>after</p><ul><li>one {i}<li>two {i}</ul>"
                     f"<div class='comments'><p>comment {i}</p></div></div><div class='sidebar'><p>see also {i}</p></div></div><form><p>sign up</p></form>") for i in range(12)]
    odd = [(50, None, None), (51, "not a url", ""), (52, "http://b.example/", "plain text & <b>bold"), (53, "http://b.example/x", "<article><p>cut sh"), (None, "http://a.example/n", None), pages[0]]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS text", "2 AS content")
    got = {}
    for r in main_text(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id] = r.text
    assert main_text(df).count() == len(pages) + len(odd)
    for i in range(12):
        assert got[i] == f"Body text {i} & more words {i * 7} after\none {i}\ntwo {i}"
    assert (got[50], got[51], got[52], got[53], got[None]) == ("", "", "plain text & bold", "cut sh", "")
    assert rows(main_text(df.limit(0))) == []


def test_article_header_is_kept_and_parts_are_not():
    html = page(1, "<header>Site</header><article><header><h1>Head</h1></header><p>A<b>b</b>c</p><aside>no</aside><div id='comments'>no</div><p>D <!-- x --> e</p></article>")[2]
    assert extract(html, None) == "Head\nAbc\nD e"


def test_parts_and_broken_markup():
    wrap = lambda x: page(1, f"<div class='entry-header'><h1>T</h1></div><div id='main'>{x}</div>")[2]
    assert extract(wrap("<p>a <svg/> b <button>no</button><button>c</p><ol class='commentlist'><li>no</ol><div class='advert-1'>no</div>" + "<p>" + "w " * 50), None).split("\n")[-2:] == ["a b c", ("w " * 50).strip()]
    assert extract("<body><main><p>x</p></main><main><p>" + "y " * 30 + "</p></main>", None) == "x\n" + ("y " * 30).strip()
    assert extract("<div><p>one<p>two<table><tr><td>c1<td>c2</table><script>never closed <p>no", None) == "one\ntwo\nc1\nc2"
    assert extract("a < b &lt;i&gt; &#233;&eacute;&bogus; <!-- c", None) == "a < b <i> éé&bogus;"


def frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string")


def by_id(df):
    return {r.page_id: r.text for r in main_text(df).collect()}


def test_nothing_of_the_article_is_outside_the_content(spark):
    bodies = [lambda i: f"<h1>Title {i}</h1><div class='lead'>{'lead %d ' % i * 14}</div><div class='body'>{'body %d ' % i * 130}</div><div class='legal'>all rights are with us</div>",
              lambda i: f"<div><p>{'text %d ' % i * 117}</p><ul><li>{'item %d ' % i * 26}</li></ul></div>"]
    want = [lambda i: f"Title {i}\n{('lead %d ' % i * 14).strip()}\n{('body %d ' % i * 130).strip()}", lambda i: f"{('text %d ' % i * 117).strip()}\n{('item %d ' % i * 26).strip()}"]
    for k, (body, text) in enumerate(zip(bodies, want)):
        assert by_id(frame(spark, [page(i, body(i), f"h{k}.example") for i in range(12)])) == {i: text(i) for i in range(12)}
        assert extract(body(3), None).startswith(text(3))
    assert extract(page(1, "<div class='entry-header'><h1>T</h1></div><div id='main'><p>" + "w " * 50)[2], None) == "T\n" + ("w " * 50).strip()


def neutral(i):
    """A page whose names say nothing: fixed menu, notice and foot, a list of links that varies, optional parts, the text in three elements."""
    links = "".join(f"<li><a href='/{i}{k}'>see number {i} {k}</a></li>" for k in range(3 + i % 4))
    maybe = f"<div class='z1'><span>hint of the day</span></div>" if i % 3 else ""
    return f"<html><body><div class='k1'><p>Start</p><p>All topics</p></div><div class='k2'>We store data on your device.</div>{maybe}<div class='k3'><h2>Name {i}</h2><div><p>first {i} words</p><p>more words {i * 3}</p></div></div><div class='k4'><ul>{links}</ul></div><div class='k5'><p>Made by us</p></div></body></html>"


def test_template_decides_on_neutral_pages(spark):
    pages = [(i, f"http://n.example/{i}", neutral(i)) for i in range(16)]
    want = {i: f"Name {i}\nfirst {i} words\nmore words {i * 3}" for i in range(16)}
    assert by_id(frame(spark, pages)) == want
    assert all(extract(html, None) != want[i] for i, _, html in pages)
    # with an article element too: its fixed notice and list of links go by the template alone
    framed = [(i, f"http://m.example/{i}", "<main>" + neutral(i) + "</main>") for i in range(16)]
    assert by_id(frame(spark, framed)) == want


def brute_force_classes(pages):
    """Vectors of tokens told apart by ordinals where their number is constant, grouped; from the pages' events."""
    counts = []
    for html in pages:
        own = {}
        for kind, path, text, _, _ in Page(html).events:
            if kind != CLOSE:
                own[kind, path, text] = own.get((kind, path, text), 0) + 1
        counts.append(own)
    groups = {}
    for token in {t for c in counts for t in c}:
        vector = tuple(c.get(token, 0) for c in counts)
        support = sum(v > 0 for v in vector)
        if support < max(2, len(pages) / 2) or token[0] == TEXT and support < max(5, 0.6 * len(pages)):
            continue
        if len({v for v in vector if v}) == 1:
            groups.setdefault(tuple(map(bool, vector)), set()).update((token, k) for k in range(max(vector)))
        else:
            groups.setdefault(vector, set()).add((token, -1))
    return groups


def test_classes_equal_brute_force(spark):
    htmls = [neutral(i) for i in range(16)]
    df = spark.createDataFrame([(i, "h", h) for i, h in enumerate(htmls)], "page long, host string, html string")
    spec = json.loads(templates(df).first().spec)
    key = lambda t: text_key(t[1], t[2]) if t[0] == TEXT else path_key(t[1])
    names = {(key(t), k, t[0]): t for own in brute_force_classes(htmls).values() for t, k in own}
    got = {}
    for c in spec["classes"]:
        assert c["tokens"] == sorted(c["tokens"], key=c["tokens"].index) and len(c["tokens"]) > 1
        vector = {tuple(bool(v) for v in g) if not c["many"] else g for g, own in brute_force_classes(htmls).items() if any((key(t), k, t[0]) in {tuple(x) for x in c["tokens"]} for t, k in own)}
        assert len(vector) == 1  # all of one vector
        got.setdefault(vector.pop(), set()).update(names[tuple(x)] + (x[1],) for x in c["tokens"] if x[2] != CLOSE)
    assert got == {g: {t + (k,) for t, k in own} for g, own in brute_force_classes(htmls).items()}
    # nesting: every instance lies in one slot of the class around it
    template = Template(spec)
    for html in htmls:
        _, bad = template.walk(Page(html))
        assert not bad
    assert {c["support"] for c in spec["classes"]} >= {16, 10} and any(c["many"] for c in spec["classes"])
    optional = next(c for c in spec["classes"] if c["support"] == 10)
    assert optional["at"][0] == 0


def test_classes_out_of_order_or_overlapping_are_not_valid(spark):
    # two parts in either order: one of them is no delimiter; both texts stay
    swap = lambda i: "".join([f"<div class='a'><p>left {i}</p></div>", f"<div class='b'><p>right {i}</p></div>"][:: 1 if i % 2 else -1])
    df = frame(spark, [(i, "http://s.example/", f"<body><div class='t'>Top</div>{swap(i)}<div class='f'>Foot</div></body>") for i in range(12)])
    tokens = {tuple(t[:2]) for c in json.loads(templates(df.selectExpr("page_id AS page", "'h' AS host", "html")).first().spec)["classes"] for t in c["tokens"]}
    a, b = ((path_key(f"body>div.{x}"), 0) in tokens for x in "ab")
    assert not (a and b) and (path_key("body>div.t"), 0) in tokens
    assert by_id(df) == {i: "\n".join([f"left {i}", f"right {i}"][:: 1 if i % 2 else -1]) for i in range(12)}
    classes = [{"tokens": [[1, 0, 2], [2, 0, 2]], "many": 0, "support": 9, "at": (-1, -1)}, {"tokens": [[3, 0, 2], [4, 0, 2]], "many": 0, "support": 8, "at": (-1, -1)}]

    class Fake:
        events = [(TEXT, "", t, 0, False) for t in "abcd"]

    template = Template({"classes": classes, "fixed": []})
    template.place = {(text_key("", t), 0, TEXT): s for t, s in zip("abcd", ((0, 0), (1, 0), (0, 1), (1, 1)))}
    assert template.walk(Fake)[1] == {(1, -1): 1}
    assert template_of({"classes": classes, "fixed": [], "articles": []}, [{"class": 1, "token": -1, "offences": 8, "chars": 0, "linked": 0, "mass": 0}])["classes"] == classes[:1]


def test_no_markup_and_no_lost_articles():
    assert extract("<article><p>a</p><img alt='it's'><p>b</p></article>") == "a\nb"
    assert extract("<p title=\"x>one") == "one"
    assert extract("<body><form id=aspnetForm><nav>menu</nav><h1>T</h1><p>" + "w " * 60 + "</p></form><form><p>sign up</p></form>") == "T\n" + ("w " * 60).strip()
    for name in ("search-results-study", "social-history", "notice-of-meeting-minutes"):
        assert extract(f"<article><p>one</p><div class='{name}'><p>two</p></div><div class='share-buttons'>no</div></article>") == "one\ntwo"
    assert extract("<article><p>" + "w " * 9 + "</p></article><div class='comments'><p>" + "no " * 90) == ("w " * 9).strip()


def test_shuffled_templates_equal_broadcast_ones(spark, monkeypatch):
    pages = [(i, f"http://n{i % 2}.example/{i}", neutral(i)) for i in range(24)] + [(30, "http://x.example", None), (31, None, neutral(3))]
    want = by_id(frame(spark, pages))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert by_id(frame(spark, pages)) == want and len(want) == 26


def stream_of(rows_):
    return gzip.compress(b"".join(rows_))


def test_normaliser_rewrites_each_record_as_a_member():
    payloads = [b"", b"x" * 5000, b"\r\n\r\nWARC/1.1\r\n", bytes(range(256)) * 3000]
    made = [record(i, f"http://h/{i}", p, len(p), hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
    made.append(record(9, None, b"", 5000, hashlib.sha1(payloads[1]).hexdigest(), 1))
    made.append(record(None, "http://h/n", b"z", 1, hashlib.sha1(b"z").hexdigest(), None))
    for source in (stream_of(made), b"".join(gzip.compress(m) for m in made)):
        out, index = io.BytesIO(), io.BytesIO()
        assert normalise(io.BytesIO(source), out, index) == len(made)
        index.seek(0)
        places = list(read_index(index))
        assert [p[0] for p in places] == [0, 1, 2, 3, 9, None]
        for (_, at, length), raw in zip(places, made):
            assert zlib.decompress(out.getvalue()[at : at + length], 31) == raw
        assert list(records(inflated(io.BytesIO(out.getvalue())))) == made
    found = parse_record(made[4])
    assert (found["record_type"], found["refers_to"], found["payload_bytes"], found["payload"]) == ("revisit", 1, 5000, b"")


def test_round_trip(spark):
    big, small = "é" * 700, "s" * 600
    pages = [(1, "u1", big), (2, "u2", big), (7, None, big), (3, "u 3", small), (4, "u4", small), (5, "u5", None), (6, "u6", ""), (None, "u", big), (8, "u8", "y" * 300_000), (9, "u", "other " * 400), (9, "u", "other " * 400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS digest")

    def want(i, html):
        raw = (html or "").encode()
        top = max((p for p, _, h in pages if h == html and p is not None), default=i) if len(raw) >= 1000 else i
        return i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if top == i else "revisit", None if top == i else top

    assert sorted(rows(round_trip(df)), key=str) == sorted((want(i, h) for i, _, h in pages), key=str)
    assert rows(round_trip(df.limit(0))) == []
