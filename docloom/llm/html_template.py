"""Main text of web pages by equivalence-class template deduction.

1. Tokens. A page is read as a sequence of tokens: the beginning and end of each block element, named by its path of elements
   with their classes, and its text blocks (path and hash of the text). An occurrence vector says how often a token is on each of the
   distinct pages of its host; vectors are compared by hashes that add up page by page, so that none is ever gathered.
2. Classes. Tokens in MIN_SUPPORT of the pages (texts: TEXT_SUPPORT) with equal vectors make a class. A token that comes a constant number
   of times a page is told apart by its ordinal first, as each of its occurrences has a role of its own. Tokens of one vector that lie in
   different elements of other classes are classes of their own.
3. Validity. Each page tests the classes of its host: the tokens of a class must come in one order (repeated as a whole,
   if it comes several times), and an instance of a class must lie between two tokens of the class around it. Tokens that
   break the order, and classes that overlap others of higher support, on more than TOLERANCE of their pages aren't valid and go.
4. Template. Valid classes nest: a slot is what lies between two following tokens of a class, outside the classes
   nested there. Texts that are tokens are fixed text. Of each slot the host's variable characters are counted, and those linked.
5. Extraction. A page's text blocks are those in its slots, except slots that are LINK_SHARE linked over the host (menus, lists
   of links). Fixed text is no slot's content and goes with the template.

What structure can't tell is left to names: text in parts named as adverts, comments, menus and so on is left out, and if
an only `article` or `main` element of the template holds ARTICLE_SHARE of the slots' unlinked text, other slots go. Hosts of fewer than
MIN_PAGES distinct pages share one template, deduced from all of them. Without a template (or the template's article), a page is taken by
its own only article, or the smallest element that holds all of its unlinked text.

Defined cases: a null or empty html gives an empty text; a null or unreadable url is a host of its own; markup that is cut short or
wrongly nested is read as far as it goes; a quote without an end is no quote; equal pages of a host count once for the template, and each
row gives its text; other columns are not returned.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docloom.llm.common import cut, join_blobs, key_side, slices

MIN_PAGES = 4
MIN_SUPPORT = 0.5
ARTICLE_SHARE = 0.3
#: A text block can be of the template if it is in this share of a host's distinct pages, of MIN_TEXT_PAGES at least.
TEXT_SUPPORT = 0.6
MIN_TEXT_PAGES = 5
#: Share of its pages on which a token may be out of order, or a class overlap another.
TOLERANCE = 0.05
#: A slot of which so much is linked is no content, unless it holds most of the text that isn't.
LINK_SHARE = 0.6
#: A form, or a part around a heading or an article, with this share of the page's text isn't a part of it but all of it.
WHOLE_SHARE = 0.5

# Kinds of elements, and names of parts that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noscript template iframe".split())
#: As RAW, if their end is there.
DROPPED = frozenset("svg math object select button canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARTS = frozenset("nav footer aside form menu dialog head".split())
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsored sponsor promo banner cookie cookies consent gdpr notice notices notification sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies reply related recommended share sharing social newsletter subscribe signup login popup modal overlay widget widgets pagination pager search".split())
#: Words that say nothing beside a mark: a name is that of a part if all of its words are marks or these.
PLAIN = frozenset("site page main top bottom left right center primary secondary global inner outer wrap wrapper container box block area section list item items bar row col column panel group links link buttons button icons icon posts post articles article stories content box text form field title head heading js is has no the of and by to id x s m l xs sm md lg xl".split())
MARK_STEMS = ("comment", "advert", "sponsor", "cookie", "sidebar", "breadcrumb", "newsletter", "navbar", "subscri")
HEADER_MARKS = frozenset("header masthead topbar".split())
#: Names that make a header that of the article.
ARTICLE_MARKS = frozenset("entry post article content story".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu".split())
NEVER_PARTS = frozenset("html body article main".split())
#: An opening tag closes open elements of its own kind among these, down to the container given.
CLOSES = {"li": ("li", "ul ol menu"), "p": ("p", ""), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr"), "th": ("td th", "tr")}

#: Quotes hold a ">" only as values, after "="; a value without an end is no value.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z]+")

OPEN, CLOSE, TEXT = range(3)


def _marked(name: str) -> bool:
    """Whether a class or id is that of a part: all of its words are marks or say nothing, and one is a mark."""
    words = _NAME.findall(name)
    marks = [w in MARKS or w.startswith(MARK_STEMS) for w in words]
    return any(marks) and all(m or w in PLAIN for m, w in zip(marks, words))


@lru_cache(20_000)
def _element(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(role, whether it is no part of an article, whether it is so outside an article only) of an opening tag."""
    if not attributes.strip():
        return name, name in PARTS, name == "header"
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(_NAME.findall(named))
    classes = ".".join(sorted(re.sub(r"\d+", "0", found.get("class", "").lower()).split()))
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    part = name in PARTS or any(map(_marked, named.split())) or found.get("role", "").lower() in ROLES or hidden
    # pages give these classes of their own
    role = f"{name}.{classes}" if classes and name not in NEVER_PARTS else name
    return role, part and name not in NEVER_PARTS, (name == "header" or bool(words & HEADER_MARKS)) and name not in NEVER_PARTS and not words & ARTICLE_MARKS


@lru_cache(50_000)
def path_key(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path.encode("utf-8", "replace")) - (1 << 63)


def text_key(path: str, text: str) -> int:
    return path_key.__wrapped__(f"{path}\n{text}")


class Page:
    """events: tokens in page order, (kind, path, text, linked characters, in a part that is no article)."""

    def __init__(self, source: str | None):
        self.events: list[tuple[int, str, str, int, bool]] = []
        #: (name, path, innermost part, in an article)
        self._open: list[tuple[str, str, int, bool]] = []
        #: part around it, a form, holds a heading or an article, unlinked characters
        self._parts: list[list] = []
        self._text: list[str] = []
        self._linked = self._anchors = 0
        if source:
            self._read(source)
            self._judge()

    def _flush(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                _, path, part, _ = self._open[-1] if self._open else ("", "", -1, False)
                self.events.append((TEXT, path, text, min(self._linked, len(text)), part))
        self._linked = 0

    def _shut(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        self.events += [(CLOSE, path, "", 0, False) for _, path, _, _ in reversed(self._open[i:])]
        del self._open[i:]

    def _close(self, names: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] in names:
                return self._shut(i)
            if self._open[i][0] in stops:
                return None

    def _read(self, source: str) -> None:
        at, find = 0, _TAG.search
        while m := find(source, at):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK:
                    self._flush()
                    self._close((name,))
                elif name == "a":
                    self._anchors = 0
            elif name in RAW or name in DROPPED:
                self._add(" ")
                if not m[3].endswith("/") or name in RAW and name not in ("iframe", "template"):
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source) if name in RAW else at
            elif name == "br":
                self._add(" ")
            elif name in BLOCK:
                self._begin(name, m[3])
            elif name == "a":
                self._anchors = 1
        if at < len(source):
            self._add(source[at:])
        self._flush()
        self._shut(0)

    def _begin(self, name: str, attributes: str) -> None:
        self._flush()
        if name in CLOSES:
            kinds, stops = CLOSES[name]
            self._close(tuple(kinds.split()), tuple(stops.split()))
        elif self._open and self._open[-1][0] == "p":
            self._shut(len(self._open) - 1)
        role, part, header = _element(name, attributes)
        _, path, within, inside = self._open[-1] if self._open else ("", "", -1, False)
        if name in ("article", "main", "h1"):
            k = within
            while k >= 0:
                self._parts[k][2] = True
                k = self._parts[k][0]
        inside = inside or name in ("article", "main")
        path = f"{path}>{role}" if path else role
        self.events.append((OPEN, path, "", 0, False))
        if part or header and not inside:
            self._parts.append([within, name == "form", False, 0])
            within = len(self._parts) - 1
        self._open.append((name, path, within, inside))
        if name in VOID or attributes.endswith("/"):
            self._shut(len(self._open) - 1)

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._anchors:
            self._linked += len(text.strip())

    def _judge(self) -> None:
        """Turns each text's innermost part into whether it is in any; a part that holds the page isn't one."""
        if not self._parts:
            self.events = [e if e[0] != TEXT else (*e[:4], False) for e in self.events]
            return
        total = 0
        for kind, _, text, linked, part in self.events:
            if kind == TEXT:
                total += len(text) - linked
                while part >= 0:
                    self._parts[part][3] += len(text) - linked
                    part = self._parts[part][0]
        out = []
        for around, form, holds, mass in self._parts:
            whole = (form or holds) and mass >= WHOLE_SHARE * total > 0
            out.append(not whole or around >= 0 and out[around])
        self.events = [e if e[0] != TEXT else (*e[:4], e[4] >= 0 and out[e[4]]) for e in self.events]

    @property
    def blocks(self) -> list[tuple[str, str, int, bool]]:
        return [e[1:] for e in self.events if e[0] == TEXT]

    def masses(self) -> dict[str, int]:
        """Characters of unlinked text outside parts, under each path; all of them under the empty one."""
        out: dict[str, int] = {}
        for path, text, linked, excluded in self.blocks:
            if not excluded and (n := len(text) - linked) > 0:
                while path:
                    out[path] = out.get(path, 0) + n
                    path = path.rpartition(">")[0]
                out[""] = out.get("", 0) + n
        return out

    def own_content(self) -> str:
        """The page's only article or main element; else the smallest single element that holds all of its mass."""
        count = {"": 1}
        for kind, path, *_ in self.events:
            if kind == OPEN:
                count[path] = count.get(path, 0) + 1
        mass = {p: n for p, n in self.masses().items() if count[p] == 1}
        total = mass.get("", 0)
        for name in ("article", "main"):
            named = [p for p in mass if p.rpartition(">")[2] == name]
            if len(named) == 1 and mass[named[0]] >= ARTICLE_SHARE * total:
                return named[0]
        return max((p for p, n in mass.items() if p and n == total > 0), key=lambda p: p.count(">"), default="")


class Template:
    """Classes of a host as tokens [key, ordinal (-1: any), kind], with what is known of their slots.

    spec: classes, each {tokens, many, support, at: the slot around it}; fixed: keys of text that is a token; drop: slots that are no
    content; region: key of the article, or 0.
    """

    def __init__(self, spec: dict):
        self.classes = spec["classes"]
        self.fixed = frozenset(spec["fixed"])
        self.drop = {tuple(s) for s in spec.get("drop", ())}
        self.region = spec.get("region", 0)
        self.place = {(k, o, kind): (c, i) for c, x in enumerate(self.classes) for i, (k, o, kind) in enumerate(x["tokens"])}
        self.loose = {(k, kind) for k, o, kind in self.place if o < 0}

    def walk(self, page: Page) -> tuple[list[tuple[int, int] | None], dict[tuple[int, int], int]]:
        """The slot of each event (texts outside classes: (-1, -1); other events: null), and offences: (class, token, or -1 for all of it)."""
        seen: dict[tuple[int, int], int] = {}
        found: list[tuple[int, int] | None] = []
        order: dict[int, list[int]] = {}
        for kind, path, text, _, _ in page.events:
            key = text_key(path, text) if kind == TEXT else path_key(path)
            if (key, kind) in self.loose:
                spot = self.place[key, -1, kind]
            else:
                n = seen[key, kind] = seen.get((key, kind), -1) + 1
                spot = self.place.get((key, n, kind))
            found.append(spot)
            if spot:
                order.setdefault(spot[0], []).append(spot[1])
        bad: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, int]] = {}
        for c, own in order.items():
            size = len(self.classes[c]["tokens"])
            if self.classes[c]["many"]:
                if len(own) % size or any(i != k % size for k, i in enumerate(own)):
                    bad[c, -1] = 1
            elif any(b <= a for a, b in zip(own, own[1:])):
                ordered = set(longest_increasing(own))
                bad |= {(c, i): 1 for i in own if i not in ordered}
                own = sorted(ordered)
            ends[c] = own[0], own[-1]
        slots: list[tuple[int, int] | None] = []
        stack: list[list[int]] = []
        for spot, event in zip(found, page.events):
            if spot and (spot[0], -1) not in bad and spot not in bad:
                c, i = spot
                first, last = (0, len(self.classes[c]["tokens"]) - 1) if self.classes[c]["many"] else ends[c]
                if i == first:
                    stack.append([c, i])
                elif any(s[0] == c for s in stack):
                    # what still is open above it doesn't end within its slot: one of the two overlaps the other
                    while stack[-1][0] != c:
                        over = stack[-1][0]
                        if (self.classes[over]["support"], -over) > (self.classes[c]["support"], -c):
                            bad[c, -1] = 1
                            stack = [s for s in stack if s[0] != c]
                            break
                        bad[over, -1] = 1
                        stack.pop()
                    else:
                        stack[-1][1] = i
                if i == last and stack and stack[-1][0] == c:
                    stack.pop()
            if event[0] == TEXT:
                slots.append(tuple(stack[-1]) if stack else (-1, -1))
            else:
                slots.append(None)
        return slots, bad

    def measure(self, page: Page) -> dict[tuple[int, int], list[int]]:
        """(class, token) -> [offences, variable characters of the slot after it, linked ones, unlinked ones outside named parts]."""
        slots, bad = self.walk(page)
        out = {spot: [1, 0, 0, 0] for spot in bad}
        for slot, (kind, path, text, linked, part) in zip(slots, page.events):
            if kind == TEXT and text_key(path, text) not in self.fixed:
                # a title that is a link is a title
                linked = 0 if path.endswith((">h1", ">h2")) else linked
                own = out.setdefault(slot, [0, 0, 0, 0])
                own[1] += len(text)
                own[2] += linked
                own[3] += 0 if part else len(text) - linked
        return out

    def extract(self, page: Page) -> str:
        slots, _ = self.walk(page)
        keys = {path_key(e[1]) for e in page.events if e[0] == OPEN} if self.region else ()
        own = page.own_content() if self.region and self.region not in keys else ""
        inside = 0 if self.region or own else 1
        out = []
        for slot, (kind, path, text, _, part) in zip(slots, page.events):
            if kind == TEXT:
                if inside and not part and slot not in self.drop and text_key(path, text) not in self.fixed:
                    out.append(text)
            elif path == own if own else self.region and path_key(path) == self.region:
                inside += 1 if kind == OPEN else -1
        return "\n".join(out)


def longest_increasing(xs: list[int]) -> list[int]:
    """A longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = []
    for k, x in enumerate(xs):
        i = bisect_left(tails, x)
        tails[i : i + 1] = [x]
        at[i : i + 1] = [k]
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(xs[k])
        k = back[k]
    return out[::-1]


def extract(source: str | None, template: Template | None = None) -> str:
    """The text of the template's slots; without a template, of the page's own content element."""
    page = Page(source)
    if template is not None:
        return template.extract(page)
    content = page.own_content()
    inside = content + ">"
    return "\n".join(t for path, t, _, out in page.blocks if not out and (not content or path == content or path.startswith(inside)))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, html) to a row for each occurrence of a token: its key and ordinal, the element around it, its times and places."""
    names = ["host", "page", "key", "ordinal", "around", "text", "article", "times", "place", "finish"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64()]
    for batch in slices(batches):
        rows = []
        for page_id, host, source in zip(*(c.to_pylist() for c in batch.columns)):
            found: dict[tuple[int, bool], list[list]] = {}
            for place, (kind, path, text, _, _) in enumerate(Page(source).events):
                if kind == TEXT:
                    found.setdefault((text_key(path, text), True), []).append([path_key(path), False, place, place])
                elif kind == OPEN:
                    around, _, role = path.rpartition(">")
                    found.setdefault((path_key(path), False), []).append([path_key(around), role in ("article", "main"), place, place])
                else:
                    # ends come in the order of the beginnings, as no path is inside itself
                    next(x for x in found[path_key(path), False] if x[2] == x[3])[3] = place
            rows += [(host, page_id, key, k, x[0], is_text, x[1], len(own), x[2], x[3]) for (key, is_text), own in found.items() for k, x in enumerate(own)]
        cols = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def classes_of(pages: int, tokens: list[dict]) -> dict:
    """The candidate classes of a host from the counts of its frequent tokens; see Template."""
    elements = {t["key"]: t for t in tokens if not t["text"] and t["ordinal"] == 0}
    groups: dict[int, tuple] = {}  # token -> its vector
    members: list[tuple[tuple, dict]] = []
    for t in tokens:
        if t["text"] and t["support"] < max(MIN_TEXT_PAGES, TEXT_SUPPORT * pages):
            continue
        constant = t["least"] == t["most"]
        if constant or t["ordinal"] == 0:
            vector = (t["support"], t["pages_vector"], False) if constant else (t["support"], t["vector"], True)
            members.append((vector, t))
            if not t["text"] and t["ordinal"] == 0:
                groups[t["key"]] = vector

    def holder(vector: tuple, t: dict) -> int:
        """The nearest element around it that is of another vector."""
        key = t["around"]
        while key in elements and groups.get(key, vector) == vector:
            key = elements[key]["around"]
        return key if key in elements else 0

    grouped: dict[tuple, list[dict]] = {}
    for vector, t in members:
        grouped.setdefault((vector, holder(vector, t)), []).append(t)
    out, articles = [], []
    for (vector, around), own in sorted(grouped.items(), key=lambda x: (-x[0][0][0], str(x[0]))):
        spots = []
        for t in own:
            ordinal = -1 if vector[2] else t["ordinal"]
            mean = t["places"] / t["support"], t["finishes"] / t["support"]
            spots.append((mean[0], [t["key"], ordinal, TEXT if t["text"] else OPEN]))
            if not t["text"]:
                spots.append((mean[1], [t["key"], ordinal, CLOSE]))
                if t["article"] and t["most"] == 1:
                    articles.append(t["key"])
        if len(spots) > 1:
            spots.sort()
            out.append({"tokens": [s for _, s in spots], "many": int(vector[2]), "support": vector[0], "around": around})
    place = {k: (c, i) for c, x in reversed(list(enumerate(out))) for i, (k, o, kind) in reversed(list(enumerate(x["tokens"]))) if kind == OPEN and o <= 0}
    for x in out:
        x["at"] = place.get(x.pop("around"), (-1, -1))
    return {"classes": out, "fixed": [t["key"] for _, t in members if t["text"]], "articles": articles}


def template_of(spec: dict, stats: list[dict]) -> dict:
    """The valid classes, the slots that are no content, and the article's element."""
    classes, offences = spec["classes"], {(s["class"], s["token"]): s["offences"] for s in stats}
    valid = []
    for c, x in enumerate(classes):
        most = TOLERANCE * x["support"]
        left = [] if offences.get((c, -1), 0) > most else [i for i in range(len(x["tokens"])) if offences.get((c, i), 0) <= most]
        valid.append(left if len(left) > 1 else [])

    def settle(slot: tuple[int, int]) -> tuple[int, int]:
        """The slot that a slot falls into without what isn't valid."""
        c, i = slot
        while c >= 0:
            kept = [k for k in valid[c] if k <= i]
            if kept:
                return c, kept[-1]
            c, i = classes[c]["at"]
        return -1, -1

    slots: dict[tuple[int, int], list[int]] = {}
    for s in stats:
        if s["token"] >= 0 or s["class"] < 0:
            own = slots.setdefault(settle((s["class"], s["token"])), [0, 0, 0])
            for k, name in enumerate(("chars", "linked", "mass")):
                own[k] += s[name]
    plain, mass = sum(x[0] - x[1] for x in slots.values()), sum(x[2] for x in slots.values())
    linked = {s for s, (n, k, _) in slots.items() if k > LINK_SHARE * n and 2 * (n - k) < plain}

    def within(slot: tuple[int, int], c: int, first: int, last: int) -> bool:
        while slot[0] >= 0:
            if slot[0] == c:
                return first <= slot[1] < last
            slot = settle(tuple(classes[slot[0]]["at"]))
        return False

    region = 0
    if len(spec["articles"]) == 1:
        key = spec["articles"][0]
        spots = [(c, i) for c in range(len(classes)) for i in valid[c] if classes[c]["tokens"][i][0] == key]
        if len(spots) == 2 and sum(x[2] for s, x in slots.items() if within(s, spots[0][0], spots[0][1], spots[1][1])) >= ARTICLE_SHARE * mass > 0:
            region = key
    number = {c: n for n, c in enumerate(c for c in range(len(classes)) if valid[c])}
    place = {(c, i): (number[c], valid[c].index(i)) for c in number for i in valid[c]} | {(-1, -1): (-1, -1)}
    kept = [{**classes[c], "tokens": [classes[c]["tokens"][i] for i in valid[c]], "at": place[settle(tuple(classes[c]["at"]))]} for c in number]
    return {"classes": kept, "fixed": spec["fixed"], "drop": sorted(place[s] for s in linked), "region": region}


@lru_cache(500)
def _loaded(spec: str) -> Template:
    return Template(json.loads(spec))


def _per_host(df: DataFrame, fn) -> DataFrame:
    """(host, value, rows) to (host, spec), spec being fn(value, rows) as JSON; a host's rows are bounded by what a page holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                value, rows = batch.column(1)[at].as_py(), batch.column(2)[at].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([json.dumps(fn(value, rows), separators=(",", ":"))])], names=["host", "spec"])

    return df.mapInArrow(run, "host string, spec string")


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, spec) to sums of what pages measure: host, class, token, offences, chars, linked, mass."""
    names = ["host", "class", "token", "offences", "chars", "linked", "mass"]
    for batch in slices(batches):
        sums: dict[tuple, list[int]] = {}
        for host, source, spec in _rows(batch):
            if spec:
                for spot, own in _loaded(spec).measure(Page(source)).items():
                    old = sums.setdefault((host, *spot), [0] * 4)
                    for k, n in enumerate(own):
                        old[k] += n
        cols = list(zip(*((*k, *v) for k, v in sums.items()))) or [()] * len(names)
        types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch whose last column has few values, which are made Python objects once."""
    last = batch.columns[-1].dictionary_encode()
    values = last.dictionary.to_pylist()
    specs = [None if i is None else values[i] for i in last.indices.to_pylist()]
    return zip(*(c.to_pylist() for c in batch.columns[:-1]), specs)


def templates(pages: DataFrame) -> DataFrame:
    """host and spec (JSON, see Template) from pages(page, host, html) that are distinct in each host."""
    tokens = pages.select("page", "host", "html").mapInArrow(_tokens, "host string, page long, key long, ordinal int, around long, text boolean, article boolean, times int, place long, finish long")
    counted = tokens.groupBy("host", "key", "ordinal", "text").agg(
        F.count("*").alias("support"), F.min("times").alias("least"), F.max("times").alias("most"), F.bit_xor(F.xxhash64("page")).alias("pages_vector"),
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.sum("place").alias("places"), F.sum("finish").alias("finishes"), F.min("around").alias("around"), F.max("article").alias("article"),
    ).where("support > 1")
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    # tokens in MIN_SUPPORT of the pages: at most 1 / MIN_SUPPORT times those of a page
    frequent = counted.join(sizes, "host").where(F.col("support") >= F.col("pages") * F.lit(MIN_SUPPORT))
    fields = ["key", "ordinal", "text", "support", "least", "most", "pages_vector", "vector", "places", "finishes", "around", "article"]
    gathered = frequent.groupBy("host", "pages").agg(F.collect_list(F.struct(*fields)).alias("tokens"))
    candidates = cut(_per_host(gathered.select("host", "pages", "tokens"), classes_of))
    measured = join_blobs(pages.select("host", "html"), candidates, "host", "spec").mapInArrow(_measures, "host string, class int, token int, offences long, chars long, linked long, mass long")
    stats = measured.groupBy("host", "class", "token").agg(*[F.sum(c).alias(c) for c in ("offences", "chars", "linked", "mass")])
    stats = stats.groupBy("host").agg(F.collect_list(F.struct("class", "token", "offences", "chars", "linked", "mass")).alias("stats"))
    return _per_host(candidates.join(stats, "host").select("host", "spec", "stats"), lambda spec, rows: template_of(json.loads(spec), rows))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    # the hash of the page stands for it in the vectors
    hosted = pages.select("page_id", "url", "html", F.when(host == "", "?").otherwise(host).alias("host"), F.xxhash64("html").alias("page"))
    known = hosted.where("html IS NOT NULL")
    groups = cut(known.groupBy("host", "page").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")))
    small = groups.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") < MIN_PAGES).select("host", F.lit("").alias("pool"))
    small = key_side(cut(small))
    pooled = hosted.join(small, "host", "left").withColumn("host", F.coalesce("pool", "host")).drop("pool")
    # of equal pages of a host one counts; most have no copy
    copied = key_side(cut(groups.where("copies > 1").join(small, "host", "left").select(F.coalesce("pool", "host").alias("host"), "page", "first")))
    reps = pooled.where("html IS NOT NULL").join(copied, ["host", "page"], "left").where("first IS NULL OR page_id = first")
    found = cut(templates(reps.select("page", "host", "html")))
    joined = join_blobs(pooled.select("page_id", "url", "host", "html"), found, "host", "spec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(source, _loaded(spec) if spec else None) for _, source, spec in _rows(batch.select(["host", "html", "spec"]))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "spec").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
