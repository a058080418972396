"""Character sets of bytes, and their text, as column expressions.

A byte order mark decides, else valid UTF-8, else the places of NUL bytes (UTF-16 and UTF-32 without a mark), else the likelihood of neighbours: under
each 8-bit set every byte is a letter of some script and case, a sign, or undefined, and pairs of kinds have weights, so that a set under
which capitals follow small letters, scripts meet within a word, or signs stand inside words, loses. The kinds are made by rule from the
sets' own tables; a text is mapped to its kinds by one `translate` for each set, and pairs are counted by regular expressions, once
in each distinct word. Among ASCII letters, words of two or three letters beyond ASCII ("ää", "Éê") say nothing of the script, and longer ones are weighed against those letters.

Bytes that none of this explains (control characters, NUL bytes without such a pattern) have no character set: they are no text. Cyrillic text in capitals only fits KOI8-R and
windows-1251 alike, and is taken for the former.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# The 8-bit sets that are told apart, in the order that decides between equals; those of another script; and the byte order marks.
SETS = ("windows-1252", "windows-1251", "koi8-r", "iso-8859-5", "iso-8859-2")
CYRILLIC = ("windows-1251", "koi8-r", "iso-8859-5")
MARKS = (("utf-32-le", b"\xff\xfe\x00\x00"), ("utf-32-be", b"\x00\x00\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"))
#: (weight, pairs of kinds): a, A ASCII letters; l, L Latin ones beyond; n, N those of another script; p punctuation; s other signs; u undefined.
WEIGHTS = (
    (4.0, "[nN][n](?=[n][n])"), (1.0, "[a][l]|[l][a]|[A][L]|[L][aA]"), (-3.0, "[aAlL][nN]|[nN][aAlL]"), (-2.0, "[an][N]|[al][L]|[l][A]"),
    (-1.0, "[l][L]"), (-1.5, "[aAlLnN][sp](?=[aAlLnN])"), (-1.0, "[ ][s](?=[aAlLnN])"), (1.5, "[ ][p](?=[aAlLnN])"), (-20.0, "u"),
)
#: A capital of another script before its like, of weight 1: any in a text without ASCII letters; with them, at the head of four letters.
CAPITALS, CAPITALS_AMONG_ASCII = "[N][nN]", "[N][nN](?=[nN][nN])"
#: What ASCII letters take from the score of a set of another script: once, as much as a lone word of four letters gives, and for each letter.
ASCII_COST, LETTER_COST = 5.0, 0.05
#: Bytes that text has none of.
_CONTROLS = r"[\x01-\x08\x0E-\x1A\x1C-\x1F]"


@cache
def table(name: str) -> str:
    """The characters of the bytes 128 to 255."""
    return "".join(bytes([b]).decode(name, "replace") for b in range(128, 256))


@cache
def kinds(name: str) -> str:
    """The kind of each byte, as a letter."""

    def kind(b: int) -> str:
        c = bytes([b]).decode(name, "replace")
        if c == "\ufffd" or b > 127 and unicodedata.category(c) == "Cc":
            return "u"
        if c.isalpha():
            latin = unicodedata.name(c, "").startswith("LATIN")
            small = "a" if b < 128 else "l" if latin else "n"
            return small.upper() if c.isupper() else small
        return " " if b < 128 or c.isspace() else "p" if unicodedata.category(c).startswith("P") else "s"

    return "".join(map(kind, range(256)))


_LATIN = "".join(map(chr, range(256)))


def _counted(weights: tuple) -> list[tuple[float, str]]:
    # pairs overlap, so the first of a pair is looked at and the second one taken
    return [(w, "|".join(f"(?<={m[1]}){m[2]}" if (m := re.fullmatch(r"(\[[^\]]*\])(\[[^\]]*\].*)", p)) else p for p in pairs.split("|"))) for w, pairs in weights]


COUNTED = _counted(WEIGHTS)
((_, _ANY_CAPITALS), (_, _HEAD_CAPITALS)) = _counted(((1.0, CAPITALS), (1.0, CAPITALS_AMONG_ASCII)))


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def score(words: Column, letters: Column, name: str) -> Column:
    """How well the neighbours fit the set: the sum of the weights of all pairs, for another script less the cost of ASCII letters."""

    def total(mapped: Column) -> Column:
        out = F.lit(0.0)
        for w, pattern in COUNTED:
            out = out + F.regexp_count(mapped, F.lit(pattern)) * w
        if name in CYRILLIC:
            out = out + F.when(letters == 0, F.regexp_count(mapped, F.lit(_ANY_CAPITALS))).otherwise(F.regexp_count(mapped, F.lit(_HEAD_CAPITALS)) - (letters * LETTER_COST + ASCII_COST))
        return out

    return _once(F.translate(words, _LATIN, kinds(name)), total)


def _best(latin: Column) -> Column:
    """The set that fits best, the first of equals."""
    scores = lambda words, n: F.array(*(F.struct(score(words, n, s).alias("score"), F.lit(-k).alias("rank"), F.lit(s).alias("name")) for k, s in enumerate(SETS)))
    words = F.array_join(F.array_distinct(F.split(latin, " ")), " ")
    return _once(words, lambda w: _once(F.length(F.regexp_replace(w, "[^A-Za-z]+", "")), lambda n: F.array_max(scores(w, n))["name"]))


def charset(content: Column) -> Column:
    """The name of the character set of bytes, null if they are no text; empty bytes are UTF-8."""
    found = F.when(F.length(content) == 0, "utf-8")
    for name, mark in MARKS:
        found = found.when(F.startswith(content, F.lit(mark)), name)
    latin = F.decode(content, "ISO-8859-1")
    clean = ~F.rlike(latin, F.lit(_CONTROLS))
    no_nul = ~F.contains(content, F.lit(b"\x00"))
    found = found.when(F.is_valid_utf8(content.cast("string")) & no_nul & clean, "utf-8")
    # a unit's upper bytes are mostly NUL in UTF-16 text of Latin script, always in UTF-32
    n = F.length(content)
    even, odd = F.regexp_count(latin, F.lit(r"\G(?s:..)*?\x00(?s:.)")), F.regexp_count(latin, F.lit(r"\G(?s:..)*?(?s:.)\x00"))
    four = (n % 4 == 0) & F.rlike(latin, F.lit(r"^(?s:..[\x00-\x10]\x00)+$")), (n % 4 == 0) & F.rlike(latin, F.lit(r"^(?s:\x00[\x00-\x10]..)+$"))
    found = found.when(four[0], "utf-32-le").when(four[1], "utf-32-be")
    found = found.when((n % 2 == 0) & (odd * 5 > n) & (even * 50 <= n), "utf-16-le").when((n % 2 == 0) & (even * 5 > n) & (odd * 50 <= n), "utf-16-be")
    return found.when(no_nul & clean, _best(latin))


def decode_text(content: Column, name: Column | None = None) -> Column:
    """The text of bytes in their character set, without its mark; null if they are no text."""
    name = charset(content) if name is None else name
    out = None
    for s, mark in (("utf-8", 3), ("utf-16-le", 2), ("utf-16-be", 2), ("utf-32-le", 4), ("utf-32-be", 4)):
        marked = F.startswith(content, F.lit(dict(MARKS)[s]))
        body = F.when(marked, F.substring(content, F.lit(mark + 1), F.length(content))).otherwise(content)
        known = {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}.get(s)
        text = F.decode(body, known) if known else F.decode(body if s == "utf-32-be" else _reversed(body), "UTF-32")
        out = F.when(name == s, text) if out is None else out.when(name == s, text)
    for s in SETS:
        out = out.when(name == s, F.translate(F.decode(content, "ISO-8859-1"), _LATIN[128:], table(s)))
    return out


def _reversed(body: Column) -> Column:
    """UTF-32 units in the other order of bytes."""
    return F.unhex(F.regexp_replace(F.hex(body), "(..)(..)(..)(..)", "$4$3$2$1"))


def charset_of(content: bytes) -> str | None:
    """The same in Python, for converters that meet bytes inside containers."""
    if not content:
        return "utf-8"
    for name, mark in MARKS:
        if content.startswith(mark):
            return name
    clean, no_nul = not re.search(_CONTROLS.encode(), content), b"\x00" not in content
    try:
        content.decode()
        valid = True
    except UnicodeDecodeError:
        valid = False
    if valid and clean and no_nul:
        return "utf-8"
    n = len(content)
    if n % 4 == 0 and re.fullmatch(rb"(?s:..[\x00-\x10]\x00)+", content):
        return "utf-32-le"
    if n % 4 == 0 and re.fullmatch(rb"(?s:\x00[\x00-\x10]..)+", content):
        return "utf-32-be"
    even, odd = content[0::2].count(0), content[1::2].count(0)
    if n % 2 == 0 and odd * 5 > n and even * 50 <= n:
        return "utf-16-le"
    if n % 2 == 0 and even * 5 > n and odd * 50 <= n:
        return "utf-16-be"
    if not (no_nul and clean):
        return None
    words = b" ".join(dict.fromkeys(content.split(b" ")))
    letters = len(re.findall(rb"[A-Za-z]", words))

    def fit(name: str) -> float:
        mapped = words.translate(kinds(name).encode()).decode()
        total = sum(w * len(re.findall(p, mapped)) for w, p in COUNTED)
        if name in CYRILLIC:
            total += len(re.findall(_HEAD_CAPITALS, mapped)) - (letters * LETTER_COST + ASCII_COST) if letters else len(re.findall(_ANY_CAPITALS, mapped))
        return total

    return max(SETS, key=fit)  # the first of equals


def text_of(content: bytes) -> str | None:
    name = charset_of(content)
    if name is None:
        return None
    for mark_of, mark in MARKS:
        if name == mark_of and content.startswith(mark):
            content = content[len(mark) :]
            break
    return content.decode(name, "replace")
