"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

A pre-token starts as one symbol per UTF-8 byte. The adjacent pair of lowest rank is popped from a
heap and merged in a doubly linked list, which may bring new pairs to its left and right; entries
whose symbols have changed since are stale and skipped. Tokens = initial symbols - merges.

Texts are cut before each space. A pre-token begins there, unless the space lies inside a run of white
space: after other white space, and before more of it or the text's end. Texts with such a space are pre-tokenised whole. Counts
of pieces and pre-tokens are kept in dictionaries of bounded size.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); strings of special tokens inside a
text count as one token each, as the library does by default; repeated rows are counted each;
other columns are kept out of the result unless asked for in `keep`.
"""

from __future__ import annotations

import heapq
import json
import re

import regex
from pyspark.sql import DataFrame

from docloom.llm.common import map_rows

# The pre-tokeniser's white space, and its pattern.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: White space before a space: without any of these no space lies inside a run.
_BEFORE = [f"{c} " for c in " \n\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"] + [f"{chr(c)} " for c in range(0x2000, 0x200B)]
_INSIDE = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)").search

#: Entries a worker keeps of counted pieces; the dictionary is emptied when full.
CACHE_ENTRIES = 400_000


def byte_alphabet() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def merges_in(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """How many merges the byte-pair encoder makes in one pre-token."""
    n = len(word)
    if n < 2:
        return 0
    part = [word[i : i + 1] for i in range(n)]
    rank = ranks.get
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := rank((part[i], part[i + 1]))) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    made = 0
    while heap:
        _, i, left, right = pop(heap)
        j = after[i]
        if part[i] is not left or j >= n or part[j] is not right:
            continue  # stale
        made += 1
        part[i] = whole = left + right
        part[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank((whole, part[k]))) is not None:
                push(heap, (r, i, whole, part[k]))
        h = before[i]
        if h >= 0 and (r := rank((part[h], whole))) is not None:
            push(heap, (r, h, part[h], whole))
    return made


class _Bounded(dict):
    """text -> tokens of prefix + text; made on first use."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class TokenCounter:
    """Counts the tokens of texts under a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normaliser and prefix space is needed")
        back = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(back[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._find = regex.compile(PATTERN).findall
        self._token = _Bounded(self._pre_token)
        self._piece = _Bounded(lambda p: self._whole(" " + p))

    def _pre_token(self, s: str) -> int:
        raw = s.encode()
        return len(raw) - merges_in(raw, self.ranks)

    def _whole(self, s: str) -> int:
        return sum(map(self._token.__getitem__, self._find(s)))

    def _segment(self, s: str) -> int:
        if any(map(s.__contains__, _BEFORE[: 6 if s.isascii() else None])) and _INSIDE(s):
            return self._whole(s)
        first, *rest = s.split(" ")
        return (self._whole(first) if first else 0) + sum(map(self._piece.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._cut is not None and any(t in text for t in self.special):
            parts = self._cut.split(text)
            return sum(map(self._segment, parts)) + len(parts) - 1
        return self._segment(text)


_COUNTERS: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; a narrow map without a shuffle.

    The vocabulary is read once by each worker process from `tokenizer_path`, which every machine must have.
    """

    def setup() -> TokenCounter:
        if tokenizer_path not in _COUNTERS:
            _COUNTERS[tokenizer_path] = TokenCounter(tokenizer_path)
        return _COUNTERS[tokenizer_path]

    def count(cols, counter):
        ids, texts = cols
        tokens = [counter.count(t) for t in texts]
        yield {id_col: ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), count, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean", setup)
