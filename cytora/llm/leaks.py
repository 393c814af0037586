"""Evaluation passages inside training documents.

One Aho-Corasick automaton holds every run of ``SEED_WORDS`` words of the normalised evaluation items. Each
document is normalised and scanned once. Around a hit, the furthest reaching alignment with few edits decides
whether a passage long enough is there; its place is mapped back to the original text.

With at most two edits in ``MIN_WORDS`` words, thirteen words remain in at most three pieces, so one piece
holds five words in a row: no passage that counts is without a hit.

Defined results: null and empty texts hold no passage; items shorter than ``MIN_WORDS`` words cannot leak; items with equal text
leak together; documents that repeat a text are all reported. Texts are scanned whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytora.session import spread

#: Words of a hit, words a leaked passage has at least, and edits allowed in so many words.
SEED_WORDS, MIN_WORDS, EDITS = 5, 15, 2
#: Items, and characters of them, that one automaton holds; more are scanned in further passes.
MAX_ITEMS, MAX_CHARS = 20_000, 8_000_000

# Letters of other scripts that look like Latin ones.
_LOOKALIKE = str.maketrans({
    "а": "a", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "в": "b", "н": "h", "ո": "n",
    "ο": "o", "α": "a", "ν": "v", "ε": "e", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "κ": "k", "ι": "i",
    "ı": "i", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
})
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|kbd|mark|s|small|span|strong|sub|sup|tt|u|wbr)\b", re.I)
_SPECIAL = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});|<[/!?A-Za-z][^<>]*>|[^\x00-\x7f]+")
_BROKEN = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_OTHER = re.compile(r"[^a-z0-9]+")


def _mend(m: re.Match) -> str:
    """A character whose UTF-8 bytes were read as single-byte text."""
    for charset in ("cp1252", "latin-1"):
        try:
            return m[0].encode(charset).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m[0]


def _fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", _BROKEN.sub(_mend, text)).lower().translate(_LOOKALIKE)
    return "".join(c if c.isascii() else "" if unicodedata.category(c) in ("Mn", "Cf") else " " for c in plain)


def _special(m: re.Match) -> str:
    text = m[0]
    if text[0] == "<":
        return "" if _INLINE.match(text) else " "
    if text[0] == "&":
        text = html.unescape(text)
        return text if text.isascii() else _fold(text)
    return _fold(text)


def normalise(text: str) -> str:
    """Words of ``text`` in lower-case ASCII letters and digits, one blank around each."""
    return " " + _OTHER.sub(" ", _SPECIAL.sub(_special, text).lower()).strip(" ") + " "


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of every word of ``normalise(text)``."""
    chars: list[str] = []
    starts: list[int] = []
    ends: list[int] = []

    def add(piece: str, start: int, end: int, each: bool) -> None:
        chars.append(piece)
        n = len(piece)
        starts.extend(range(start, start + n) if each else [start] * n)
        ends.extend(range(start + 1, start + n + 1) if each else [end] * n)

    at = 0
    for m in _SPECIAL.finditer(text):
        add(text[at : m.start()], at, m.start(), True)
        add(_special(m), m.start(), m.end(), False)
        at = m.end()
    add(text[at:], at, len(text), True)
    return [(starts[m.start()], ends[m.end() - 1]) for m in re.finditer(r"[a-z0-9]+", "".join(chars).lower())]


def _reach(a: list[str], i: int, b: list[str], j: int, step: int, edits: int) -> list[tuple[int, int]]:
    """For 0, 1, ... edits: the most words of ``a`` from ``i`` on that align with ``b`` from ``j`` on and end in an equal word, with the words of ``b``."""
    na, nb = (len(a) - i, len(b) - j) if step > 0 else (i + 1, j + 1)
    front = {0: 0}
    best: list[tuple[int, int]] = []
    for e in range(edits + 1):
        if e:
            spread: dict[int, int] = {}
            for d, x in front.items():
                for dd, xx in ((d, x + 1), (d + 1, x + 1), (d - 1, x)):  # altered, left out, put in
                    if xx <= na and 0 <= xx - dd <= nb and spread.get(dd, -1) < xx:
                        spread[dd] = xx
            front = spread
        top = best[-1] if best else (0, 0)
        for d, x in front.items():
            y, x0 = x - d, x
            while x < na and y < nb and a[i + step * x] == b[j + step * y]:
                x, y = x + 1, y + 1
            front[d] = x
            if x > x0 and x > top[0]:
                top = (x, y)
        best.append(top)
    return best


def passage(a: list[str], i: int, b: list[str], j: int, least: int = MIN_WORDS, edits: int = EDITS) -> tuple[int, int, int]:
    """(words of item ``a``, first and last word of ``b``) of the longest passage through the hit at ``a[i]``, ``b[j]``; no words if it is shorter than ``least``."""
    after = _reach(a, i + SEED_WORDS, b, j + SEED_WORDS, 1, edits)
    if SEED_WORDS + after[-1][0] + i < least:
        return 0, j, j
    before = _reach(a, i - 1, b, j - 1, -1, edits)
    e = max(range(edits + 1), key=lambda e: before[e][0] + after[edits - e][0])
    longest = SEED_WORDS + before[e][0] + after[edits - e][0]
    return (longest if longest >= least else 0), j - before[e][1], j + SEED_WORDS - 1 + after[edits - e][1]


class ItemIndex:
    """The automaton over all runs of words of the items, with the words of each item."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.words: dict[int, list[str]] = {}
        runs: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = normalise(text or "").split()
            if len(words) < MIN_WORDS:
                continue
            self.words[item] = words
            for k in range(len(words) - SEED_WORDS + 1):
                runs.setdefault(" " + " ".join(words[k : k + SEED_WORDS]) + " ", []).append((item, k))
        self.automaton = ahocorasick.Automaton()
        for run, places in runs.items():
            self.automaton.add_word(run, (len(run), places))
        if runs:
            self.automaton.make_automaton()
        self.empty = not runs

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, words, start, end) of the longest passage of each item that ``text`` holds."""
        if self.empty or not text:
            return []
        plain = normalise(text)
        hits = list(self.automaton.iter(plain))
        if not hits:
            return []
        words = plain.split()
        found: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        counted, at = 0, 0
        for end, (length, places) in hits:
            start = end - length + 1
            counted += plain.count(" ", at, start)
            at, j = start, counted
            for item, i in places:
                seen = tried.setdefault(item, set())
                if (j - i, j) in seen:
                    continue
                n, first, last = passage(self.words[item], i, words, j)
                if n:
                    seen.update((j - i, j + k) for k in range(1, MIN_WORDS))
                    if n > found.get(item, (0,))[0]:
                        found[item] = (n, first, last)
        if not found:
            return []
        places_of = word_places(text)
        return [(item, n, places_of[first][0], places_of[last][1]) for item, (n, first, last) in found.items()]


_CACHE: dict[str, ItemIndex] = {}


def _index(key: str, items: list[tuple[int, str]]) -> ItemIndex:
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = ItemIndex(items)
    return _CACHE[key]


_SCHEMA = "doc_id long, item_id long, n_words int, start int, end int"


def find_leaks(documents: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, n_words, start, end): every item a document holds a passage of, with the longest one's place.

    ``items`` is small by its nature (evaluation suites); what one automaton may hold is bounded by
    ``MAX_ITEMS`` and ``MAX_CHARS``, and more items are scanned for in as many passes as it takes.
    """
    rows = [(r[0], r[1]) for r in items.select(item_id, item_text).filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct().toLocalIterator()]
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    for row in sorted(rows, key=lambda r: r[0]):
        if parts[-1] and (len(parts[-1]) >= MAX_ITEMS or size + len(row[1]) > MAX_CHARS):
            parts.append([])
            size = 0
        parts[-1].append(row)
        size += len(row[1])
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND text != ''")
    docs = spread(docs)
    out: DataFrame | None = None
    for part in parts:
        shared = documents.sparkSession.sparkContext.broadcast(part)
        key = f"{id(shared)}-{hash(tuple(part))}"

        def scan(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            index = _index(key, shared.value)
            for pdf in batches:
                found = [(d, *hit) for d, t in zip(pdf["doc_id"], pdf["text"]) for hit in index.find(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "n_words", "start", "end"])

        hits = docs.mapInPandas(scan, _SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return out


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) of documents and the items they leak."""
    return find_leaks(documents, items).select("doc_id", "item_id").distinct()
