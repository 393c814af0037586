"""Pages made of keywords, links, tags or offers instead of sentences.

A page is cut into segments (lines, and sentences within lines) and each segment is reduced to a shape: how many
words it has, how it begins and ends, how many of its words are written with capitals, how many separators and links
it holds. Words themselves are not looked up anywhere; of them only their length, their letter case and whether
the segment has held them before count. Segments are grouped by shape, within each page and over the whole crawl, and each
shape of a page is held to be one of sentences or not by what all its segments have in common: sentences are held together by
short words, and neither consist of links, separators, tags and codes nor of a few words again and again. Where a page has
only few words of a shape, what the crawl says about that shape counts with it. A page is spam when ``FEW`` shapes
that no sentences have hold more than half of its words.

Everything runs on Arrow arrays of a whole batch; regular expressions see each distinct word once.

Defined results: null and empty texts and texts without words are no spam; so are texts of scripts that don't part
words, unless links or repetition hold them. Texts are read whole. Of rows that repeat a doc_id, one suffices.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytora.session import spread

#: Share of a page's words in few non-sentence shapes above which the page is spam, and how many shapes are few.
SPAM_SHARE, FEW = 0.5, 12
#: Share of words that a segment has held already from which it exists only to carry them, up to and beyond ``WALL``
#: words, and words without any that a shape is given beforehand; times that segments repeat a word for it to be a
#: keyword of the page, and share of keywords from which a shape exists only to carry them.
CARRIED, CARRIED_WALL, WALL, CARRIED_FROM = 0.1, 0.2, 40, 12
KEYWORD_TIMES, KEYED = 3, 0.3
#: Words a shape has to hold in a page to count; a title or a single short line is no list.
SHAPE_WORDS = 6
#: Share of short words below which segments are no sentences: of up to ``BRIEF`` words, of usual length with an end, of
#: more than ``LONG`` words or with a link, and without an end.
JOINERS_BRIEF, JOINERS_ENDED, JOINERS_LONG, JOINERS_OPEN = 0.12, 0.035, 0.12, 0.14
BRIEF, LONG = 4, 20
#: Words that ended segments of usual length hold at least before a lack of short ones tells anything.
ENDED_FROM = 25
#: Words that the crawl's share of short words counts for, that share where no crawl is given, and the usual share of codes.
PRIOR_WORDS, PRIOR_SHARE, PRIOR_CODES = 6.0, 0.2, 0.1
#: Share of words with digits or several capitals (with an end and without one), separators per word, and distinct words over the root of all of
#: at least ``VARIED_FROM`` longer words, beyond or below which a shape is a list of codes, a list, or a few words repeated.
CODES, CODES_OPEN, LISTED, VARIED, VARIED_FROM = 0.35, 0.3, 0.2, 2.6, 20

_LINK = "\u0001"
_BREAK = r"(?i)<(?:br|/?p|/?div|/?li|/?ul|/?ol|/?tr|/?h[1-6]|/?table|/?section|/?article)\b[^<>]*>"
_ANCHOR = r"(?is)<a\b[^<>]*href[^<>]*>"
_TAG = r"</?[A-Za-z!][^<>]*>"
_MARKDOWN = r"\[([^\[\]]*)\]\(\s*[^()\s]+[^()]*\)"
_URL = r"(?i)(?:https?://|www[.\-])\S+|[\pL\pN\-]+(?:\.[\pL\pN\-]+)*\.\pL{2,}(?:/\S*)?"
_SENTENCE = r"([.?!…][\"”’')\]]*)[ \t]+(\S)"
_WIDE_STOP = r"([。！？])"
_SPLIT = r"[^\pL\pN\x01\-'’]+"
_SIGNS = r"[,;|·•»›→★✓、，/>:]|\s[\-–—]\s"
_SIGNED = r"(?i)(?:^|\s)(?:[#@+][\pL\pN]|tags?:\s?[\pL\pN])"
_BUCKETS = np.array([1, 2, 3, 4, 5, 8, 13, 21, 41, 81])

#: Columns of a page's shape: its number, and what all its segments hold together.
SUMS = ("words", "joiners", "repeated", "keyed", "codes", "content", "kinds", "links", "signs", "signed", "segments", "tabs", "wide")


def _clean(texts: pa.Array) -> pa.Array:
    """Markup is gone, links have become a mark, and every sentence has a line of its own."""
    texts = pc.fill_null(texts, "")
    has = pc.match_substring(texts, "<")
    if pc.any(has).as_py():
        marked = pc.replace_substring_regex(texts, _ANCHOR, f" {_LINK} ")
        marked = pc.replace_substring_regex(pc.replace_substring_regex(marked, _BREAK, "\n"), _TAG, "")
        texts = pc.if_else(has, marked, texts)
    has = np.flatnonzero(pc.match_substring(texts, "&").to_numpy(zero_copy_only=False))
    if len(has):
        listed = texts.to_pylist()
        for i in has:
            listed[i] = html.unescape(listed[i])
        texts = pa.array(listed, pa.string())
    texts = pc.replace_substring_regex(texts, _MARKDOWN, rf" {_LINK} \1 ")
    texts = pc.replace_substring_regex(texts, _URL, f" {_LINK} ")
    texts = pc.replace_substring_regex(texts, _SENTENCE, r"\1" + "\n" + r"\2")
    return pc.replace_substring_regex(texts, _WIDE_STOP, r"\1" + "\n")


def _owners(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))


def _segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(segments, the page of each)."""
    lists = pc.split_pattern_regex(_clean(texts), r"[\r\n\x0b\x0c  ]+")
    flat, page = pc.utf8_trim_whitespace(lists.flatten()), _owners(lists)
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(keep)), page[keep]


def _per(index: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(index, weights=weights, minlength=n)


def page_shapes(texts: pa.Array) -> dict[str, np.ndarray]:
    """For every page and shape: ``page``, ``shape`` and the ``SUMS`` of its segments."""
    segment, page = _segments(texts)
    n = len(segment)
    if not n:
        return {c: np.zeros(0) for c in ("page", "shape", *SUMS)}
    lists = pc.split_pattern_regex(segment, _SPLIT)
    words, owner = lists.flatten(), _owners(lists)
    coded = words.dictionary_encode()
    code, each = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    test = lambda pattern: pc.match_substring_regex(each, pattern).to_numpy(zero_copy_only=False)
    link = test(_LINK)
    worded = test(r"[\pL\pN]") & ~link
    keep = (worded | link)[code]
    code, owner = code[keep], owner[keep]
    small, first_small = test(r"^(?:[\p{Ll}\p{M}]{1,3}|\p{Lo}{1,3}|I)$"), test(r"^\p{Lu}[\p{Ll}\p{M}]{0,2}$")
    coded_ = test(r"\pN") | test(r"\p{Lu}.*\p{Lu}")
    shout, wide = test(r"^\p{Lu}{2,}$"), test(r"\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Thai}|\p{Hangul}")
    upper = test(r"^\p{Lu}")
    size = pc.utf8_length(each).to_numpy(zero_copy_only=False)
    able = worded & (size > 3) & ~test(r"^\pN+$")
    real = worded[code]
    many, loud = np.bincount(owner[real], minlength=n), np.bincount(owner[real & shout[code]], minlength=n)
    shouting = ((many >= 4) & (loud > 0.6 * many))[owner]
    first = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    joins = small[code] | (first & first_small[code]) | (shouting & shout[code] & (size[code] <= 3))
    code_words = coded_[code] & real & ~joins & ~(shouting & shout[code])
    content = real & ~joins & ~code_words
    # words that a segment repeats, whatever their letter case
    lower = pc.utf8_lower(each).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    kinds = int(lower.max(initial=0)) + 1
    _, first_time = np.unique(owner * kinds + lower[code], return_index=True)
    repeated = able[code]
    repeated[first_time] = False
    # words that segments of the page repeat time and again are its keywords, wherever it has them
    in_page = page[owner].astype(np.int64) * kinds + lower[code]
    again, times = np.unique(in_page[repeated], return_counts=True)
    keyed = np.isin(in_page, again[times >= KEYWORD_TIMES])
    count = lambda v: _per(owner, v.astype(float), n)
    total, links = count(real), count(~real)
    signs = pc.count_substring_regex(segment, _SIGNS).to_numpy(zero_copy_only=False).astype(float)
    signed = pc.count_substring_regex(segment, _SIGNED).to_numpy(zero_copy_only=False).astype(float)
    tabs = pc.count_substring(segment, "\t").to_numpy(zero_copy_only=False).astype(float)
    ended = pc.match_substring_regex(segment, r"[.?!:…。！？][\"”’')\]*_]*$").to_numpy(zero_copy_only=False)
    begins = pc.match_substring_regex(segment, r"^[^\pL\pN]*\p{Lu}").to_numpy(zero_copy_only=False)
    held = np.maximum(total + links, 1)
    bucket = np.searchsorted(_BUCKETS, total, side="right")
    caps = np.digitize(count(upper[code] & real) / held, [0.3, 0.7])
    shape = bucket + 11 * (begins + 2 * (ended + 2 * (np.digitize(signs / held, [0.05, LISTED]) + 3 * (np.minimum(links, 2).astype(int) + 3 * (caps + 3 * (tabs >= 2))))))
    group, inverse = np.unique(page.astype(np.int64) * 10_000 + shape, return_inverse=True)
    distinct = np.unique(inverse[owner[content]].astype(np.int64) * kinds + lower[code[content]]) // kinds
    sums = {"words": total + links, "joiners": count(joins & real), "repeated": count(repeated), "keyed": count(keyed), "codes": count(code_words), "content": count(content), "links": links, "signs": signs, "signed": signed, "segments": np.ones(n), "tabs": tabs, "wide": count(wide[code])}
    out = {c: _per(inverse, v, len(group)) for c, v in sums.items()} | {"kinds": np.bincount(distinct, minlength=len(group)).astype(float)}
    has = out["words"] > 0
    return {"page": (group // 10_000)[has], "shape": (group % 10_000)[has], **{c: v[has] for c, v in out.items()}}


def no_sentences(rows: dict[str, np.ndarray], crawl: np.ndarray | float = PRIOR_SHARE) -> np.ndarray:
    """Whether the segments of each page's shape are no sentences; ``crawl`` is the share of short words in that shape over all pages."""
    w, segments = np.maximum(rows["words"], 1), np.maximum(rows["segments"], 1)
    joined = (rows["joiners"] + PRIOR_WORDS * crawl) / (w + PRIOR_WORDS)
    length = w / segments
    ended = (rows["shape"] // 22) % 2 == 1
    linked = (rows["links"] > 0) & (w <= np.where(ended, 6, 12) * rows["links"]) & (joined < 0.2)
    tagged = rows["signed"] * 3 >= w
    carried = (rows["repeated"] >= np.where(length <= WALL, CARRIED, CARRIED_WALL) * (w + CARRIED_FROM)) | (rows["keyed"] >= KEYED * w)
    varied = rows["kinds"] >= VARIED * np.sqrt(rows["content"])
    carried |= ~varied & (rows["content"] >= VARIED_FROM) & (~ended | (length < BRIEF + 0.5))
    listed = ((rows["signs"] >= LISTED * w) & (rows["signs"] >= 3 * segments) & (joined < JOINERS_OPEN)) | (rows["codes"] >= np.where(ended, CODES * (w + PRIOR_WORDS) - PRIOR_CODES * PRIOR_WORDS, CODES_OPEN * w))
    least = np.where(~ended, JOINERS_OPEN, np.where(length < BRIEF + 0.5, JOINERS_BRIEF, np.where((length > LONG) | (rows["links"] > 0), JOINERS_LONG, np.where(w >= ENDED_FROM, JOINERS_ENDED, 0))))
    table = rows["tabs"] >= 2 * segments
    unparted = rows["wide"] * 2 > w
    return linked | tagged | (rows["words"] >= SHAPE_WORDS) & (carried | (~unparted & ~table & (listed | (joined < least))))


def spam_share(text: str | None) -> float:
    """Share of one page's words that lie in few non-sentence shapes, as far as the page alone tells."""
    rows = page_shapes(pa.array([text], pa.string()))
    if not len(rows["words"]):
        return 0.0
    apart = np.sort(rows["words"][no_sentences(rows)])[::-1]
    return float(apart[:FEW].sum() / rows["words"].sum())


_COUNTS = "doc_id long, shape int, " + ", ".join(f"{c} double" for c in SUMS)


def shape_counts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, shape, sums...): what the segments of each shape of each page hold together."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text != ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for a in range(0, len(ids), 512):  # pages that are worked on together
                rows = page_shapes(batch.column("text").slice(a, 512))
                at = a + rows["page"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(rows["shape"].astype(np.int32)), *[pa.array(rows[c].astype(float)) for c in SUMS]], names=["doc_id", "shape", *SUMS])

    return spread(docs).mapInArrow(count, _COUNTS)


def crawl_shapes(counts: DataFrame) -> DataFrame:
    """(shape, pages, segments, words, joiners) over the whole crawl: at most as many rows as there are shapes, some thousand."""
    return counts.groupBy("shape").agg(F.count(F.lit(1)).alias("pages"), F.sum("segments").alias("segments"), F.sum("words").alias("words"), F.sum("joiners").alias("joiners"))


def page_scores(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, share, main_shape, n_shapes): share of a page's words in few non-sentence shapes, the shape that holds most words, shapes seen."""
    from cytora.session import materialise

    counts = materialise(shape_counts(documents, text, doc_id))
    over = {r["shape"]: r["joiners"] / r["words"] for r in crawl_shapes(counts).collect()}  # bounded by the number of shapes
    shared = counts.sparkSession.sparkContext.broadcast(over)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in ("shape", *SUMS)}
            share = np.array([shared.value[s] for s in rows["shape"].tolist()])
            apart = no_sentences(rows, share) if len(share) else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shape"), batch.column("words"), pa.array(apart)], names=["doc_id", "shape", "words", "apart"])

    judged = counts.mapInArrow(judge, "doc_id long, shape int, words double, apart boolean").groupBy("doc_id", "shape").agg(F.max("words").alias("words"), F.max("apart").alias("apart"))
    most = lambda c: F.aggregate(F.slice(F.array_sort(F.collect_list(c)), 1, FEW), F.lit(0.0), lambda s, v: s - v)
    per = judged.groupBy("doc_id").agg((most(F.when(F.col("apart"), -F.col("words"))) / F.sum("words")).alias("share"), F.max_by("shape", F.struct("words", -F.col("shape"))).alias("main_shape"), F.count(F.lit(1)).cast("int").alias("n_shapes"))
    return per.select("doc_id", "share", "main_shape", "n_shapes")


def spam_pages(documents: DataFrame, share: float = SPAM_SHARE) -> DataFrame:
    """Distinct doc_id of the pages whose words lie in few non-sentence shapes by more than ``share``."""
    return page_scores(documents).filter(F.col("share") > share).select("doc_id")
