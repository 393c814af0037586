"""Texts put into containers of fixed capacity, measured in tokens of a public tokenizer.

A text that alone exceeds the capacity is cut into full pieces and a rest; no other text is cut. Texts are dealt
by a hash into chunks of about ``CHUNK_BINS`` containers, and each chunk is filled by itself: best fit, largest
first, then a local search that moves a piece, exchanges one for one, two for one or one for two among all underfull
containers, whenever the sum of squared fills grows, until containers run empty. A chunk leaves at most about one
container's space unused, so the loss of working in chunks is below one in ``CHUNK_BINS``.

Defined results: every doc_id with a text has at least one row; a text without tokens takes a place of size 0;
null texts and null doc_ids have no size and no row; rows that repeat a doc_id are separate items, told apart by ``copy``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytora.session import materialise, spread

#: Tokens a container holds, containers of a chunk, and the vocabulary that measures texts.
CAPACITY, CHUNK_BINS = 2048, 2000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sweeps over all underfull containers at most; the search ends earlier once a sweep finds no step.
SWEEPS = 30

_ENCODINGS: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, kept for the life of the worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every text."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in pdf["text"]]})

    return spread(docs).mapInPandas(measure, "doc_id long, n_tokens long")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Containers (lists of item numbers) and their free space; each item goes, largest first, where least space remains."""
    bins: list[list[int]] = []
    free: list[int] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = open_mask >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = at[space].pop()
            if not at[space]:
                open_mask &= ~(1 << space)
        else:
            b, space = len(bins), capacity
            bins.append([])
            free.append(0)
        bins[b].append(i)
        free[b] = space - size
        if not at[free[b]]:
            open_mask |= 1 << free[b]
        at[free[b]].append(b)
    return bins, free


class Packing:
    """Containers under local search: the container of every item, and the space each has left."""

    def __init__(self, bins: list[list[int]], free: list[int], sizes: list[int], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.size, self.gap = np.asarray(sizes, dtype=np.int64), np.asarray(free, dtype=np.int64)
        self.owner = np.zeros(len(sizes), dtype=np.int64)
        for b, own in enumerate(bins):
            self.owner[own] = b
        self.least = -(-int(self.size.sum()) // capacity)

    def used(self) -> int:
        return int((self.gap < self.capacity).sum())

    def shift(self, items: list[int], source: int, target: int) -> None:
        for i in items:
            self.bins[source].remove(i)
            self.bins[target].append(i)
            self.owner[i] = target
            self.gap[source] += self.size[i]
            self.gap[target] -= self.size[i]

    def fill_from_emptier(self, target: int) -> int:
        """One step that takes a larger item, or two, from a container with more space, for none, one or two of ``target``; the space it fills."""
        room = int(self.gap[target])
        giver = self.gap[self.owner]
        may = np.flatnonzero((giver >= room) & (self.owner != target) & (self.size > 0))
        if not room or not len(may):
            return 0
        size, giver = self.size[may], giver[may]
        mine = self.bins[target]
        offers = [((), 0)] + [((j,), int(self.size[j])) for j in {int(self.size[j]): j for j in mine if self.size[j]}.values()]
        best: tuple[int, int, int, tuple[int, ...]] = (0, 0, -1, ())
        for out, value in offers:
            best = max(best, self._gain(size, giver, value, room, out))
            if best[0] == room:
                break
        if best[0] < room:  # two of the target's for one
            pairs = {int(self.size[a] + self.size[b]): (a, b) for k, a in enumerate(mine) for b in mine[:k] if self.size[a] and self.size[b]}
            for value, out in pairs.items():
                best = max(best, self._gain(size, giver, value, room, out))
                if best[0] == room:
                    break
        if best[0] <= 0:
            return 0
        item = int(may[best[2]])
        source = int(self.owner[item])
        self.shift([item], source, target) if not best[3] else self._exchange(item, list(best[3]), source, target)
        return best[0]

    @staticmethod
    def _gain(size: np.ndarray, giver: np.ndarray, value: int, room: int, out: tuple[int, ...]) -> tuple[int, int, int, tuple[int, ...]]:
        """(space filled, space of the giver, place of the item, items out) of the fullest exchange; givers with more space first."""
        score = np.where((size > value) & (size <= value + room), (size - value) * (1 << 20) + giver, -1)
        at = int(np.argmax(score))
        return (int(size[at] - value), int(giver[at]), at, out) if score[at] > 0 else (0, 0, -1, ())

    def _exchange(self, item: int, out: list[int], source: int, target: int) -> None:
        self.shift([item], source, target)
        self.shift(out, target, source)

    def empty(self, source: int) -> bool:
        """Move every item of ``source`` to where least space remains; nothing moves unless all find a place."""
        left = self.gap.copy()
        left[source] = -1
        left[[b for b in range(len(self.bins)) if not self.bins[b]]] = -1
        plan = []
        for i in sorted(self.bins[source], key=lambda i: -self.size[i]):
            fits = np.flatnonzero(left >= self.size[i])
            if not len(fits):
                return False
            b = int(fits[np.argmin(left[fits])])
            left[b] -= self.size[i]
            plan.append((i, b))
        for i, b in plan:
            self.shift([i], source, b)
        return True


def improve(bins: list[list[int]], free: list[int], sizes: list[int], capacity: int, sweeps: int = SWEEPS) -> int:
    """Local search in place, the number of steps taken.

    Every underfull container, the fullest first, takes what fills it most from containers with more space: an item, or an
    item for one or two of its own. Each step makes a fuller container fuller, so the sum of squared fills grows and space gathers
    in few containers, whose items then find places elsewhere. The search ends where the sizes leave no container to save.
    """
    p = Packing(bins, free, sizes, capacity)
    steps = 0

    def try_to_empty() -> None:
        for source in np.argsort(-p.gap, kind="stable").tolist():
            if p.used() <= p.least or p.gap[source] >= capacity:
                if p.used() <= p.least:
                    return
                continue
            if not p.empty(source):
                return

    try_to_empty()
    for _ in range(sweeps):
        if p.used() <= p.least:
            break
        before = int((p.gap * p.gap).sum())
        for target in [b for b in np.argsort(p.gap, kind="stable").tolist() if 0 < p.gap[b] < capacity]:
            while 0 < p.gap[target] < capacity and p.fill_from_emptier(target):
                steps += 1
        try_to_empty()
        if int((p.gap * p.gap).sum()) <= before:
            break
    free[:] = p.gap.tolist()
    return steps


def fill(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers of item numbers; sizes must not exceed the capacity."""
    bins, free = best_fit(sizes, capacity)
    improve(bins, free, sizes, capacity)
    return [b for b in bins if b]


_SCHEMA = "chunk int, bin int, place int, doc_id long, copy int, piece int, first_token long, n_tokens int"


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, chunk_bins: int = CHUNK_BINS) -> DataFrame:
    """(container_id, place, doc_id, copy, piece, first_token, n_tokens): what each container holds, in order."""
    sized = materialise(token_counts(documents, vocabulary=vocabulary))
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    chunks = max(1, round(total / (capacity * chunk_bins)))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        pdf["copy"] = pdf.groupby("doc_id").cumcount()
        items: list[tuple[int, int, int, int, int]] = []
        full: list[tuple[int, int, int, int, int]] = []
        for doc, copy, n in zip(pdf["doc_id"], pdf["copy"], pdf["n_tokens"]):
            piece = 0
            while n - piece * capacity > capacity:
                full.append((doc, copy, piece, piece * capacity, capacity))
                piece += 1
            items.append((doc, copy, piece, piece * capacity, n - piece * capacity))
        rows = [(key[0], b, 0, *piece) for b, piece in enumerate(full)]
        for b, own in enumerate(fill([i[4] for i in items], capacity), start=len(full)):
            rows.extend((key[0], b, place, *items[i]) for place, i in enumerate(own))
        return pd.DataFrame(rows, columns=["chunk", "bin", "place", "doc_id", "copy", "piece", "first_token", "n_tokens"])

    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    # a stated number of partitions, so that chunks of few bytes but much work aren't put into one task
    packed = dealt.repartition(min(chunks, 10_000), "chunk").groupBy("chunk").applyInPandas(pack, _SCHEMA)
    number = F.col("bin").cast("long") * F.lit(chunks) + F.col("chunk")
    return packed.select(number.alias("container_id"), "place", "doc_id", "copy", "piece", "first_token", "n_tokens")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill): how many containers are used and which share of their space is."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("held"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("held").alias("tokens"), (F.sum("held") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("fill"))
