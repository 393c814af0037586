"""Most similar vectors of every vector, by randomly rotated one-bit codes.

Vectors of unit length are dealt to cells around centroids (fitted on a bounded sample, every vector indexed).
Within a cell a vector is kept as one bit per rotated direction of its offset from the centroid, with two
correction scalars: the offset's length and how well the code points along it. For a query, packed bits of its own
offset, in four bit planes, give an unbiased estimate of the inner product with an error bound; vectors whose
estimate, widened by its bound, can still matter are compared exactly.

Which cells a query looks into:

* with a least similarity, every cell that could hold such a partner on one of the two sides: if two unit vectors
  lie ``r`` apart, the one of them that is nearer to the border of their cells is at most ``r / 2`` away from it, so
  looking across borders that near from both sides loses no pair. Where vectors lie so densely that this means many
  cells, each first finds the distance of its k-th neighbour in its own cell and then looks across borders nearer than that;
* without one, each query first finds the distance of its k-th neighbour in its own cell and then looks across borders
  nearer than ``SHORTER`` of it. The whole distance would lose nothing; the share loses what lies behind borders that
  near neighbours rarely lie behind, at any number of cells alike.

With a least similarity and without separate queries, what is moved are the vectors once and their looks across borders, so cells are wide
(up to ``WIDE`` vectors, see ``wide_cell``) and have few borders; the task of a cell parts it again (see ``Join``) and moves nothing for that. Exact
products of so few rows cost less than codes there.

Otherwise cells hold about ``CELL`` vectors in a table of any size: they form a tree of two levels (see ``Tree``) of up to
``MOST_CELLS`` cells, and a table that needs more is first split into parts, each with the vectors just beyond its borders, that are searched
one after the other. Hot classes of equal vectors (more than ``HOT_COPIES``) are searched through their first members; the others have
these as their nearest, as the similarity cannot be exceeded. A cell is split into as many blocks of members as its own size asks for;
queries pass a block in batches.

Defined results: null, all-zero, non-finite and wrongly long vectors are left out (the most frequent length is right); rows that repeat a vec_id are
one vector; ties in similarity go to the smaller vec_id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytora.session import hashed, materialise, spread

#: Vectors the upper centroids are fitted on, vectors that each leaf is fitted on, vectors aimed at in a cell.
SAMPLE, PER_LEAF, CELL = 40_000, 24, 800
#: Leaves of a node, and cells of one tree: at 32 dimensions, what every task is given takes 128 MB at most.
FAN, MOST_CELLS = 512, 1 << 20
#: Bits of a code with a least similarity and without one (there bounds have to tell many near ones apart), bits of
#: a query's components, and the width of the error bound in standard errors.
BITS, MORE_BITS, PLANES, BOUND = 64, 256, 4, 3.0
#: Members of a cell that one task compares at once, and equal vectors from which a class is hot.
BLOCK, HOT_COPIES = 4096, 2000
#: With a least similarity and every vector asking: most vectors aimed at in a cell, and vectors aimed at in the cells that its task parts it into.
WIDE, FINE = 250_000, 512
#: Without a least similarity, share of the distance of the k-th neighbour in the own cell within which borders are looked across.
SHORTER = 0.4
_SEED = 20240607
#: Queries whose bounds are computed together, so that the intermediate matrices stay in the cache.
_AT_ONCE = 128


def rotation(dims: int, bits: int = BITS, seed: int = _SEED) -> np.ndarray:
    """Random matrix (bits x dims) with orthonormal columns: a rotation of the vector padded with zeros."""
    rng = np.random.default_rng(seed)
    q, r = np.linalg.qr(rng.standard_normal((max(bits, dims), max(bits, dims))))
    return (q * np.sign(np.diag(r)))[:, :dims].astype(np.float32)


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    padded = np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64)))
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of the offsets of ``x`` from ``centre``."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        offset = (x - centre) @ turn.T
        self.length = np.linalg.norm(offset, axis=1)
        unit = offset / np.maximum(self.length, 1e-12)[:, None]
        self.bits = pack(offset > 0)
        self.width = turn.shape[0]
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64).astype(np.float32)
        self.along = np.abs(unit).sum(axis=1) / np.sqrt(self.width)

    def bounds(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, bound: float = BOUND, upper: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """(lower, upper) bounds of the squared distances of every query from every vector, from the packed bits alone.

        A query's offset is ``low + step * level`` with levels of ``PLANES`` bits, so its inner product with a
        vector's signs follows from ANDs and bit counts; all that depends on one side only is added as one product of thin matrices.
        """
        offset = (q - centre) @ turn.T
        reach = np.linalg.norm(offset, axis=1)
        low = offset.min(axis=1)
        step = np.maximum((offset.max(axis=1) - low) / (2**PLANES - 1), 1e-12)
        level = np.rint((offset - low[:, None]) / step[:, None]).astype(np.uint8)
        hits: np.ndarray | None = None
        for plane in reversed(range(PLANES)):
            words = pack((level >> plane) & 1 > 0)
            if hits is not None:
                hits += hits
            for w in range(words.shape[1]):
                counts = np.bitwise_count(words[:, w, None] & self.bits[None, :, w])
                hits = counts.astype(np.uint16) if hits is None else np.add(hits, counts, out=hits)
        root = np.sqrt(self.width)
        scale = self.length / np.maximum(self.along, 1e-6)
        slack = scale * np.sqrt(np.maximum(1 - self.along**2, 0) / (self.width - 1))
        rounding = 2 * bound * step * np.sqrt(self.width / 12.0) / root
        fixed = 2 * (low * self.width + step * level.sum(axis=1, dtype=np.int64)) / root
        ones = np.ones(len(q))
        mine = np.column_stack([ones, reach**2, -4 * low / root, fixed - rounding, -2 * bound * reach]).astype(np.float32)
        theirs = np.column_stack([self.length**2, np.ones(len(scale)), self.ones * scale, scale, slack]).astype(np.float32)
        met = hits.astype(np.float32)
        met *= (4 * step / root).astype(np.float32)[:, None]
        met *= scale.astype(np.float32)[None, :]
        under = mine @ theirs.T
        under -= met
        if not upper:
            return under, None
        mine[:, 3] += (2 * rounding).astype(np.float32)
        mine[:, 4] *= -1
        over = mine @ theirs.T
        over -= met
        return under, over


def centroids(x: np.ndarray, cells: int, steps: int = 6, seed: int = _SEED) -> np.ndarray:
    """Centroids of unit vectors by k-means; empty cells are filled with vectors far from theirs."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(x))
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(steps):
        sums, counts, far = np.zeros_like(c, dtype=np.float64), np.zeros(cells), np.empty(len(x))
        for a in range(0, len(x), 8192):
            part = x[a : a + 8192]
            s = part @ c.T - 0.5 * (c * c).sum(axis=1)
            own = s.argmax(axis=1)
            far[a : a + 8192] = -s[np.arange(len(part)), own]
            counts += np.bincount(own, minlength=cells)
            order = np.argsort(own, kind="stable")
            key, start = np.unique(own[order], return_index=True)
            sums[key] += np.add.reduceat(part[order].astype(np.float64), start, axis=0)
        empty = np.flatnonzero(counts == 0)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c).astype(np.float32)
        if len(empty):
            c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


def unit_rows(ids: np.ndarray, lists: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the arrays that have ``dims`` finite values, not all zero."""
    length = np.array(lists.value_lengths().fill_null(-1))
    good = np.flatnonzero(length == dims)
    offsets = np.array(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)
    x = flat[offsets[good][:, None] + np.arange(dims)[None, :]].astype(np.float64) if len(good) else np.zeros((0, dims))
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.linalg.norm(x, axis=1)
    keep = np.isfinite(norm) & (norm > 0)
    return ids[good][keep], (x[keep] / norm[keep, None]).astype(np.float32)


def _list_array(column) -> pa.Array:
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], whole.type)
    return whole


#: Cells a vector may look into on average before its own nearest are found first, to bound where it looks.
MANY_LOOKS = 32


class Tree:
    """Cells in two levels: a vector belongs to the nearest node, and among that node's leaves to the nearest one.

    A table has about one leaf for every ``CELL`` vectors and one node for every ``FAN`` leaves, so that finding a
    cell costs the square root of their number.
    """

    def __init__(self, nodes: np.ndarray, leaves: list[np.ndarray]):
        self.nodes, self.leaves = nodes, leaves
        self.first = np.concatenate([[0], np.cumsum([len(v) for v in leaves])])
        self.centres = np.concatenate(leaves)

    def __len__(self) -> int:
        return len(self.centres)

    def node_scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.nodes.T - 0.5 * (self.nodes * self.nodes).sum(axis=1)

    def _by_node(self, x: np.ndarray, row: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, places in ``row``, scores of its leaves) for all pairs of a row and a node, a bounded number at a time."""
        order = np.argsort(node, kind="stable")
        key, start = np.unique(node[order], return_index=True)
        for t, a, b in zip(key, start, np.r_[start[1:], len(order)]):
            c = self.leaves[t]
            half = 0.5 * (c * c).sum(axis=1)
            for lo in range(a, b, _SCORED):
                at = order[lo : min(b, lo + _SCORED)]
                yield int(t), at, x[row[at]] @ c.T - half

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, cell) of each vector."""
        node = self.node_scores(x).argmax(axis=1) if len(self.nodes) > 1 else np.zeros(len(x), dtype=np.int64)
        cell = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for t, at, score in self._by_node(x, rows, node):
            cell[at] = self.first[t] + score.argmax(axis=1)
        return node, cell

    def looks(self, x: np.ndarray, node: np.ndarray, cell: np.ndarray, reach: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the further cells whose border lies within ``reach``; ``across`` holds inside other nodes.

        The border of two centres is a plane; the lead of one score over the other, over the distance of the centres,
        is the distance from it.
        """
        row, of = np.arange(len(x)), node
        if len(self.nodes) > 1:
            score = self.node_scores(x)
            lead = score[row, node][:, None] - score
            at, t = np.nonzero(lead <= reach[:, None] * _WIDEST)
            gap = np.linalg.norm(self.nodes[node[at]] - self.nodes[t], axis=1)
            near = (lead[at, t] <= reach[at] * gap + 1e-5) & (t != node[at])
            row, of = np.concatenate([row, at[near]]), np.concatenate([node, t[near]])
        rows, cells = [], []
        for t, at, score in self._by_node(x, row, of):
            own = node[row[at]] == t
            best = np.where(own, cell[row[at]] - self.first[t], score.argmax(axis=1))
            limit = np.where(own, reach[row[at]], across[row[at]])
            lead = score[np.arange(len(at)), best][:, None] - score
            i, c = np.nonzero(lead <= limit[:, None] * _WIDEST)
            gap = np.linalg.norm(self.leaves[t][best[i]] - self.leaves[t][c], axis=1)
            near = (lead[i, c] <= limit[i] * gap + 1e-5) & ~(own[i] & (c == best[i]))
            rows.append(row[at][i[near]])
            cells.append(self.first[t] + c[near])
        return np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), np.concatenate(cells) if cells else np.zeros(0, dtype=np.int64)


#: No two points of the unit ball lie further apart; vectors whose leaves are scored at once.
_WIDEST, _SCORED = 2.0, 2048
#: Products of unit vectors in single precision are nearer to the exact ones than this.
_ROUNDING = 1e-6

_ROWS = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("role", pa.int8()), ("vec_id", pa.int64()), ("x", pa.binary())])
_ROWS_SQL = "cell int, block int, role byte, vec_id long, x binary"
_REACHED = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("reach", pa.float64())])
_REACHED_SQL = "vec_id long, x binary, reach double"
_PAIRS = pa.schema([("vec_id", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])
_PAIRS_SQL = "vec_id long, other long, similarity double"


#: Pairs that a search gathers before it keeps the best of them only, and placed rows that are handed on together.
GATHERED, HANDED = 200_000, 32_768
_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Search:
    """Queries against the members of one block. No more than the ``k`` best of a query or a member are kept beyond a batch of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, least: float | None, mutual: bool):
        self.ids, self.x, self.centre, self.turn = ids, x, centre, turn
        self.k, self.least, self.mutual = k, least, mutual
        self.codes = Codes(x, centre, turn)
        self._back: list[_Found] = []

    def _pairs(self, pids: np.ndarray, part: np.ndarray) -> _Found:
        """(query, place of the member, similarity) of all pairs of a few queries that may matter."""
        under, over = self.codes.bounds(part, self.centre, self.turn, upper=self.least is None)
        if self.least is not None:
            # of unit vectors, the squared distance is 2 - 2 * similarity
            possible = under <= 2 - 2 * self.least
        else:
            kk = min(self.k + 1, len(self.ids)) - 1  # one place for the query itself
            possible = under <= np.partition(over, kk, axis=1)[:, kk, None]
        i, j = np.nonzero(possible)
        other = pids[i] != self.ids[j]
        i, j = i[other], j[other]
        if len(i) > possible.size // 8:  # most pairs: one product of matrices
            exact = (part.astype(np.float64) @ self.x.T.astype(np.float64))[i, j]
        else:
            exact = np.einsum("nd,nd->n", part[i].astype(np.float64), self.x[j].astype(np.float64))
        good = np.ones(len(i), dtype=bool) if self.least is None else exact >= self.least - 1e-9
        return pids[i[good]], j[good], exact[good]

    def run(self, qids: np.ndarray, q: np.ndarray) -> Iterator[_Found]:
        """(query, partner, similarity): for every query its k best members."""
        held: list[_Found] = []
        for a in range(0, len(q), _AT_ONCE):
            held.append(self._pairs(qids[a : a + _AT_ONCE], q[a : a + _AT_ONCE]))
            if sum(len(h[0]) for h in held) > GATHERED:
                yield self._reduce(held)
                held = []
        if held:
            yield self._reduce(held)

    def _reduce(self, held: list[_Found]) -> _Found:
        i, j, s = (np.concatenate(v) for v in zip(*held))
        mine = _top(i, self.ids[j], s, self.k)
        if self.mutual:
            best = _top(j, i, s, self.k)
            self._back.append((i[best], j[best], s[best]))
            if len(self._back) > 1 and sum(len(b[0]) for b in self._back) > GATHERED:
                self._back = [self._merged()]
        return i[mine], self.ids[j[mine]], s[mine]

    def _merged(self) -> _Found:
        i, j, s = (np.concatenate(v) for v in zip(*self._back))
        order = np.lexsort((-s, i, j))  # a query that came twice counts once
        first = np.r_[True, (np.diff(j[order]) != 0) | (np.diff(i[order]) != 0)][: len(order)]
        i, j, s = i[order][first], j[order][first], s[order][first]
        best = _top(j, i, s, self.k)
        return i[best], j[best], s[best]

    def back(self) -> _Found:
        """With ``mutual``, (member, query, similarity): for every member the k best of all queries so far."""
        if not self._back:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(0)
        i, j, s = self._merged()
        return self.ids[j], i, s


class _Best:
    """The ``k`` best partners of every vector among all pairs added so far; a pair that comes twice counts once."""

    def __init__(self, k: int):
        self.k, self.fresh, self.kept = k, 0, 0
        self.held: list[_Found] = []

    def add(self, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> None:
        if len(i):
            self.held.append((i, j, s))
            self.fresh += len(i)
            if self.fresh > max(GATHERED, self.kept):
                self.merged()

    def merged(self) -> _Found:
        if not self.held:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(0)
        i, j, s = (np.concatenate(v) for v in zip(*self.held))
        if self.fresh:
            order = np.lexsort((-s, j, i))
            first = np.r_[True, (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)]
            i, j, s = i[order][first], j[order][first], s[order][first]
            best = _top(i, j, s, self.k)
            i, j, s = i[best], j[best], s[best]
        self.held, self.fresh, self.kept = [(i, j, s)], 0, len(i)
        return i, j, s


class Join:
    """Pairs of similarity ``least`` or more among the members of one block, and between them and queries that visit it.

    The block is parted into cells of about ``fine`` members. Members and visitors alike have one of these as home and look
    from there across borders, as in the whole table: members at members and visitors, visitors at members.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, least: float, fine: int = FINE, many_looks: float = MANY_LOOKS):
        self.k, self.least, self.many_looks = k, least, many_looks
        self.radius = np.float32(np.sqrt(max(0.0, 2 - 2 * least)))
        cells = int(max(1, round(len(ids) / fine)))
        some = np.random.default_rng(_SEED).choice(len(ids), min(len(ids), PER_LEAF * cells), replace=False)
        self.centres = centroids(x[some], cells) if cells > 1 else x[:1]
        self.half = 0.5 * (self.centres * self.centres).sum(axis=1)
        self.gap = np.stack([np.linalg.norm(self.centres - c, axis=1) for c in self.centres])
        self.ids, self.x, self.own, self.start = self._arranged(ids, x)
        self.best = _Best(k)
        self.done = False

    def _arranged(self, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, vectors, cells, first of each cell), by cell."""
        own = np.zeros(len(ids), dtype=np.int64)
        if len(self.centres) > 1:
            for a in range(0, len(x), 4 * _SCORED):
                own[a : a + 4 * _SCORED] = (x[a : a + 4 * _SCORED] @ self.centres.T - self.half).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        own = own[order]
        return ids[order], x[order], own, np.searchsorted(own, np.arange(len(self.centres) + 1))

    def _looks(self, x: np.ndarray, own: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the further cells whose border lies within ``limit``."""
        rows, cells = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for a in range(0, len(x) if len(self.centres) > 1 else 0, _SCORED):
            b = slice(a, a + _SCORED)
            score = x[b] @ self.centres.T - self.half
            at = np.arange(len(score))
            near = score[at, own[b], None] - score <= limit[b, None] * self.gap[own[b]] + np.float32(1e-5)
            near[at, own[b]] = False
            i, c = np.nonzero(near)
            rows.append((i + a).astype(np.int32))
            cells.append(c.astype(np.int32))
        return np.concatenate(rows), np.concatenate(cells)

    def _pairs(self, q: np.ndarray, qids: np.ndarray, row: np.ndarray, cell: np.ndarray, ids: np.ndarray, x: np.ndarray, start: np.ndarray) -> Iterator[_Found]:
        """(query, partner, similarity) of rows of ``q`` with the vectors of ``x`` at home in cells they look into: all that may be one of the k best of either."""
        order = np.argsort(cell, kind="stable")
        key, first = np.unique(cell[order], return_index=True)
        for c, a, b in zip(key, first, np.r_[first[1:], len(order)]):
            pieces = [slice(m, min(start[c + 1], m + _SCORED)) for m in range(start[c], start[c + 1], _SCORED)]
            for lo, piece in itertools.product(range(a, b, 4 * _AT_ONCE), pieces):
                theirs, their = x[piece], ids[piece]
                mine = row[order[lo : min(b, lo + 4 * _AT_ONCE)]]
                part = q[mine]
                near = part @ theirs.T
                possible = near >= np.float32(self.least - _ROUNDING)
                many = int(np.count_nonzero(possible))
                if not many:
                    continue
                if many > 4 * (self.k + 1) * sum(possible.shape):  # one place for a vector itself
                    for axis in (0, 1):
                        kk = max(0, near.shape[axis] - self.k - 1)
                        level = np.expand_dims(np.take(np.partition(near, kk, axis=axis), kk, axis=axis), axis) - np.float32(2 * _ROUNDING)
                        wanted = near >= level if axis == 0 else wanted | (near >= level)
                    possible &= wanted
                i, j = np.nonzero(possible)
                i, j = (v[qids[mine[i]] != their[j]] for v in (i, j))
                # never as a product of matrices, whose last digits differ from place to place and would part equal vectors
                exact = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", part[i[n : n + HANDED]].astype(np.float64), theirs[j[n : n + HANDED]].astype(np.float64)) for n in range(0, len(i), HANDED))])
                good = exact >= self.least - 1e-9
                yield qids[mine[i[good]]], their[j[good]], exact[good]

    def _reach(self, ids: np.ndarray, best: _Best) -> np.ndarray:
        """Distance of the k-th neighbour found so far, the radius where there are fewer."""
        i, _, s = best.merged()
        reach = np.full(len(ids), self.radius, dtype=np.float32)
        whose, start, count = np.unique(i, return_index=True, return_counts=True)
        if len(whose):
            far = np.sqrt(np.maximum(2 - 2 * np.minimum.reduceat(s, start), 0)) + 1e-6
            full = count == self.k
            order = np.argsort(ids, kind="stable")
            reach[order[np.searchsorted(ids[order], whose[full])]] = np.minimum(self.radius, far[full])
        return reach

    def run(self) -> _Found:
        """Every member with its k best of the block."""
        if not self.done:
            self.done = True
            mine = self.ids, self.x, self.start
            for i, j, s in self._pairs(self.x, self.ids, np.arange(len(self.ids)), self.own, *mine):
                self.best.add(i, j, s)
            some = slice(None, None, max(1, len(self.x) // 2000))
            few = self.x[some]
            self.dense = len(self._looks(few, self.own[some], np.full(len(few), self.radius / 2, dtype=np.float32))[0]) > self.many_looks * len(few)
            limit = self._reach(self.ids, self.best) if self.dense else np.full(len(self.x), self.radius / 2, dtype=np.float32)
            self.look = self._looks(self.x, self.own, limit)
            for i, j, s in self._pairs(self.x, self.ids, *self.look, *mine):
                self.best.add(i, j, s)
                self.best.add(j, i, s)
        return self.best.merged()

    def visit(self, ids: np.ndarray, x: np.ndarray) -> _Found:
        """Every visitor with its k best of the block; what the members find among visitors is kept."""
        self.run()
        ids, x, own, start = self._arranged(ids, x)
        found = _Best(self.k)
        for i, j, s in self._pairs(x, ids, np.arange(len(ids)), own, self.ids, self.x, self.start):
            found.add(i, j, s)
            self.best.add(j, i, s)
        limit = self._reach(ids, found) if self.dense else np.full(len(x), self.radius / 2, dtype=np.float32)
        for i, j, s in self._pairs(x, ids, *self._looks(x, own, limit), self.ids, self.x, self.start):
            found.add(i, j, s)
            self.best.add(j, i, s)
        for i, j, s in self._pairs(self.x, self.ids, *self.look, ids, x, start):
            self.best.add(i, j, s)
            found.add(j, i, s)
        return found.merged()


def wide_cell(total: int, cores: int) -> int:
    """Vectors aimed at in a wide cell: eight cells a core, of ``CELL`` to ``WIDE`` vectors."""
    return int(min(WIDE, max(CELL, total / (8 * cores))))


def own_blocks(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Block of each member among the ``blocks`` of its cell; ids are mixed, as they may all be multiples of one number."""
    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed % blocks.astype(np.uint64)).astype(np.int64)


def _top(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of every ``a``, ties to the smaller ``b``."""
    order = np.lexsort((b, -s, a))
    key = a[order]
    start = np.r_[True, key[1:] != key[:-1]]
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    return order[rank < k]


def _vectors(table: pa.Table, role: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = table.filter(pc.equal(table.column("role"), role)) if table.num_rows else table
    ids = own.column("vec_id").to_numpy()
    raw = b"".join(own.column("x").to_pylist())
    x = np.frombuffer(raw, dtype=np.float32).reshape(-1, dims)
    ids, first = np.unique(ids, return_index=True)
    return ids, x[first]


def _dims(vectors: DataFrame) -> tuple[int, int]:
    """(most frequent length of the non-empty arrays, 0 without any; number of rows)."""
    lengths = vectors.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.agg(F.max_by("size", F.when(F.col("size") > 0, F.struct("n", "size"))).alias("dims"), F.sum("n").alias("total")).first()
    return top["dims"] or 0, top["total"] or 0


def hot_classes(vectors: DataFrame, copies: int = HOT_COPIES) -> DataFrame:
    """(h1, h2, n): hashes and sizes of classes of equal vectors with more than ``copies`` rows; at most rows / copies."""
    hashed = vectors.select(F.xxhash64("x").alias("h1"), F.hash("x").alias("h2"))
    return hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > copies)


def usable(dims: int) -> Column:
    """The rule of ``unit_rows`` on column ``x``: ``dims`` finite values, not all zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return (F.size("x") == dims) & F.forall("x", finite) & F.exists("x", lambda v: v != 0)


def _split_hot(vectors: DataFrame, k: int, copies: int, dims: int) -> tuple[DataFrame, DataFrame | None]:
    """(vectors to search, pairs inside hot classes): of a hot class only the first k + 1 members are searched.

    Hot classes of arrays that are no vectors are left out whole.
    """
    hot = materialise(hot_classes(vectors, copies))
    if hot.isEmpty():
        return vectors, None
    hashed = vectors.withColumns({"h1": F.xxhash64("x"), "h2": F.hash("x")})
    members = materialise(hashed.join(hot, ["h1", "h2"]).filter(usable(dims)).select("h1", "h2", "n", "vec_id", "x"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / 5000)))
    firsts = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    part = salted.groupBy("h1", "h2", "salt").agg(firsts(F.collect_set("vec_id")).alias("v"))
    first = materialise(part.groupBy("h1", "h2").agg(firsts(F.flatten(F.collect_list("v"))).alias("first")))
    kept = members.join(first, ["h1", "h2"]).filter(F.array_contains("first", F.col("vec_id"))).select("vec_id", "x")
    rest = hashed.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").select("vec_id", "x")
    inside = members.select("h1", "h2", "vec_id").distinct().join(first, ["h1", "h2"])
    others = F.slice(F.filter("first", lambda v: v != F.col("vec_id")), 1, k)
    pairs = inside.select("vec_id", F.explode(others).alias("other"), F.lit(1.0).alias("similarity"))
    return rest.unionByName(kept), pairs


def fit_tree(searched: DataFrame, sample: np.ndarray, total: int, dims: int, cell: int = CELL, fan: int = FAN) -> Tree:
    """Cells for ``total`` vectors. One node's leaves are fitted on the sample; more nodes are, and their leaves on ``PER_LEAF`` vectors each."""
    cells = int(max(1, round(total / cell)))
    if cells <= fan:
        return Tree(np.zeros((1, dims), dtype=np.float32), [centroids(sample, int(max(1, min(cells, len(sample) / 8))))])
    nodes = centroids(sample, int(min(-(-cells // fan), max(1, len(sample) // 8))))
    shared = searched.sparkSession.sparkContext.broadcast(nodes)
    keep = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < int(min(1.0, PER_LEAF * cells / total) * 1_000_000)

    def node_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            ids, x = unit_rows(batch.column("vec_id").to_numpy(), batch.column("x"), dims)
            node = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array([v.tobytes() for v in x], pa.binary())], names=["node", "x"])

    def leaves_of(key: tuple, group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), dtype=np.float32).reshape(-1, dims)
        c = centroids(x, max(1, round(len(x) / PER_LEAF)))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int32()), "leaves": pa.array([c.tobytes()], pa.binary())})

    picked = searched.filter(keep).mapInArrow(node_of, "node int, x binary")
    rows = hashed(picked, "node", size=PER_LEAF * cells * dims * 4).groupBy("node").applyInArrow(leaves_of, "node int, leaves binary").toArrow()  # the centroids only
    fitted = {n: np.frombuffer(v, dtype=np.float32).reshape(-1, dims) for n, v in zip(rows.column("node").to_pylist(), rows.column("leaves").to_pylist())}
    return Tree(nodes, [fitted.get(i, nodes[i : i + 1]) for i in range(len(nodes))])


def _sampled(searched: DataFrame, total: int, dims: int) -> np.ndarray:
    keep = min(1.0, 1.2 * SAMPLE / total)
    picked = searched.filter(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000)) < int(keep * 1_000_000)).limit(SAMPLE).toArrow()
    return unit_rows(picked.column("vec_id").to_numpy(), _list_array(picked.column("x")), dims)[1]


def _binary(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * x.shape[1] * 4).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _read(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float32).reshape(-1, dims)


_NOTHING = "vec_id long, other long, similarity double, rank int"


def neighbours(vectors: DataFrame, k: int, least: float | None = None, queries: DataFrame | None = None, vec_id: str = "vec_id", values: str = "detector_values", copies: int = HOT_COPIES, cell: int | None = None, fan: int = FAN, many_looks: float = MANY_LOOKS, most_cells: int = MOST_CELLS, shorter: float = SHORTER, fine: int = FINE) -> DataFrame:
    """(vec_id, other, similarity, rank): the k vectors most similar in cosine to every vector, or to every row of ``queries``.

    With ``least``, only partners of at least that cosine, and none of them is lost to the choice of cells.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(values).cast("array<float>").alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    rows, asked = plain(vectors), None if queries is None else plain(queries)
    dims, total = _dims(rows)
    if not dims:
        return spark.createDataFrame([], _NOTHING)
    searched, inside = _split_hot(rows, k, copies, dims)
    sample = _sampled(searched, total, dims)
    if not len(sample):
        return spark.createDataFrame([], _NOTHING)
    joined = least is not None and asked is None
    block = BLOCK
    if cell is None:
        cell = wide_cell(total, spark.sparkContext.defaultParallelism) if joined else CELL
        block = max(BLOCK, 2 * cell) if joined else BLOCK
    settings = {"k": k, "least": least, "cell": cell, "block": block, "fan": fan, "fine": fine, "many_looks": many_looks, "shorter": shorter}
    if total / cell > most_cells:
        pairs = _in_parts(searched, asked, sample, total, dims, most_cells, settings)
    else:
        pairs = _search(searched, asked, sample, total, dims, **settings)
    if inside is not None:
        pairs = pairs.unionByName(inside if asked is None else inside.join(asked.select("vec_id"), "vec_id", "left_semi"))
    # dealt by vec_id once, which serves both steps
    best = pairs.repartition("vec_id").groupBy("vec_id", "other").agg(F.max("similarity").alias("similarity"))
    order = F.struct((-F.col("similarity")).alias("d"), "other")
    listed = best.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))
    flat = listed.select("vec_id", F.posexplode("top").alias("rank", "t"))
    return flat.select("vec_id", F.col("t.other").alias("other"), (-F.col("t.d")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def _in_parts(searched: DataFrame, asked: DataFrame | None, sample: np.ndarray, total: int, dims: int, most_cells: int, settings: dict) -> DataFrame:
    """Pairs of a table too large for one tree: parts around centroids, each with the vectors as near beyond its borders as a partner can lie.

    Without a least similarity that is the share ``shorter`` of the distance of the k-th neighbours within the sample,
    which lie further apart than those of the whole table.
    """
    spark = searched.sparkSession
    k, least = settings["k"], settings["least"]
    c = centroids(sample, max(2, int(np.ceil(2 * total / settings["cell"] / most_cells))))
    if least is None:
        few = sample[:256]
        near = np.partition(few @ sample.T, -min(k + 1, len(sample)), axis=1)[:, -min(k + 1, len(sample))]
        reach = settings["shorter"] * float(np.sqrt(np.maximum(2 - 2 * near, 0)).max())
    else:
        reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    shared = spark.sparkContext.broadcast(Tree(np.zeros((1, dims), dtype=np.float32), [c]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            ids, x = unit_rows(batch.column("vec_id").to_numpy(), batch.column("x"), dims)
            node, own = tree.home(x)
            limit = np.full(len(x), reach, dtype=np.float32)
            at, other = tree.looks(x, node, own, limit, limit)
            row, part, home = np.concatenate([np.arange(len(x)), at]), np.concatenate([own, other]), np.r_[np.ones(len(x), dtype=bool), np.zeros(len(at), dtype=bool)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * dims), pa.array(x[row].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), lists, pa.array(home), pa.array(part.astype(np.int32))], names=["vec_id", "x", "home", "part"])

    dealt = materialise(searched.mapInArrow(deal, "vec_id long, x array<float>, home boolean, part int"), ["part"])
    found = None
    for part in range(len(c)):
        own = dealt.filter(F.col("part") == part).select("vec_id", "x", "home")
        wanted = own.filter("home").select("vec_id", "x")
        wanted = wanted if asked is None else wanted.join(asked.select("vec_id").distinct(), "vec_id", "left_semi")
        size = own.count()
        picked = _sampled(own.select("vec_id", "x"), max(size, 1), dims)
        if len(picked):
            pairs = materialise(_search(own.select("vec_id", "x"), wanted, picked, size, dims, **settings))
            found = pairs if found is None else found.unionByName(pairs)
    return found


def _search(searched: DataFrame, asked: DataFrame | None, sample: np.ndarray, total: int, dims: int, k: int, least: float | None, cell: int, block: int, fan: int, fine: int, many_looks: float, shorter: float) -> DataFrame:
    """(vec_id, other, similarity): pairs among which the k best of every query are."""
    spark = searched.sparkSession
    wide = spread(searched)
    tree = fit_tree(searched, sample, total, dims, cell, fan)
    turn = rotation(dims, max(dims, BITS if least is not None else MORE_BITS))
    planted = spark.sparkContext.broadcast(tree)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = planted.value
        n = np.zeros(len(t), dtype=np.int64)
        for batch in batches:
            _, x = unit_rows(batch.column("vec_id").to_numpy(), batch.column("x"), dims)
            n += np.bincount(t.home(x)[1], minlength=len(t))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full])], names=["cell", "n"])

    counted = wide.mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most MOST_CELLS rows of 12 bytes
    held = np.zeros(len(tree), dtype=np.int64)
    held[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    # every cell by its own size, so that no task holds more than a block of members
    shared = spark.sparkContext.broadcast((tree, turn, held, np.maximum(-(-held // block), 1)))
    radius = None if least is None else float(np.sqrt(max(0.0, 2 - 2 * least)))
    all_query = asked is None
    joined = all_query and least is not None
    some = sample[:5000]
    full = lambda v: np.full(len(some), v, dtype=np.float32)
    measured = not all_query or radius is None or len(tree.looks(some, *tree.home(some), full(radius / 2), full(radius))[0]) > many_looks * len(some)

    def rows(cells_: np.ndarray, block: np.ndarray, role: int, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(ids), HANDED):
            b = slice(a, a + HANDED)
            n = len(ids[b])
            yield pa.RecordBatch.from_arrays([pa.array(cells_[b].astype(np.int32)), pa.array(block[b].astype(np.int32)), pa.array(np.full(n, role, dtype=np.int8)), pa.array(ids[b]), _binary(x[b])], schema=_ROWS)

    def at_home(batches: Iterator[pa.RecordBatch], role: int) -> Iterator[pa.RecordBatch]:
        """Each vector in its own block of its own cell."""
        t, _, _, blocks = shared.value
        for batch in batches:
            ids, x = unit_rows(batch.column("vec_id").to_numpy(), batch.column("x"), dims)
            own = t.home(x)[1]
            yield from rows(own, own_blocks(ids, blocks[own]), role, ids, x)

    def looking(ids: np.ndarray, x: np.ndarray, reach: np.ndarray, across: np.ndarray, home: tuple[np.ndarray, np.ndarray], with_own: bool) -> Iterator[pa.RecordBatch]:
        """Queries in the blocks of their own cell and of those they look into; a member is a query of its own block already."""
        t, _, _, blocks = shared.value
        node, own = home
        at, other = t.looks(x, node, own, reach, across)
        cell_of, row_of = np.concatenate([own, other]), np.concatenate([np.arange(len(ids)), at])
        times = blocks[cell_of]
        upto = np.cumsum(times)
        lo = 0
        while lo < len(times):  # a bounded number of rows at once, however many blocks there are
            before = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, before + HANDED, "right")))
            look = np.repeat(np.arange(lo, hi), times[lo:hi])
            b = np.arange(len(look)) - np.repeat(upto[lo:hi] - times[lo:hi] - before, times[lo:hi])
            if not with_own:
                away = (look >= len(ids)) | (b != own_blocks(ids[row_of[look]], blocks[cell_of[look]]))
                look, b = look[away], b[away]
            yield from rows(cell_of[look], b, 1, ids[row_of[look]], x[row_of[look]])
            lo = hi

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members that look from both sides of every border."""
        t, _, _, blocks = shared.value
        for batch in batches:
            ids, x = unit_rows(batch.column("vec_id").to_numpy(), batch.column("x"), dims)
            home = t.home(x)
            yield from rows(home[1], own_blocks(ids, blocks[home[1]]), 0, ids, x)
            limit = np.full(len(x), radius, dtype=np.float32)
            yield from looking(ids, x, limit / 2, limit, home, False)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries that know how far they have to look; NaN where the own cell holds too few vectors to tell."""
        t, _, held, _ = shared.value
        for batch in batches:
            ids, x, reach = batch.column("vec_id").to_numpy(), _read(batch, dims), batch.column("reach").to_numpy(zero_copy_only=False).astype(np.float32)
            node, own = t.home(x)
            for i in np.flatnonzero(np.isnan(reach)):  # as far as the centres of enough vectors
                far = np.linalg.norm(t.leaves[node[i]] - x[i], axis=1)
                order = np.argsort(far)
                enough = np.searchsorted(np.cumsum(held[t.first[node[i]] + order]), k + 1)
                reach[i] = far[order[enough]] if enough < len(order) else _WIDEST
            yield from looking(ids, x, reach, reach, (node, own), not all_query)

    def split(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Search | Join, pa.Table | None]]:
        """The search in a block with the queries that visit it, some batches at a time; members come first, as rows are sorted by role."""
        t, turn, _, _ = shared.value
        members: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        found: Search | Join | None = None

        def begin() -> Search | Join:
            ids, x = _vectors(pa.Table.from_batches(members, schema=members[0].schema), 0, dims)
            members.clear()
            if joined:
                return Join(ids, x, k, least, fine, many_looks)
            return Search(ids, x, t.centres[key[0].as_py()], turn, k, least, all_query)

        for batch in batches:
            role = batch.column("role").to_numpy()
            if (role == 0).any():
                assert found is None, "members come before queries"
                members.append(batch.filter(pa.array(role == 0)))
            if (role == 1).any() and (members or found is not None):
                if found is None:
                    found = begin()
                    yield found, None
                waiting.append(batch)
                if not joined or sum(w.num_rows for w in waiting) >= max(len(found.ids), HANDED):
                    yield found, pa.Table.from_batches(waiting)
                    waiting = []
        if found is None and members:
            yield begin(), None
        elif waiting:
            yield found, pa.Table.from_batches(waiting)

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda v: pa.RecordBatch.from_arrays([pa.array(v[0]), pa.array(v[1]), pa.array(v[2])], schema=_PAIRS)
        found: Search | Join | None = None
        for found, visitors in split(key, batches):
            if visitors is not None:
                queries = _vectors(visitors, 1, dims)
                yield from map(out, [found.visit(*queries)] if joined else found.run(*queries))
            elif all_query and not joined:
                yield from map(out, found.run(found.ids, found.x))
        if found is not None and all_query:
            yield out(found.run() if joined else found.back())

    def measure(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the distance to look within, from the k nearest in their own block."""
        for found, visitors in split(key, batches):
            if visitors is not None:
                ids, x = _vectors(visitors, 1, dims)
                yield _reached(found.run(ids, x), ids, x, k, radius, shorter)
            elif joined:
                yield _reached([found.run()], found.ids, found.x, k, radius, shorter)
            elif all_query:
                found.mutual = False
                yield _reached(found.run(found.ids, found.x), found.ids, found.x, k, radius, shorter)

    by_block = lambda df, rows_: hashed(df, "cell", "block", size=rows_ * (dims * 4 + 24)).sortWithinPartitions("cell", "block", "role").groupBy("cell", "block")
    if not measured:
        placed = wide.mapInArrow(both, _ROWS_SQL)
    elif all_query:
        home = materialise(wide.mapInArrow(lambda it: at_home(it, 0), _ROWS_SQL))
        limits = by_block(home, total).applyInArrow(measure, _REACHED_SQL)
        placed = home.unionByName(limits.mapInArrow(reached, _ROWS_SQL))
    else:
        home = materialise(wide.mapInArrow(lambda it: at_home(it, 0), _ROWS_SQL))
        limits = by_block(home.unionByName(spread(asked).mapInArrow(lambda it: at_home(it, 1), _ROWS_SQL)), total).applyInArrow(measure, _REACHED_SQL)
        placed = home.unionByName(limits.mapInArrow(reached, _ROWS_SQL))
    return by_block(placed, 6 * total).applyInArrow(search, _PAIRS_SQL)


def _reached(found: Iterable[_Found], ids: np.ndarray, x: np.ndarray, k: int, radius: float | None, shorter: float) -> pa.RecordBatch:
    a, _, s = (np.concatenate(v) for v in zip(*found))
    reach = np.full(len(ids), np.nan if radius is None else radius, dtype=np.float64)
    which, count = np.unique(a, return_counts=True)
    full = np.isin(a, which[count == k])
    if full.any():
        order = np.argsort(a[full], kind="stable")
        whose, start = np.unique(a[full][order], return_index=True)
        far = np.sqrt(np.maximum(2 - 2 * np.minimum.reduceat(s[full][order], start), 0))
        by_id = np.argsort(ids, kind="stable")
        reach[by_id[np.searchsorted(ids[by_id], whose)]] = shorter * far if radius is None else np.minimum(radius, far + 1e-6)
    return pa.RecordBatch.from_arrays([pa.array(ids), _binary(x), pa.array(reach)], schema=_REACHED)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.99) -> DataFrame:
    """Distinct (vec_a, vec_b), vec_a < vec_b, of cosine ``least`` or more, one among the k most similar of the other."""
    near = neighbours(vectors, k, least)
    return near.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
