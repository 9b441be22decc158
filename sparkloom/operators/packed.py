"""Triangles by sorted lists that travel packed, between parts of a graph that are ranges of its vertices.

1. Vertices are ordered: those of few edges by id, and after them the few of many edges by degree and id, so that a vertex has
   at most about ``sqrt(2 E)`` edges to later ones. An edge goes from its earlier end to its later one.
2. The order is cut into parts of about as many edges. A part holds the sorted lists of its vertices, and sends a list to each
   other part that has vertices of it, once a part and not once an edge, and only from the first of these vertices on.
3. A part meets its own lists and those it was sent: the list of ``u`` is marked, and the lists of the ``v`` in it are looked
   up in the marks. What is marked is a triangle ``u, v, w``, found once, in the part of ``v``.
4. Numbers a side of a triangle gets go to the part of the side's earlier end.
5. All triangles of an edge with both ends in a part are found in that part.

Lists are coded as differences in as few bytes as they need, some three bytes an edge. No wedge is sent, stored or held beyond
a step of ``WEDGES``. On the driver are the vertices of many edges, at most ``4 sqrt(2 E)``, and the bounds of the parts.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.shared import cut, discard

#: Ends of edges in a part: most, and least where cores would idle.
MOST, LEAST = 1 << 21, 200_000
#: Edges, or entries of lists, in a packed row; wedges looked up in a step; cells of the marks.
ROW, WEDGES, CELLS = 1 << 18, 1 << 19, 1 << 22
#: Parts that the triples of a part are dealt into, when they are sorted by their sides.
SHARES = 8
#: Triangles that a part may hold besides two an edge.
HELD = 1 << 20

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned 64-bit arrays of one length as differences of as few bytes as the largest needs."""
    out = [struct.pack("<Q", len(arrays[0]))]
    for x in arrays:
        step = np.diff(x, prepend=x[:1]).view(np.int64)
        step = ((step << 1) ^ (step >> 63)).view(np.uint64)
        top = int(step.max()) if len(step) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        out += [struct.pack("<QB", int(x[0]) if len(x) else 0, width), step.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<Q", raw), 8, []
    while at < len(raw):
        first, width = struct.unpack_from("<QB", raw, at)
        step = np.frombuffer(raw, f"<u{width}", n, at + 9).astype(np.uint64)
        step = (step >> np.uint64(1)) ^ (np.uint64(0) - (step & np.uint64(1)))
        out.append(np.cumsum(step, dtype=np.uint64) + np.uint64(first))
        at += 9 + n * width
    return out


def joined(packed: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpack, packed), strict=True)]


@dataclass
class Order:
    """Places of vertices, and the parts the places are cut into."""

    low: int
    span: int
    heavy: np.ndarray  # ids in order
    bounds: np.ndarray  # places at which a part begins, without the first

    @property
    def parts(self) -> int:
        return len(self.bounds) + 1

    def places(self, ids: np.ndarray) -> np.ndarray:
        out = ids.view(np.uint64) - np.uint64(self.low % (1 << 64))
        if len(self.heavy):
            rank = np.argsort(self.heavy)
            at = rank[np.minimum(np.searchsorted(self.heavy, ids, sorter=rank), len(rank) - 1)]
            out = np.where(self.heavy[at] == ids, np.uint64(self.span + 1) + at.astype(np.uint64), out)
        return out

    def ids(self, places: np.ndarray) -> np.ndarray:
        out = (places + np.uint64(self.low % (1 << 64))).view(np.int64)
        late = places > np.uint64(self.span)
        if late.any():
            out[late] = self.heavy[(places[late] - np.uint64(self.span + 1)).astype(np.int64)]
        return out

    def part(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, side="right")

    def inner(self, part: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Which edges ``u, v``, with ``u`` the earlier, have both ends in the part."""
        out = u >= self.bounds[part - 1] if part else np.ones(len(u), bool)
        return out & (v < self.bounds[part]) if part < len(self.bounds) else out


def order_of(edges: DataFrame) -> Order | None:
    """The order of the vertices of ``a, b``, as long integers; None without edges."""
    degrees = cut(edges.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("d")), "degrees")
    ends, low, high, n = degrees.agg(F.sum("d"), F.min("x"), F.max("x"), F.count("*")).first()
    if not ends:
        discard(degrees)
        return None
    many = math.isqrt(ends) // 4 + 1  # at most 4 sqrt(2 E) vertices have more edges
    heavy = sorted((r["d"], r["x"]) for r in degrees.where(F.col("d") > many).collect())
    if high - low + len(heavy) >= 1 << 64:
        heavy = []  # no places are left for them
    share = max(min(ends // (4 * edges.sparkSession.sparkContext.defaultParallelism), MOST), LEAST)
    light = degrees.where(F.col("d") <= many) if heavy else degrees
    bounds, parts = set(), math.ceil(ends / share)
    if parts > 1:
        # a vertex counts as often as its share of the mean degree, so that parts have about as many ends
        weighed = light.select(F.explode(F.array_repeat("x", F.ceil(F.col("d") / (ends / n)).cast("int"))).alias("x"))
        cuts = weighed.agg(F.percentile_approx("x", [k / parts for k in range(1, parts)], 100 * parts).alias("x")).first()["x"]
        bounds = {x - low for x in cuts or [] if x > low}
    total = 0
    for k, (d, _) in enumerate(heavy):
        total += min(d, len(heavy) - k)
        if not k or total > share:
            bounds.add(high - low + 1 + k)
            total = 0
    discard(degrees)
    return Order(low, high - low, np.array([x for _, x in heavy], np.int64), np.array(sorted(bounds), np.uint64))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def batch_of(kinds: dict[str, pa.DataType], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def in_order(*keys: np.ndarray) -> np.ndarray | slice:
    """What sorts by the keys, the last of which counts first."""
    if len(keys) == 2:
        b, a = keys
        if np.all((a[1:] > a[:-1]) | (a[1:] == a[:-1]) & (b[1:] >= b[:-1])):
            return slice(None)
        low, width = b.min(), int(b.max()) - int(b.min()) + 1
        if (int(a.max()) - int(a.min()) + 1) * width < 1 << 64:
            return np.argsort((a - a.min()) * np.uint64(width) + (b - low), kind="stable")
    return np.lexsort(keys)


def spread(packed: DataFrame, order: Order, key: str, *more: str) -> DataFrame:
    """Rows of one part in one task, in order."""
    return packed.repartitionById(order.parts, key).sortWithinPartitions(key, *more)


def lists_of(edges: DataFrame, order: Order, value: str | None = None) -> DataFrame:
    """``q, foreign, p, blob``: the lists that each part ``q`` meets, its own first; those of repeated edges add their values."""
    to_part = {"part": pa.int32(), "blob": pa.binary()}

    def deal(batches):
        held, n = [], 0

        def flush():
            a, b, *val = (np.concatenate(x) for x in zip(*held, strict=True))
            x, y = order.places(a), order.places(b)
            u, v = np.minimum(x, y), np.maximum(x, y)
            by = in_order(v, u)
            arrays = [z[by] for z in (u, v, *[w.astype(np.uint64) for w in val])]
            at = np.searchsorted(arrays[0], order.bounds)
            for p, (i, j) in enumerate(zip([0, *at], [*at, len(u)], strict=True)):
                if i < j:
                    yield batch_of(to_part, [p], [pack(*[z[i:j] for z in arrays])])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= 4 * ROW:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    to_parts = {"q": pa.int32(), "foreign": pa.bool_(), "p": pa.int32(), "blob": pa.binary()}

    def send(batches):
        for p, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            u, v, *val = joined([r[1] for r in rows])
            by = in_order(v, u)
            u, v, *val = (z[by] for z in (u, v, *val))
            new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
            u, v, val = u[new], v[new], [np.add.reduceat(z, new) for z in val]
            arrays = [u, v, *val]
            for i in range(0, len(u), ROW):
                yield batch_of(to_parts, [p], [False], [p], [pack(*[z[i : i + ROW] for z in arrays])])
            first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            last = np.append(first[1:], len(u))
            end = np.repeat(last, last - first)
            part = order.part(v)
            # entries at which a list enters another part, and goes on
            enter = np.concatenate(([True], (part[1:] != part[:-1]) | (u[1:] != u[:-1]))) & (part != p) & (end - np.arange(len(u)) > 1)
            enter = np.flatnonzero(enter)
            enter = enter[np.argsort(part[enter], kind="stable")]
            for q in np.unique(part[enter]).tolist():
                some = enter[slice(*np.searchsorted(part[enter], [q, q + 1]))]
                sizes = end[some] - some
                upto = np.cumsum(sizes)
                i = 0
                while i < len(some):
                    j = max(i + 1, int(np.searchsorted(upto, upto[i] - sizes[i] + ROW, side="right")))
                    k = np.repeat(some[i:j] - (np.cumsum(sizes[i:j]) - sizes[i:j]), sizes[i:j]) + np.arange(sizes[i:j].sum())
                    yield batch_of(to_parts, [q], [True], [p], [pack(*[z[k] for z in arrays])])
                    i = j

    fields = ["a", "b", *([value] if value else [])]
    plain = edges.select(*[F.col(c).cast("long") for c in fields]).where("a <> b")
    dealt = spread(plain.mapInArrow(deal, "part int, blob binary"), order, "part")
    return spread(dealt.mapInArrow(send, "q int, foreign boolean, p int, blob binary"), order, "q", "foreign")


class Part:
    """The lists of a part's vertices, met by other lists."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.u, self.v = u, v
        self.heads, self.first = np.unique(u, return_index=True)
        self.size = np.diff(np.append(self.first, len(u)))
        self.domain = np.unique(v)
        self.far = np.searchsorted(self.domain, v)
        self.rows = max(1, CELLS // len(self.domain))
        self.mark = np.zeros(self.rows * len(self.domain), bool)
        self.place = np.zeros(len(self.mark), np.int32)

    def met(self, u: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of triangles ``u, v, w`` the places: of ``u, v`` in the lists given, ``v, w`` in the part's, ``u, w`` in those given."""
        n = len(self.domain)
        at = np.minimum(np.searchsorted(self.heads, x), len(self.heads) - 1)
        size = np.where(self.heads[at] == x, self.size[at], 0)
        local = np.minimum(np.searchsorted(self.domain, x), n - 1)
        known = self.domain[local] == x
        new = np.concatenate(([True], u[1:] != u[:-1]))
        number = np.cumsum(new) - 1
        begin = np.append(np.flatnonzero(new), len(u))
        pick = np.flatnonzero(size)
        upto, of_list = np.cumsum(size[pick]), number[pick]
        i = 0
        while i < len(pick):
            j = int(np.searchsorted(upto, upto[i] - size[pick[i]] + WEDGES, side="right"))
            j = max(i + 1, min(j, int(np.searchsorted(of_list, of_list[i] + self.rows))))
            e, low = pick[i:j], of_list[i]
            s, t = begin[low], begin[of_list[j - 1] + 1]
            entry = np.flatnonzero(known[s:t]) + s
            cell = (number[entry] - low) * n + local[entry]
            self.mark[cell] = True
            sizes = size[e]
            ends = np.cumsum(sizes)
            k = np.repeat(self.first[at[e]] - (ends - sizes), sizes) + np.arange(ends[-1])
            key = np.repeat((of_list[i:j] - low) * n, sizes) + self.far[k]
            hit = np.flatnonzero(self.mark[key])
            if len(hit):
                self.place[cell] = entry
                yield e[np.searchsorted(ends, hit, side="right")], k[hit], self.place[key[hit]]
            self.mark[cell] = False
            i = j


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part, list, Iterator[tuple[int, list, list]]]]:
    """For each part: its number, its lists, their values, and all lists it meets with the part they are of and their values."""
    for q, rows in groupby(rows_of(batches), key=lambda r: r[0]):
        mine, first = [], None
        for row in rows:
            if row[1]:
                first = row
                break
            mine.append(row[3])
        if not mine:
            for _ in rows:
                pass
            continue
        u, v, *val = joined(mine)
        part = Part(u, v)

        def lists(q=q, u=u, v=v, val=val, first=first, rows=rows):
            yield q, [u, v], val
            while first:
                x, y, *more = unpack(first[3])
                yield first[2], [x, y], more
                first = next(rows, None)

        yield q, part, val, lists()


# ---- what is made of the triangles


def numbered(edges: DataFrame, make: Callable[[DataFrame], DataFrame], names: tuple[str, ...]) -> DataFrame:
    """``make`` of the edges with long integers for ids; columns ``names`` of what it gives are ids again."""
    edges, kind = edges.where("a <> b"), dict(edges.dtypes)["a"]
    if kind in INTEGERS:
        out = make(edges.withColumns({c: F.col(c).cast("long") for c in "ab"}))
        return out.select(*[F.col(c).cast(kind).alias(c) if c in names else F.col(c) for c in out.columns])
    from sparkloom.operators.matrix import dense_ids

    ids = cut(dense_ids(edges.select(F.explode(F.array("a", "b")).alias("x")).distinct(), ["x"], "x"), "ids")
    plain = edges
    for c in "ab":
        plain = plain.join(ids.select(F.col("x").alias(c), F.col("place").alias(f"n{c}")), c)
    out = make(cut(plain.select(F.col("na").alias("a"), F.col("nb").alias("b"), *[c for c in edges.columns if c not in "ab"]), "numbered"))
    for c in names:
        out = out.withColumnRenamed(c, f"n{c}").join(ids.select(F.col("x").alias(c), F.col("place").alias(f"n{c}")), f"n{c}").drop(f"n{c}")
    return out.select(*names, *[c for c in out.columns if c not in names])


def none(edges: DataFrame, schema: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([], schema)


def listed(edges: DataFrame) -> DataFrame:
    """``a < b < c`` of each triangle."""
    order = order_of(edges)
    if order is None:
        return none(edges, "a long, b long, c long")
    kinds = dict.fromkeys("abc", pa.int64())

    def run(batches):
        for _, part, _, lists in meetings(batches):
            for _, (u, x), _ in lists:
                for e, k, _ in part.met(u, x):
                    found = np.sort(np.stack([order.ids(z) for z in (u[e], x[e], part.v[k])]), axis=0)
                    for i in range(0, found.shape[1], ROW):
                        yield batch_of(kinds, *found[:, i : i + ROW])

    return lists_of(edges, order).mapInArrow(run, "a long, b long, c long")


def counted(edges: DataFrame, value: str | None = None, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``key, n``: how many triangles have each key that ``weigh`` makes of their sides' values, without it all 0; perhaps in several rows."""
    order = order_of(edges)
    if order is None:
        return none(edges, "key long, n long")
    kinds = {"key": pa.int64(), "n": pa.int64()}

    def run(batches):
        for _, part, (*own,), lists in meetings(batches):
            total: dict[int, int] = {}
            for _, (u, x), val in lists:
                for e, k, t in part.met(u, x):
                    keys, n = np.unique(weigh(val[0][e], own[0][k], val[0][t]), return_counts=True) if weigh else ([0], [len(e)])
                    for key, m in zip(keys, n, strict=True):
                        total[int(key)] = total.get(int(key), 0) + int(m)
            yield batch_of(kinds, list(total), list(total.values()))

    return lists_of(edges, order, value).mapInArrow(run, "key long, n long")


def supported(edges: DataFrame, order: Order | None = None) -> DataFrame:
    """``a, b, triangles`` of each edge that is in one, those of a part together; ``order`` may be that of a larger graph."""
    order = order or order_of(edges)
    if order is None:
        return none(edges, "a long, b long, triangles long")
    to_part = {"part": pa.int32(), "blob": pa.binary()}

    def run(batches):
        for q, part, _, lists in meetings(batches):
            mine = np.zeros(len(part.u), np.uint64)

            def message(p, u, x, n):
                some = np.flatnonzero(n)
                for i in range(0, len(some), ROW):
                    k = some[i : i + ROW]
                    yield batch_of(to_part, [p], [pack(u[k], x[k], n[k])])

            for p, (u, x), _ in lists:
                n = mine if p == q else np.zeros(len(u), np.uint64)
                for e, k, t in part.met(u, x):
                    for to, where in ((mine, k), (n, e), (n, t)):
                        np.add.at(to, where, np.uint64(1))
                if p != q:
                    yield from message(p, u, x, n)
            yield from message(q, part.u, part.v, mine)

    kinds = {"a": pa.int64(), "b": pa.int64(), "triangles": pa.int64()}

    def add(batches):
        for _, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            u, v, n = joined([r[1] for r in rows])
            by = in_order(v, u)
            u, v, n = u[by], v[by], n[by]
            new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
            n = np.add.reduceat(n, new).view(np.int64)
            x, y = order.ids(u[new]), order.ids(v[new])
            for i in range(0, len(new), ROW):
                j = slice(i, i + ROW)
                yield batch_of(kinds, np.minimum(x[j], y[j]), np.maximum(x[j], y[j]), n[j])

    sent = lists_of(edges, order).mapInArrow(run, "part int, blob binary")
    return spread(sent, order, "part").mapInArrow(add, "a long, b long, triangles long")


# ---- peeling, by parts that keep their triangles

#: Rows of what ``peelings`` writes: sides and triangles that are left in a part, edges that are gone, sides' numbers of triangles, and too many triangles.
SIDES, FOUND, GONE, SUMS, OVER = range(5)
PEELED = "part int, kind int, at int, blob binary"
PEELED_KINDS = {"part": pa.int32(), "kind": pa.int32(), "at": pa.int32(), "blob": pa.binary()}


def peel(sides: np.ndarray, size: int, bad: np.ndarray, inner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of triangles, columns of the numbers of their sides, those without a bad side, and how many each side is in; inner sides in fewer than ``least`` go bad."""
    n = sum(np.bincount(s, minlength=size) for s in sides)
    while True:
        go = bad[sides[0]] | bad[sides[1]] | bad[sides[2]]
        if go.any():
            n -= sum(np.bincount(s, minlength=size) for s in sides[:, go])
            sides = sides[:, ~go]
        bad = inner & (n > 0) & (n < least)
        if not bad.any():
            return sides, n


def sums(order: Order, u: np.ndarray, v: np.ndarray, n: np.ndarray, which: np.ndarray, q: int, last: bool = False) -> Iterator[tuple]:
    """Rows that tell the parts of the earlier ends of sides ``u, v`` of part ``q`` in how many of its triangles they are, by their numbers.

    At ``last`` they only tell which sides are in one.
    """
    some = np.flatnonzero(which & (n > 0))
    at = [*np.searchsorted(u[some], order.bounds), len(some)]
    for p, (low, high) in enumerate(zip([0, *at], at, strict=False)):
        for i in range(low, high, ROW):
            k = some[i : min(i + ROW, high)]
            yield p, SUMS, q, pack(u[k], v[k], *([] if last else [n[k].astype(np.uint64), k.astype(np.uint64)]))


def peelings(edges: DataFrame, order: Order, least: int) -> DataFrame:
    """The parts' triangles that are left when inner edges, with both ends in a part, in fewer than ``least`` of them went, and ``SUMS`` of others.

    A part finds all triangles of its inner edges, so these go without a word to others. A part of more than two triangles an
    edge and ``HELD`` gives ``OVER`` in their place.
    """

    def run(batches):
        for q, part, _, lists in meetings(batches):
            found, us, vs, size, n, most = [], [], [], 0, 0, 2 * len(part.u) + HELD
            for p, (u, x), _ in lists:
                hits = [np.stack((e, t, k)) for e, k, t in part.met(u, x)]
                n += sum(h.shape[1] for h in hits)
                if n > most:
                    break
                if p == q:
                    us, vs, size = [u], [x], len(u)
                elif hits:
                    # of others' edges those in triangles
                    some = np.zeros(len(u), bool)
                    for h in hits:
                        some[h[0]] = some[h[1]] = True
                    number = np.cumsum(some) - 1 + size
                    for h in hits:
                        h[:2] = number[h[:2]]
                    us.append(u[some])
                    vs.append(x[some])
                    size += len(us[-1])
                found += [h.astype(np.int32) for h in hits]
            if n > most:
                yield batch_of(PEELED_KINDS, [q], [OVER], [0], [b""])
                continue
            if not n:
                continue
            u, v, sides = np.concatenate(us), np.concatenate(vs), np.concatenate(found, axis=1)
            del us, vs, found
            sides, n = peel(sides, size, np.zeros(size, bool), order.inner(q, u, v), least)
            some = np.flatnonzero(n)
            some = some[in_order(v[some], u[some])]
            number = np.zeros(size, np.int32)
            number[some] = np.arange(len(some))
            u, v, n = u[some], v[some], n[some]
            sides = number[sides]
            i, j, k = sides[:, np.argsort(sides[0], kind="stable")].astype(np.int64)
            # u w by its place after u v, v w by its place in the list of v, so that a triangle takes some three bytes
            places = [z.astype(np.uint64) for z in (i, j - i, k - np.searchsorted(u, v)[i])]
            for kind, arrays in ((SIDES, (u, v)), (FOUND, places)):
                for i in range(0, len(arrays[0]), ROW):
                    yield batch_of(PEELED_KINDS, [q], [kind], [i // ROW], [pack(*[z[i : i + ROW] for z in arrays])])
            for row in sums(order, u, v, n, ~order.inner(q, u, v), q):
                yield batch_of(PEELED_KINDS, *[[x] for x in row])

    return lists_of(edges, order).mapInArrow(run, PEELED)


def peeled(held: DataFrame, order: Order, least: int, last: bool) -> DataFrame:
    """``SUMS`` of sides that are not inner, or at ``last`` of all, once the edges ``GONE`` of rows that ``peelings`` gave have gone."""

    def run(batches):
        for q, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            of = {kind: joined([r[3] for r in some]) for kind, some in groupby(rows, key=lambda r: r[1])}
            if SIDES not in of:
                continue
            u, v = of[SIDES]
            bad = np.zeros(len(u), bool)
            if GONE in of:
                bad[of[GONE][0]] = True
            inner = order.inner(q, u, v)
            i, j, k = (z.astype(np.int32) for z in of.pop(FOUND))
            _, n = peel(np.stack((i, i + j, np.searchsorted(u, v).astype(np.int32)[i] + k)), len(u), bad, inner, least)
            for row in sums(order, u, v, n, ~inner | last, q, last):
                yield batch_of(PEELED_KINDS, *[[x] for x in row])

    return spread(held, order, "part", "kind", "at").mapInArrow(run, PEELED)


def gone(told: DataFrame, order: Order, least: int) -> DataFrame:
    """For each part the numbers of its sides that are in fewer than ``least`` triangles by all ``SUMS`` told."""

    def run(batches):
        for p, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            rows = list(rows)
            u, v, n, k = joined([r[3] for r in rows])
            q = np.repeat([r[2] for r in rows], [struct.unpack_from("<Q", r[3])[0] for r in rows])
            by = in_order(v, u)
            u, v, n, k, q = (z[by] for z in (u, v, n, k, q))
            new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
            few = np.repeat(np.add.reduceat(n, new) < least, np.diff(np.append(new, len(k))))
            for to in np.unique(q[few]).tolist():
                yield batch_of(PEELED_KINDS, [to], [GONE], [p], [pack(np.sort(k[few & (q == to)]))])

    return spread(told.where(F.col("kind") == SUMS), order, "part").mapInArrow(run, PEELED)


def remaining(told: DataFrame, order: Order) -> DataFrame:
    """``a, b`` of the edges in the ``last`` ``SUMS`` told, once."""
    kinds = {"a": pa.int64(), "b": pa.int64()}

    def run(batches):
        for _, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            u, v = joined([r[3] for r in rows])
            by = in_order(v, u)
            u, v = u[by], v[by]
            new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
            x, y = order.ids(u[new]), order.ids(v[new])
            for i in range(0, len(new), ROW):
                j = slice(i, i + ROW)
                yield batch_of(kinds, np.minimum(x[j], y[j]), np.maximum(x[j], y[j]))

    return spread(told, order, "part").mapInArrow(run, "a long, b long")


def cornered(edges: DataFrame) -> DataFrame:
    """``a, b, corners``: of each edge in a triangle the third corners, in order."""
    order = order_of(edges)
    if order is None:
        return none(edges, "a long, b long, corners array<long>")
    to_part = {"part": pa.int32(), "share": pa.int32(), "blob": pa.binary()}

    def run(batches):
        for q, part, _, lists in meetings(batches):
            held: dict[int, list] = {}

            def messages(p, held=held):
                # sides of p's vertices: u v and u w of any triangle, v w only where p is this part
                u, v, w = (np.concatenate(z) for z in zip(*held.pop(p), strict=True))
                share = (u % np.uint64(SHARES)).astype(np.int64)
                for s in np.unique(share).tolist():
                    k = np.flatnonzero(share == s)
                    k = k[np.lexsort((w[k], v[k], u[k]))]
                    yield batch_of(to_part, [p], [s], [pack(u[k], v[k], w[k])])

            def put(p, u, v, w, held=held):
                held.setdefault(p, []).append((u, v, w))
                if sum(len(z[0]) for z in held[p]) >= 4 * ROW:
                    yield from messages(p)

            for p, (u, x), _ in lists:
                for e, k, _ in part.met(u, x):
                    a, b, c = u[e], x[e], part.v[k]
                    yield from put(p, np.concatenate((a, a)), np.concatenate((b, c)), np.concatenate((c, b)))
                    yield from put(q, b, c, a)
                if p != q and p in held:
                    yield from messages(p)
            if q in held:
                yield from messages(q)

    kinds = {"a": pa.int64(), "b": pa.int64(), "corners": pa.list_(pa.int64())}

    def gather(batches):
        for _, rows in groupby(rows_of(batches), key=lambda r: r[:2]):
            u, v, w = joined([r[2] for r in rows])
            w = order.ids(w)
            by = np.lexsort((w, v, u))
            u, v, w = u[by], v[by], w[by]
            new = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
            x, y = order.ids(u[new]), order.ids(v[new])
            a, b, ends = np.minimum(x, y), np.maximum(x, y), np.append(new, len(u))
            for i in range(0, len(new), ROW // 8):
                j = min(i + ROW // 8, len(new))
                corners = pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i], pa.int32()), pa.array(w[ends[i] : ends[j]]))
                yield pa.RecordBatch.from_arrays([pa.array(a[i:j]), pa.array(b[i:j]), corners], list(kinds))

    sent = lists_of(edges, order).mapInArrow(run, "part int, share int, blob binary")
    return sent.repartition(4 * order.parts * SHARES, "part", "share").sortWithinPartitions("part", "share").mapInArrow(gather, "a long, b long, corners array<long>")
