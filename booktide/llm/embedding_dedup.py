"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees (Beygelzimer, Kakade and Langford 2006)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, kept, mapped
from .vectors import matrix, usable

#: Vectors link at this cosine or above.
COSINE = 0.95
#: Bytes of the vectors of a block (as doubles), and rows of it at most; rows of a leaf.
BLOCK_BYTES, BLOCK, LEAF = 1 << 22, 8192, 32
#: Centres of the top level at most: some vectors, drawn by a hash. All vectors are placed below them.
CENTERS = 256
#: Distances are rounded by less than this, dot products of single precision by less than that.
_SLACK, _SINGLE = 1e-6, 1e-5
_STRIP = 512


@dataclass
class Node:
    """center: row of the centre; radius: distance of members from it at most; members or children, of which the first ``singles`` have one member."""

    center: int
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)
    at: np.ndarray | None = None
    reach: np.ndarray | None = None
    singles: int = 0


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dot)) + _SLACK


def _cover(x: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of members, the first of each its centre: all are within radius of it, and no later centre is within radius of an earlier one.

    In strips, so that most distances come from products of matrices: a strip is held against the centres so far, then its rest against itself.
    """
    close, centers, groups = 1 - radius * radius / 2, np.empty(0, np.int64), []
    for at in range(0, len(members), _STRIP):
        rows = members[at : at + _STRIP]
        if len(centers):
            dot = x[rows] @ x[centers].T
            best = dot.argmax(axis=1)
            hit = dot[np.arange(len(rows)), best] >= close
            for g in np.unique(best[hit]):
                groups[g].append(rows[hit & (best == g)])
            rows = rows[~hit]
        near = x[rows] @ x[rows].T >= close
        left, new = np.ones(len(rows), bool), []
        for k in range(len(rows)):
            if left[k]:
                own = near[k] & left
                own[k] = False
                left &= ~own
                left[k] = False
                groups.append([rows[k : k + 1], rows[own]])
                new.append(rows[k])
        centers = np.concatenate((centers, np.array(new, np.int64)))
    return [np.concatenate(g) for g in groups]


def build(x: np.ndarray, members: np.ndarray | None = None) -> Node:
    """A tree over rows of x (unit length, single precision): the children of a node cover its members within half its radius."""
    members = np.arange(len(x)) if members is None else members
    node = Node(int(members[0]), float(_distance(x[members] @ x[members[0]]).max()) if len(members) > 1 else 0.0, members)
    if len(members) <= LEAF or node.radius < 0.01:
        return node
    groups = sorted(_cover(x, members, node.radius / 2), key=lambda g: len(g) > 1)
    node.singles = sum(len(g) == 1 for g in groups)
    node.children = [build(x, g) if len(g) > 1 else Node(int(g[0]), 0.0, g) for g in groups]
    node.at = np.array([c.center for c in node.children])
    node.reach = np.array([c.radius for c in node.children])
    return node


class Forest:
    """Links of rows, kept as a count for each row and a forest: never as pairs."""

    def __init__(self, counts: np.ndarray):
        self.n, self.links, self.top = counts, np.zeros(len(counts)), np.arange(len(counts))

    def roots(self, at: np.ndarray) -> np.ndarray:
        out = self.top[at]
        while True:
            up = self.top[out]
            if (up == out).all():
                self.top[at] = out
                return out
            out = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links between i[k] and j[k]."""
        if not len(i):
            return
        self.links += np.bincount(i, self.n[j], len(self.n)) + np.bincount(j, self.n[i], len(self.n))
        self.join(i, j)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            u, v = self.roots(i), self.roots(j)
            low, high = np.minimum(u, v), np.maximum(u, v)
            open_ = low < high
            if not open_.any():
                return
            i, j = i[open_], j[open_]
            np.minimum.at(self.top, high[open_], low[open_])

    def add_all(self, p: np.ndarray, q: np.ndarray, twin: bool) -> None:
        """Links between each of p and each of q; between all of p if they are the same."""
        if twin:
            self.links[p] += self.n[p].sum() - self.n[p]
        else:
            self.links[p] += self.n[q].sum()
            self.links[q] += self.n[p].sum()
            self.join(p, np.full(len(p), q[0]))
        self.join(q, np.full(len(q), p[0]))


def _open(node: Node) -> tuple[np.ndarray, np.ndarray, list[Node], int]:
    return (node.at, node.reach, node.children, node.singles) if node.children else (np.array([node.center]), np.array([node.radius]), [node], 0)


def traverse(x: np.ndarray, exact: np.ndarray, a: Node, b: Node, cosine: float, same: bool, out: Forest) -> None:
    """Give out all links of a row of a with a row of b, at a cosine of at least ``cosine``; each unordered pair once if both trees are one.

    x and exact are the rows in single and in double precision; what single precision leaves open, double precision settles. A pair of
    nodes is dropped if its centres are further apart than both radii and the threshold's distance; it is linked as a whole if they are
    so near that no members can be further apart than that distance.
    """
    reach = np.sqrt(2 - 2 * cosine)
    todo = [(a, b, same)]

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 1 << 16):
            u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good = np.einsum("kd,kd->k", exact[u], exact[v]) >= cosine
            out.add(u[good], v[good])

    while todo:
        p, q, twin = todo.pop()
        apart = 0.0 if twin else float(_distance(x[p.center] @ x[q.center]))
        if apart + p.radius + q.radius < reach - 1e-2 and min(len(p.members), len(q.members)) > 1:
            out.add_all(p.members, q.members, twin)
        elif not p.children and not q.children:
            for at in range(0, len(p.members), _STRIP):
                rows = p.members[at : at + _STRIP]
                for to in range(0, len(q.members), _STRIP):
                    i, j = np.nonzero(x[rows] @ x[q.members[to : to + _STRIP]].T >= cosine - _SINGLE)
                    if twin:
                        i, j = i[i + at < j + to], j[i + at < j + to]
                    settle(rows[i], q.members[j + to])
        else:
            pa_, pr, pn, ps = _open(p)
            qa, qr, qn, qs = _open(q)
            rest = qr[qs:]
            for at in range(0, len(pa_), _STRIP):
                rows = pa_[at : at + _STRIP]
                single = max(0, min(ps - at, len(rows)))
                dot = x[rows] @ x[qa].T
                i, j = np.nonzero(dot[:single, :qs] >= cosine - _SINGLE)
                if twin:
                    i, j = i[i + at < j], j[i + at < j]
                settle(rows[i], qa[j])
                for first, last, lo, r in ((0, single, qs, rest), (single, len(rows), 0, qr)):
                    if first < last and len(r):
                        far = pr[at + first : at + last, None] + r + (reach + _SLACK)
                        i, j = np.nonzero(dot[first:last, lo:] >= 1 - far * far / 2 - _SINGLE)
                        i, j = i + first + at, j + lo
                        if twin:
                            i, j = i[i <= j], j[i <= j]
                        todo += [(pn[u], qn[v], twin and u == v) for u, v in zip(i.tolist(), j.tolist(), strict=True)]


def _settled(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray] | None, cosine: float) -> list[tuple[int, int, int]]:
    """(id, links, a smaller or equal id of its component) for the linked classes (ids, counts, vectors) of one or two blocks."""
    ids, n, exact = (np.concatenate(v) for v in zip(left, right, strict=True)) if right else left
    order = np.argsort(ids, kind="stable")  # so that the forest's roots are the smallest ids
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, n, exact = ids[order], n[order], exact[order]
    x, out = exact.astype(np.float32), Forest(n)
    first = place[: len(left[0])]
    tree = build(x, first)
    traverse(x, exact, tree, build(x, place[len(first) :]) if right else tree, cosine, not right, out)
    linked = np.flatnonzero(out.links)
    return list(zip(ids[linked].tolist(), out.links[linked].astype(np.int64).tolist(), ids[out.roots(linked)].tolist(), strict=True))


def unit(x: np.ndarray) -> np.ndarray:
    """The rows scaled to length 1, first by their greatest component, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(classes: DataFrame, d: int, n: int, rows: int, cosine: float) -> tuple[DataFrame, dict[int, list[int]]]:
    """The top level: classes of d components with the cell of their nearest centre, and for each cell the later or equal cells that can hold links.

    Cells are dropped as partners by the same bound as nodes: their centres' distance, both radii and the threshold's distance. Centres
    come from at most CENTERS rows with the least hashes, whatever the table's size; the radius of a cell covers all of its rows.
    """
    some = classes.orderBy("f1", "f2").limit(min(CENTERS, max(1, n // rows))).select("x").toArrow()
    centers = unit(matrix(some["x"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                dot = unit(matrix(part.column("x"))) @ centers.T
                cell = dot.argmax(axis=1)
                away = np.sqrt(np.maximum(0, 2 - 2 * dot[np.arange(len(cell)), cell])) + _SLACK
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "n", "x")), pa.array(cell, pa.int32()), pa.array(away, pa.float64())], ["id", "n", "x", "cell", "away"])

    kind = dict(classes.dtypes)["x"]
    placed = kept(mapped(classes.select("id", "n", "x"), place, f"id long, n long, x {kind}, cell int, away double"))
    reach = {r.cell: (r.away, r.rows) for r in placed.groupBy("cell").agg(F.max("away").alias("away"), F.count(F.lit(1)).alias("rows")).collect()}  # CENTERS rows at most
    gap = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T))
    limit = np.sqrt(2 - 2 * cosine) + 2 * _SLACK
    partners = {c: [e for e in sorted(reach) if e >= c and gap[c, e] <= reach[c][0] + reach[e][0] + limit] for c in sorted(reach)}
    return placed.withColumn("d", F.lit(d)), {c: (partners[c], max(1, -(-reach[c][1] // rows))) for c in partners}


def _dealt(placed: DataFrame, plan: dict[int, tuple[list[int], int]]) -> DataFrame:
    """The rows of each pair of blocks that can hold links: d, i, j (the blocks), own (the row's block), id, n, x. Cells of many rows are several blocks."""
    start, blocks = {}, 0
    for c, (_, parts) in plan.items():
        start[c], blocks = blocks, blocks + parts
    pairs = placed.sparkSession.createDataFrame([(c, start[c], plan[c][1], [(start[e], plan[e][1]) for e in plan if e in plan[c][0] or c in plan[e][0]]) for c in plan], "cell int, first int, parts int, others array<struct<first: int, parts: int>>")
    own = placed.join(F.broadcast(pairs), "cell").withColumn("own", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.flatten(F.transform("others", lambda o: F.sequence(o["first"], o["first"] + o["parts"] - 1)))
    out = own.select("d", "id", "n", "x", "own", F.explode(others).alias("other"))
    return out.select("d", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "x")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths, nor
    rows with a null id. Equal vectors form a class, which is compared once and counts for all its rows. The top level of the tree parts
    the classes into cells of their nearest centre; only blocks of cells that can hold links are compared (see _cells). Each pair of
    blocks is one task, which returns no pairs but each class's number of links and a spanning forest. Repeated rows count as rows; rows
    that share an id share a component. Other columns play no part; an empty table gives none.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = vectors.select("vec_id", "embedding", F.when(usable() & F.col("vec_id").isNotNull(), square > 0).otherwise(F.lit(False)).alias("_ok"))
    keyed = whole.withColumns({"f1": F.xxhash64("embedding"), "f2": F.xxhash64(F.lit(3), "embedding")})
    classes = kept(keyed.where("_ok").groupBy("f1", "f2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("x")))

    def one(table: pa.Table) -> pa.Table:
        own, first = table["own"].to_numpy(), table["i"][0].as_py()
        ids, n, x = table["id"].to_numpy(), table["n"].to_numpy().astype(float), unit(matrix(table["x"]))
        sides = [(ids[m], n[m], x[m]) for m in (own == first, own != first)]
        rows = []
        if first == table["j"][0].as_py():
            rows = _settled(sides[0], None, cosine)
        elif len(sides[0][0]) and len(sides[1][0]):
            rows = _settled(sides[0], sides[1], cosine)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("id", "links", "up"), list(zip(*rows, strict=True)) or [[], [], []], strict=True)})

    found = classes.select("id", F.col("n").alias("links"), F.col("id").alias("up")).limit(0)
    for d, n in sorted((r.d, r.n) for r in classes.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each length
        rows = max(LEAF, min(BLOCK, BLOCK_BYTES // (8 * d)))
        dealt = _dealt(*_cells(classes.where(F.size("x") == d), d, n, rows, cosine))
        found = found.union(kept(dealt.groupBy("d", "i", "j").applyInArrow(one, "id long, links long, up long")))
    links = kept(found.groupBy("id").agg(F.sum("links").alias("links")))
    group = kept(components(found.where("id <> up"), "id", "up"))
    named = classes.select("f1", "f2", "id", "n").join(bounded(links), "id", "left").join(bounded(group), "id", "left")
    named = kept(named.select("f1", "f2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    out = keyed.select("vec_id", "_ok", "f1", "f2").join(bounded(named.withColumn("_ok", F.lit(True))), ["_ok", "f1", "f2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
