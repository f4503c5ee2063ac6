"""Exact n-gram Jaccard self-join of documents, as components of its links.

Size-banded tiles with bitmap signatures: the hash range of a document's shingles is cut into parts, as many for all documents of a band of
sizes; documents of a band that have a part in common form a tile. In a tile only sizes that can reach the threshold are paired; bit counts
of hashed bitmaps bound the overlap from above; what is left is settled by intersecting the sorted sets. Tiles that many share (a passage
that is quoted often) are set aside; documents that cannot do without them are compared in blocks, each pair once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, components, kept, mapped, scratch
from .hashing import mixed, shingles, words_of

#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 5, 80
#: Rows of a tile that are paired as they are; larger tiles are set aside, and what depends on them is compared in pairs of blocks.
FEW, BLOCK = 16, 512
#: Rounds in which tiles are gathered: the shuffle files of one are on disk together.
TILE_ROUNDS = 4
#: Minimum hashes for the first, approximate round, which joins large groups so that the exact round need not pair their members.
ROUNDS = 4
#: Bits of the smallest bitmap.
BITS = 1024
#: Rows of a single long that may be broadcast (16 MB).
WANTED_ROWS = 1_000_000

_PART, _BAND = np.uint64(0xA0761D6478BD642F), 0xE7037ED1A0B428DB


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """Least intersection of sets of a and b elements that link."""
    return -((-percent * (a + b)) // (100 + percent))


def bitmap(items: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap of at least two bits for each element."""
    bits = max(BITS, 1 << int(2 * len(items) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(items >> np.uint64(7)) & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little")


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bytes that still has a bit for each element."""
    return np.bitwise_or.reduce(x.reshape(-1, size))


def apart(total: int, percent: int) -> int:
    """Elements at most that only one of two linked sets has, of ``total`` elements together."""
    return total * (100 - percent) // (100 + percent)


def tile_keys(own: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int, np.ndarray]]:
    """For each band of a sorted distinct set: (give, occupied parts, keys of its tiles). Two linked sets share a tile.

    Band b holds sizes below 16 << b, from half of that on (band 0 from 1 on). Its hash range is cut into equal parts; a key says which
    elements a part holds. Two linked sets differ in ``apart`` elements at most, each of which spoils one part. So of ``give`` parts, one
    more than that, that either set occupies, one is equal in the other: leave out any keys, in all sets alike, and two sets of which one
    still has ``give`` keys share one. A set also joins lower bands down to the smallest size that it can link with. A set that occupies
    too few parts, which is rare, has a key besides that all such sets of its band share.
    """
    n, out = len(own), []
    band = most = max(0, n.bit_length() - 4)
    while band >= 0 and (band == most or 100 * ((8 << (band + 1)) - 1) >= percent * n):
        top = 16 << band
        give = 1 + apart(n + n * 100 // percent if band == most else top - 1 + n, percent)
        parts = 8 + -(-6 * apart(top + top * 100 // percent, percent) // 5)
        at = ((own >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        keys = np.add.reduceat(own, first) + at[first] * _PART
        if len(first) < give:
            keys = np.append(keys, np.uint64(1))
        out.append((give, len(first), mixed(keys ^ np.uint64((band + 1) * _BAND & (1 << 64) - 1))))
        band -= 1
    return out


def _over(fn: Callable, columns: list[str], schema: pa.Schema):
    """A function for mapInArrow: fn gets the columns as lists and yields tuples of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = list(fn(*(part.column(c).to_pylist() for c in columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of each row: id, size of its set, a fingerprint in two halves (null for an empty set), minimum hashes, keys of its tiles and bitmap."""
    kind = "id long, size long, f1 long, f2 long, least array<long>, tiles array<struct<give: int, parts: int, keys: array<long>>>, bits binary"
    many = pa.list_(pa.int64())
    band = pa.struct([("give", pa.int32()), ("parts", pa.int32()), ("keys", many)])
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("least", many), ("tiles", pa.list_(band)), ("bits", pa.binary())])
    seeds = [np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1) for k in range(ROUNDS)]

    def make(ids: list, of: list):
        for i, w in zip(ids, words_of(of), strict=True):
            own = shingles(w, words)
            if not len(own):
                yield i, 0, None, None, [], [], b""
                continue
            f1, f2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist()
            tiles = [{"give": give, "parts": parts, "keys": keys.view(np.int64)} for give, parts, keys in tile_keys(own, percent)]
            yield i, len(own), f1, f2, [mixed(own ^ k).min().astype(np.int64) for k in seeds], tiles, bitmap(own).tobytes()

    return mapped(docs.select("doc_id", "text"), _over(make, ["doc_id", "text"], schema), kind)


def _side(df: DataFrame, key: str, own: str, *columns: str) -> DataFrame:
    """df's id under the name key, and columns with own before their names: one side of a join of pairs."""
    return df.select(F.col("id").alias(key), *(F.col(c).alias(f"{own}_{c}") for c in columns))


def _can_link(p: int, q: int, u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """Whether sets of sizes p and q can link by the bits of their bitmaps: each bit that only one has is an element that the other lacks."""
    width = min(len(u), len(v))
    u, v = (x if len(x) == width else folded(x, width) for x in (u, v))
    return min(p - int(np.bitwise_count(u & ~v).sum()), q - int(np.bitwise_count(v & ~u).sum())) >= needed(p, q, percent)


def _do_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    return len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), percent)


def _sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id and own (the sorted set) of the documents in ids (doc_id)."""
    make = lambda ids, of: ((i, shingles(w, words).tobytes()) for i, w in zip(ids, words_of(of), strict=True))
    texts = docs.select("doc_id", "text").join(bounded(kept(ids.distinct()), WANTED_ROWS), "doc_id", "left_semi")
    return kept(mapped(texts, _over(make, ["doc_id", "text"], pa.schema([("id", pa.int64()), ("own", pa.binary())])), "id long, own binary"), release=True)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(pairs: DataFrame, signed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those distinct pairs (a, b) of ids whose sets link: first by the bound that bitmaps give, then by intersecting the sorted sets."""

    def can(a: list, b: list, m: list, n: list, x: list, y: list):
        for i, j, p, q, u, v in zip(a, b, m, n, x, y, strict=True):
            if _can_link(p, q, np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8), percent):
                yield i, j

    both = pairs.join(_side(signed, "a", "x", "size", "bits"), "a").join(_side(signed, "b", "y", "size", "bits"), "b")
    close = kept(mapped(both, _over(can, ["a", "b", "x_size", "y_size", "x_bits", "y_bits"], _PAIR), "a long, b long").distinct(), release=True)
    sets = _sets(close.select(F.col("a").alias("doc_id")).union(close.select("b")), docs, words)
    both = close.join(_side(sets, "a", "x", "own"), "a").join(_side(sets, "b", "y", "own"), "b")

    def settle(a: list, b: list, x: list, y: list):
        for i, j, p, q in zip(a, b, x, y, strict=True):
            if _do_link(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent):
                yield i, j

    return kept(mapped(both.select("a", "b", "x_own", "y_own"), _over(settle, ["a", "b", "x_own", "y_own"], _PAIR), "a long, b long"), release=True)


def _open_tiles(named: DataFrame) -> DataFrame:
    """The rows of tiles that hold several groups: tile, n (its rows), id, size, group, give, parts, band. named: id, size, group, tiles.

    Tiles are taken in TILE_ROUNDS rounds by their key, so a round's shuffle files have gone when the next one starts.
    """
    every = named.select("id", "size", "group", F.posexplode("tiles").alias("band", "t")).select("id", "size", "group", "band", "t.give", "t.parts", F.explode("t.keys").alias("tile"))
    rounds = []
    for k in range(TILE_ROUNDS):
        placed = every.where(F.pmod("tile", F.lit(TILE_ROUNDS)) == k)
        tiles = kept(placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("g"), F.max("group").alias("h")).where("g < h").select("tile", "n"), release=True)
        rounds.append(kept(placed.join(bounded(tiles, WANTED_ROWS), "tile"), release=True))
    return functools.reduce(DataFrame.union, rounds)


def _tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of ids that share a tile of FEW rows at most, are in different groups and have sizes that can link."""
    few = tiles.where(F.col("n") <= FEW).select("tile", "id", "size", "group")
    one = lambda x: few.select("tile", *(F.col(c).alias(f"{x}_{c}") for c in ("id", "size", "group")))
    both = one("a").hint("merge").join(one("b"), "tile")
    fits = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent
    both = both.where((F.col("a_id") < F.col("b_id")) & (F.col("a_group") != F.col("b_group")) & fits)
    return kept(both.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct(), release=True)


def _blocks(members: DataFrame) -> DataFrame:
    """members (id, cluster, group) dealt out to pairs of blocks: id, cluster, i, j, side, group.

    Only rows outside a cluster's largest group are held against all its rows; those of that group are in one component already.
    """
    sizes = members.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("cluster").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("all"))
    most = most.select("cluster", F.col("top.group").alias("major"), F.ceil(F.col("top.n") / BLOCK).alias("wide"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("rest")).where("rest > 0")
    x = members.join(bounded(kept(most)), "cluster").withColumn("main", F.col("group") == F.col("major"))
    h = F.xxhash64("id")
    x = x.withColumn("side", F.when(F.col("main"), F.col("rest") + F.pmod(h, F.greatest("wide", F.lit(1)))).otherwise(F.pmod(h, F.col("rest"))))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), F.col("rest")).otherwise(F.col("rest") + F.col("wide")) - 1)))
    return x.select("id", "cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "group")


def _block_links(percent: int):
    """For mapInArrow over rows sorted by (cluster, i, j): links between a block's rows and another's that join groups not joined yet."""

    def links(rows: list[tuple], same: bool, first: int) -> Iterator[tuple[int, int]]:
        rows = sorted(rows, key=lambda r: r[2])  # by size
        size, own = np.array([r[2] for r in rows]), [np.frombuffer(r[5], np.uint64) for r in rows]
        width = min(len(r[4]) for r in rows)
        maps = np.stack([np.frombuffer(r[4], np.uint8) if len(r[4]) == width else folded(np.frombuffer(r[4], np.uint8), width) for r in rows])
        names: dict[int, int] = {}
        group = np.array([names.setdefault(r[3], len(names)) for r in rows])  # joined groups take one number
        side = np.array([r[1] == first for r in rows])
        until = np.searchsorted(size, size * 100 // percent, side="right")
        for k in range(len(rows)):
            at = np.arange(k + 1, until[k])
            at = at[(group[at] != group[k]) & ((side[at] != side[k]) | same)]
            if len(at):
                lacks = np.bitwise_count(maps[at] & ~maps[k]).sum(axis=1), np.bitwise_count(~maps[at] & maps[k]).sum(axis=1)
                most = np.minimum(size[at] - lacks[0], size[k] - lacks[1])
                for o in at[most >= needed(size[at], size[k], percent)]:
                    if group[o] != group[k] and _do_link(own[k], own[o], percent):
                        group[group == group[o]] = group[k]
                        yield min(rows[k][0], rows[o][0]), max(rows[k][0], rows[o][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        tell = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=_PAIR)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "id", "side", "size", "group", "bits", "own")]
            for cluster, i, j, *row in zip(*cols, strict=True):
                if key != (cluster, i, j):
                    found += links(rows, key[1] == key[2], key[1]) if rows else []
                    key, rows = (cluster, i, j), []
                    if len(found) > 50_000:
                        yield tell()
                        found = []
                rows.append(tuple(row))
        found += links(rows, key[1] == key[2], key[1]) if rows else []
        if found:
            yield tell()

    return run


def _crowded(tiles: DataFrame, signed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between documents that have too few tiles besides those that many share: they form clusters by the latter, compared in pairs of blocks."""
    hot = tiles.where(F.col("n") > FEW)
    left = hot.groupBy("id", "band").agg(F.count(F.lit(1)).alias("gone"), F.first("give").alias("give"), F.first("parts").alias("parts"))
    short = kept(left.where("parts - gone < give").select("id", "band"), release=True)
    rows = kept(hot.select("tile", "id", "band", "group").join(bounded(short), ["id", "band"], "left_semi"), release=True)
    edges = rows.join(bounded(kept(rows.groupBy("tile").agg(F.min("id").alias("least")))), "tile").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    cluster = kept(components(kept(edges, release=True)).withColumnRenamed("component", "cluster"))
    members = cluster.join(bounded(kept(rows.select("id", "group").distinct())), "id")
    dealt = kept(_blocks(kept(members)), release=True)
    wanted = kept(dealt.select(F.col("id").alias("doc_id")).distinct())
    sets = kept(_sets(wanted, docs, words).join(signed.select("id", "size", "bits"), "id"))
    tasks = dealt.join(bounded(sets, BLOCK), "id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return kept(mapped(tasks, _block_links(percent), "a long, b long"), release=True)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text).

    Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased; a text of fewer words is one shingle; a text without
    words (or null) has none and links with nothing. component_id is the smallest doc_id that links reach, the own one included.
    Equal sets are joined by fingerprint; each class goes on as its smallest id, so copies cost nothing further. A first round links each
    class with the smallest one that shares a minimum hash, which joins large groups of near copies along stars. The second round is
    exact: two linked sets share a tile (see tile_keys); a tile whose members are all in one component needs no further look. Tiles of
    FEW rows are paired by size and component, and settled; larger ones are left out, and documents that have too few keys without them
    are compared in blocks (see _crowded): there, rows dealt and pairs grow with a cluster's rows times those outside its largest component. Repeated rows each get a
    row; rows that share an id share a component through their smallest; a null id is carried along and never an answer for others. An
    empty table gives none; other columns of docs play no part. The rows are a scratch table; all others of the join are gone when it returns.
    """
    with scratch() as stays:
        return stays(kept(_components(docs, words, percent), release=True))


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """What jaccard_components returns, as a plan over scratch tables."""
    every = kept(_signed(docs, words, percent))
    full = every.where("size > 0 and id is not null")
    copies = kept(full.groupBy("f1", "f2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("f1", "f2", "first"))
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    signed = full.join(F.broadcast(copies) if small else copies, ["f1", "f2"], "left").where("first is null or id = first").select("id", "size", "least", "tiles", "bits")
    if not small:
        signed = kept(signed)

    near = signed.select("id", "size", F.posexplode("least").alias("k", "h"))
    first = near.groupBy("k", "h").agg(F.min(F.struct("id", "size")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "h", F.col("c.id").alias("c"), F.col("c.size").alias("s"))
    close = (F.col("id") != F.col("c")) & (F.least("size", "s") * 100 >= F.greatest("size", "s") * percent)
    stars = near.join(bounded(kept(first)), ["k", "h"]).where(close).select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))
    links = _linked(kept(stars.distinct()), signed, docs, words, percent)
    groups = kept(components(links))

    named = signed.join(bounded(groups), "id", "left")
    tiles = _open_tiles(named.select("id", "size", F.coalesce("component", "id").alias("group"), "tiles"))
    more = _linked(_tile_pairs(tiles, percent), signed, docs, words, percent).union(_crowded(tiles, signed, docs, words, percent))
    group = kept(components(links.union(more)))

    mine = every.select("id", "size", "f1", "f2").join(bounded(copies), ["f1", "f2"], "left").withColumn("node", F.coalesce("first", "id"))
    out = mine.join(bounded(group.select(F.col("id").alias("node"), "component")), "node", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
