"""Fuzzy line deduplication by MinHash, in DataFrame functions alone."""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, dropped, fresh, kept, scratch

#: Characters of a shingle; lines link at this Jaccard similarity or above.
CHARS, SIMILARITY = 8, 0.8
#: Bands and rows of the signature: a pair at 0.8 shares a band with a chance of 1 - (1 - 0.8**5)**12 = 0.991.
BANDS, ROWS = 12, 5
#: Shingles that are taken at a time: their least hash is found before the row goes into the aggregate.
CHUNK = 8
#: Shingles that are cut at a time where all of them are kept.
PART = 32
#: Bands that are grouped at a time: their rows are on disk together.
ROUND = 3
#: Lines of a band that are paired at once; larger bands are dealt out as pairs of blocks.
BLOCK = 512
#: Words of 64 bits in the marks of a line: each of its shingles turns one bit over.
MARKS = 16
MARKED = ["size", *(f"w{k}" for k in range(MARKS))]
#: Lines of a band that are compared with all others of it, once its first and last have been; all other pairs follow.
PICKED = 8
#: Rows of a few longs that may be broadcast (32 MB).
WANTED_ROWS = 1_000_000


def spaced(line: Column) -> Column:
    """The line as it is compared: lower case, white space (ASCII) as single spaces, one before the first word."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    return F.concat(F.lit(" "), F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r\x0b\x0c]+", " ")).otherwise(line))))


def made(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once for each row: they come out of a generator, else Catalyst makes them again at each mention."""
    out = df.select("*", F.explode_outer(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_made"))
    return out.select(*df.columns, *(F.col("_made")[k].alias(k) for k in columns))


def _cut(df: DataFrame, line: str) -> DataFrame:
    """df with the line as it is compared in UTF-16 (raw), where a shingle is cut out by its place, and the place of its last shingle (last).

    Characters are units of UTF-16; those beyond the basic plane count as two. A line of fewer than CHARS characters is its own shingle.
    """
    raw = made(df, raw=F.encode(spaced(F.col(line)), "UTF-16BE"))
    return raw.withColumn("last", _last(F.col("raw")))


def _last(raw: Column) -> Column:
    """The place of the last shingle of a line in UTF-16."""
    return F.greatest((F.octet_length(raw) / 2).cast("int") - CHARS, F.lit(0))


def _shingle(at: Column) -> Column:
    """The hash of the shingle at a place of a line that _cut has prepared."""
    return F.xxhash64(F.substring("raw", at * 2 + 1, F.lit(2 * CHARS)))


def with_bands(lines: DataFrame) -> DataFrame:
    """lines (h, h2, line, n, at) with the bands of the signature in place of the line: the least hash of all shingles under BANDS * ROWS orders.

    An order turns over some bits of the hashes, each its own. Shingles come out of a generator, so that all of this is compiled; lines
    are in one place already, so the minima need no exchange.
    """
    masks = [random.Random(k).getrandbits(64) - (1 << 63) for k in range(BANDS * ROWS)]
    own = ["h", "h2", "n", "at"]
    chunks = _cut(lines, "line").select(*own, "raw", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(CHUNK))).alias("i"))
    hashed = chunks.select(*own, *(_shingle(F.least(F.col("i") + k, "last")).alias(f"x{k}") for k in range(CHUNK)))
    least = hashed.groupBy("h", "h2").agg(
        F.max("n").alias("n"), F.first("at.doc_id").alias("doc_id"), F.first("at.pos").alias("pos"), F.first("at.row").alias("row"),
        *(F.min(F.least(*(F.col(f"x{c}").bitwiseXOR(m) for c in range(CHUNK)))).alias(f"m{k}") for k, m in enumerate(masks)),
    )
    bands = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    return least.select("h", "h2", "n", F.struct("doc_id", "pos", "row").alias("at"), F.array(*bands).alias("bands"))


def _occurrences(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: doc_id, row (a hash that tells documents of one id apart), pos, line, and two hashes of the line.

    The outer form spares the filter on the array that Catalyst puts below the other one, which splits each text once more.
    """
    row = F.xxhash64(F.col("doc_id").cast("string"), "text")
    lines = docs.select("doc_id", row.alias("row"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line")).where(F.trim(F.col("line")) != "")
    return lines.select("doc_id", "row", "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _hashes(lines: DataFrame, key: list[str]) -> DataFrame:
    """key and xs for parts of each line of lines (key, line): arrays that together hold the hashes of all of its shingles, some more than once.

    They are cut by compiled code, PART at a time; a function over the places of a line would be interpreted.
    """
    cut = _cut(lines, "line").select(*key, "raw", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(PART))).alias("i"))
    return cut.select(*key, F.array(*(_shingle(F.least(F.col("i") + k, "last")) for k in range(PART))).alias("xs"))


def _sized(texts: DataFrame) -> DataFrame:
    """texts (id, line) with size, the number of distinct shingles, and marks w0, w1, ...: each distinct shingle turns over the bit of its hash."""
    sets = _hashes(texts.repartition("id"), ["id"]).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("xs"))).alias("xs"))
    parts = sets.select("id", "xs", F.size("xs").alias("size"), F.explode(F.sequence(F.lit(0), F.size("xs") - 1, F.lit(CHUNK))).alias("i"))
    hashed = parts.select("id", "size", *(F.get("xs", F.col("i") + k).alias(f"x{k}") for k in range(CHUNK)))  # null beyond the end
    bit = lambda k, w: F.when(F.col(f"x{k}").bitwiseAND(MARKS - 1) == w, F.expr(f"shiftleft(1L, cast(shiftrightunsigned(x{k}, 58) as int))")).otherwise(F.lit(0).cast("long"))
    words = [F.bit_xor(functools.reduce(Column.bitwiseXOR, (bit(k, w) for k in range(CHUNK)))).alias(f"w{w}") for w in range(MARKS)]
    return texts.join(hashed.groupBy("id").agg(F.max("size").alias("size"), *words), "id")


def _odd(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """The number of marks in which two lines differ. a and b give the columns size, w0, w1, ... of either."""
    return functools.reduce(Column.__add__, (F.bit_count(a(f"w{k}").bitwiseXOR(b(f"w{k}"))) for k in range(MARKS)))


def _near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """False only for two lines that cannot link.

    What both share turns the same bits over in both. So a bit that differs takes at least one shingle that one line has alone, and lines
    of m and n shingles link if these are at most (1 - SIMILARITY) / (1 + SIMILARITY) * (m + n).
    """
    sizes = F.least(a("size"), b("size")) >= SIMILARITY * F.greatest(a("size"), b("size"))
    return sizes & (_odd(a, b) <= (1 - SIMILARITY) / (1 + SIMILARITY) * (a("size") + b("size")) + 1e-6)


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of lines that sizes and marks alone do not keep under SIMILARITY. texts: id and what _sized adds."""
    marks = lambda i: texts.select(F.col("id").alias(i), *(F.col(c).alias(f"{i}_{c}") for c in MARKED))
    return pairs.join(marks("a"), "a").join(marks("b"), "b").where(_near(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those distinct pairs (a, b) of lines whose sets of all shingles link. texts: id, line and what _sized adds.

    The shingles are gathered and counted pair by pair in the task that cuts them: nothing but the texts goes through a shuffle.
    """
    side = lambda i, s, n: texts.select(F.col("id").alias(i), F.col("line").alias(s), F.col("size").alias(n))
    both = pairs.join(side("a", "p", "m"), "a").join(side("b", "q", "n"), "b").repartition("a", "b")
    each = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("p").alias("line")), F.struct(F.lit(2).alias("side"), F.col("q").alias("line"))))
    parts = _hashes(both.select("a", "b", "m", "n", each.alias("s")).select("a", "b", "m", "n", "s.side", "s.line"), ["a", "b", "m", "n", "side"])
    of = lambda k: F.flatten(F.collect_list(F.when(F.col("side") == k, F.col("xs"))))
    common = parts.groupBy("a", "b", "m", "n").agg(F.size(F.array_intersect(of(1), of(2))).alias("c"))
    return common.where(F.col("c") >= SIMILARITY * (F.col("m") + F.col("n") - F.col("c"))).select("a", "b")


def _open(members: DataFrame, groups: DataFrame, least: int = 3) -> DataFrame:
    """The rows of members (h, band, n and others) in bands of more than ``least`` lines that are in several components, with the line's component g."""
    named = members.where(F.col("n") > least).join(bounded(groups, WANTED_ROWS), F.col("h") == F.col("id"), "left").select(*members.columns, F.coalesce("component", "h").alias("g"))
    named = kept(named)
    mixed = kept(named.groupBy("band").agg(F.min("g").alias("_g0"), F.max("g").alias("_g1")).where("_g0 < _g1").select("band"))
    return named.join(bounded(mixed, WANTED_ROWS), "band", "left_semi")


def _picked_pairs(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components: of each large open band PICKED lines, the first by hash of as many shares, with all others."""
    inside = _open(members, groups, 4 * PICKED)
    order = F.xxhash64("h", F.lit(PICKED))
    first = inside.groupBy("band", F.pmod(order, F.lit(PICKED)).alias("share")).agg(F.min(F.struct(order.alias("o"), "h", "g")).alias("first"))
    first = kept(first.select("band", F.col("first.h").alias("one"), F.col("first.g").alias("of")))
    pairs = inside.join(bounded(first, WANTED_ROWS), "band").where("g <> of")
    return kept(pairs.select(F.least("h", "one").alias("a"), F.greatest("h", "one").alias("b")).distinct(), release=True)


def _open_pairs(members: DataFrame, groups: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of lines that share a band and are in different components of groups, each once.

    members has h (a line), band and the band's n lines, of which the smallest and the largest have been compared with all others; so bands of
    up to three lines are done. Large bands are dealt out as pairs of blocks: rows dealt and pairs looked at grow with the square of such a
    band. texts: the sizes and marks of all lines (see _sized); pairs that these rule out are not made, the others
    get odd, the number of marks that differ.
    """
    marks = MARKED if texts else []
    named = _open(members.select("h", "band", "n"), groups)
    if texts:
        named = named.join(texts.select(F.col("id").alias("h"), *marks), "h")
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = named.withColumn("side", F.pmod(F.xxhash64("h"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = kept(dealt.select("band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "h", "g", "side", *marks))
    one = lambda s: dealt.select("band", "i", "j", *(F.col(c).alias(f"{s}_{c}") for c in ("h", "g", "side", *marks)))
    which = F.expr("a_h < b_h and a_g <> b_g and (i = j or a_side <> b_side)")
    if texts:
        of = (lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
        which = which & _near(*of)
    both = one("a").hint("merge").join(one("b"), ["band", "i", "j"]).where(which)
    pairs = kept(both.select(F.col("a_h").alias("a"), F.col("b_h").alias("b"), *([_odd(*of).alias("odd")] if texts else [])).distinct(), release=True)
    dropped(dealt)
    return pairs


def _members(signed: DataFrame, bands: range) -> tuple[DataFrame, DataFrame]:
    """Of the lines of signed (id, b0, b1, ...) that share one of these bands with others: pairs (a, b) and members.

    pairs: each line of a band with the band's first and its last, a < b, which for up to three lines are all pairs; some more than once.
    members: id, band and the band's n lines, of bands of more than three lines only: smaller ones are told from their least, greatest and
    xor of ids. Bands of one number are alike only to each other (the number is hashed with them), so they can be taken in any rounds.
    """
    banded = signed.select("id", F.explode(F.array(*(f"b{b}" for b in bands))).alias("band"))
    ends = [F.min("id").alias("first"), F.max("id").alias("last"), F.bit_xor("id").alias("all"), F.count(F.lit(1)).alias("n")]
    shared = kept(banded.groupBy("band").agg(*ends).where("first < last"), release=True)
    names = kept(shared.where("n > 3").select("band"))
    inside = banded.join(bounded(names, WANTED_ROWS), "band", "left_semi")
    members = kept(inside.join(bounded(kept(shared.where("n > 3"))), "band").select("id", "band", "first", "last", "n"), release=True)
    mid = F.col("all").bitwiseXOR(F.col("first")).bitwiseXOR(F.col("last"))
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    few = shared.where("n <= 3").select("first", "last", F.when(F.col("n") == 3, mid).alias("mid"))
    few = few.select(F.explode(F.array(pair("first", "last"), pair("first", "mid"), pair("mid", "last"))).alias("p")).select("p.a", "p.b").where("a < b")
    many = members.select(F.explode(F.array(pair("first", "id"), pair("id", "last"))).alias("p")).select("p.a", "p.b").where("a < b")
    pairs = kept(few.union(many))
    dropped(shared, names)
    return pairs, members


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are in different components."""
    of = lambda c: bounded(groups, WANTED_ROWS).select(F.col("id").alias(c), F.col("component").alias(f"g{c}"))
    named = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")


def _grown(group: DataFrame | None, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The components (id, component) of group once those of pairs that link are joined. pairs and group are deleted."""
    links = kept(_linked(pairs, texts), release=True)
    more = links if group is None else links.union(group.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))
    out = kept(components(more))
    dropped(pairs, links, *([] if group is None else [group]))
    return out


def line_groups(docs: DataFrame) -> DataFrame:
    """The distinct lines that repeat or link: h and h2 (hashes of the line) and keep (doc_id, pos and row of the occurrence that stays).

    Lines of equal text are one (told apart by 128 bits) and get a number. The signature is of all shingles (see with_bands). Lines that share
    a band are paired with the band's smallest and its largest number. Of those pairs that sizes and marks leave possible, each line's with the
    smallest number is compared, which joins large groups of near copies along stars, then what is apart still. Bands of more than three
    lines can have pairs left: lines of those that are not in one component yet are compared with lines picked from the band (see
    _picked_pairs). Of all its pairs of different components that marks leave possible (see _open_pairs), each line's nearest is compared,
    then what is apart still.
    A link needs the exact similarity of all shingles. A component keeps its first occurrence by doc_id (null before all others) and place.
    """
    lines = _occurrences(docs).groupBy("h", "h2").agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "pos", "row")).alias("at"), F.count(F.lit(1)).alias("n"))
    signed = kept(with_bands(lines).select(F.monotonically_increasing_id().alias("id"), "h", "h2", "n", "at", *(F.col("bands")[b].alias(f"b{b}") for b in range(BANDS))), release=True)

    rounds = [_members(signed, range(b, min(b + ROUND, BANDS))) for b in range(0, BANDS, ROUND)]
    near = kept(functools.reduce(DataFrame.union, [pairs for pairs, _ in rounds]).distinct(), release=True)
    members = functools.reduce(DataFrame.union, [x for _, x in rounds]).select(F.col("id").alias("h"), "band", "n")
    wanted = kept(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = kept(signed.select("id", "h", "h2").join(bounded(wanted, WANTED_ROWS), "id", "left_semi"))
    lines = kept(_occurrences(docs).select("h", "h2", "line").join(bounded(wanted, WANTED_ROWS), ["h", "h2"]).groupBy("id").agg(F.first("line").alias("line")), release=True)
    texts = kept(_sized(lines))
    dropped(lines)

    possible = kept(_possible(near, texts), release=True)
    group = _grown(None, kept(possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")), texts)
    group = _grown(group, kept(_apart(possible, group)), texts)
    dropped(near, possible)
    if (members.agg(F.max("n")).first()[0] or 0) > 4 * PICKED:
        picked = _picked_pairs(members, group)
        group = _grown(group, kept(_possible(picked, texts)), texts)
        dropped(picked)
    pairs = _open_pairs(members, group, texts)
    ends = [pairs.select(F.col(c).alias("of"), F.struct("odd", "a", "b").alias("pair")) for c in ("a", "b")]
    nearest = kept(ends[0].union(ends[1]).groupBy("of").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct())
    group = _grown(group, nearest, texts)
    rest = kept(_apart(pairs, group))
    dropped(pairs)
    group = _grown(group, rest, texts)
    dropped(wanted, texts, *(x for both in rounds for x in both))

    grouped = signed.join(bounded(group), "id", "left").select("h", "h2", "n", "at", F.coalesce("component", "id").alias("g"), F.col("component").isNotNull().alias("many"))
    open_ = kept(grouped.where("n > 1 or many"))
    keep = kept(open_.groupBy("g").agg(F.min("at").alias("keep")))
    dropped(signed)
    return open_.join(bounded(keep), "g").select("h", "h2", "keep")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with fuzzy copies of lines removed from text: every column stays, and n_lines and n_kept are added.

    Over all documents one line of each component stays (see line_groups); blank lines always stay. Lines are parted by line feeds and
    compared in lower case with single spaces. A null text stays null with 0 lines, an empty one has one (blank) line. Rows equal in id and
    text are one document, and all of them keep what it keeps; a null id is an id. n_chars is counted anew if there is such a column. Columns
    of docs that are called n_lines or n_kept stay as they are; the counts then have underscores after their names. An empty table stays empty.
    """
    name = {k: fresh(k, docs.columns) for k in ("n_lines", "n_kept", "_doc", "_row", "_of", "_gone", "_lines", "_left")}
    doc, row, of, gone, lines, left = (name[k] for k in ("_doc", "_row", "_of", "_gone", "_lines", "_left"))
    with scratch() as stays:
        groups = kept(line_groups(docs.select("doc_id", "text")), release=True)
        spots = _occurrences(docs.select("doc_id", "text")).select("doc_id", "row", "pos", "h", "h2").join(bounded(groups), ["h", "h2"])
        spots = spots.where(~F.struct("doc_id", "pos", "row").eqNullSafe(F.col("keep")))
        away = stays(kept(spots.groupBy(F.col("doc_id").alias(doc), F.col("row").alias(of)).agg(F.collect_set("pos").alias(gone)), release=True))
    out = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    out = out.join(away, (out[row] == away[of]) & out["doc_id"].eqNullSafe(away[doc]), "left").withColumn(lines, F.split("text", "\n"))
    stays = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.element_at(lines, i + 1))
    out = out.withColumn(left, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(stays))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    text = F.array_join(left, "\n")
    new = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns), size(lines).alias(name["n_lines"]), size(left).alias(name["n_kept"]))
