"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line of some length, cut into threshold + 1 segments, shares at least one
whole segment with every line within the threshold's edits.  Each distinct line
is indexed under hashes of its own segments, and looks up the substrings that
could equal a segment of an equally long or shorter line (only positions that
edits on both sides allow).  Pairs that meet, and whose letter counts differ by
no more than the edits allow, are verified by a banded bit-parallel edit
distance on the lines themselves.

A segment that many lines own would give many candidates.  Such a group isn't
paired: the shared segment is taken out of its lines and what is left of them,
which must again lie within the threshold, is cut into segments of its own
(``LEVELS`` times over).  Groups that stay large hold lines that differ little; they are
compared in tiles of bounded size that say which lines have a near one before
them, not which pairs there are.

Only hashes are shuffled, except for the texts of candidate lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilayer.llm._spark import cut, measured

#: Edits up to which lines are copies; characters from which a line is looked at.
EDITS, LEAST = 2, 20
#: Owners of a segment up to which it gives pairs, how often larger groups are cut again, and lines on a tile's side.
MANY, LEVELS, SIDE = 8, 1, 1000
_ID = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    """Lines of a text (parts between newlines); null text has none."""
    return F.split(text, "\n", -1)


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def line_id(line: Column) -> list[Column]:
    """128 bits that a line is known by."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


#: Letters whose counts (modulo 16) a line is known by.
LETTERS = "etanirso"


def letter_counts(line: Column) -> Column:
    """Counts of ``LETTERS``, four bits each."""
    n = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 16
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        out = out + n(c) * F.lit(16**k).cast("long")
    return out


def counts_apart(a: Column, b: Column) -> Column:
    """Least sum of differences that two packed counts leave possible; an edit changes it by two at most."""
    out = F.lit(0)
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftright(a, 4 * k).bitwiseAND(15) - F.shiftright(b, 4 * k).bitwiseAND(15))
        out = out + F.least(d, 16 - d)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edits between two strings where they are at most ``most``; otherwise some number above it.

    Bit-parallel over a band: bit t of a column's words stands for the row
    t - ``most`` below the column's own, so that the band moves down by one as
    the words shift.  The distance is followed along the diagonal that ends in
    the last cell, where it grows by one in each column whose diagonal step
    isn't free.
    """
    width = 2 * most + 1
    full = (1 << width) - 1
    apart = F.abs(F.length(a) - F.length(b))
    one = lambda x: F.lit(x).cast("long")
    flip = lambda x: x.bitwiseXOR(one(full))

    def matches(long_: Column, c: Column, j: Column) -> Column:
        out = one(0)
        for t in range(width):
            out = out + F.when(F.get(long_, j + (t - most)) == c, one(1 << t)).otherwise(one(0))
        return out

    def step(s: Column, x: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        free = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(one(full))
        return let(free, lambda d: follow(s, d, vn.bitwiseOR(flip(d.bitwiseOR(vp))), F.shiftright(d, 1)))

    def follow(s: Column, d: Column, hp: Column, down: Column) -> Column:
        vp = d.bitwiseAND(s["vp"]).bitwiseOR(flip(down.bitwiseOR(hp)))
        stays = (d.bitwiseAND(s["bit"]) != 0).cast("long")
        return F.struct(vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["n"] + 1 - stays).alias("n"), s["bit"].alias("bit"))

    bits = F.array(*[one(1 << (most + d)) for d in range(most + 1)])
    start = F.struct(one(full & ~((1 << most) - 1)).alias("vp"), one(0).alias("vn"), apart.cast("long").alias("n"), F.get(bits, F.least(apart, F.lit(most))).alias("bit"))
    swap = F.length(a) < F.length(b)
    both = F.struct(F.split(F.when(swap, b).otherwise(a), "").alias("long"), F.split(F.when(swap, a).otherwise(b), "").alias("short"))
    met = let(both, lambda s: F.aggregate(F.transform(s["short"], lambda c, j: matches(s["long"], c, j)), start, step, lambda x: x["n"]))
    return F.when((apart > most) | (F.length(a) == 0) | (F.length(b) == 0), apart.cast("long")).otherwise(met)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(d, k, move): a substring stands for segment k of a line shorter by d, moved by ``move``.

    At most k edits lie before it and edits - k after it.  Own segments come first.
    """
    out = [(d, k, move) for d in range(edits + 1) for k in range(edits + 1) for move in range(-edits, edits + 1) if abs(move) <= k and abs(move - d) <= edits - k]
    return sorted(out, key=lambda p: (p[0] != 0 or p[2] != 0, p))


def _segment(length: Column, parts: int, k: Column) -> tuple[Column, Column]:
    """(start from 1, length) of segment k from 0; the last ones take what doesn't divide."""
    q, whole = ((length - length % parts) / parts).cast("int"), parts - length % parts
    return k * q + F.greatest(F.lit(0), k - whole) + 1, q + F.when(k >= whole, 1).otherwise(0)


def _hash(line: Column, target: Column, k: Column, at: Column, size: Column, *more: Column) -> Column:
    """Hash of a substring; all lines give bytes, which are cut out directly where each character is one."""
    plain = F.length(line) == F.octet_length(line)
    part = F.when(plain, F.substring(line.cast("binary"), at, size)).otherwise(F.substring(line, at, size).cast("binary"))
    return F.xxhash64(*more, target.cast("int"), k.cast("int"), part)


def own_keys(line: Column, edits: int) -> list[Column]:
    out = []
    for k in range(edits + 1):
        at, size = _segment(F.length(line), edits + 1, F.lit(k))
        out.append(_hash(line, F.length(line), F.lit(k), at, size))
    return out


def _place(line: Column, p: Column, edits: int) -> tuple[Column, Column, Column, Column]:
    """(length of the lines meant, segment, start, size) of the substring that probe number p stands for."""
    d, k, move = (F.get(F.array(*[F.lit(x[c]) for x in probes(edits)]), p) for c in range(3))
    target = F.length(line) - d
    at, size = _segment(target, edits + 1, k)
    return target, k, (at + move).cast("int"), size.cast("int")


def _looked(rows: DataFrame, edits: int, keep: list[str], parent: bool = False) -> DataFrame:
    """A row for each substring of ``line`` to look up: ``keep``, key, p (number of the probe), own.

    parent: rows come from a larger group (``key``), stand for lines as much
    shorter as their own probe says, and are owners only if they were before.
    """
    table, own = probes(edits), F.col("q") <= edits
    numbers = lambda d: F.array(*[F.lit(x) for x, probe in enumerate(table) if d is None or probe[0] == d])
    mine = numbers(None)
    if parent:
        mine = F.get(F.array(*[numbers(d) for d in range(edits + 1)]), F.get(F.array(*[F.lit(x[0]) for x in table]), F.col("p")))
        own = own & F.col("own")
    out = rows.withColumn("q", F.explode(mine))
    target, k, at, size = _place(F.col("line"), F.col("q"), edits)
    out = out.select("*", target.alias("target"), k.alias("k"), at.alias("at"), size.alias("size")).where("target >= 0 and at >= 1 and at + size - 1 <= length(line)")
    key = _hash(F.col("line"), F.col("target"), F.col("k"), F.col("at"), F.col("size"), *([F.col("key")] if parent else []))
    return out.select(*keep, key.alias("key"), F.col("q").alias("p"), own.alias("own"))


def _rest(line: Column, p: Column, edits: int) -> Column:
    """A line without the substring that it shares with its group."""
    _, _, at, size = _place(line, p, edits)
    return F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + size, F.length(line)))


def _occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, short: bool = False) -> DataFrame:
    """(doc, pos, line) of each line that is looked at; short: also shorter ones with a letter or digit."""
    d = docs.select(F.col(id_col).alias("doc"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    d = d.select("doc", "pos", trimmed(F.col("line")).alias("line"))
    return d.where((F.length("line") >= least) | F.rlike("line", F.lit(r"[\p{L}\p{N}]")) if short else F.length("line") >= least)


def _first(occ: DataFrame) -> DataFrame:
    """Each distinct line: where it stands first, how often, its own segments' keys."""
    return cut(occ.groupBy(*_ID).agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")))


def _read(docs: DataFrame, id_col: str, text_col: str, least: int, edits: int, short: bool) -> DataFrame:
    occ = _occurrences(docs, id_col, text_col, least, short)
    keys = F.when(F.length("line") >= least, F.array(*own_keys(F.col("line"), edits)))
    return cut(occ.select("doc", "pos", *line_id(F.col("line")), keys.alias("keys")))


def _again(occ: DataFrame, first: DataFrame) -> DataFrame:
    """(doc, again): the lines of each document that repeat an earlier one."""
    hit = occ.join(measured(cut(first.where("n > 1").select(*_ID, "first"))), _ID).where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
    return cut(hit.groupBy("doc").agg(F.collect_set("pos").alias("again")))


def _distinct_lines(docs: DataFrame, again: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(h1, h2, line) of the lines that don't repeat an earlier one."""
    d = docs.select(F.col(id_col).alias("doc"), lines_of(F.col(text_col)).alias("lines")).alias("d")
    d = d.join(measured(again).alias("r"), F.col("d.doc").eqNullSafe(F.col("r.doc")), "left").select("lines", "again")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    d = d.where(F.size("lines") > 0).select("lines", F.explode(F.when(F.col("again").isNull(), every).otherwise(F.array_except(every, F.col("again")))).alias("pos"))
    d = d.select(trimmed(F.get("lines", "pos")).alias("line")).where(F.length("line") >= least)
    return d.select(*line_id(F.col("line")), "line")


def _meet(own: DataFrame, looked: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs (a1, a2, b1, b2), rows of ``looked`` whose key has too many owners) by key.

    The index holds the owners of a key that has few of them, else the key once.
    """
    large = cut(own.groupBy("key").agg(F.count("*").alias("owners")).where(F.col("owners") > MANY).select("key"))
    few = own.join(measured(large), "key", "left_anti")
    index = few.select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2")).unionByName(large.select("key", F.lit(None).cast("long").alias("a1"), F.lit(None).cast("long").alias("a2")))
    found = looked.join(index.hint("shuffle_hash"), "key").where("a1 is null or a1 <> h1 or a2 <> h2")
    found = cut(found.select("key", *_ID, "a1", "a2", *more))
    return found.where("a1 is not null").select("a1", "a2", F.col("h1").alias("b1"), F.col("h2").alias("b2")), found.where("a1 is null").select("key", *_ID, *more)


class _Near:
    """Candidates of a table's lines: ``pairs`` (a1, a2, b1, b2) and tiles of groups that stay large."""

    def __init__(self, docs: DataFrame, first: DataFrame, again: DataFrame, id_col: str, text_col: str, edits: int, least: int):
        self.first, self.edits = first, edits
        own = first.where(F.col("keys").isNotNull()).select(*_ID, F.explode("keys").alias("key"))
        looked = _looked(_distinct_lines(docs, again, id_col, text_col, least), edits, _ID)
        pairs, large = _meet(own, looked, ["p", "own"])
        ids = pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(pairs.select("b1", "b2")).union(large.select(*_ID))
        self.lines = self._fetch(docs, cut(ids.distinct()), id_col, text_col)
        self.tiles = None
        if not large.isEmpty():
            for _ in range(LEVELS):
                if "line" not in large.columns:
                    large = large.join(self.lines.select(*_ID, "line"), _ID)
                rows = cut(_looked(large.select("key", *_ID, "p", "own", _rest(F.col("line"), F.col("p"), edits).alias("line")), edits, [*_ID, "line"], parent=True))
                more, large = _meet(rows.where("own").select("key", *_ID), rows, ["p", "own", "line"])
                pairs = pairs.union(more)
                if large.isEmpty():
                    break
            else:
                self.tiles = self._tiles(large.select("key", *_ID, "own").distinct())
        swap = (F.col("a1") > F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") > F.col("b2")))
        pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
        self.pairs = cut(pairs.select(pick("a1", "b1", "a1"), pick("a2", "b2", "a2"), pick("b1", "a1", "b1"), pick("b2", "a2", "b2")).distinct())

    def _fetch(self, docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(h1, h2, first, c, line) of some lines, read where each stands first."""
        at = cut(ids.join(self.first, _ID).select(*_ID, "first"))
        d, need = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).alias("d"), measured(cut(at.select("first.doc").distinct())).alias("r")
        some = d.join(need, F.col("d.doc").eqNullSafe(F.col("r.doc")), "left_semi").select("doc", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        some = some.select(trimmed(F.col("line")).alias("line")).select(*line_id(F.col("line")), "line")
        one = some.join(measured(at), _ID).groupBy(*_ID).agg(F.first("first").alias("first"), F.first("line").alias("line"))
        return cut(one.select(*_ID, "first", letter_counts(F.col("line")).alias("c"), "line"))

    def _tiles(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(owners, lookers) of groups that stay large, with the tiles in which they meet."""
        rows = cut(rows)
        sizes = rows.groupBy("key").agg(F.ceil(F.count_if("own") / SIDE).cast("int").alias("m"), F.ceil(F.count("*") / SIDE).cast("int").alias("n"))
        rows = rows.join(measured(cut(sizes)), "key").join(self.lines, _ID)
        chunk = lambda parts: F.pmod(F.xxhash64("h1", F.lit(3)), F.col(parts)).cast("int")
        own = rows.where("own").select("key", chunk("m").alias("i"), F.explode(F.expr("sequence(0, n - 1)")).alias("j"), *_ID, "first", "c", "line")
        return own, rows.select("key", F.explode(F.expr("sequence(0, m - 1)")).alias("i"), chunk("n").alias("j"), *_ID, "first", "c", "line")

    def _close(self, a: str, b: str) -> Column:
        near = counts_apart(F.col(f"{a}.c"), F.col(f"{b}.c")) <= 2 * self.edits
        return near & (edit_distance(F.col(f"{a}.line"), F.col(f"{b}.line"), self.edits) <= self.edits)

    def _verified(self) -> DataFrame:
        """Pairs within the edits as rows of structs a and b; letter counts are compared before texts are joined."""
        side = lambda x, cols: self.lines.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.struct(*cols).alias(x))
        few = self.pairs.join(side("a", ["c"]), ["a1", "a2"]).join(side("b", ["c"]), ["b1", "b2"])
        few = cut(few.where(counts_apart(F.col("a.c"), F.col("b.c")) <= 2 * self.edits).select("a1", "a2", "b1", "b2"))
        cols = [*_ID, "first", "c", "line"]
        return few.join(side("a", cols), ["a1", "a2"]).join(side("b", cols), ["b1", "b2"]).where(self._close("a", "b")).select("a", "b")

    def links(self) -> DataFrame:
        """(a, b) as structs (h1, h2, first): all links."""
        out = self._verified()
        if self.tiles is not None:
            a, b = (x.alias(n) for x, n in zip(self.tiles, "ab", strict=True))
            met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("key", "i", "j")]).where("a.h1 <> b.h1 or a.h2 <> b.h2").where(self._close("a", "b"))
            side = lambda n: F.struct(*[F.col(f"{n}.{c}").alias(c) for c in (*_ID, "first", "c", "line")]).alias(n)
            out = out.union(met.select(side("a"), side("b")))
        return out

    def later(self) -> DataFrame:
        """(h1, h2) of lines of which a near one stands earlier; a tile stops at the first that it finds for a line."""
        out = self._verified().select(F.when(F.col("a.first") > F.col("b.first"), F.struct("a.h1", "a.h2")).otherwise(F.struct("b.h1", "b.h2")).alias("x")).select("x.h1", "x.h2")
        if self.tiles is not None:
            for x, y in (self.tiles, self.tiles[::-1]):
                a, b = x.alias("a"), y.alias("b")
                on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("key", "i", "j")] + [F.col("b.first") < F.col("a.first"), self._close("a", "b")]
                out = out.union(a.join(b, on, "left_semi").select(*_ID))
        return cut(out.distinct())


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(a, b): hashes of distinct lines that 1 to ``edits`` edits part, a < b; one row a link."""
    occ = _read(docs, id_col, text_col, least, edits, False)
    first = _first(occ)
    links = _Near(docs, first, _again(occ, first), id_col, text_col, edits, least).links()
    return links.select(F.least("a.h1", "b.h1").alias("a"), F.greatest("a.h1", "b.h1").alias("b")).distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, short: bool = True) -> DataFrame:
    """(doc, exact, near): numbers of the lines that go from each document that loses any."""
    occ = _read(docs, id_col, text_col, least, edits, short)
    first = _first(occ)
    near = _Near(docs, first, _again(occ, first), id_col, text_col, edits, least).later().withColumn("is_near", F.lit(True))
    acts = cut(first.join(measured(near), _ID, "left").where("n > 1 or is_near").select(*_ID, "first", "is_near"))
    hit = occ.join(measured(acts), _ID).where(F.col("is_near") | ~F.struct("doc", "pos").eqNullSafe(F.col("first")))
    return hit.groupBy("doc").agg(
        F.collect_set(F.when(F.col("is_near").isNull(), F.col("pos"))).alias("exact"),
        F.collect_set(F.when(F.col("is_near"), F.col("pos"))).alias("near"),
    )


def short_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row (n_lines, n_repeats): lines under ``least`` characters with a letter or digit, and those that repeat an earlier one."""
    short = _occurrences(docs, id_col, text_col, least, True).where(F.length("line") < least)
    n = short.groupBy(F.unhex(F.md5("line")).alias("h")).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return n.agg(total(F.col("n")).alias("n_lines"), total(F.col("n") - 1).alias("n_repeats"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, short: bool = True) -> DataFrame:
    """``docs`` without repeated lines, with n_lines, n_exact and n_near.

    Lines of ``least`` characters or more (blanks at the ends aside) are looked
    at for repeats and near copies, shorter ones that hold a letter or digit for
    exact repeats alone; without ``short`` these stay, and ``short_repeats`` counts
    the repeats among them.  Of equal lines the first stays, by (id, line
    number), nulls first.  A line also goes if one within ``edits`` edits of it
    first occurs earlier.  n_lines counts all lines of the text before, n_exact
    the lines that went as repeats, n_near those that went as near copies.

    Null text stays null and has no lines; empty text has one empty line.
    A text all of whose lines go becomes empty.  Repeated rows: rows of one id
    count as the same document and keep the same lines (so do rows with a null
    id).  Ties can't occur within a document.  Empty table: no rows.  All
    columns pass through; the three added names must not be taken.
    """
    if clash := {"n_lines", "n_exact", "n_near"} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    lost = cut(dropped_lines(docs, id_col, text_col, edits, least, short))
    d, l = docs.alias("d"), measured(lost).alias("l")  # noqa: E741
    whole = F.col(f"d.{text_col}")
    n = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("int")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.concat(F.col("l.exact"), F.col("l.near")))
    kept = F.array_join(let(lines_of(whole), lambda x: F.transform(stay, lambda i: F.get(x, i))), "\n")
    count = lambda c: F.greatest(F.coalesce(F.size(F.col(c)), F.lit(0)), F.lit(0)).cast("long")
    joined = d.join(l, F.col(f"d.{id_col}").eqNullSafe(F.col("l.doc")), "left")
    return joined.select(
        *[F.when(F.col("l.exact").isNull(), whole).otherwise(kept).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns],
        F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"), count("l.exact").alias("n_exact"), count("l.near").alias("n_near"),
    )
