"""Exact dedup by progressive refinement: length, then a prefix's hash, then the full hash.

Only rows whose (length, prefix hash) occurs again are hashed in full, and only
full hashes name a group.  What survives a step is handed to the next scan as a
bitmap of bounded size: it may let rows through that have no partner, never
keeps one back, and the full hash decides.  Texts stay in the rows they are
read from; narrow rows are shuffled.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilayer.llm._spark import cut

#: Characters of the normalised text that the second step hashes.
PREFIX = 64
#: Bits of one row of a bitmap, most rows of it (32 MB in all), bits a key.
ROW_BITS, MOST_ROWS, KEY_BITS = 1 << 15, 1 << 13, 16
#: Groups with more than one row in so many are joined by broadcast: there are at most as many of them.
HOT_SHARE = 10_000


def normalised(text: Column) -> Column:
    """The text without space and \\x09-\\x0D; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r ", "")


def _slot(key: Column, rows: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(rows * ROW_BITS))


def _bitmap(keys: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """``keys`` (materialised) as (bucket, bits), and the number of buckets, a power of two of at most MOST_ROWS."""
    rows = 1
    most = keys.count() * KEY_BITS
    while rows < MOST_ROWS and rows * ROW_BITS < most:
        rows *= 2
    slot = keys.select(_slot(key, rows).alias("s"))
    bits = slot.groupBy(F.floor(F.col("s") / ROW_BITS).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("s") % ROW_BITS).alias("_bits"))
    return cut(bits), rows


def _marked(df: DataFrame, key: Column, bitmap: tuple[DataFrame, int], name: str) -> DataFrame:
    """``df`` with a boolean column: may ``key`` be among the bitmap's keys?"""
    bits, rows = bitmap
    at = _slot(key, rows)
    df = df.withColumn("_at", at).join(F.broadcast(bits), F.floor(F.col("_at") / ROW_BITS) == F.col("_bucket"), "left")
    place = (F.col("_at") % ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col("_bits").isNotNull() & (F.call_function("getbit", byte, place % 8) == 1)
    return df.withColumn(name, hit).drop("_at", "_bucket", "_bits")


def _lengths(docs: DataFrame, text_col: str) -> DataFrame:
    """(n, p) of each row: length of the normalised text and hash of its prefix."""
    t = docs.select(normalised(F.col(text_col)).alias("_t"))
    return t.select(F.length("_t").alias("n"), F.xxhash64(F.substring("_t", 1, PREFIX)).alias("p"))


def _resolved(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(_id, _x0.., _keep, _size, _kept) of each row."""
    narrow = cut(_lengths(docs, text_col))
    lengths = cut(narrow.groupBy("n").count().where("count > 1").select("n"))
    again = _marked(narrow, F.col("n"), _bitmap(lengths, F.col("n")), "_again").where("_again")
    prefixes = cut(again.groupBy("n", "p").count().where("count > 1").select(F.struct("n", "p").alias("k")))

    named = [F.col(f"`{c}`").alias(f"_x{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), *named, F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).alias("_points"), normalised(F.col(f"`{text_col}`")).alias("_t"))
    key = F.struct(F.length("_t").alias("n"), F.xxhash64(F.substring("_t", 1, PREFIX)).alias("p"))
    rows = _marked(rows.withColumn("_k", key), F.col("_k"), _bitmap(prefixes, F.col("k")), "_again")
    kept_cols = ["_id", *[f"_x{i}" for i in range(len(carry))]]
    rows = cut(rows.select(*kept_cols, "_points", F.when(F.col("_again"), F.sha2("_t", 256)).alias("_h"), F.monotonically_increasing_id().alias("_row")))

    best = F.min(F.struct((-F.col("_points")).alias("points"), F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = rows.where(F.col("_h").isNotNull()).groupBy("_h").agg(F.count("*").alias("_size"), best.alias("_best")).where("_size > 1")
    groups = cut(groups.select("_h", "_size", F.col("_best.id").alias("_keep"), F.col("_best.row").alias("_first")))
    hot = F.broadcast(groups.where(F.col("_size") > max(HOT_SHARE // 100, rows.count() // HOT_SHARE)))

    seen = rows.where(F.col("_h").isNotNull())
    alone = rows.where(F.col("_h").isNull()).select(*kept_cols, F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    large = seen.join(hot, "_h").select(*kept_cols, "_keep", "_size", (F.col("_row") == F.col("_first")).alias("_kept"))
    rest = seen.join(hot.select("_h"), "_h", "left_anti").join(groups, "_h", "left")
    single = F.col("_first").isNull()
    rest = rest.select(
        *kept_cols,
        F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("_size"),
        (single | (F.col("_row") == F.col("_first"))).alias("_kept"),
    )
    return alone.unionByName(large).unionByName(rest)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, [carry], keep_id, group_size, kept): the group of each row of ``docs``, dropped rows too.

    Texts are equal when they are identical without space and \\x09-\\x0D.  Of
    equal ones the row with the most code points in the original text stays,
    then the one with the smallest id, null last; ``keep_id`` is its id.

    Null text: the empty text, equal to blank ones.  Null id: a row like others.
    Ties and repeated rows: exactly one row of a group is kept.  Long texts are
    compared whole.  Empty table: no rows.  Columns that aren't carried are left
    out; a carried one named like a result is an error.
    """
    clash = {id_col, *carry} & {"keep_id", "group_size", "kept"}
    if clash:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    out = _resolved(docs, id_col, text_col, carry)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_x{i}").alias(c) for i, c in enumerate(carry)], F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns under their names."""
    out = _resolved(docs, id_col, text_col, tuple(docs.columns)).where("_kept")
    return out.select(*[F.col(f"_x{i}").alias(c) for i, c in enumerate(docs.columns)])
