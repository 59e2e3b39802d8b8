"""Document fingerprints as invertible Bloom lookup sketches, by DataFrame operations only.

A text's paragraphs are cut into pieces of a few words, and each piece's digest is put into three cells of a
sketch: a cell has a count, and the exclusive or of its digests and of their checks. A text's fingerprint is its sketch of
CELLS cells a table. Fingerprints of two versions subtract cell by cell; what both have cancels. A cell with a count of one
or minus one whose check fits gives away a differing digest, which is then taken out of its other cells, until nothing is left.
If that fails, both versions get sketches four times as large, and so on without an end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm import common

#: Words of a piece, with the white space after them; pieces begin anew in every line.
PIECE_WORDS = 16
#: Cells of each of the three tables of a fingerprint, and how many times as many a retry has.
CELLS, GROWTH = 64, 4
#: Sweeps over the three tables.
SWEEPS = 4
#: Parts of the span of ids at least, the rows of a part on average at most, and rows that parts are gathered to.
PARTS, PART_ROWS, BUCKET_ROWS = 32_768, 16_384, 64
#: A part of more rows is cut into SUB smaller ones, up to LEVELS times.
HEAVY, SUB, LEVELS = 4 * PART_ROWS, 1024, 4
#: Bytes of a table of rows that is broadcast at most; a larger one is joined by a shuffle.
MOST_BROADCAST = 32 << 20
#: The texts that sketches are made of: a row's own, its edited one and the next row's; the pairs that are subtracted.
SIDES, PAIRS = ("own", "edit", "next"), (("own", "edit"), ("own", "next"))


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's pieces; none of a null, empty or blank text."""
    pattern = rf"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){{1,{PIECE_WORDS}}}"
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(1))


def _place(d: Column, table: int, cells: Column, seed: int) -> Column:
    """A digest's cell in one of the three tables."""
    return F.xxhash64(d, F.lit(100 + 3 * seed + table)).bitwiseAND(cells - 1)


def sketches(keys: DataFrame, sides: tuple[str, ...], seed: int) -> DataFrame:
    """The cells of the sketches of each row: row, want, cells, tab, pos, and for each side n, key and chk (0: nothing there).

    keys has row, want, cells (of a table) and an array of digests for each side.
    """
    each = F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"{s}_keys").alias("keys")) for k, s in enumerate(sides)))
    rows = keys.select("row", "want", "cells", F.explode(each).alias("s")).select("row", "want", "cells", "s.side", F.explode("s.keys").alias("key"))
    rows = rows.withColumn("chk", _check(F.col("key")))
    at = F.array(*(F.struct(F.lit(t).alias("tab"), _place(F.col("key"), t, F.col("cells"), seed).alias("pos")) for t in range(3)))
    rows = rows.withColumn("at", F.explode(at)).select("row", "want", "cells", "side", "key", "chk", "at.tab", "at.pos")
    sums = []
    for k, s in enumerate(sides):
        here = F.col("side") == k
        sums.append(F.sum(F.when(here, 1).otherwise(0)).alias(f"{s}_n"))
        sums += [F.bit_xor(F.when(here, F.col(c)).otherwise(F.lit(0).cast("long"))).alias(f"{s}_{c}") for c in ("key", "chk")]
    return rows.groupBy("row", "want", "cells", "tab", "pos").agg(*sums)


def subtract(cells: DataFrame) -> DataFrame:
    """The differences of the sketches of the wanted PAIRS (want: bits), cell by cell: row, pair, cells, tab, pos, n, key, chk."""
    minus = [F.struct(F.lit(k).alias("pair"), (F.col(f"{a}_n") - F.col(f"{b}_n")).alias("n"), *(F.col(f"{a}_{c}").bitwiseXOR(F.col(f"{b}_{c}")).alias(c) for c in ("key", "chk"))) for k, (a, b) in enumerate(PAIRS)]
    out = cells.select("row", "want", "cells", "tab", F.col("pos").cast("long").alias("pos"), F.explode(F.array(*minus)).alias("d")).select("row", "want", "d.pair", "cells", "tab", "pos", "d.n", "d.key", "d.chk")
    wanted = F.when(F.col("pair") == 0, F.col("want").bitwiseAND(1)).otherwise(F.col("want").bitwiseAND(2)) > 0
    return out.where(wanted & ((F.col("n") != 0) | (F.col("key") != 0) | (F.col("chk") != 0))).drop("want")


def peel(cells: DataFrame, seed: int) -> DataFrame:
    """Cells after peeling; each recovered digest is counted in a cell of table -1. What else is left couldn't be peeled.

    One table at a time: its cells that hold just one digest hold different ones, which are taken out of
    the other two. Rows of a sketch never leave their task: cells must be partitioned by row.
    """
    by = ["row", "pair", "cells"]
    cell = lambda tab, pos, n, key, chk: F.struct(tab.cast("int").alias("tab"), pos.cast("long").alias("pos"), n.cast("long").alias("n"), key.alias("key"), chk.alias("chk"))
    zero = F.lit(0).cast("long")
    for k in list(range(3)) * SWEEPS:
        pure = (F.col("tab") == k) & (F.abs("n") == 1) & (F.col("chk") == _check(F.col("key")))
        out = [cell(F.lit(j), _place(F.col("key"), j, F.col("cells"), seed), -F.col("n"), F.col("key"), F.col("chk")) for j in range(3) if j != k]
        after = F.when(pure, F.array(cell(F.lit(-1), zero, F.lit(1), zero, zero), *out)).otherwise(F.array(cell(F.col("tab"), F.col("pos"), F.col("n"), F.col("key"), F.col("chk"))))
        cells = cells.select(*by, F.explode(after).alias("x")).select(*by, "x.*").groupBy(*by, "tab", "pos").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
        cells = cells.where("n <> 0 or key <> 0 or chk <> 0")
    return cells


def differing(keys: DataFrame) -> DataFrame:
    """row, pair, n_differing (digests in one version only) and cells (of a table of the sketch that told) of all pairs that differ.

    keys has row and the arrays of digests. The first try subtracts the fingerprints; pairs whose difference can't be
    peeled get sketches GROWTH times as large, with other places, until it can.
    """
    done, left, cells, seed = None, keys.withColumn("want", F.lit(3)), CELLS, 0
    while True:
        sized = left.withColumn("cells", F.lit(cells).cast("long")).repartition("row")
        rest = peel(subtract(sketches(sized, SIDES, seed)), seed)
        found = F.sum(F.when(F.col("tab") == -1, F.col("n")).otherwise(0))
        tried = common.written(rest.groupBy("row", "pair", "cells").agg(found.alias("n_differing"), (F.max("tab") >= 0).alias("failed")))
        good = tried.where("not failed").drop("failed")
        done = good if done is None else done.unionByName(good)
        failed = tried.where("failed").groupBy("row").agg(F.sum(F.when(F.col("pair") == 0, 1).otherwise(2)).cast("int").alias("want"))
        n = failed.count()
        if not n:
            return done
        # Rows to retry are 24 bytes each: a small table of them spares a shuffle of all arrays.
        left, cells, seed = keys.join(F.broadcast(failed) if 24 * n <= MOST_BROADCAST else failed, "row"), cells * GROWTH, seed + 1


def prints(keys: DataFrame) -> DataFrame:
    """row, fingerprint and edited_fingerprint: the sketches as text, for each full cell table, place, count, digest and check."""
    cells = sketches(keys.withColumns({"want": F.lit(0), "cells": F.lit(CELLS).cast("long")}), SIDES[:2], 0)

    def whole(s: str) -> Column:
        text = F.concat_ws(":", F.col("tab").cast("string"), F.col("pos").cast("string"), F.col(f"{s}_n").cast("string"), F.lower(F.hex(f"{s}_key")), F.lower(F.hex(f"{s}_chk")))
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col(f"{s}_n") > 0, text))), " ")

    return cells.groupBy("row").agg(whole("own").alias("fingerprint"), whole("edit").alias("edited_fingerprint"))


def _place_of_hash() -> Column:
    """0 to SUB - 1, rising with the hash that orders rows of one id."""
    return F.least(F.floor((F.xxhash64("text").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * SUB), F.lit(SUB - 1)).cast("long")


def _place_of_id(hi: Column, lo: Column, n: int) -> Column:
    """0 to n - 1, rising as ids fall from hi to lo."""
    down = (hi.cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")).cast("double")
    span = (hi.cast("decimal(20,0)") - lo.cast("decimal(20,0)")).cast("double") + 1
    return F.least(F.floor(down / span * n), F.lit(n - 1)).cast("long")


def _parted(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with part, which rises in the order of rows, and of each part that has rows part, n, top (its first id) and least (its least hash).

    Parts are equal spans of ids; null ids come last. Parts with many rows are cut anew over the span that they have, and
    if they have one id, over the hashes of its texts; least is known of parts with one id that were cut.
    """
    lo, hi, n = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long"), F.count("*")).first()
    parts = max(PARTS, n // PART_ROWS)
    last = F.lit(parts).cast("long")
    out = docs.withColumn("part", last if hi is None else F.when(F.col("doc_id").isNull(), last).otherwise(_place_of_id(F.lit(hi), F.lit(lo), parts)))
    sums = [F.count("*").alias("n"), F.min("doc_id").cast("long").alias("lo"), F.max("doc_id").cast("long").alias("hi")]
    found = out.groupBy("part").agg(*sums, F.lit(None).cast("long").alias("least")).collect()
    for _ in range(LEVELS):
        heavy = [(r.part, r.lo, r.hi) for r in found if r.n > HEAVY]
        if not heavy:
            break
        table = F.broadcast(docs.sparkSession.createDataFrame(heavy, "part long, lo long, hi long").withColumn("cut", F.lit(True)))
        by_id = _place_of_id(F.col("hi"), F.col("lo"), SUB)
        sub = F.when(F.col("cut").isNull(), F.lit(0).cast("long")).when(F.col("lo").isNull() | (F.col("lo") == F.col("hi")), _place_of_hash()).otherwise(by_id)
        out = out.join(table, "part", "left").withColumn("part", F.col("part") * SUB + sub).drop("lo", "hi", "cut")
        found = out.groupBy("part").agg(*sums, F.min(F.xxhash64("text")).alias("least")).collect()
        found = [type(r)(part=r.part, n=r.n, lo=r.lo, hi=r.hi, least=r.least if r.lo == r.hi else None) for r in found]
    return out, sorted(found, key=lambda r: r.part)


def _bucketed(docs: DataFrame) -> DataFrame:
    """docs with bucket, a run of neighbouring rows, and ghost: each bucket's first rows stand in the bucket before too, as ghosts.

    The first bucket stands after the last.
    """
    placed, found = _parted(docs)
    rows, before, last = [], 0, -1
    for r in found:
        bucket = before // BUCKET_ROWS
        rows.append((r.part, bucket, r.hi, r.least, bucket != last))
        before, last = before + r.n, bucket
    order = sorted({r[1] for r in rows})
    behind = {b: order[k - 1] for k, b in enumerate(order)}
    # One row for each part: a few tens of bytes for PART_ROWS texts.
    table = docs.sparkSession.createDataFrame([(p, b, behind[b], t, h, first) for p, b, t, h, first in rows], "part long, own long, behind long, top long, least long, first boolean")
    begins = F.col("first") & F.col("doc_id").cast("long").eqNullSafe(F.col("top")) & (F.col("least").isNull() | (F.xxhash64("text") == F.col("least")))
    at = lambda b, g: F.struct(b.alias("bucket"), F.lit(g).alias("ghost"))
    both = F.when(begins, F.array(at(F.col("own"), False), at(F.col("behind"), True))).otherwise(F.array(at(F.col("own"), False)))
    return placed.join(F.broadcast(table), "part").withColumn("in", F.explode(both)).select(*docs.columns, "in.bucket", "in.ghost")


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, and the digests own_keys and next_keys of each row of docs (doc_id, text); the next row has the next smaller id.

    Rows of the same id are ordered by their texts; the row after the last is the first. A null text is empty.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = _bucketed(d).withColumn("own_keys", digests(F.col("text")))
    order = W.Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    rows = rows.withColumn("after", F.lead(F.struct("text", "own_keys")).over(order)).where("not ghost")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("after.text", F.lit(1), half))
    return rows.select("doc_id", "text", edited.alias("edited"), "own_keys", F.col("after.own_keys").alias("next_keys"))


def compare(docs: DataFrame) -> DataFrame:
    """The fingerprints of each text and of its edited text, and how like they are; see versions for the order of rows.

    near_edited and near_next are the shares of common digests, from the differences of fingerprints; cells_edited and cells_next tell
    how large (cells of a table) the sketches were that could be peeled. Rows of equal texts have equal fingerprints; an
    empty or blank text has that of no piece, and two such are alike. Rows with a null id come last, repeated rows count each.
    """
    v = versions(docs).withColumn("edit_keys", digests(F.col("edited")))
    keys = common.written(v.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(f"{s}_keys" for s in SIDES)))
    arrays = keys.select("row", *(f"{s}_keys" for s in SIDES))
    apart = differing(arrays)
    of = lambda c, k: F.max(F.when(F.col("pair") == k, F.col(c)))
    apart = apart.groupBy("row").agg(*(of(c, k).alias(f"{c}{k}") for k in range(2) for c in ("n_differing", "cells")))
    sizes = keys.select("row", "doc_id", "n_chars", "edited_sha256", *((F.size(f"{a}_keys") + F.size(f"{b}_keys")).alias(f"both{k}") for k, (a, b) in enumerate(PAIRS)))
    out = sizes.join(apart, "row", "left").join(prints(arrays.repartition("row")), "row", "left")

    def likeness(k: int) -> Column:
        both, d = F.col(f"both{k}"), F.coalesce(F.col(f"n_differing{k}"), F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))

    printed = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("fingerprint", "edited_fingerprint"))
    cells = (F.coalesce(F.col(f"cells{k}"), F.lit(CELLS).cast("long")).alias(c) for k, c in enumerate(("cells_edited", "cells_next")))
    return out.select("doc_id", "n_chars", "edited_sha256", *printed, likeness(0).alias("near_edited"), likeness(1).alias("near_next"), *cells)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(common.read(spark, sf_dir, "documents"))
