"""Operator 7: mix sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source_size`` times. The whole part is taken
outright; the fraction is a word mass (fraction x size). In a duel two documents of a source pass
mass to and fro at random, expectation and sum kept, until one of them has all or none of its size;
the other goes on. Documents meet first within size classes in groups of about ``group``; each
group's one residual goes to the next level, and so on up to one document a source, a tree of depth
log(n) / log(group). The last one has no partner and goes to the nearer side, so a source misses its
target by half a document at most. Every random number is a hash of the two documents, so reruns
agree. At the end one document a source, of about the size still over or short, is turned where
that brings the source nearer to its target. All of it is DataFrame functions: folds over bounded
arrays.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its own and
sorts last; equal rows (same doc_id, source and size) are counted, then told apart by a running
number; null doc_ids stay null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

DONE = "array<struct<doc_id:bigint,k:bigint,size:bigint,bit:int>>"


def numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``, from 0 by code point order with null last. Sources are sorted into ranges and counted a
    range at a time; the driver holds one count a range."""
    spark = sources.sparkSession
    ranged = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("range").count().collect()):
        offsets.append((r["range"], before))
        before += r["count"]
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    offset = F.broadcast(spark.createDataFrame(offsets, "range int, before long"))
    return ranged.withColumn("within", within).join(offset, "range").select(*sources.columns, (F.col("before") + F.col("within")).alias("place"))


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``sources(source, source_size)`` -> plus ``target``. Weights repeat by code point order, null
    last; shares stop at ``most`` times the source and the excess is reshared by weight until none is
    above. The share of a weight of one only grows from round to round, and each round is one sum."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    s = cut(numbered(sources).select("source", "source_size", w.alias("w"), (most * F.col("source_size")).alias("cap")), "mix-weights")
    total, level, capped = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * level
        n, used, rest = s.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or rest is None:
            break
        capped, level = n, (total - (used or 0.0)) / rest
    return s.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def copies_of(n: Column, at_once: int = 4096) -> tuple[Column, Column]:
    """Two generators in turn that number ``n`` equal rows from 0, without an array of all of them."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / F.lit(at_once)).cast("long")))
    then = F.explode(F.sequence(F.col("_turn") * at_once, F.least(n, (F.col("_turn") + 1) * at_once) - 1))
    return first, then


def _duel(seed: int):
    def step(acc: Column, e: Column) -> Column:
        c = acc["carry"]
        room_c, room_e = c["size"] - c["mass"], e["size"] - e["mass"]
        up, down = F.least(room_c, e["mass"]), F.least(c["mass"], room_e)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), c["doc_id"], c["k"], e["doc_id"], e["k"]), 11) / F.lit(float(1 << 53))
        rise = (up + down <= 0) | (u * (up + down) < down)
        ended = F.when(rise, room_c <= e["mass"]).otherwise(c["mass"] <= room_e)
        mass = F.when(ended, e["mass"] + F.when(rise, -room_c).otherwise(c["mass"])).otherwise(c["mass"] + F.when(rise, e["mass"]).otherwise(-room_e))
        bit = (ended == rise).cast("int")
        out, stay = (lambda n: F.when(ended, c[n]).otherwise(e[n])), (lambda n: F.when(ended, e[n]).otherwise(c[n]))
        done = F.struct(out("doc_id").alias("doc_id"), out("k").alias("k"), out("size").alias("size"), bit.alias("bit"))
        carry = F.struct(stay("size").alias("size"), stay("doc_id").alias("doc_id"), stay("k").alias("k"), mass.alias("mass"))
        return F.struct(carry.alias("carry"), F.concat(acc["done"], F.array(done)).alias("done"))

    return step


def _level(rows: DataFrame, keys: list[str], group: int, seed: int) -> DataFrame:
    """Fold each group of a level: a row has ``done`` and the group's ``carry``."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(group)).alias("groups"))
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "groups")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    dealt = rows.join(sizes, same).select(*rows.columns, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "k"), F.col("groups")).alias("g"))
    packed = dealt.groupBy("source", "source_size", "target", "base", *[k for k in keys if k != "source"], "g").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "k", "mass"))).alias("all"))
    zero = F.struct(F.element_at("all", 1).alias("carry"), F.expr(f"cast(array() as {DONE})").alias("done"))
    return packed.select("source", "source_size", "target", "base", F.aggregate(F.slice("all", 2, F.size("all")), zero, _duel(seed)).alias("x")).select("source", "source_size", "target", "base", "x.done", "x.carry")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, group: int = 64, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; one row per document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"))
    alike = cut(base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    goal = cut(targets(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, most), "mix-targets")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(p + 1e-12)
    goal = goal.withColumnRenamed("source", "_source")
    rows = alike.join(goal, F.col("source").eqNullSafe(F.col("_source"))).select("source", "source_size", "target", whole.cast("int").alias("base"), "doc_id", "size", "n", (F.greatest(p - whole, F.lit(0.0)) * F.col("size")).alias("mass"))
    first, then = copies_of(F.col("n"))
    rows = rows.withColumn("_turn", first).withColumn("k", then).drop("_turn", "n")
    out = ["doc_id", "k", "source", "size", "source_size", "target", "base", "bit"]
    settled = rows.where("mass <= 0").withColumn("bit", F.lit(None).cast("int")).select(*out)
    level = cut(_level(rows.where("mass > 0").withColumn("class", F.floor(F.log2("size"))), ["source", "class"], group, seed), "mix-level")
    done = [level]
    while (most_left := level.groupBy("source").count().agg(F.max("count")).first()[0] or 0) > 1:
        up = level.select("source", "source_size", "target", "base", "carry.doc_id", "carry.size", "carry.k", "carry.mass")
        seed += 1
        level = cut(_level(up, ["source"], group if most_left > group else most_left, seed), "mix-level")
        done.append(level)
    last = level.select("carry.*", "source", "source_size", "target", "base").withColumn("bit", (2 * F.col("mass") >= F.col("size")).cast("int")).select(*out)
    rounded = settled.unionByName(last)
    for x in done:
        rounded = rounded.unionByName(x.select("source", "source_size", "target", "base", F.explode("done").alias("d")).select("d.*", "source", "source_size", "target", "base").select(*out))
    return _mended(cut(rounded, "mix-rounded")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def _mended(rounded: DataFrame) -> DataFrame:
    """Turn one document of each source, the one whose size is nearest to what the last residual
    left over or short, where that brings the source nearer to its target."""
    took = rounded.groupBy("source").agg((F.max("target") - F.sum((F.col("base") + F.coalesce("bit", F.lit(0))) * F.col("size"))).alias("short"))
    took = took.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    off = F.abs(F.abs("short") - F.col("size"))
    turns = ((F.col("short") > 0) & (F.col("bit") == 0)) | ((F.col("short") < 0) & (F.col("bit") == 1))
    best = rounded.join(took, same).where(turns & (F.col("size") > 0) & (off < F.abs("short"))).groupBy("_source").agg(F.min(F.struct(off.alias("off"), F.col("doc_id").alias("_doc"), F.col("k").alias("_k"), F.col("size").alias("_size"))).alias("turn")).select("_source", "turn.*")
    turned = F.col("_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("k") == F.col("_k")) & (F.col("size") == F.col("_size"))
    bit = F.when(turned, 1 - F.col("bit")).otherwise(F.coalesce("bit", F.lit(0)))
    return rounded.join(best, same, "left").withColumn("copies", F.col("base") + bit)
