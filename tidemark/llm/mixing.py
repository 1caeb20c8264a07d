"""Mixing sources to target weights by Pfair scheduling.

Each source has a target of `parts` out of W, the sum of all parts; sources without a target share the one named
REST. The texts of a source, in hashed order, fill blocks of `block_units` (characters, unless a column says
otherwise). Block b of a source with a parts is released at slot floor(b W / a) and due by slot
ceil((b + 1) W / a); of the released blocks the one with the earliest deadline takes the slot. With weights that
sum to 1 every block meets its window, so after any number of slots each source is less than one block away from
its share of them, for as long as all sources last; the slots of a source that has run out stay empty.

Releases and deadlines repeat after W slots, so one period is scheduled (W is at most MAX_PARTS) and each block
looks up its slot by its number within the period. Places within a source come from sums by (source, hash prefix),
so that no task holds a source: a hot source is spread over 4096 prefixes.

Defined cases
- null source: like a source without a target. Null or non-positive size: 1. Null doc_id: hashed as empty text.
- repeated rows and ties: equal rows share their places in some order; the set of rows returned is the same.
- empty table: no rows. No targets: everything is REST. Extra columns: kept by `interleaved`, whatever their names.
- empty or long texts: a text starts in the block of its first unit; a long one may leave later blocks empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import columns_of

REST = "*"
MAX_PARTS = 10_000
PREFIX = 3  # hexadecimal digits of the hashed order


def period(spark: SparkSession, parts: dict[str, int]) -> DataFrame:
    """source, parts, ordinal, at: which slot of a period the ordinal-th block of a source takes.

    Earliest deadline first over the W slots of one period, as one SQL aggregate over the slots.
    """
    total = sum(parts.values())
    if not 0 < total <= MAX_PARTS or min(parts.values()) < 1:
        raise ValueError(f"parts have to be positive and to sum to {MAX_PARTS} at most")
    names = sorted(parts)
    # The next block of source i: s.done[i] blocks are placed, a[i] parts are due in W slots.
    pick = (
        "array_min(filter(transform(s.done, (c, i) -> named_struct("
        "'deadline', ((c + 1) * w + a[i] - 1) div a[i], 'i', i, 'release', (c * w) div a[i])), x -> x.release <= t)).i"
    )
    one = spark.createDataFrame([(names, [parts[n] for n in names], total)], "names array<string>, a array<int>, w int")
    slots = one.withColumn(
        "picked",
        F.expr(
            f"""aggregate(sequence(0, w - 1), named_struct('done', array_repeat(0, size(a)), 'picked', CAST(array() AS array<int>)),
            (s, t) -> transform(array({pick}), p -> named_struct(
                'done', transform(s.done, (c, i) -> c + if(i = p, 1, 0)), 'picked', array_append(s.picked, p)))[0],
            s -> s.picked)"""
        ),
    )
    at = slots.select("names", "a", F.posexplode("picked").alias("at", "i"))
    return at.select(
        F.get("names", F.col("i")).alias("source"),
        F.get("a", F.col("i")).alias("parts"),
        (F.row_number().over(Window.partitionBy("i").orderBy("at")) - 1).alias("ordinal"),
        "at",
    )


def _schedule(rows: DataFrame, parts: dict[str, int], block_units: int) -> DataFrame:
    """`rows` (row, doc_id, source, size) with grp, key, block, release, deadline and slot."""
    spark, total = rows.sparkSession, sum(parts.values())
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))
    named = [n for n in parts if n != REST]
    keyed = rows.select(
        "row",
        "doc_id",
        F.when(F.col("source").isin(named), F.col("source")).otherwise(F.lit(REST)).alias("grp"),
        size.alias("units"),
    )
    keyed = keyed.withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("units").cast("string"))))
    keyed = keyed.withColumn("prefix", F.substring("key", 1, PREFIX))
    before = Window.partitionBy("grp").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("grp", "prefix").agg(F.sum("units").alias("n")).select("grp", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("grp", "prefix").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("units").over(within), F.lit(0))).join(starts, ["grp", "prefix"])
    blocks = placed.withColumn("block", F.expr(f"(base + within) div {int(block_units)}"))
    ordinals = F.broadcast(period(spark, parts).select(F.col("source").alias("grp"), "parts", "ordinal", "at"))  # MAX_PARTS rows at most
    own = F.create_map(*[x for n, a in sorted(parts.items()) for x in (F.lit(n), F.lit(a))])
    a = own[F.col("grp")]
    found = blocks.withColumn("ordinal", (F.col("block") % a).cast("int")).join(ordinals, ["grp", "ordinal"])
    return found.select(
        "row",
        "doc_id",
        "grp",
        "key",
        "block",
        F.expr(f"(block * {total}) div parts").alias("release"),
        F.expr(f"((block + 1) * {total} + parts - 1) div parts").alias("deadline"),
        F.expr(f"(block div parts) * {total} + at").alias("slot"),
    )


def with_rest(parts: dict[str, int], rest: int = 1) -> dict[str, int]:
    """Targets with a share for all other sources."""
    return {REST: rest} | dict(parts)


def schedule(docs: DataFrame, parts: dict[str, int], block_units: int, size: str | Column = "n_chars") -> DataFrame:
    """doc_id, grp (the target it counts for), block, release, deadline and slot of every row of `docs`."""
    size = F.col(size) if isinstance(size, str) else size
    rows = docs.select(F.lit(None).cast("int").alias("row"), "doc_id", "source", size.alias("size"))
    return _schedule(rows, with_rest(parts) if REST not in parts else parts, block_units).select("doc_id", "grp", "block", "release", "deadline", "slot")


def interleaved(docs: DataFrame, parts: dict[str, int], block_units: int) -> DataFrame:
    """All rows of `docs` with their columns, range-partitioned and sorted by slot: written files follow the mix."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), docs["doc_id"], docs["source"], docs["n_chars"].alias("size"))
    placed = _schedule(rows, with_rest(parts) if REST not in parts else parts, block_units)
    return placed.select("row", "slot", "key").repartitionByRange("slot", "key").sortWithinPartitions("slot", "key").select("row.*")
