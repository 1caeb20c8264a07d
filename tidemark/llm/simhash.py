"""Near-duplicate components by SimHash and multi-index hashing.

A text is lower-cased (A-Z), cut into words at blanks, and its runs of three words, repeats included, are hashed by
XXH64 (seed 42). A bit of its fingerprint is 1 if it is 1 in over half of the hashes. Texts whose fingerprints differ in
RADIUS bits at most are linked; components of the links are the classes.

A fingerprint has two segments of 32 bits, so two that differ in three bits have a segment in which they differ in one
at most. For each segment the ball of radius one is enumerated: the segment as it is, and with one more bit set. (Of two
segments that differ in one bit one lacks that bit, so one of the two balls meets the other segment.) The balls are used
twice:

1. With the rest of the fingerprint: whoever shares such a key is within one bit of it, so linked through it. At most 65
   fingerprints share one. This joins most of what is alike without looking at a pair.
2. Without the rest: the table of fingerprints is looked up by segment and each match is verified over all 64 bits. Only
   matches between different components of the first step matter. Keys under which all are of one component are left
   out by counts, before anything meets. Keys with many fingerprints (over LIGHT) are split further by the four bytes of
   the rest, of which one has to agree too. Under a key what is outside its largest component meets the others in blocks
   of BLOCK, so that a component of any size costs its size, not its square. Each link found is one between components.

Equal fingerprints are one node throughout; documents get their component by a join in which hot fingerprints are split.

Defined cases
- null, empty and blank texts: no words, fingerprint zero, linked like any other.
- fewer words than three: one run, all words. Ties (a bit in exactly half of the hashes): 0.
- long texts: hashed whole, RUNS hashes at a time.
- repeated rows: each is returned, in the same component. Null doc_ids: returned, and never the least; a component of
  nothing else has a null id.
- empty table: no rows. Extra columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import joined_by_count, written
from tidemark.llm.near_duplicates import components

WORDS = 3
SEED = 42
RADIUS = 3
#: Hashes whose bits are counted at a time.
RUNS = 1 << 14
#: Bytes of text that are held as words at a time.
CHUNK = 4_000_000
#: A key with more fingerprints is split by the bytes of the rest.
LIGHT = 64
#: Fingerprints of a key in a block.
BLOCK = 1_000

_HALF = (1 << 32) - 1


def hashes(text: bytes) -> np.ndarray:
    """XXH64 of every run of words of a UTF-8 text, in order."""
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    runs = zip(*(words[k:] for k in range(WORDS)), strict=False)
    return np.fromiter((digest(b" ".join(r), SEED) for r in runs), np.uint64, len(words) - WORDS + 1)


def fingerprint(text: bytes | None) -> int:
    """The 64 bits of a text, unsigned."""
    h = hashes(text or b"").astype("<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), RUNS):
        ones += np.unpackbits(h[at : at + RUNS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            part = batch.slice(lo, hi - lo)
            bits = np.array([fingerprint(t) for t in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and bits (64, as a long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, bits long")


def _balls(nodes: DataFrame) -> DataFrame:
    """The columns of `nodes` (with bits) for each member of the balls of both segments.

    flip: the bit that is set besides, or -1 and -2 for the first and the second segment as it is; segment: 0 or 1;
    whole: the fingerprint with that bit.
    """
    all_ = nodes.select("*", F.explode(F.sequence(F.lit(-2), F.lit(63))).alias("flip"))
    bit = F.expr("shiftleft(1L, greatest(flip, 0))")
    unset = F.col("bits").bitwiseAND(bit) == 0
    return all_.where((F.col("flip") < 0) | unset).select(
        "*",
        F.when(F.col("flip") < 0, -1 - F.col("flip")).otherwise(F.expr("flip div 32")).cast("int").alias("segment"),
        F.when(F.col("flip") < 0, F.col("bits")).otherwise(F.col("bits").bitwiseOR(bit)).alias("whole"),
    )


def _segment(bits: Column, segment: Column) -> Column:
    """The 32 bits of a segment, as a long."""
    return F.when(segment == 0, bits.bitwiseAND(F.lit(_HALF))).otherwise(F.shiftrightunsigned(bits, 32))


def _stars(nodes: DataFrame) -> DataFrame:
    """Links (a, b) through members of balls that several fingerprints share; 65 at most share one."""
    shared = _balls(nodes).where("flip <> -2").groupBy("whole").agg(F.collect_set("bits").alias("all")).where(F.size("all") > 1)
    links = shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b"))
    return links.where(F.col("a") != F.col("b")).distinct()


def _between(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the components (comp) of `nodes` (bits, comp) that some two of their fingerprints make."""
    probes = _balls(nodes).select("bits", "comp", (F.col("flip") < 0).alias("own"), "segment", (_segment(F.col("whole"), F.col("segment")) * 2 + F.col("segment")).alias("key"))
    count = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("own").alias("listed"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    mixed = F.expr("listed AND least <> most")
    keys = written(count(probes, "key").where(mixed).select("key", "n"), "simhash-keys")
    found = written(joined_by_count(probes, keys, ["key"]), "simhash-found")
    rest = _segment(F.col("bits"), 1 - F.col("segment"))
    light = found.where(F.col("n") <= LIGHT).withColumn("part", F.lit(-1)).withColumn("byte", F.lit(0).cast("long"))
    heavy = found.where(F.col("n") > LIGHT).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("byte", rest)
    heavy = heavy.withColumn("byte", F.expr("shiftrightunsigned(byte, 8 * part) & 255L"))
    by = ["key", "part", "byte"]
    rows = light.unionByName(heavy).drop("n", "segment")
    sizes = rows.groupBy(*by, "comp").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    tops = sizes.groupBy(*by).agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.max("own").alias("listed"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    tops = written(tops.where(mixed).select(*by, "top", "n"), "simhash-tops")
    placed = written(joined_by_count(rows, tops, by).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "simhash-placed")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("bits", "comp", "own")]
    outside = placed.where("comp <> top").select(*by, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), *side("x"))
    inside = placed.select(*by, F.pmod(F.xxhash64("bits", "own"), F.col("blocks")).cast("int").alias("block"), *side("y"))
    close = F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits"))) <= RADIUS
    met = outside.join(inside, [*by, "block"]).where(close & (F.col("x_comp") != F.col("y_comp")) & (F.col("x_own") | F.col("y_own")))
    return met.select(F.least("x_comp", "y_comp").alias("a"), F.greatest("x_comp", "y_comp").alias("b")).distinct()


def _named(links: DataFrame) -> DataFrame | None:
    """node, label of written links; None if there are none."""
    links = written(links, "simhash-links")
    return components(links) if links.limit(1).count() else None


def linked(nodes: DataFrame) -> DataFrame:
    """bits, comp (the same for all fingerprints that links lead to) of `nodes`, a written table of distinct bits."""
    stars = _named(_stars(nodes.select("bits")))
    placed = nodes.select("bits", F.col("bits").alias("comp"))
    if stars is not None:
        placed = nodes.select("bits").join(stars, F.col("bits") == F.col("node"), "left").select("bits", F.coalesce("label", "bits").alias("comp"))
    placed = written(placed, "simhash-stars")
    more = _named(_between(placed))
    if more is None:
        return placed
    return placed.join(more, F.col("comp") == F.col("node"), "left").select("bits", F.coalesce("label", "comp").alias("comp"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id that links lead to) of every row of `docs`."""
    rows = written(fingerprints(docs), "simhash-rows")
    nodes = written(rows.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    comps = written(linked(nodes), "simhash-comps")
    known = nodes.join(comps, "bits")
    ids = known.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = written(ids, "simhash-ids")
    named = written(joined_by_count(known.select("bits", "comp", F.col("n").alias("rows")), ids, ["comp"]).select("bits", "component_id", F.col("rows").alias("n")), "simhash-named")
    return joined_by_count(rows, named, ["bits"]).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
