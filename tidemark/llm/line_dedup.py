"""Line de-duplication by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are the same if their words (parted by blanks) are equal, or if one word's insertion, deletion or
replacement turns one into the other and both have at least `min_words` words. That is the bound as a function of a
line's length: one word, if that is a fifth of the line at most; none for lines of one to four words, which one word
makes another line (any two lines of one word are one edit apart). A line goes if an equal or near line comes before
it, by doc_id, text and place.

A line's variants are the line without its i-th word, and the line itself with a gap at each place, each keyed by a
hash of what stands before the gap and what stands after it. Lines that share a variant are then at most one edit
apart, all of them, so the earliest line of a variant stands for the rest and no pairs are made within a group. Its
words are compared with the line's at the end, which removes hash collisions.

Lines one edit apart also agree in their first or last half, so only lines that share a half with a different line
emit variants. Nothing is lost by that: the halves of a line of n words are cut as for n and for n - 1 words.
Counts by half, variant and line are grouped aggregates with map-side combining, whatever the size of the group.

Defined cases
- null text: no lines. Lines without words: never removed. Lines shorter than `min_words`: equal lines only.
- null doc_id: after all others, like the largest id that a long holds. Repeated rows (same doc_id and text) are one document; each row is returned.
- long lines: variants come from running hashes, in proportion to the line's length.
- empty table: no rows. Extra columns: kept by `clean`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded, columns_of, written

MIN_WORDS = 5
LAST = 2**63 - 1


def _lines(docs: DataFrame) -> DataFrame:
    """id, text_hash, line_no, line (its words, parted by single spaces), n (how many), h1, h2: every line with words."""
    # Plain texts, whose only blanks are single spaces and line ends, pass as they are; a search is cheaper than a pattern.
    odd = reduce(lambda a, b: a | b, [F.contains("text", F.lit(b)) for b in ("  ", "\t", "\x0b", "\x0c", "\r")])
    spaced = F.when(odd, F.regexp_replace("text", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("text"))
    rows = docs.select(F.coalesce(docs["doc_id"], F.lit(LAST)).alias("id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text")).where("text IS NOT NULL")
    split = rows.select("id", "text_hash", F.posexplode(F.split(spaced, "\n")).alias("line_no", "line"))
    line = split.select("id", "text_hash", "line_no", F.trim("line").alias("line")).where("line <> ''")
    counted = line.withColumn("n", F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1)
    return counted.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))


def _halves() -> Column:
    """Hashes of the first and last half of a line's words, cut as for n and for n - 1 words."""
    n, line = F.col("n"), F.col("line")
    first = lambda m: F.xxhash64(F.lit("first"), m, F.call_function("substring_index", line, F.lit(" "), m))
    last = lambda m: F.xxhash64(F.lit("last"), m, F.call_function("substring_index", line, F.lit(" "), -m))
    low, high = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    return F.array_distinct(F.array(first(low), first(high), last((n - low).cast("int")), last((n - 1 - high).cast("int"))))


def _variants(suspects: DataFrame) -> DataFrame:
    """first (the line's first occurrence, which stands for it) and variant: keys of each suspect line's variants."""
    words = suspects.select("first", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    fore, aft = F.xxhash64("i", "word"), F.xxhash64(F.col("n") - F.col("i"), "word")
    hashed = words.select("first", "n", "i", fore.alias("fore"), aft.alias("aft"))
    own = Window.partitionBy("first")
    none = F.lit(0).cast("long")
    before = F.coalesce(F.bit_xor("fore").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), none)
    after = F.coalesce(F.bit_xor("aft").over(own.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)), none)
    cut = hashed.select("*", before.alias("before"), after.alias("after"))
    without = F.xxhash64("i", "before", "after")
    gap = F.xxhash64("i", "before", F.col("after").bitwiseXOR(F.col("aft")))
    end = F.xxhash64("n", F.col("before").bitwiseXOR(F.col("fore")), none)
    keys = F.array(without, gap, F.when(F.col("i") == F.col("n") - 1, end))
    return cut.select("first", F.explode(keys).alias("variant")).where("variant IS NOT NULL")


def _within_one(a: Column, b: Column) -> Column:
    """One word's insertion, deletion or replacement at most: what the ends have in common leaves one word."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def same(x: Column, y: Column) -> Column:
        miss = F.array_position(F.transform(x, lambda w, i: F.coalesce(w == F.get(y, i), F.lit(False))), False)
        return F.when(miss == 0, F.size(x)).otherwise(miss - 1)

    return (long - short <= 1) & (same(a, b) + same(F.reverse(a), F.reverse(b)) >= long - 1)


def decisions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, text_hash, n_lines (with words) and removed (numbers of the lines that go) of each text with lines."""
    order = F.struct("id", "text_hash", "line_no")
    lines = _lines(docs)
    seen = written(lines.select("id", "text_hash", "line_no", "h1", "h2", F.when(F.col("n") >= min_words, _halves()).alias("halves")), "lines")
    first = written(seen.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last")), "first-lines")

    halves = seen.where("halves IS NOT NULL").select("h1", "h2", F.explode("halves").alias("half"))
    ends = halves.groupBy("half").agg(F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"), F.max("h2").alias("b2"))
    shared = ends.where("a1 <> b1 OR a2 <> b2").select("half")
    names = written(halves.join(shared, "half").select("h1", "h2").distinct(), "suspect-names")
    texts = lines.select("h1", "h2", "line").join(bounded(names), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    suspects = written(texts.join(first.select("h1", "h2", "first"), ["h1", "h2"]).withColumn("words", F.split("line", " ")).drop("line"), "suspects")

    variants = written(_variants(suspects), "variants")
    earliest = variants.groupBy("variant").agg(F.min("first").alias("earliest"), F.max("first").alias("latest")).where("earliest <> latest").select("variant", "earliest")
    tried = variants.join(earliest, "variant").where("earliest < first").select("first", "earliest").distinct()
    theirs = suspects.select(F.col("first").alias("earliest"), F.col("words").alias("other"))
    near = tried.join(suspects, "first").join(theirs, "earliest").where(_within_one(F.col("words"), F.col("other"))).select("h1", "h2").distinct()

    doubles = first.where("first <> last").select("h1", "h2", "first")
    goes = doubles.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "full")
    gone = F.coalesce("near", F.lit(False)) | F.coalesce(order != F.col("first"), F.lit(False))
    marked = seen.select("id", "text_hash", "line_no", "h1", "h2").join(goes, ["h1", "h2"], "left").select("id", "text_hash", F.when(gone, F.col("line_no")).alias("off"), "line_no").distinct()
    return written(marked.groupBy("id", "text_hash").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list("off")).alias("removed")), "lines-gone")


def judge(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with words), n_removed and removed (line numbers from 0) of every row of `docs`."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_hash"))
    found = rows.join(decisions(docs.select("doc_id", "text"), min_words), ["id", "text_hash"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without the lines that go; all other columns as they were."""
    gone = decisions(docs.select("doc_id", "text"), min_words).where(F.size("removed") > 0).select("id", "text_hash", "removed")
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.coalesce(docs["doc_id"], F.lit(LAST)).alias("id"), F.xxhash64(docs["text"]).alias("text_hash"))
    found = rows.join(gone, ["id", "text_hash"], "left")
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("removed", i), F.lit(False))), "\n")
    return found.select(*[(F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(left) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
