"""Near-duplicate classes by ProbMinHash, banding and verification.

A text is the multiset of its runs of five terms; a run's weight is how often it occurs. Each run is a Poisson
process whose rate is its weight; every arrival falls on one of the registers, which keeps the run that arrives
first. A run stops arriving once its next arrival is later than all registers' (early termination), so a text costs
about its length plus m log m arrivals. Two texts agree in a register with the probability Jaccard similarity of
their weighted runs. BANDS bands of ROWS registers make candidates: texts at 0.8 share none with odds of 1 in 10^4.
A text that repeats runs has a second sketch, of its runs with weight one, in the same bands: a text and its like
with a stutter in it have alike sets of runs, however far apart their weights are.

Candidates are verified: a link needs a Jaccard similarity of their sets of runs of at least 0.8, computed exactly.
First in rounds by leaders: within a bucket, texts outside its largest class are tried against one member of that
class and one of the others; in the first round each text is its own class. Further rounds try the buckets that still
hold several classes against members drawn anew, and finer buckets of two bands, where what meets is likelier to be
similar, until a round finds no link (LEADER_ROUNDS at most). Then an exact round: in each bucket that still holds
several classes, every text outside the largest is held, in blocks of BLOCK members, against every text of another
class. A pair is left out if it cannot be similar: each text has a map of BITS bits, in which its runs set bits by
hash; a bit that one text has and the other lacks stands for a run that they do not share, so sizes and maps bound
their similarity from above, and only what may reach SIMILAR is tried. After it no two texts of a bucket that are
similar are in two classes, whatever the rounds before found; what they save is pairs within classes, which are never
looked at. No pair is tried twice. Classes are the connected components of the links, found by label propagation with
each step written.

Copies are one text throughout: texts are compared by a 128-bit key and joined to their rows at the end.

Defined cases
- null, empty and wordless texts: no runs, each row is a class of its own and kept.
- texts of fewer than five terms: one run, all of its terms.
- long texts: sketched whole. Ties: the least doc_id stays; null ids come last.
- repeated rows: copies of each other; `judge` marks all rows with the least id, `one_of_each` returns one of them.
- empty table: no rows. Extra columns: kept by `one_of_each`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, columns_of, joined_by_count, mixed, shingles_of, terms_of, text_key, written

TERMS = 5
BANDS, ROWS = 24, 5
SIMILAR = 0.8
LEADER_ROUNDS = 3
#: Members of a bucket in a block of the exact round, about.
BLOCK = 1_000
#: Bits of a text's map of runs, 64 to a number.
BITS = 1024
#: Bytes of text that are sketched at a time.
CHUNK = 1_000_000

_U = np.uint64


def weighted_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct run of five terms, ordered by text."""
    split = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    words = [w for s in split for w in s]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=True).astype(_U)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # terms from here to the text's end
    run, place = np.zeros(len(words), _U), np.arange(len(words))
    for k in range(TERMS):
        there = np.minimum(place + k, len(words) - 1)
        run = mixed(run * _U(0x9E3779B97F4A7C15) + np.where(k < left, h[there], _U(0)) + _U(k))
    starts = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = (left >= TERMS) | (starts == 0)
    doc, run = doc[whole], run[whole]
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
    at = np.flatnonzero(new)
    return doc[at], run[at], np.diff(np.append(at, len(doc))).astype(np.float64)


def sketch(texts: list[str], registers: int = BANDS * ROWS) -> np.ndarray:
    """The run that arrives first at each register, a row a text; zeros for a text without runs."""
    return arrivals(*weighted_runs(texts), len(texts), registers)


def arrivals(doc: np.ndarray, run: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """`sketch` of `n` texts from their runs and the runs' weights."""
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, _U)
    time, turn = np.zeros(len(doc)), 0
    while len(doc):
        turn += 1
        draw = mixed(run + _U((turn * 0x9E3779B97F4A7C15) % 2**64))
        uniform = ((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight
        cell = doc * registers + (mixed(draw ^ _U(0xD1B54A32D192ED03)) % _U(registers)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        kept[cell[won]] = run[won]
        texts_left, inverse = np.unique(doc, return_inverse=True)
        last = first.reshape(-1, registers)[texts_left].max(axis=1)[inverse]
        on = time < last
        doc, run, weight, time = doc[on], run[on], weight[on], time[on]
    return kept.reshape(-1, registers)


def band_hashes(sketches: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sketches), BANDS), _U)
    for r in range(ROWS):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + sketches[:, r::ROWS][:, :BANDS])
    return out


def bands_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many runs each text has, its map of them, how many band hashes (BANDS, or twice if runs repeat), and all of these in a row."""
    doc, run, weight = weighted_runs(texts)
    runs = np.bincount(doc, minlength=len(texts))
    bit = mixed(run ^ _U(0x5851F42D4C957F2D)) % _U(BITS)
    maps = np.zeros((len(texts), BITS // 64), _U)
    np.bitwise_or.at(maps, (doc, (bit >> _U(6)).astype(np.int64)), _U(1) << (bit & _U(63)))
    hashes = band_hashes(arrivals(doc, run, weight, len(texts)))
    repeats = np.unique(doc[weight > 1])
    if not len(repeats):
        return runs, maps, np.full(len(texts), BANDS), hashes.ravel()
    own = np.isin(doc, repeats)
    second = band_hashes(arrivals(np.searchsorted(repeats, doc[own]), run[own], np.ones(own.sum()), len(repeats)))
    which = np.concatenate([np.arange(len(texts)), repeats])
    order = np.argsort(which, kind="stable")
    return runs, maps, np.bincount(which) * BANDS, np.concatenate([hashes, second])[order].ravel()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of the texts of each batch, CHUNK characters (one text at least) at a time."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            part = batch.slice(lo, hi - lo)
            runs, maps, counts, hashes = bands_of(part.column("text").to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
            bits = pa.ListArray.from_arrays(np.arange(len(maps) + 1, dtype=np.int32) * (BITS // 64), pa.array(maps.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key_a"), part.column("key_b"), pa.array(runs.astype(np.int32)), bits, bands], ["key_a", "key_b", "size", "bits", "bands"])


def _has_terms(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def _node() -> Column:
    return F.struct("key_a", "key_b").alias("node")


def _draw(node: Column, turn: int) -> Column:
    """A text's place in the order of a round; its key in the first."""
    if turn == 0:
        return F.struct(node["key_a"].alias("h"), node["key_b"].alias("k"))
    return F.struct(F.xxhash64(F.lit(turn), node["key_a"], node["key_b"]).alias("h"), node["key_b"].alias("k"))


def _linked(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of runs have a Jaccard similarity of at least SIMILAR."""
    both = pairs.join(runs.select(F.col("node").alias("a"), F.col("runs").alias("runs_a")), "a").join(
        runs.select(F.col("node").alias("b"), F.col("runs").alias("runs_b")), "b"
    )
    sizes = both.select("a", "b", F.size(F.array_intersect("runs_a", "runs_b")).alias("common"), (F.size("runs_a") + F.size("runs_b")).alias("total"))
    return sizes.where(F.col("common") >= SIMILAR * (F.col("total") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that links lead to, for all nodes with links."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = least.join(jump, "label", "left").select("node", "was", F.coalesce("further", "label").alias("label"))
        new = written(new, "labels")
        labels = new.select("node", "label")
        if not new.where("label <> was").limit(1).count():
            return labels


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """The rows (node, band, value) of buckets with several texts."""
    buckets = written(rows, f"all-{name}")
    several = buckets.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return written(buckets.join(several, ["band", "value"]), name)


def classes(docs: DataFrame) -> DataFrame:
    """node (text key), label: for each text that is linked to another one, its class."""
    keyed = docs.select(*text_key(F.col("text")), "text").where(_has_terms(F.col("text")))
    bands = written(keyed.mapInArrow(_bands, "key_a long, key_b long, size int, bits array<long>, bands array<long>"), "bands")
    once = bands.groupBy("key_a", "key_b").agg(F.first("bands").alias("bands"))
    placed = lambda values: F.explode(F.array_distinct(F.transform(values, lambda x, i: F.struct((i % BANDS).alias("band"), x.alias("value"))))).alias("x")
    members = _shared(once.select(_node(), placed("bands")).select("node", "x.*"), "members")
    # Finer buckets of two neighbouring bands: what meets there is likelier to be similar.
    pairs = F.transform("bands", lambda x, i: F.xxhash64(x, F.get("bands", i - i % BANDS + (i + 1) % BANDS)))
    finer = _shared(once.select(_node(), placed(pairs)).select("node", "x.*"), "finer-members").withColumn("band", F.col("band") + BANDS)

    wanted = written(members.select("node.key_a", "node.key_b").distinct(), "candidates")
    texts = keyed.join(bounded(wanted), ["key_a", "key_b"], "left_semi").groupBy("key_a", "key_b").agg(F.first("text").alias("text"))
    terms = texts.select(_node(), terms_of(F.col("text")).alias("terms"))
    whole = F.when(F.size("terms") < TERMS, F.array(F.xxhash64(F.array_join("terms", " ")))).otherwise(F.array_distinct(shingles_of(F.col("terms"), TERMS)))
    runs = written(terms.select("node", whole.alias("runs")), "runs")

    labels = tried = None
    for turn in range(LEADER_ROUNDS):
        rows = members.unionByName(finer) if turn else members
        at = rows.withColumn("label", F.col("node")) if labels is None else rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        draw = lambda c: _draw(F.col(c), turn)  # noqa: B023, E731
        by_class = written(at.groupBy("band", "value", "label").agg(F.count("*").alias("n"), F.min_by("node", draw("node")).alias("rep")), "bucket-classes")
        tops = by_class.groupBy("band", "value").agg(F.max_by(F.struct("label", "rep"), F.struct("n", draw("rep"))).alias("top"), F.count("*").alias("k")).where("k > 1").drop("k")
        rest = by_class.join(tops, ["band", "value"]).where(F.col("label") != F.col("top.label"))
        leaders = rest.groupBy("band", "value").agg(F.first("top").alias("top"), F.min_by("rep", draw("rep")).alias("other"))
        outside = at.join(leaders, ["band", "value"]).where(F.col("label") != F.col("top.label"))
        tries = outside.select(F.col("node").alias("a"), F.explode(F.array("top.rep", "other")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if labels is not None:
            own = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
            tries = tries.join(own("a"), "a", "left").join(own("b"), "b", "left").where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
        tries = written(tries if tried is None else tries.join(tried, ["a", "b"], "left_anti"), "tries")
        tried = tries if tried is None else tried.unionByName(tries)
        new = written(_linked(tries, runs), "new-links")
        if not new.limit(1).count():
            if turn:
                break
            continue
        labels = components(new) if labels is None else _joined(labels, new)

    rest = _untried(members, labels, bands)
    rest = written(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), "rest")
    new = written(_linked(rest, runs), "new-links")
    if new.limit(1).count():
        labels = components(new) if labels is None else _joined(labels, new)
    if labels is None:
        return members.select("node", F.col("node").alias("label")).limit(0)
    return labels


def _untried(members: DataFrame, labels: DataFrame | None, bands: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket in different classes that sizes and maps of runs do not rule out, one of them outside its largest class."""
    at = members.withColumn("label", F.col("node")) if labels is None else members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    at = written(at, "placed-members")
    by_class = at.groupBy("band", "value", "label").agg(F.count("*").alias("n"))
    buckets = by_class.groupBy("band", "value").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("k"))
    buckets = written(buckets.where("k > 1").select("band", "value", "top", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed-buckets")
    both = written(at.join(buckets, ["band", "value"]), "mixed-members")
    nodes = both.select("node").distinct()
    maps = bands.select(_node(), "size", "bits").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    words = range(BITS // 64)
    ones = F.aggregate("bits", F.lit(0), lambda n, w: n + F.bit_count(w))
    known = written(both.join(maps, "node").select("*", (F.col("size") - ones).alias("hidden"), *[F.get("bits", F.lit(i)).alias(f"w{i}") for i in words]).drop("bits"), "mixed-maps")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("node", "label", "size", "hidden", *(f"w{i}" for i in words))]
    outside = known.where(F.col("label") != F.col("top")).select("band", "value", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *side("x"))
    inside = known.select("band", "value", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), *side("y"))
    # Each bit that only one has is a run that only it has: what they share is at most the bits that both have and the
    # runs that the bits hide. SIMILAR of the union is a fixed share of the sum of the sizes.
    both_bits = reduce(lambda m, n: m + n, [F.bit_count(F.col(f"x_w{i}").bitwiseAND(F.col(f"y_w{i}"))) for i in words])
    possible = both_bits >= (F.col("x_size") + F.col("y_size")) * (SIMILAR / (1 + SIMILAR)) - 1e-6 - F.least("x_hidden", "y_hidden")
    pairs = outside.join(inside, ["band", "value", "block"]).where(possible & (F.col("x_label") != F.col("y_label")))
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _joined(labels: DataFrame, new: DataFrame) -> DataFrame:
    """`labels` with the classes put together that new links (a, b) join; only the classes are searched, not their members."""
    own = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    ends = new.join(own("a"), "a", "left").join(own("b"), "b", "left")
    between = written(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct(), "class-links")
    joined = components(between).select(F.col("node").alias("old"), F.col("label").alias("whole"))
    nodes = labels.unionByName(between.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    return written(nodes.join(joined, F.col("label") == F.col("old"), "left").select("node", F.coalesce("whole", "label").alias("label")), "labels")


def _placed(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep` of every row with words, id, node and class (null for a row that is its own class)."""
    labels = classes(docs)
    rows = docs.select(*keep, docs["doc_id"].alias("id"), *text_key(docs["text"]), _has_terms(docs["text"]).alias("worded"))
    rows = rows.select(*[c for c in rows.columns if c not in ("key_a", "key_b")], _node())
    return rows.join(labels, "node", "left").select(*rows.columns, F.when(F.col("worded"), F.coalesce("label", "node")).alias("class"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size and kept (it has that id) of every row of `docs`."""
    rows = written(_placed(docs.select("doc_id", "text"), []), "classes")
    sizes = written(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "class-sizes")
    some = joined_by_count(rows.where("class IS NOT NULL"), sizes, ["class"]).select(F.col("id").alias("doc_id"), "class_id", F.col("n").alias("class_size"))
    none = rows.where("class IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` of each class, the one with the least doc_id, all columns as they were."""
    narrow = written(_placed(docs.select("doc_id", "text"), []), "classes").where("class IS NOT NULL")
    least = written(narrow.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "class-sizes")
    best = joined_by_count(narrow, least, ["class"]).where(F.col("id").eqNullSafe(F.col("class_id"))).drop("n")
    # A text and an id name the rows that stay; where several rows have both, one of them.
    stay = written(best.groupBy("class").agg(F.min("node").alias("node"), F.first("class_id").alias("class_id"), F.count("*").alias("n")).select("node", "class_id", "n"), "stay")
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), docs["doc_id"].alias("id"), *text_key(docs["text"]), _has_terms(docs["text"]).alias("worded"))
    rows = rows.select("row", "id", "worded", _node())
    chosen = rows.where("worded").join(stay, (rows["node"] == stay["node"]) & rows["id"].eqNullSafe(stay["class_id"])).select("row", stay["node"], "n")
    single = chosen.where("n = 1").select("row.*")
    repeated = chosen.where("n > 1").groupBy("node").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated).unionByName(rows.where("NOT worded").select("row.*"))
