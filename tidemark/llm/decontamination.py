"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Seeds are runs of `seed_terms` terms (lower-cased runs of letters and digits) of benchmark items; an item of fewer terms
has one, all its terms. A seed that at most `rare_texts` texts have is rare, and joins texts to items. The common ones,
which in prose are phrases like "at the end of the", join nothing: a text with one is looked at where it is, beside the
items that have it, and becomes a candidate only if around the seed it has as many of the item's terms as a match needs.
So no copy is lost to a seed being common, and no pairs are made of all texts and all items that share a phrase.

Candidates are aligned locally: +1 for a term in common, -1 for a changed, added or missing one. A score of at least
`least` times the item's terms marks the text. Stretches of a text that lack too many of the item's terms to reach it
are passed over, and the stretches are wide enough for all gaps that it allows, so neither loses a match.

A copy of an item of L terms with up to (L - seed_terms) / seed_terms changed terms keeps a seed, wherever they are. One whose
every run of seed_terms terms is broken (an edit in each fourth term, or a term put in after each third) is not
found; of an item of fewer terms only copies without an edit are.

Each distinct run of a text is looked up in the item runs. Those are broadcast when their counted number is at
most BROADCAST_SEEDS, and otherwise joined by a shuffle. Items and texts are compared by 128-bit keys of their texts
throughout; ids come in at the end. Alignment runs in rows of one candidate text and about ITEMS_A_ROW items at most.

Defined cases
- null, empty or wordless texts and items: never found, never marked. Null doc_id: kept as it is.
- items with the same or null item_id: each is found by its own text; a null id marks the text but is not listed.
- items with equal texts: all are found. Ties of scores: all items are listed, ascending.
- repeated rows: each is judged; copies of a text are aligned once.
- empty tables: no rows, or nothing marked. Extra columns: kept by `clean`, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, columns_of, shingles_of, terms_of, text_key, written

BROADCAST_SEEDS = 2_000_000
#: Items that are aligned with a text in one row, about.
ITEMS_A_ROW = 64
#: Places of common seeds in items that are sent to all tasks; more of them are joined, hot seeds split.
COMMON_PLACES = 100_000
SPLITS = 64


@dataclass(frozen=True)
class Decontamination:
    seed_terms: int = 4
    least: float = 0.5
    #: A seed that more texts have is common.
    rare_texts: int = 1_000


def smith_waterman(item: np.ndarray, text: np.ndarray) -> int:
    """Best local alignment score of two arrays of term numbers: match 1, mismatch -1, gap -1."""
    if not len(item) or not len(text):
        return 0
    row, best, at = np.zeros(len(text) + 1, dtype=np.int32), 0, np.arange(len(text) + 1, dtype=np.int32)
    for term in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == term, 1, -1), row[1:] - 1)
        # A gap in the item costs 1 a step: the best of all cells to the left, each less its distance.
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + at) - at, 0)
        best = max(best, int(row.max()))
    return best


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _windows(starts: list[int], length: int, slack: int, end: int) -> list[tuple[int, int]]:
    """Merged stretches of a text of `end` terms around the places where an item of `length` terms may start."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        lo, hi = max(0, s - slack), min(end, s + length + slack)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


#: Where each run of terms is in the items: (item, place).
Places = dict[tuple, list[tuple[int, int]]]


def stretches(terms: list[str], items: list[list[str]], runs: Places, least: float) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Each item that shares a run with a text, its terms as numbers, and the stretches of the text that have enough of them to score `least`."""
    numbers: dict[str, int] = {}
    coded = np.array([numbers.setdefault(t, len(numbers)) for t in terms], dtype=np.int64)
    starts: dict[int, list[int]] = defaultdict(list)
    for size in {len(r) for r in runs}:
        for p in range(len(terms) - size + 1):
            for k, q in runs.get(tuple(terms[p : p + size]), ()):
                starts[k].append(p - q)
    for k, at in starts.items():
        words = np.array([numbers.get(t, -1 - i) for i, t in enumerate(items[k])], dtype=np.int64)
        slack = max(4, int(len(words) * (1 - least)))
        # No score exceeds the number of the item's terms that the stretch has.
        wide = [coded[lo:hi] for lo, hi in _windows(at, len(words), slack, len(terms))]
        if enough := [s for s in wide if np.isin(words, s).sum() / len(words) >= least]:
            yield k, words, enough


def best_alignments(text: str, items: list[str], n: int, least: float) -> list[tuple[int, float]]:
    """(item's place in `items`, score / its terms) of each item that shares a seed with the text and scores `least`."""
    split = [_terms(t) for t in items]
    runs: Places = defaultdict(list)
    for k, words in enumerate(split):
        size = min(n, len(words))
        for p in range(len(words) - size + 1 if size else 0):
            runs[tuple(words[p : p + size])].append((k, p))
    found = ((k, max(smith_waterman(words, s) / len(words) for s in enough)) for k, words, enough in stretches(_terms(text), split, runs, least))
    return [(k, score) for k, score in found if score >= least]


def _item_key() -> list[Column]:
    return [c.alias(f"item_{k}") for c, k in zip(text_key(F.col("text")), "ab", strict=True)]


def _by_common(docs: DataFrame, hits: DataFrame, places: DataFrame, common: DataFrame, how: Decontamination) -> DataFrame:
    """key_a, key_b, item_a, item_b: texts that have a common seed and around it enough of the terms of an item with it.

    `places`: where the items have seeds (item_a, item_b, terms, size, p, gram).
    """
    common = written(common, "common-seeds")
    hot = hits.join(bounded(common), "gram")
    theirs = written(places.join(bounded(common), "gram"), "common-seed-places")
    if theirs.count() > COMMON_PLACES:  # too many to send: all pairs of their keys, a seed's in SPLITS tasks
        salted = theirs.select("gram", "item_a", "item_b").distinct().withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        return hot.withColumn("split", F.pmod("key_a", F.lit(SPLITS)).cast("int")).join(salted, ["gram", "split"]).select("key_a", "key_b", "item_a", "item_b")
    items = theirs.groupBy("item_a", "item_b").agg(F.first("terms").alias("terms"), F.first("size").alias("size"), F.collect_list("p").alias("ps")).collect()
    runs: Places = defaultdict(list)
    for k, r in enumerate(items):
        for p in r["ps"]:
            runs[tuple(r["terms"][p : p + r["size"]])].append((k, p))
    sent = docs.sparkSession.sparkContext.broadcast((dict(runs), [r["terms"] for r in items], [(r["item_a"], r["item_b"]) for r in items]))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, terms, keys = sent.value
        for batch in batches:
            out = [(a, b, *keys[k]) for a, b, text in batch.itertuples(index=False) for k, _, _ in stretches(_terms(text), terms, runs, how.least)]
            yield pd.DataFrame(out, columns=["key_a", "key_b", "item_a", "item_b"])

    keys = written(hot.select("key_a", "key_b").distinct(), "common-seed-texts")
    texts = docs.select(*text_key(F.col("text")), "text").join(bounded(keys), ["key_a", "key_b"], "left_semi")
    return texts.mapInPandas(look, "key_a long, key_b long, item_a long, item_b long")


def matches(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """key_a, key_b (the text's key), item_a, item_b (the item's), score: the items that each marked text holds."""
    n = how.seed_terms
    distinct = items.where("text IS NOT NULL").select(*_item_key(), "text").groupBy("item_a", "item_b").agg(F.first("text").alias("item_text"))
    named = written(distinct.withColumn("terms", terms_of(F.col("item_text"))).where(F.size("terms") > 0), "items")
    size = F.least(F.size("terms"), F.lit(n))
    counts = {r["size"]: r["items"] for r in named.groupBy(size.alias("size")).agg(F.count("*").alias("items")).collect()}  # n rows at most
    seeds_of = lambda m: named.where(size == m).select("item_a", "item_b", F.explode(F.array_distinct(shingles_of(F.col("terms"), m))).alias("gram"))
    seeds = written(reduce(DataFrame.unionByName, [seeds_of(m) for m in counts] or [seeds_of(n)]), "seeds")
    grams = seeds.select("gram").distinct()
    grams = F.broadcast(grams) if grams.count() <= BROADCAST_SEEDS else grams
    terms = docs.select(*text_key(F.col("text")), terms_of(F.col("text")).alias("terms"))
    runs = F.array_distinct(F.concat(*[shingles_of(F.col("terms"), m) for m in counts or [n]]))
    hits = written(terms.select("key_a", "key_b", F.explode(runs).alias("gram")).join(grams, "gram"), "seed-hits")

    often = written(hits.groupBy("gram").agg(F.count("*").alias("n")), "seed-counts")
    rare = seeds.join(often.where(F.col("n") <= how.rare_texts), "gram").select("gram", "item_a", "item_b")
    pairs = hits.join(rare, "gram").select("key_a", "key_b", "item_a", "item_b")
    common = often.where(F.col("n") > how.rare_texts)
    if common.limit(1).count():
        at = lambda m: named.where(size == m).select("item_a", "item_b", "terms", F.lit(m).alias("size"), F.posexplode(shingles_of(F.col("terms"), m)).alias("p", "gram"))
        pairs = pairs.unionByName(_by_common(docs, hits, reduce(DataFrame.unionByName, [at(m) for m in counts]), common, how))
    pairs = pairs.distinct()

    rows = max(1, -(-sum(counts.values()) // ITEMS_A_ROW))
    listed = pairs.join(named.select("item_a", "item_b", "item_text"), ["item_a", "item_b"]).groupBy("key_a", "key_b", F.pmod("item_a", F.lit(rows)).alias("row"))
    wanted = written(listed.agg(F.collect_list(F.struct("item_a", "item_b", "item_text")).alias("items")), "candidates")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, text, candidates in batch.itertuples(index=False):
                own = best_alignments(text, [c["item_text"] for c in candidates], n, how.least)
                out += [(a, b, candidates[k]["item_a"], candidates[k]["item_b"], s) for k, s in own]
            yield pd.DataFrame(out, columns=["key_a", "key_b", "item_a", "item_b", "score"])

    keys = written(wanted.select("key_a", "key_b").distinct(), "candidate-keys")
    texts = docs.select(*text_key(F.col("text")), "text").join(bounded(keys), ["key_a", "key_b"], "left_semi")
    once = texts.groupBy("key_a", "key_b").agg(F.first("text").alias("text")).join(wanted, ["key_a", "key_b"])
    aligned = once.select("key_a", "key_b", "text", "items").mapInPandas(align, "key_a long, key_b long, item_a long, item_b long, score double")
    return written(aligned, "alignments")


def judge(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and the best score (null if not marked) of every row of `docs`."""
    found = matches(docs, items, how)
    ids = items.select(*_item_key(), "item_id").groupBy("item_a", "item_b").agg(F.collect_set("item_id").alias("ids"))
    marked = found.join(ids, ["item_a", "item_b"]).groupBy("key_a", "key_b")
    marked = written(marked.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"), F.max("score").alias("score")), "marked")
    return docs.select("doc_id", *text_key(F.col("text"))).join(bounded(marked, 200_000), ["key_a", "key_b"], "left").select(
        "doc_id",
        F.col("score").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        "score",
    )


def clean(docs: DataFrame, items: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """The rows of `docs` that hold no item, all columns as they were."""
    found = written(matches(docs.select("text"), items, how).select("key_a", "key_b").distinct(), "marked")
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), *text_key(docs["text"]))
    return rows.join(bounded(found), ["key_a", "key_b"], "left_anti").select("row.*")
