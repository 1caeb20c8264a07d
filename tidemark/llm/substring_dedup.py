"""Substring de-duplication over sliding spans of sentences.

A sentence ends with a word that ends in . ! or ?, or at a line's end. Every run of `sentences` consecutive sentences
is a span, however short they are; longer runs are covered by the spans in them. A sentence of more than LONG words
is cut into pieces besides, as a passage may begin or end within it: of each WINDOW neighbouring pairs of words, it is
cut after the one with the least hash. Texts that share a part of a sentence thus cut it alike, and a piece has at
most WINDOW words (one more at its start). From every piece starts a span of the least number of pieces, two at
least, that has `words` words, if a cut sentence is in it: pairs of small pieces would meet by chance. A passage of 50
words that texts share holds a span wherever its sentences end, and stays once, up to the pieces at its ends.

Spans are hashed (96 bits, over words, so that blanks do not matter) and joined over the whole corpus; the first
occurrence, by doc_id, text and place, stays, and every word that any other occurrence covers is removed. How often a
span occurs and where first are grouped aggregates, combined on the map side. Only spans that occur again are joined
back, and those of them that are hot by a broadcast, so that neither a passage in a third of all texts nor a group of
copies meets in one task.

Defined cases
- null text: no sentences, returned as null. Empty or blank text: unchanged. Long texts: whole.
- null doc_id: after all others (like the largest id). Ties do not occur between different rows but for repeated ones:
- repeated rows (same doc_id and text) are one document: each is returned with the same sentences removed.
- a text whose every sentence is removed becomes the empty text.
- empty table: no rows. Extra columns: kept by `clean`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns_of, joined_by_count, mixed, written

#: Sentences of more words are cut, at the least of so many neighbouring hashes.
LONG, WINDOW = 12, 12
WORD = re.compile(r"\s*\S+\s*")
LAST = 2**63 - 1
#: Bytes of text that are taken at a time.
CHUNK = 2_000_000

_U = np.uint64
#: Bases of the two span hashes, odd numbers, and their inverses modulo 2^64.
_BASES = [(b, pow(b, -1, 2**64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

SPANS = "id long, text_hash long, spans array<struct<start:int,stop:int,h1:long,h2:int>>"


@dataclass(frozen=True)
class Spans:
    """`sentences`: of a run of whole sentences. `words`: least of a run with parts of long sentences."""

    sentences: int = 2
    words: int = 12


def _windows_least(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of the least of each WINDOW neighbouring keys of a group. One that ties stays while its window lasts, so that a stutter is no run of cuts."""
    if len(keys) < WINDOW:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(keys, WINDOW)
    start = np.flatnonzero(group[: len(view)] == group[WINDOW - 1 :])
    left, right = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
    for lo in range(0, len(start), 100_000):
        part = view[start[lo : lo + 100_000]]
        left[lo : lo + 100_000] = part.argmin(axis=1)
        right[lo : lo + 100_000] = WINDOW - 1 - part[:, ::-1].argmin(axis=1)
    at, tie = start + left, np.isin(group[start], group[start[left != right]])
    out, now, last = [at[~tie]], -1, -1
    for s, r in zip(start[tie].tolist(), right[tie].tolist(), strict=True):
        if group[s] != last:
            now, last = -1, group[s]
        if now < s or keys[s + WINDOW - 1] < keys[now]:
            now = s + r if now < s else s + WINDOW - 1
            out.append(np.array([now]))
    return np.unique(np.concatenate(out))


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts in a row: how many each text has, their hashes, where pieces start, and whether the piece is a whole sentence."""
    words, line_ends, sizes, total = [], [], [], 0
    for t in texts:
        before = total
        for line in t.split("\n"):
            found = line.split()
            if found:
                words += found
                total += len(found)
                line_ends.append(total - 1)
        sizes.append(total - before)
    if not total:
        return np.array(sizes, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)
    codes, names = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(names, categorize=False).astype(_U)[codes]
    ends = np.array([w[-1] in ".!?" for w in names])[codes]
    ends[line_ends] = True
    starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
    lengths = np.diff(np.append(starts, total))
    long = lengths > LONG
    sentence = np.repeat(np.arange(len(starts)), lengths)
    inside = np.flatnonzero(long[sentence])
    # Pairs of neighbouring words of a long sentence; the last word of one begins none.
    first = inside[~ends[inside]]
    keys = mixed(h[first] * _U(_BASES[0][0]) + h[np.minimum(first + 1, total - 1)])
    cuts = first[_windows_least(keys, sentence[first])] + 2
    cuts = cuts[cuts < (starts + lengths)[sentence[cuts - 2]]]
    at = np.union1d(starts, cuts)
    return np.array(sizes, np.int64), h, at, ~long[sentence[at]]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^n modulo 2^64."""
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def spans(texts: list[str], how: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word, word after the last (both within the text) and two hashes of every span."""
    sizes, h, at, whole = pieces(texts)
    n, first_word = len(at), np.cumsum(sizes) - sizes
    edges = np.append(at, len(h))
    text = np.repeat(np.arange(len(sizes)), sizes)[at] if n else np.zeros(0, np.int64)
    last = np.searchsorted(text, text, side="right")  # the piece after the text's last one
    part = np.concatenate([[0], np.cumsum(~whole)])
    place = np.arange(n)
    run = place + how.sentences
    plain = place[(run <= last) & (part[np.minimum(run, n)] == part[place])]
    end = np.maximum(np.searchsorted(edges, at + how.words), place + 2)
    cut = place[(end <= last) & (part[np.minimum(end, n)] > part[place])]
    lo = np.concatenate([at[plain], at[cut]])
    hi = np.concatenate([edges[run[plain]], edges[end[cut]]])
    hashes = []
    for k, (base, inverse) in enumerate(_BASES):
        power, back = _powers(base, len(h)), _powers(inverse, len(h))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed(h + _U(k)) * power[:-1])])
        hashes.append(mixed((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(_U)))
    which = np.concatenate([text[plain], text[cut]])
    order = np.argsort(which, kind="stable")
    base = first_word[which[order]]
    return which[order], lo[order] - base, hi[order] - base, hashes[0][order], hashes[1][order]


def _hashed(how: Spans):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                part = batch.slice(lo, hi - lo)
                which, start, stop, h1, h2 = spans(part.column("text").to_pylist(), how)
                each = [pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array((h2 >> _U(32)).astype(np.uint32).view(np.int32))]
                offsets = np.searchsorted(which, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(each, ["start", "stop", "h1", "h2"]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), lists], ["id", "text_hash", "spans"])

    return hashed


def _order() -> Column:
    return F.struct("id", "text_hash", "start")


def removed(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """id (doc_id, LAST for null), text_hash, gone: the ranges of words of each text that other texts have before it."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    found = written(rows.mapInArrow(_hashed(how), SPANS), "spans").select("id", "text_hash", F.explode("spans").alias("s")).select("id", "text_hash", "s.*")
    # A repeated row repeats its spans; its copies are told from other occurrences by the order, which they share.
    again = written(found.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1"), "repeated-hashes")
    shared = written(joined_by_count(found, again, ["h1"]).drop("n"), "repeated-spans")
    first = written(shared.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.max(_order()).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"), "first-spans")
    later = joined_by_count(shared, first, ["h1", "h2"]).where(_order() != F.col("first"))
    ranges = later.select("id", "text_hash", "start", "stop").distinct()
    return written(ranges.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone")), "removed")


def _left(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    rows = []
    for t, ranges in zip(text, gone, strict=True):
        if t is None or ranges is None:
            rows.append((None, 0))
            continue
        parts, kept, at, off = WORD.findall(t), [], 0, 0
        for r in ranges:
            lo = max(r["start"], at)
            kept += parts[at:lo]
            off += max(0, r["stop"] - lo)
            at = max(at, r["stop"])
        rows.append(("".join(kept + parts[at:]), off))
    return pd.DataFrame(rows, columns=["text", "n_removed"])


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` (with id, text_hash and text) with `left`: the text that stays and how many words went."""
    found = rows.join(gone, ["id", "text_hash"], "left")
    cut = F.pandas_udf(_left, "text string, n_removed long")(F.when(F.col("gone").isNotNull(), F.col("text")), F.col("gone"))
    out = found.withColumn("cut", cut)
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.col("cut.text"))
    return out.withColumn("left", F.struct(left.alias("text"), F.coalesce("cut.n_removed", F.lit(0)).alias("n_removed"))).drop("gone", "cut")


def judge(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """doc_id, text (what stays), n_removed (words) and repeats (some were removed) of every row of `docs`."""
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    out = _without(rows, removed(docs, how))
    return out.select("doc_id", "left.text", "left.n_removed", (F.col("left.n_removed") > 0).alias("repeats"))


def clean(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """`docs` with the text that stays; all other columns as they were."""
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text"))
    out = _without(rows, removed(docs.select("doc_id", "text"), how))
    return out.select(*[(F.col("left.text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
