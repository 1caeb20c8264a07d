"""Language-model scores by stupid backoff, computed relationally.

The model is the corpus itself: the counts of all n-grams up to `order`, over all texts. A text is scored by the
counts of the other rows: what it holds itself is taken off each count, as it would else vouch for itself. A term's
score is log(count of the n-gram / count of its context) for the longest n-gram ending in it that the others hold,
with log(backoff) for each order given up; for single terms log(count / terms of the others); a term that no other
row holds scores as one of those terms, with one more log(backoff).

Three steps, each of rows that Spark shuffles:
1. Texts are taken in chunks of about CHUNK characters. Each chunk's n-grams are exploded, hashed to 64 bits and
   counted; the different ones go, by the leading bits of their hash, to buckets: a row a chunk, order and bucket.
2. A bucket is a part of the count tables. It adds up the counts of its n-grams over all chunks and joins them back
   to its rows: for each chunk, the corpus counts of the chunk's n-grams, in their order.
3. A chunk's texts meet its counts, each term takes the longest n-gram that is left, and a document's sum is made.

The number of buckets grows with the corpus, so that a bucket keeps about BUCKET n-grams; chunks do not grow. A
frequent n-gram counts once a chunk, so a bucket also has an entry a chunk for each of those that it holds.
Chunks are made anew for step 3, from the same rows in the same order. Each carries a checksum of its ids and texts
through steps 1 and 2; where it differs from that of step 3 the job fails instead of scoring by counts of other texts.

Rows of packed n-grams take a third of the disk that a row an n-gram takes (README), but a row has fewer n-grams the
more buckets there are; from about 10 TB on BUCKET has to grow with the executors' memory.

Defined cases
- null, empty or wordless text: n_terms 0, log_score 0, mean_log null.
- first terms of a text: the longest n-gram that fits. Long texts: whole, as a chunk of their own.
- repeated rows and null doc_id: each row counts and is scored, copies by each other.
- a single row: all terms unseen, of one. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mixed, written

#: Characters of the texts of a chunk, one text at least.
CHUNK = 4_000_000
#: Different n-grams of a bucket, about.
BUCKET = 2_000_000

GRAMS = "bucket int, chunk long, check long, n int, grams binary, counts binary"
TOTALS = "chunk long, check long, n int, bucket int, totals binary"
TEXTS = "chunk long, check long, ids array<long>, sizes array<int>, texts binary, raw long"
SCORES = "doc_id long, n_terms long, part double, singles long"

_U = np.uint64


def _packed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: planes that are alike take next to nothing."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    planes = np.frombuffer(pa.decompress(b[4:], 8 * n, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Text number and place of each term, and for n = 1..order the hash of the n terms that end there (where place >= n - 1)."""
    split = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    words = np.array([w for s in split for w in s], dtype=object)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = pd.util.hash_array(words, categorize=True).astype(_U) if len(words) else np.zeros(0, _U)
    out = [mixed(h)]
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(1, _U), out[-1][:-1]])[: len(h)]
        out.append(mixed(before * _U(0x9E3779B97F4A7C15) + h + _U(n)))
    return doc, place, out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, list[str]]]:
    """chunk number, checksum, ids and texts; in the order of the task's rows."""
    task, at, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def done() -> tuple[int, int, list, list[str]]:
        digest = xxhash.xxh3_64()
        for i, t in zip(ids, texts, strict=True):
            digest.update(f"{i}\0{t}\0")
        return task * 2**32 + at, digest.intdigest() - 2**63, ids, texts

    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                t = t or ""
                if texts and size + len(t) > CHUNK:
                    yield done()
                    at, ids, texts, size = at + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
    if texts:
        yield done()


def _table(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _bucketed(x: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of the sorted hashes `x` starts, and the end."""
    marks = np.arange(1, 2**bits, dtype=np.uint64) << _U(64 - bits) if bits else np.zeros(0, _U)
    return np.concatenate([[0], np.searchsorted(x, marks), [len(x)]])


def exploded(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """Step 1: the different n-grams of each chunk with their counts, by bucket."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, check, _ids, texts in _chunks(batches):
            _doc, place, hashes = grams(texts, order)
            for n, h in enumerate(hashes, 1):
                each, counts = np.unique(h[place >= n - 1], return_counts=True)
                at = _bucketed(each, bits)
                there = np.flatnonzero(np.diff(at))
                parts = [slice(at[b], at[b + 1]) for b in there]
                steps = [_packed(np.diff(each[p], prepend=_U(0))) for p in parts]
                yield _table(GRAMS, [there.tolist(), [chunk] * len(there), [check] * len(there), [n] * len(there), steps, [_packed(counts[p]) for p in parts]])

    return docs.mapInArrow(explode, GRAMS)


def counted(rows: DataFrame) -> DataFrame:
    """Step 2: for each chunk's n-grams in a bucket their counts over the corpus, in the same order."""

    def count(bucket: pa.Table) -> pa.Table:
        out = []
        for n in sorted(set(bucket.column("n").to_pylist())):
            own = bucket.filter(pc.equal(bucket.column("n"), n))
            each = [np.cumsum(_unpacked(b), dtype=_U) for b in own.column("grams").to_pylist()]
            counts = np.concatenate([_unpacked(b) for b in own.column("counts").to_pylist()])
            different, which = np.unique(np.concatenate(each), return_inverse=True)
            totals = np.bincount(which, weights=counts, minlength=len(different))[which].astype(np.int64)
            ends = np.cumsum([len(e) for e in each])
            keys = zip(*[own.column(k).to_pylist() for k in ("chunk", "check", "bucket")], np.split(totals, ends[:-1]), strict=True)
            out += [(c, k, n, b, _packed(t)) for c, k, b, t in keys]
        return pa.Table.from_batches([_table(TOTALS, [list(c) for c in zip(*out, strict=True)])])

    return rows.groupBy("bucket").applyInArrow(count, TOTALS)


def _texts(docs: DataFrame) -> DataFrame:
    """The chunks again, with their texts packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, check, ids, texts in _chunks(batches):
            each = [t.encode() for t in texts]
            raw = b"".join(each)
            yield _table(TEXTS, [[chunk], [check], [ids], [[len(e) for e in each]], [pa.Codec("zstd", compression_level=9).compress(raw, asbytes=True)], [len(raw)]])

    return docs.mapInArrow(pack, TEXTS)


def _others(h: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of each n-gram `h` of text `doc`: how often other texts hold it, from the corpus counts of the different ones."""
    if not len(h):
        return np.zeros(0)
    order = np.argsort(h, kind="stable")  # texts stay in order among equal ones
    sorted_h, sorted_doc = h[order], doc[order]
    new = np.append(True, sorted_h[1:] != sorted_h[:-1])
    each = np.append(new[1:] | (sorted_doc[1:] != sorted_doc[:-1]), True)
    ends = np.flatnonzero(each)
    own = np.repeat(np.diff(ends, prepend=-1), np.diff(ends, prepend=-1))
    out = np.empty(len(h))
    out[order] = totals[np.cumsum(new) - 1] - own
    return out


def _scored(texts: list[str], totals: dict[int, np.ndarray], order: int, backoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its terms, the sum of their scores without the log of the others' terms, and how many lack that."""
    doc, place, hashes = grams(texts, order)
    counts = []
    for n, h in enumerate(hashes, 1):
        there = place >= n - 1
        c = np.zeros(len(h))
        c[there] = _others(h[there], doc[there], totals[n])
        counts.append(c)
    score, level = np.full(len(doc), order * math.log(backoff)), np.zeros(len(doc), int)
    for n in range(order, 0, -1):
        found = (level == 0) & (counts[n - 1] > 0)
        context = counts[n - 2][np.flatnonzero(found) - 1] if n > 1 else 1.0
        score[found] = np.log(counts[n - 1][found] / context) + (order - n) * math.log(backoff)
        level[found] = n
    size = len(texts)
    return np.bincount(doc, minlength=size), np.bincount(doc, weights=score, minlength=size), np.bincount(doc[level <= 1], minlength=size)


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_terms, log_score (sum over the terms) and mean_log of every row of `docs`."""
    rows = docs.select("doc_id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, chars * order / 8 / BUCKET))))  # about eight characters to a different n-gram

    def join(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        names, out = [f.split()[0] for f in SCORES.split(", ")], []
        by: dict[tuple[int, int], dict[int, bytes]] = {}
        checks = set(counts.column("check").to_pylist())
        for c, n, b, t in zip(*[counts.column(k).to_pylist() for k in ("chunk", "n", "bucket", "totals")], strict=True):
            by.setdefault((c, n), {})[b] = t
        for r in chunk.to_pylist():
            if checks - {r["check"]}:
                raise ValueError("the texts came in another order the second time: write them before scoring")
            raw, ends = pa.decompress(r["texts"], r["raw"], "zstd", asbytes=True), np.cumsum(r["sizes"])
            texts = [raw[e - s : e].decode() for s, e in zip(r["sizes"], ends, strict=True)]
            totals = {n: np.concatenate([_unpacked(t) for _, t in sorted(by.get((r["chunk"], n), {0: _packed(np.zeros(0))}).items())]) for n in range(1, order + 1)}
            terms, part, singles = _scored(texts, totals, order, backoff)
            out.append(_table(SCORES, [r["ids"], terms.tolist(), part.tolist(), singles.tolist()]))
        if counts.num_rows and not chunk.num_rows:
            raise ValueError("the texts came in other chunks the second time: write them before scoring")
        schema = _table(SCORES, [[]] * len(names)).schema
        return pa.Table.from_batches(out, schema)

    totals = counted(exploded(rows, order, bits))
    sums = written(_texts(rows).groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(join, SCORES), "lm-sums")
    terms = sums.agg(F.sum("n_terms")).first()[0] or 0
    others = F.log(F.greatest(F.lit(terms) - F.col("n_terms"), F.lit(1)))
    log_score = F.col("part") - F.col("singles") * others
    return sums.select("doc_id", "n_terms", log_score.alias("log_score"), F.when(F.col("n_terms") > 0, log_score / F.col("n_terms")).alias("mean_log"))
