"""SimHash components, fill-in-the-middle and Delta Lloyd against brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tests.oracle import connection, same
from tidemark.llm import delta_lloyd, fill_in_middle, oracles, queries, simhash
from tidemark.sources.paths import exists, fresh

# SimHash


def bits_of(text) -> int:
    """The fingerprint, word by word and bit by bit."""
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(bits: dict) -> dict:
    """The least id that links lead to, by all pairs."""
    ids, least = sorted(bits), {}
    for i in ids:
        if i in least:
            continue
        todo = [i]
        least[i] = i
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in least and bin(bits[a] ^ bits[b]).count("1") <= simhash.RADIUS:
                    least[b] = i
                    todo.append(b)
    return least


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \n\x0b\x0c\r", "One", "one two", "one TWO three", "ÄÖ ÄÖ x y z", "a b c " * 40, prose(3, 40_000)]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [bits_of(t) for t in texts]
    assert simhash.fingerprint(b"") == 0


def test_simhash_equals_all_pairs(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    bits = {r.doc_id: bits_of(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.judge(docs).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{b:016x}" for i, b in bits.items()}
    assert {i: r.component_id for i, r in got.items()} == reached(bits)


def linked_like_all_pairs(spark, bits):
    nodes = spark.createDataFrame([(b - 2**64 if b >> 63 else b,) for b in set(bits)], "bits long")
    path = fresh(spark, "nodes")
    nodes.write.parquet(path)
    got = {r.bits % 2**64: r.comp for r in simhash.linked(spark.read.parquet(path)).collect()}
    want = reached({b: b for b in bits})
    assert len(got) == len(set(bits))
    # The same partition, whatever names the parts have.
    assert len({(got[b], want[b]) for b in got}) == len(set(got.values())) == len(set(want.values()))


def test_simhash_links_of_every_distance(spark):
    rng = random.Random(1)
    bits = []
    for _ in range(40):
        b = rng.getrandbits(64)
        bits.append(b)
        for d in range(1, 6):  # both segments, and across them
            flips = rng.sample(range(64), d)
            bits.append(b ^ sum(1 << f for f in flips))
    linked_like_all_pairs(spark, bits)


@pytest.mark.parametrize("sparse", [True, False])
def test_simhash_of_a_crowded_segment(spark, sparse):
    """Many fingerprints with one segment in common: alike ones and (sparse) ones that only a link of three bits joins."""
    rng, low = random.Random(2), random.Random(3).getrandbits(32)
    bits = {low | rng.getrandbits(32) << 32 for _ in range(300)}
    code = [0b0000000, 0b1110000, 0b1001100, 0b0111100]  # three bits and more apart
    bits |= {low | c << (32 + s) for c in code for s in range(0, 24, 7)} if sparse else {low | (1 << i | 1 << j) << 32 for i in range(20) for j in range(i)}
    linked_like_all_pairs(spark, bits)


def test_simhash_of_odd_rows(spark, odd_docs):
    rows = simhash.judge(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert sorted(str(r.doc_id) for r in zero) == ["1", "2", "3", "None"] and {r.component_id for r in zero} == {1}
    three = [r for r in rows if r.doc_id in (5, 6)]
    assert len(three) == 2 and {r.component_id for r in three} == {5}
    assert simhash.judge(odd_docs.limit(0)).count() == 0
    only = spark.createDataFrame([(None, "x y z")] * 2, "doc_id long, text string")
    assert [r.component_id for r in simhash.judge(only).collect()] == [None, None]


# Fill in the middle


@pytest.mark.parametrize("how", [fill_in_middle.Form(), fill_in_middle.Form(moved=100, spm=50)])
def test_middle_round_trip(how):
    rng = random.Random(4)
    texts = ["", "a", "<", "<P", "<P>", "x<S>y", "<<S", "<M", "é\n\r  z", "𝔘nicode 𝔘", "ab12 cd"] + ["".join(rng.choice("ab1 <>PSM\n") for _ in range(rng.randrange(40))) for _ in range(400)]
    forms = set()
    for k, t in enumerate(texts):
        n, form, p, m, out = fill_in_middle.moved(str(k), t, how)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert n == len(units) and fill_in_middle.restored(out, form) == t
        h = hashlib.sha256(f"1:{k}".encode()).hexdigest()
        a, b = sorted(int(h[i : i + 8], 16) % (n + 1) for i in (0, 8))
        plain = not t or any(x in t for x in ("<P>", "<S>", "<M>")) or int(h[16:24], 16) % 100 >= how.moved
        assert (form == "plain") == plain
        if not plain:
            assert (p, m) == (len("".join(units[:a])), len("".join(units[a:b])))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_middle_of_odd_rows(spark, odd_docs):
    got = fill_in_middle.transform(odd_docs)
    assert got.dtypes[:-1] == odd_docs.dtypes
    rows = got.select("doc_id", F.col("`text`").alias("text"), "fim.*").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert fill_in_middle.restored(r.output, r.form) == (r.text or "") and r.restored_sha256 == fill_in_middle.digest(r.text or "")
    assert {r.form for r in rows if not r.text} == {"plain"} and all(r.n == 0 for r in rows if not r.text)
    assert fill_in_middle.judge(odd_docs.limit(0)).count() == 0
    again = fill_in_middle.transform(odd_docs.withColumn("fim", F.lit(1)))
    assert again.dtypes == got.dtypes and again.count() == len(rows)


# Delta Lloyd


def lloyd(vectors: list, how: delta_lloyd.Lloyd):
    """Every round over all vectors, in Python's own integers."""
    q = [[math.floor(how.scale * x) for x in v] for _, v in vectors]
    order = sorted(range(len(q)), key=lambda i: hashlib.sha256(f"{how.salt}{vectors[i][0]}".encode()).hexdigest())
    cents = [q[i] for i in order[: how.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(how.rounds):
        own = [near(v)[1] for v in q]
        for k in range(len(cents)):
            if mine := [v for v, o in zip(q, own, strict=True) if o == k]:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, *near(v)[::-1]) for (i, _), v in zip(vectors, q, strict=True)], cents


def stored(spark, rows):
    path = fresh(spark, "vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string, cluster int").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("n", "rounds"), [(300, 10), (5, 3), (60, 1)])
def test_lloyd_equals_plain_rounds(spark, n, rounds):
    rng = np.random.default_rng(n)
    how = delta_lloyd.Lloyd(clusters=6, dims=5, rounds=rounds, scale=8, bucket_rows=100)  # coarse: many ties
    vectors = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(n)]
    df, cents = delta_lloyd.cluster(stored(spark, [(i, v, "r", 1) for i, v in vectors]), how)
    want, want_cents = lloyd(vectors, how)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in df.collect()) == sorted(want)
    assert cents.tolist() == want_cents


def test_lloyd_rounds_join_without_a_shuffle(spark):
    how = delta_lloyd.Lloyd(dims=2)
    buckets = delta_lloyd._Buckets(spark, 4)
    rows = spark.range(100).select(F.col("id").alias("row"), F.array("id", "id").alias("q"))
    a, path = buckets.stored(rows.repartition(4, "row"), "a")
    b, _ = buckets.stored(rows.select("row").repartition(4, "row"), "b")
    both = a.join(b.hint("shuffle_hash"), "row")
    assert both.count() == 100 and exists(spark, path) and how.dims == 2
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_lloyd_of_odd_vectors(spark):
    ok = [0.5] * 64
    rows = [(1, ok, "r", 1), (1, ok, "r", 1), (None, ok, None, None), (2, None, "r", 1), (3, [], "r", 1), (4, ok[:63], "r", 1), (5, [None] + ok[1:], "r", 1), (6, [math.nan] + ok[1:], "r", 1), (7, [math.inf] + ok[1:], "r", 1), (8, [1e30] + ok[1:], "r", 1), (9, [-0.25] * 64, "r", 1)]
    got = delta_lloyd.judge(stored(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "9", "None"]
    assert {r.distance for r in got} == {0} and {r.inertia for r in got} == {0}
    assert delta_lloyd.judge(stored(spark, rows[3:5])).count() == 0
    assert delta_lloyd.judge(stored(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_delta_lloyd"])
def test_twins(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), oracles.ORACLES[name])


# Long urls, lists from a table, lines that a third of all texts have


def test_hosts_of_many_labels_and_long_paths(spark):
    from tidemark.llm import url_rules

    long_host, long_path = ".".join(["a"] * 50_000) + ".bad.test", "/x" * 50_000
    urls = [f"http://{long_host}/", f"http://good.test{long_path}", f"http://{'b.' * 20_000}com/en/1{long_path}", "http://bad.test"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("bad.test", "")], "host string, path string")
    got = {r.page_id: (r.verdict, r.by) for r in url_rules.judge(pages, rules, listed).select("page_id", "verdict", "by").collect()}
    assert got == {0: ("block", "list"), 1: ("allow", None), 2: ("block", "rule"), 3: ("block", "list")}


def test_a_list_of_thousands_hits_and_its_false_positives_go(spark):
    from tidemark.llm import url_rules

    pages = spark.range(12_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 700, F.lit(".net/p/"), F.col("id")).alias("url"))
    listed = pages.where("page_id % 3 = 0").select(F.concat(F.lit("h"), F.col("page_id") % 700, F.lit(".net")).alias("host"), F.concat(F.lit("/p/"), F.col("page_id")).alias("path"))
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = url_rules.judge(pages, rules, listed)
    assert got.where("verdict = 'block'").count() == 4_000 == got.where("verdict = 'block' AND page_id % 3 = 0").count()
    # The filter alone lets some keys through that are in no list: the exact join is what removes them.
    entries = listed.withColumn("depth", F.lit(2))
    blocks = -(-4_000 * url_rules.BITS_PER_ENTRY // (64 * url_rules.LONGS))
    others = pages.where("page_id % 3 <> 0").select(F.concat(F.lit("h"), F.col("page_id") % 700, F.lit(".net")).alias("host"), F.concat(F.lit("/p/"), F.col("page_id")).alias("path"))
    block, bits = url_rules._places(F.col("host"), F.col("path"), blocks)
    found = others.select(block.alias("block"), bits.alias("want")).join(url_rules.bloom_blocks(entries, blocks), "block")
    false = found.where(F.forall("want", lambda b: url_rules._bit(F.col("bits"), b))).count()
    assert 0 < false < 0.02 * 8_000


def test_a_line_in_a_third_of_all_texts(make_docs):
    from tests.llm.conftest import prose
    from tidemark.llm import line_dedup

    hot, near = "this very line is in a third of all texts", "this very line is in a third of all tests"
    texts = [(hot + "\n" if k % 3 == 0 else near + "\n" if k == 100 else "") + prose(k, 30) for k in range(150)]
    got = {r.doc_id: r.removed for r in line_dedup.judge(make_docs(texts)).collect()}
    assert got[0] == [] and got[3] == [0] and got[100] == [0] and sum(map(len, got.values())) == 50


@pytest.mark.parametrize("places", [100_000, 0])
def test_common_seeds_join_nothing_and_lose_nothing(spark, make_docs, monkeypatch, places):
    """A phrase in a third of all texts, in items too; copies that keep no other seed are found all the same."""
    from tests.llm.conftest import prose
    from tidemark.llm import decontamination as op

    phrase = "at the end of the day it was"
    items = [f"one two {phrase} three four five", f"{phrase} six seven", "nothing of that kind is in here at all", "w1 w2 w3"]
    # Of the first item only the phrase and single terms between edits are left.
    worn = f"one XX two {phrase} three YY four ZZ five"
    texts = [prose(k, 60) + (f" {phrase} " if k % 3 == 0 else " ") + prose(k + 500, 20) for k in range(60)]
    texts += [prose(901, 40) + " " + worn + " " + prose(902, 40), items[2], prose(903, 30) + " w1 w2 w3 " + prose(904, 30), None, ""]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {r.doc_id: (list(r.item_ids), r.score) for r in op.judge(make_docs(texts), frame).collect()}
    for k, t in enumerate(texts):  # every pair by the full alignment, of those that share a run
        terms = re.findall(r"[^\W_]+", (t or "").lower())
        found = []
        for i, item in enumerate(items):
            w = re.findall(r"[^\W_]+", item.lower())
            n = min(4, len(w))
            grams = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} & {tuple(terms[j : j + n]) for j in range(len(terms) - n + 1)}
            names = {x: j for j, x in enumerate(dict.fromkeys(terms + w))}
            if grams and op.smith_waterman(np.array([names[x] for x in w]), np.array([names[x] for x in terms])) >= len(w) / 2:
                found.append(i)
        assert want[k][0] == found
    assert want[60][0] == [0, 1]
    monkeypatch.setattr(op, "COMMON_PLACES", places)
    seen = []
    by_common = op._by_common
    monkeypatch.setattr(op, "_by_common", lambda *a: (seen.append(a[3].count()), by_common(*a))[1])
    got = op.judge(make_docs(texts), frame, op.Decontamination(rare_texts=5))
    assert {r.doc_id: (list(r.item_ids), r.score) for r in got.collect()} == want
    assert seen == [5]  # the runs of four of the phrase's eight words
