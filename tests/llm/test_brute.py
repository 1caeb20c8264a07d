"""Operators against brute force, held-out accuracy, or an exact round trip."""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidemark.llm import common, decontamination, line_dedup, lm_scoring, mixing, near_duplicates, oracles, quality_model, queries, robust_rules, sharding, substring_dedup, url_rules
from tidemark.llm.common import mixed
from tidemark.sources.paths import shared_folder


ITEM = "item_id long, text string"


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def edited(text, every, seed=0):
    rng, words = random.Random(seed), text.split(" ")
    for i in range(every // 2, len(words), every):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


# LM scoring


def test_lm_scores_equal_a_direct_count(spark, make_docs):
    texts = [prose(i % 3, 60, 9) for i in range(5)] + ["one", "one two", "one two three", "two one two one two", None, "..."]
    of = lambda t: Counter(tuple(w[i : i + n]) for w in [terms(t)] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(map(of, texts), Counter())
    # A text is scored by what the other rows hold, whatever occurs once there too.
    size = sum(len(terms(t)) for t in texts)
    got = {r.doc_id: r for r in lm_scoring.score(make_docs(texts)).collect()}
    for k, t in enumerate(texts):
        w, others, want = terms(t), total - of(t), 0.0
        for i in range(len(w)):
            for n in (3, 2, 1, 0):
                g = tuple(w[i - n + 1 : i + 1]) if i >= n - 1 else ()
                if n == 0:
                    want -= math.log(max(1, size - len(w)))
                elif others[g]:
                    want += math.log(others[g] / (others[g[:-1]] if n > 1 else max(1, size - len(w))))
                    break
                want += math.log(0.4) if n else 0
        assert got[k].n_terms == len(w)
        assert got[k].log_score == pytest.approx(want)
        assert got[k].mean_log == (pytest.approx(got[k].log_score / len(w)) if w else None)


def test_lm_refuses_rows_in_another_order(spark, make_docs):
    # Each scan deals the rows anew, as a shuffle that is made again may.
    @F.udf("string")
    def other(t):
        return f"{t} {random.random()}"

    docs = make_docs([prose(k, 30) for k in range(20)]).withColumn("text", other.asNondeterministic()("text"))
    with pytest.raises(Exception, match="write them before scoring"):
        lm_scoring.score(docs).count()


# Near duplicates


def shingles(t):
    w = terms(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_sketch_estimates_the_probability_jaccard():
    a, b = prose(1, 400), edited(prose(1, 400), 40)
    s = near_duplicates.sketch([a, b], registers=2000)
    x, y = shingles(a), shingles(b)
    assert (s[0] == s[1]).mean() == pytest.approx(len(x & y) / len(x | y), abs=0.05)


def test_sketch_weighs_repeated_runs():
    # Half of one text's weight is a run that the other lacks; sets would differ little.
    base = prose(2, 300)
    heavy = base + " " + "a b c d e " * 60
    s = near_duplicates.sketch([base, heavy], registers=4000)
    split = [near_duplicates.weighted_runs([t]) for t in (base, heavy)]
    w = [dict(zip(r.tolist(), c.tolist(), strict=True)) for _, r, c in split]
    both = [d for d in w[0] if d in w[1]]
    everything = set(w[0]) | set(w[1])
    exact = sum(1 / sum(max(w[0].get(e, 0) / w[0][d], w[1].get(e, 0) / w[1][d]) for e in everything) for d in both)
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)


def linked_classes(texts):
    """The least place of each text's class, from all pairs of texts that have a run in common."""
    sets, holders, parent = [shingles(t) for t in texts], defaultdict(list), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        common = Counter(j for g in own for j in holders[g])
        for j, n in common.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in own:
            holders[g].append(i)
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("rounds", [3, 1])
def test_near_duplicate_classes(spark, make_docs, monkeypatch, rounds):
    """Also when the leader rounds leave nearly all to the exact one, in blocks."""
    monkeypatch.setattr(near_duplicates, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    texts = [prose(i, 200) for i in range(30)]
    texts += [edited(texts[0], 45, k) for k in range(25)] + [texts[1]] * 20 + [texts[2].upper()]
    texts += [edited(texts[3], 9, 1)]  # far too many edits
    texts += [edited(texts[4], 37 + k % 9, k) for k in range(60)]  # most at just 0.8 of few others
    stutter = " ".join(texts[5].split()[:3])
    texts += [texts[5] + f" {stutter}" * k for k in (40, 300)]  # the same runs but for some that repeat
    docs, want = make_docs(texts), linked_classes(texts)
    assert {r.doc_id: r.class_id for r in near_duplicates.judge(docs).collect()} == want
    if rounds > 1:
        assert sorted(r.doc_id for r in near_duplicates.one_of_each(docs).collect()) == sorted(set(want.values()))


def test_near_duplicate_classes_of_a_table(spark):
    d = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text) for r in table(spark, d).collect())
    want = linked_classes([t for _, t in rows])
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op2_near_duplicates"](spark, d).collect()}
    assert got == {i: rows[want[k]][0] for k, (i, _) in enumerate(rows)}


def test_components_of_a_chain(spark):
    node = lambda c: F.struct(F.col(c).alias("key_a"), F.col(c).alias("key_b"))
    links = spark.range(40).select(node("id").alias("a"), (F.col("id") + 1).alias("n"), "id").withColumn("b", node("n")).select("a", "b")
    got = near_duplicates.components(links).collect()
    assert len(got) == 41 and {r.label.key_a for r in got} == {0}


# Substrings


def test_repeated_passages_stay_once(spark, make_docs):
    passage = "The first shared sentence has several words in it. And here is the second one of them. A third sentence ends the shared passage now."
    texts = [prose(1, 60) + " " + passage + " " + prose(2, 60), prose(3, 60) + ".\n" + passage + "\n" + prose(4, 60), prose(5, 90)]
    got = {r.doc_id: r for r in substring_dedup.judge(make_docs(texts)).collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2] and not got[2].repeats
    assert "second one" not in got[1].text and prose(3, 60) in got[1].text and prose(4, 60) in got[1].text


def pieces_one_by_one(text):
    """(words, whether it is a whole sentence) of each piece: a long sentence is cut after the least pair of every window."""
    out = []
    for line in text.split("\n"):
        sentence = []
        for w in [*line.split(), None]:
            if w is not None:
                sentence.append(w)
            if not sentence or (w is not None and w[-1] not in ".!?"):
                continue
            cuts = set()
            if len(sentence) > 12:
                h = pd.util.hash_array(np.array(sentence, dtype=object)).astype(np.uint64)
                keys = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]).tolist()
                at = -1
                for end in range(11, len(keys)):
                    if at <= end - 12:
                        at = min(range(end, end - 12, -1), key=keys.__getitem__)
                    elif keys[end] < keys[at]:
                        at = end
                    cuts.add(at + 2)
            edges = [0, *sorted(c for c in cuts if c < len(sentence)), len(sentence)]
            out += [(sentence[x:y], len(edges) == 2) for x, y in zip(edges, edges[1:], strict=False)]
            sentence = []
    return out


def spans_one_by_one(text):
    """(first word, word after the last, words) of every pair of sentences and of the pieces of long ones."""
    parts, at = pieces_one_by_one(text), [0]
    for w, _ in parts:
        at.append(at[-1] + len(w))
    words = [w for p, _ in parts for w in p]
    for k in range(len(parts) - 1):
        if parts[k][1] and parts[k + 1][1]:
            yield at[k], at[k + 2], tuple(words[at[k] : at[k + 2]])
        end = next((e for e in range(k + 2, len(parts) + 1) if at[e] - at[k] >= 12), None)
        if end and not all(whole for _, whole in parts[k:end]):
            yield at[k], at[end], tuple(words[at[k] : at[end]])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_substrings_equal_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in table(spark, f"/root/testdata/{sf}").collect())
    first, off = {}, defaultdict(set)
    for d, t in docs:
        for lo, hi, words in sorted(spans_one_by_one(t)):
            if first.setdefault(words, (d, lo)) != (d, lo):
                off[d] |= set(range(lo, hi))
    got = {r.doc_id: r for r in substring_dedup.judge(table(spark, f"/root/testdata/{sf}")).collect()}
    for d, t in docs:
        assert got[d].text.split() == [w for k, w in enumerate(t.split()) if k not in off[d]]
        assert got[d].repeats == bool(off[d]) and got[d].n_removed == len(off[d])
        assert off[d] or got[d].text == t
    assert sum(map(len, off.values()))


def test_repeated_pairs_of_short_sentences_stay_once(spark, make_docs):
    texts = [f"{prose(k, 20)}. No way. It is. {prose(9 + k, 20)}" for k in range(4)] + ["No way. Then other words. It is. So there."]
    got = {r.doc_id: r.text for r in substring_dedup.judge(make_docs(texts)).collect()}
    assert [("No way. It is." in got[k]) for k in range(4)] == [True, False, False, False]
    assert all(" ".join(got[k].split()) == " ".join(texts[k].replace("No way. It is. ", "").split()) for k in range(1, 4)) and got[4] == texts[4]


def test_hot_spans_are_joined_apart(spark, make_docs, monkeypatch):
    """Some keys by broadcast, the others by a shuffle: the same result as all by a shuffle."""
    passage = "This one is shared. All over the place. "
    docs = make_docs([passage + prose(k, 30) + (" Twice in here. Just so. " if k % 9 == 0 else "") + passage for k in range(40)])
    want = sorted(substring_dedup.judge(docs).select("doc_id", "text", "n_removed").collect())
    monkeypatch.setattr(common.joined_by_count, "__defaults__", (20,))
    assert sorted(substring_dedup.judge(docs).select("doc_id", "text", "n_removed").collect()) == want


@pytest.mark.parametrize("ends", [(), (24,), (9, 18, 27), (12, 24, 36), (5, 45)])
def test_no_shared_run_of_50_words_stays(spark, make_docs, ends):
    """Wherever the sentences of a shared run end, also nowhere, and however they go on before and after it."""
    plain = lambda seed, n: prose(seed, n).replace(".", "").split()
    texts, runs = [], []
    for i in range(30):
        run = plain(1000 + i, 50)
        for k in ends:
            run[k] += "."
        runs.append(run)
        texts += [" ".join(plain(2000 + 9 * i + k, n) + run + plain(3000 + 9 * i + k, m)) for k, n, m in ((0, 40, i), (1, i, 40))]
    got = {r.doc_id: r.text for r in substring_dedup.judge(make_docs(texts)).collect()}
    assert all(got[2 * i] == texts[2 * i] for i in range(30))
    assert not any(" ".join(run) in got[2 * i + 1] for i, run in enumerate(runs))


def test_a_stutter_is_cut_into_whole_windows():
    assert len(substring_dedup.pieces(["so " * 600])[2]) <= 600 / substring_dedup.WINDOW + 2


# Quality model


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    scores = queries.QUERIES["op4_quality_classifier"](spark, d).where("held_out").join(table(spark, d, "labels"), "doc_id").collect()
    good = [r.score for r in scores if r.quality]
    bad = [r.score for r in scores if not r.quality]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scores)


def plain_features(t):
    """The transformed statistics of a text, one by one."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = max(len(w), 1), sum(map(len, w))
    windows = list(zip(w, w[1:], w[2:], strict=False))
    capitals = sum(unicodedata.category(c) == "Lu" for c in t)
    return [
        (chars + 60) / (n + 10),
        math.log1p(100 * sum(c in "#*$%&|<>!" for c in t) / (n + 10)),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 3)),
        math.sqrt(max(0, n - 2 - len(set(windows))) / (n + 10)),
        math.sqrt((capitals + 1) / (chars + 60)),
        math.sqrt((sum(c in ".,;:?" for c in t) + 1.4) / (n + 10)),
        math.log((len(set(w)) + 10) / (n + 10) ** 0.9),
        (sum(len(x) <= 3 for x in w) + 4) / (n + 10),
    ]


def test_scores_equal_a_fit_by_hand(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    x = {d: np.array(plain_features(t)) for d, t in texts.items()}
    learnt = [d for d in labels if zlib.crc32(str(d).encode()) % 4 != 2 and texts[d].split()]
    by = [np.array([x[d] for d in learnt if labels[d] == c]) for c in (0, 1)]
    covs = [np.cov(v.T, bias=True) for v in by]
    pooled = np.diag(sum(len(v) * np.diag(c) for v, c in zip(by, covs, strict=True)) / sum(map(len, by)))
    covs = [0.7 * c + 0.3 * pooled + np.eye(8) * 0.02**2 for c in covs]
    log = lambda c, v: -0.5 * ((v - by[c].mean(0)) @ np.linalg.solve(covs[c], v - by[c].mean(0)) + np.linalg.slogdet(covs[c])[1])
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality_classifier"](spark, sf_dir).collect()}
    for d, t in texts.items():
        odds = log(1, x[d]) - log(0, x[d]) + math.log(len(by[1]) / len(by[0]))
        want = 1 / (1 + math.exp(-min(30, max(-30, odds)))) if t.split() else 0.0
        assert got[d].score == pytest.approx(want, abs=1e-6)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    kept = {r.doc_id for r in quality_model.keep_good(table(spark, sf_dir), table(spark, sf_dir, "labels")).collect()}
    assert kept == {d for d, r in got.items() if r.predicted}


def test_score_is_the_density_ratio():
    rng = np.random.default_rng(1)
    means = (rng.normal(size=8), rng.normal(size=8))
    covs = [np.diag(rng.uniform(0.5, 2, 8)) + 0.1 for _ in range(2)]
    roots = [np.linalg.cholesky(c) for c in covs]
    x = rng.normal(size=8)
    logs = [-0.5 * ((x - m) @ np.linalg.solve(c, x - m) + np.log(np.linalg.det(c))) for m, c in zip(means, covs, strict=True)]
    want = 1 / (1 + math.exp(-(logs[1] - logs[0] + math.log(3))))
    from pyspark.sql import SparkSession

    model = quality_model.QuadraticModel(means, tuple(np.linalg.inv(r) for r in roots), tuple(2 * float(np.log(np.diag(r)).sum()) for r in roots), math.log(3))
    got = SparkSession.active().range(1).select(model.score([F.lit(float(v)) for v in x])).first()[0]
    assert got == pytest.approx(want)


# Sharding


def test_shards_round_trip_and_versions(spark, sf_dir):
    docs = table(spark, sf_dir)
    store = sharding.ShardTable(spark, f"{shared_folder(spark)}/test-shards-{random.random()}", sharding.Tiers(arrival_rows=10, target_bytes=60_000, least_bytes=1_000))
    store.append(docs.where("doc_id < 100"))
    store.append(docs.where("doc_id >= 100"))
    before = store.manifest().count()
    version = store.compact()
    assert version > 2 and store.manifest().count() < before
    assert sorted(store.read().collect()) == sorted(docs.collect()) == sorted(store.read(2).collect())
    sizes = store.manifest().agg(F.sum("rows"), F.max("bytes")).first()
    assert sizes[0] == docs.count() and sizes[1] < 3 * 60_000
    assert store.compact() == version  # nothing left to merge
    assert store.vacuum() == 0 or store.read().count() == docs.count()


def test_a_version_is_committed_once(spark, make_docs):
    store = sharding.ShardTable(spark, f"{shared_folder(spark)}/test-commit-{random.random()}")
    store.append(make_docs(["a"]))
    shards, schema = store.manifest(1), make_docs(["a"]).schema
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(shards, schema, 0)
    assert store.version() == 1


@pytest.mark.parametrize("who", ["append", "compact"])
def test_vacuum_beside_a_writer_loses_nothing(spark, make_docs, who):
    path = f"{shared_folder(spark)}/test-vacuum-{random.random()}"
    tiers = sharding.Tiers(arrival_rows=3, target_bytes=1 << 20, least_runs=2)
    first, second = sharding.ShardTable(spark, path, tiers), sharding.ShardTable(spark, path, tiers)
    docs = make_docs([prose(k, 20) for k in range(40)])
    first.append(docs.where("doc_id < 20"))
    first.append(docs.where("doc_id >= 20 AND doc_id < 30"))
    commit = first._commit
    first._commit = lambda *a: (second.vacuum(), commit(*a))[1]
    if who == "append":
        first.append(docs.where("doc_id >= 30"))
    else:
        second.append(docs.where("doc_id >= 30"))
        first.compact()
    assert sorted(map(str, second.read().collect())) == sorted(map(str, docs.collect()))
    assert second.vacuum(grace_hours=0) >= 0 and second.read().count() == 40


def test_vacuum_deletes_what_only_older_versions_name(spark, make_docs):
    store = sharding.ShardTable(spark, f"{shared_folder(spark)}/test-old-{random.random()}", sharding.Tiers(arrival_rows=3, target_bytes=1 << 20, least_runs=2))
    store.append(make_docs([prose(k, 20) for k in range(30)]))
    files = store.manifest(1).count()
    assert store.compact() == 2 and store.vacuum() == files and store.vacuum() == 0
    assert store.read().count() == 30


def test_plan_equals_a_model(spark):
    rng = random.Random(4)
    tiers = sharding.Tiers(target_bytes=1000, least_bytes=10, least_runs=3)
    store = sharding.ShardTable(spark, f"{shared_folder(spark)}/test-plan", tiers)
    shards = [(f"f{k:03d}", rng.choice([5, 30, 60, 200, 499, 700]), 1, k) for k in range(200)]
    frame = spark.createDataFrame(shards, "file string, bytes long, rows long, seq long").withColumn("tier", store._tier())
    want, sums = defaultdict(list), Counter()
    for f, size, _, _ in shards:
        if size < 500:
            tier = int(math.log(max(size / 10, 1)) / math.log(4))
            want[tier, sums[tier] // 1000].append(f)
            sums[tier] += size
    got = defaultdict(list)
    for r in store._plan(frame).orderBy("seq").collect():
        got[r.tier, r.n].append(r.file)
    assert got == {k: v for k, v in want.items() if len(v) >= 3}


# Mixing


def test_lag_is_less_than_a_block(spark):
    parts = {"a": 10, **{f"s{i}": 1 for i in range(10)}}
    slots = [r.source for r in mixing.period(spark, parts).orderBy("at").collect()]
    assert Counter(slots) == Counter(parts)
    for s, p in parts.items():
        for t in range(len(slots) + 1):
            assert abs(slots[:t].count(s) - t * p / len(slots)) < 1


def test_blocks_keep_their_windows(spark, sf_dir):
    rows = queries.QUERIES["op6_mixing"](spark, sf_dir).collect()
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert len({(r.grp, r.block) for r in rows}) == len({r.slot for r in rows})


def test_interleaved_files_follow_the_mix(spark, sf_dir):
    docs = table(spark, sf_dir)
    slot = {r.doc_id: r.slot for r in mixing.schedule(docs, queries.MIX, 5_000).collect()}
    got = mixing.interleaved(docs, queries.MIX, 5_000).collect()
    order = [slot[r.doc_id] for r in got]
    assert order == sorted(order) and sorted(got) == sorted(docs.collect())


# Lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = s = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    while s < min(len(a), len(b)) and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def test_lines_equal_brute_force(spark, make_docs):
    base = [" ".join(f"w{(i * 7 + j) % 31}" for j in range(10)) for i in range(6)]
    rng, texts = random.Random(3), []
    for _ in range(40):
        words = rng.choice(base).split()
        k = rng.randrange(len(words))
        change = rng.randrange(5)
        if change == 0:
            words[k] = f"x{rng.randrange(3)}"
        elif change == 1:
            del words[k]
        elif change == 2:
            words.insert(k, f"y{rng.randrange(3)}")
        elif change == 3:
            words[k], words[k - 1] = "p", "q"
        # Lines of one to seven words too, most of them one edit from another.
        short = [rng.choice("ab") if k == rng.randrange(7) else f"s{k}" for k in range(rng.randrange(1, 8))]
        texts.append("\n".join([" ".join(words), " ".join(short), "short line", "", "  " + rng.choice(base) + "  "]))
    lines = [(tuple(line.split()), d, k) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.split()]
    first = {}
    for w, d, k in lines:
        first.setdefault(w, (d, k))
    want = defaultdict(list)
    for w, d, k in lines:
        near = len(w) >= 5 and any(len(o) >= 5 and o != w and first[o] < first[w] and within_one(o, w) for o in first)
        if near or first[w] != (d, k):
            want[d].append(k)
    got = {r.doc_id: list(r.removed) for r in line_dedup.judge(make_docs(texts)).collect()}
    assert got == {d: want.get(d, []) for d in range(len(texts))}
    kept = {r.doc_id: r.text for r in line_dedup.clean(make_docs(texts)).collect()}
    assert kept == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[d]) for d, t in enumerate(texts)}


def test_line_bound_on_both_sides(spark, make_docs):
    lines = ["a b c d e f g", "a b x d e f g", "one two three four five", "one two three four six", "p q r s", "p q r t", "p q r s u", "k", "l"]
    got = line_dedup.judge(make_docs(["\n".join(lines)])).first()
    assert list(got.removed) == [1, 3] and got.n_lines == len(lines)


# Decontamination


def test_smith_waterman_equals_the_textbook():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.smith_waterman(a, b) == h.max()


def test_copies_and_edits_of_items_are_found(spark, make_docs):
    items = [(i, prose(100 + i, 40)) for i in range(6)]
    texts = [prose(i, 300) for i in range(10)]
    texts += [prose(20, 100) + " " + items[0][1] + " " + prose(21, 100)]
    texts += [prose(22, 100) + " " + edited(items[1][1], 8) + " " + prose(23, 100)]
    texts += [prose(24 + k, 30) + " " + items[2][1] for k in range(40)]  # one item in many texts keeps its seeds
    texts += [" ".join(items[3][1].split(" ")[:6]) + " " + prose(70, 100)]  # a phrase is no copy
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontamination.judge(make_docs(texts), frame).collect()}
    assert [got[i] for i in range(10)] == [[]] * 10
    assert got[10] == [0] and got[11] == [1] and all(got[12 + k] == [2] for k in range(40)) and got[52] == []
    kept = {r.doc_id for r in decontamination.clean(make_docs(texts), frame).collect()}
    assert kept == {*range(10), 52}


@pytest.mark.parametrize("every", [5, 6])
def test_copies_with_close_edits_are_found(spark, make_docs, every):
    items = [(i, prose(300 + i, 40)) for i in range(20)]
    # Each item twice with other edits: what one copy leaves intact the other may lack.
    texts = [prose(400 + i, 50) + " " + edited(t, every, i) + " " + prose(500 + i, 50) for i, t in items]
    texts += [prose(600 + i, 50) + " " + edited("x " + t, every, 50 + i) for i, t in items]
    texts += [" ".join(t.split(" ")[10:22]) + " " + prose(700 + i, 100) for i, t in items]  # a third is no copy
    got = {r.doc_id: list(r.item_ids) for r in decontamination.judge(make_docs(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: [k % 20] if k < 40 else [] for k in range(60)}


def test_a_copy_with_many_added_terms_is_found(spark, make_docs):
    # 19 added terms leave a score of 21 of 40; only the last four terms are a run.
    words = prose(800, 40).split()
    text = " ".join(w + (f" added{i}" if i in (0, 35) or (i % 2 == 0 and 2 <= i < 36) else "") for i, w in enumerate(words))
    frame = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = decontamination.judge(make_docs([prose(801, 30) + " " + text + " " + prose(802, 30)]), frame).first()
    assert got.item_ids == [1] and got.score == 21 / 40


def matched(text, items, n=4, least=0.5):
    """Places of the items that share a seed with the text and align to at least half: the whole text, cell by cell."""
    t, out = terms(text), set()
    for k, item in enumerate(items):
        w = terms(item)
        m = min(n, len(w))
        if not m or not {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} & {tuple(t[i : i + m]) for i in range(len(t) - m + 1)}:
            continue
        row, best = [0] * (len(t) + 1), 0
        for x in w:
            new = [0]
            for j, y in enumerate(t):
                new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row, best = new, max(best, *new)
        if best >= least * len(w):
            out.add(k)
    return out


def test_repeated_and_null_item_ids_equal_brute_force(spark, make_docs):
    """Five items under one id, several without, short ones, equal texts: by their texts, on both sides."""
    items = [prose(900 + k, 30) for k in range(10)] + ["rare thing", "Unlikely", "", None, prose(900, 30)]
    ids = [7] * 5 + [None] * 3 + [8, 9, 10, 11, 12, 13, 14]
    texts = [prose(950 + k, 60) + " " + edited(items[k % 10], 4 + k % 5, k) + " " + prose(980 + k, 60) for k in range(40)]
    texts += ["a rare thing here", "rare other thing", "not unlikely at all", "", None, items[9], prose(1, 5)]
    got = {r.doc_id: r for r in decontamination.judge(make_docs(texts), spark.createDataFrame(list(zip(ids, items, strict=True)), ITEM)).collect()}
    for k, t in enumerate(texts):
        want = matched(t, items)
        assert got[k].contaminated == bool(want)
        assert set(got[k].item_ids) == {ids[i] for i in want} - {None} and sorted(set(got[k].item_ids)) == list(got[k].item_ids)
    assert sum(r.contaminated for r in got.values()) > 25


def test_every_exact_copy_in_the_tables_is_found(spark):
    d = "/root/testdata/sf0.01"
    items = [(r.item_id, " ".join(terms(r.text))) for r in table(spark, d, "benchmark").collect()]
    got = {r.doc_id: set(r.item_ids) for r in queries.QUERIES["op8_decontamination"](spark, d).collect()}
    for r in table(spark, d).collect():
        text = " ".join(terms(r.text))
        assert {i for i, t in items if t in text} <= got[r.doc_id]


# URL filter and rules


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_matches_duckdb(spark, sf_dir, name):
    from tests.oracle import connection, same

    same(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), oracles.ORACLES[name])


def test_bloom_blocks_pass_all_entries_and_few_others(spark):
    entries = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id") % 500).alias("host"), F.concat(F.lit("/a/"), F.col("id")).alias("path"))
    others = entries.select("host", F.concat("path", F.lit("x")).alias("path"))
    blocks = 20_000 * url_rules.BITS_PER_ENTRY // 512
    filters = url_rules.bloom_blocks(entries, blocks)
    assert filters.count() == blocks

    def passed(keys):
        block, bits = url_rules._places(F.col("host"), F.col("path"), blocks)
        at = keys.select(block.alias("block"), bits.alias("want")).join(filters, "block")
        return at.where(F.forall("want", lambda b: url_rules._bit(F.col("bits"), b))).count()

    assert passed(entries) == 20_000
    assert passed(others) < 0.01 * 20_000


def test_listed_urls_are_found_by_their_canonical_form(spark, make_docs):
    """A list of thousands read from a table, against a set of all its keys."""
    listed = spark.range(5_000).select(F.concat(F.lit("Bad"), F.col("id") % 700, F.lit(".test")).alias("host"), F.concat(F.lit("/p/"), F.col("id"), F.lit("/")).alias("path"))
    listed = common.written(listed.unionByName(spark.createDataFrame([("all.test.", ""), (None, "/"), ("", "/")], "host string, path string")), "list")
    cases = {
        "http://bad3.test/p/3": "bad3.test/p/3",
        "http://BAD3.test:8080/p/3/": "bad3.test/p/3",
        "http://user:pw@www.bad3.test./p//./3/deeper?q": "bad3.test/p/3",
        "http://bad3.test/%70/3": "bad3.test/p/3",
        "http://bad3.test/p/33": None,
        "http://bad3.test/p/703": "bad3.test/p/703",
        "http://notbad3.test/p/3": None,
        "http://bad3.test/%zz/3": None,
        "http://x.all.test/anything": "all.test",
        "http://all.test:80": "all.test",
        "http://all.test.example/": None,
        "http://bad3.test": None,
        "": None,
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), listed).collect()}
    assert [got[k].entry for k in range(len(cases))] == list(cases.values())
    assert [got[k].verdict for k in range(len(cases))] == ["block" if e else "allow" for e in cases.values()]
    assert got[1].host == "bad3.test:8080" and got[2].path == "/p//./3/deeper"


def test_base_counts_equal_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in queries.QUERIES["op10_quality_rules"](spark, sf_dir).collect()}
    for r in table(spark, sf_dir).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(covered))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


FLOORS = np.array(list(robust_rules.STATISTICS.values()))


def robust_vector(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    chars, n = sum(map(len, w)), len(w)
    capitals = sum(unicodedata.category(c) == "Lu" for c in t)
    x = [chars / n, math.log1p(100 * sum(c in "#*$%&|<>" for c in t) / n), math.sqrt((len(lines) - len(set(lines))) / len(lines)), math.sqrt(len(covered) / n), math.sqrt(capitals / chars), math.sqrt(sum(c in ".,;:!?" for c in t) / n)]
    return None if n < 50 or 100 * len(covered) > 50 * n else np.array(x)


def bins(v):
    return np.floor(32 * np.log2(np.maximum(v, 1e-6))).astype(int)


def at_share(b, share):
    """The least bin that has this share of the values at or below it."""
    return min(k for k in set(b.tolist()) if (b <= k).sum() >= share * len(b))


def lowest_determinant(x, rules):
    """Centre and covariance of the lowest determinant that concentration from three starts meets."""
    d = x.shape[1]
    quarts = [[at_share(np.floor(c * 64), s) for s in (0.25, 0.5, 0.75)] for c in x.T]
    m0 = np.array([(q[1] + 0.5) / 64 for q in quarts])
    spread = np.maximum([(q[2] - q[0]) / 64 / 1.349 for q in quarts], FLOORS)
    z = (x - m0) / spread
    signs = z / np.sqrt(np.maximum((z**2).sum(1), 1e-12))[:, None]
    starts = [np.eye(d), np.tanh(z).T @ np.tanh(z) / len(x), d * signs.T @ signs / len(x)]

    def step(m, c):
        z = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
        b = bins((z**2).sum(0))
        core = x[b <= at_share(b, rules.share)]
        return core.mean(0), np.cov(core.T, bias=True).reshape(d, d) + np.diag(FLOORS**2)

    det = lambda f: np.linalg.slogdet(f[1])[1]
    runs = []
    for s in starts:
        now = best = step(m0, s * np.outer(spread, spread) + np.diag(FLOORS**2))
        for _ in range(1, rules.first_steps):
            if now is not None:
                new = step(*now)
                now = new if det(new) < det(best) - rules.falls else None
                best = best if now is None else now
        runs.append((det(best), len(runs), best, now))
    _, _, best, now = min(runs, key=lambda r: r[:2])
    for _ in range(rules.first_steps, rules.most_steps):
        if now is not None:
            new = step(*now)
            now = new if det(new) < det(best) - rules.falls else None
            best = best if now is None else now
    return best


def test_robust_distances_equal_numpy(spark, make_docs):
    """Groups of 3 to 300 rows, of several sources of two languages, some of them with junk."""
    rng, rules = random.Random(8), robust_rules.RobustRules()
    rows, k = [], 0
    for lang, source, n in (("a", "s0", 300), ("a", "s1", 50), ("a", "s2", 5), ("a", None, 3), ("b", "s0", 40), ("b", "s1", 12)):
        for _ in range(n):
            words = prose(rng.randrange(10**6), rng.randrange(60, 160)).split(" ")
            words = [w.upper() if rng.random() < 0.05 * (k % 4) else w for w in words]
            words = [w + "#$" * 3 if k % 9 == 0 or rng.random() < 0.01 else w for w in words]
            rows.append((k, " ".join(words), lang, source))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    vectors = {i: robust_vector(t) for i, t, _, _ in rows}
    groups = {}
    for i, _, lang, source in rows:
        if vectors[i] is not None:
            for g in ((), (lang,), (lang, source or "")):
                groups.setdefault(g, []).append(i)
    raw = {g: lowest_determinant(np.array([vectors[i] for i in ids]), rules) for g, ids in groups.items()}
    blend = lambda n, own, above: (n * own + rules.prior * above) / (n + rules.prior)
    fit = dict(raw)
    for size in (1, 2):
        for g in [g for g in raw if len(g) == size]:
            fit[g] = tuple(blend(len(groups[g]), raw[g][i], (raw if size == 1 else fit)[g[:-1]][i]) for i in (0, 1))
    d2 = {}
    middle = robust_rules.chi2_quantile(0.5, 6)
    own = {}
    for g in [g for g in groups if len(g) == 2]:
        z = np.linalg.solve(np.linalg.cholesky(fit[g][1]), (np.array([vectors[i] for i in groups[g]]) - fit[g][0]).T)
        d2[g] = (z**2).sum(0)
        own[g] = max(1.0, 2 ** ((at_share(bins(d2[g]), 0.5) + 0.5) / 32) / middle)
    got = {r.doc_id: r for r in robust_rules.judge(docs, rules).collect()}
    cutoff = robust_rules.chi2_quantile(1 - rules.tail, 6)
    for g, values in d2.items():
        peers = [h for h in own if h[0] == g[0]]
        above = sum(len(groups[h]) * own[h] for h in peers) / sum(len(groups[h]) for h in peers)
        scale = blend(len(groups[g]), own[g], above)
        for i, v in zip(groups[g], values, strict=True):
            assert got[i].d2 == pytest.approx(v / scale, rel=1e-6, abs=1e-9)
            assert got[i].kept == (v / scale <= cutoff)
    assert all(got[i].base_failed and not got[i].kept and got[i].d2 is None for i, v in vectors.items() if v is None)
    assert 20 < sum(not got[i].kept for i, v in vectors.items() if v is not None) < 100


def test_outliers_go_and_plain_texts_stay(spark, make_docs):
    good = [prose(i, 120 + i) for i in range(120)]
    junk = [" ".join(w + "###$$$" for w in prose(900 + i, 120).split()) for i in range(20)]
    got = {r.doc_id: r.kept for r in robust_rules.judge(make_docs(good + junk)).collect()}
    assert all(got[i] for i in range(120)) and not any(got[120 + i] for i in range(20))


def test_chi2_quantile():
    # Tabulated: 6 degrees of freedom at 0.5 and 0.99.
    assert robust_rules.chi2_quantile(0.5, 6) == pytest.approx(5.348, abs=0.02)
    assert robust_rules.chi2_quantile(0.99, 6) == pytest.approx(16.81, abs=0.05)
