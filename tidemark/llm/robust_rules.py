"""Quality rules from robust multivariate outliers.

Base rules fail texts that are short or repeat themselves. The others are held against their own language and source:
a regularised minimum-covariance-determinant estimate of a vector of text statistics is made for each (lang, source)
group, and a text goes if its squared Mahalanobis distance is beyond a chi-squared cutoff.

Estimates are made for everything, for each language and for each (lang, source) alike. Each has three starts about
the medians: the quartile ranges alone, the covariance of squashed (tanh) and that of signed (length one) standardised
vectors. A concentration step takes the `share` of a group's rows that are nearest, by bins of distance, and estimates
anew; after `first_steps` the start with the lowest determinant goes on, until no group's determinant falls by
`falls` (in its logarithm) or `most_steps` are made. The lowest determinant met is kept. Every estimate is then shrunk
towards the one above it, which weighs as much as `prior` rows: a group of five rows is judged almost as its language,
one of thousands by its own rows, and nothing switches in between.

All of it is DataFrame functions. A step is one grouped aggregate by (group, start, bin) with map-side combining; the
fits are a row a group and broadcast while there are few.

Defined cases
- null or empty text: no words, base_failed, not kept.
- null lang or source: the group of the empty string.
- small groups: shrunk as above; a lone text has distance 0 to an estimate of itself and is kept.
- repeated rows: each is judged by itself and counts in the estimate.
- ties at the concentration threshold: all are taken.
- empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded, words_of, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Estimates of so many groups are broadcast (some 100 numbers each), and shuffled beyond.
BROADCAST_FITS = 100_000

#: Name, and the least standard deviation that an estimate may have in that direction (regularisation: most
#: texts have no symbols and no repeats at all, which would leave the covariance singular).
STATISTICS = {
    "mean_word": 0.35,
    "symbols": 0.35,
    "dup_lines": 0.15,
    "repeats": 0.15,
    "capitals": 0.06,
    "marks": 0.10,
}


@dataclass(frozen=True)
class RobustRules:
    """Parameters. `share`: of each group that a concentration step keeps. `prior`: rows that the estimate above weighs. `tail`: of a normal population beyond the cutoff."""

    min_words: int = 50
    max_repeat_percent: int = 50
    share: float = 0.75
    first_steps: int = 2
    most_steps: int = 10
    falls: float = 0.01
    prior: float = 50.0
    tail: float = 1e-6


def _kept_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text, with the vector of transformed statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    split = base.select(
        "doc_id",
        "lang",
        "source",
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("lines"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        _kept_chars(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
        _kept_chars(F.col("text"), ".,;:!?").alias("n_marks"),
    )
    windows = split.select(
        "*",
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"),
    )
    # Sorted by hash, a window found again stands beside its like; most texts have none and are not sorted.
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = windows.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted")).select(
        "*",
        F.sort_array(
            F.transform(
                F.filter("sorted", lambda x, k: (x["h"] == F.get("sorted", k - 1)["h"]) | (x["h"] == F.get("sorted", k + 1)["h"])),
                lambda x: x["i"],
            )
        ).alias("at"),
    )
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    counted = marked.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_capitals",
        "n_marks",
    )
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return counted.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        per_word("word_chars").alias("mean_word"),
        F.log1p(100 * per_word("n_symbols")).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"),
        F.sqrt(per_word("n_repeat_words")).alias("repeats"),
        F.sqrt(F.col("n_capitals") / F.greatest("word_chars", F.lit(1))).alias("capitals"),
        F.sqrt(per_word("n_marks")).alias("marks"),
    )


def chi2_quantile(p: float, d: int) -> float:
    """Of the chi-squared distribution with `d` degrees of freedom (Wilson-Hilferty), by bisection on the normal tail."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - math.erfc(mid / math.sqrt(2)) / 2 < p else (lo, mid)
    return d * max(0.0, 1 - 2 / (9 * d) + lo * math.sqrt(2 / (9 * d))) ** 3


def _quantile_bins(rows: DataFrame, keys: list[str], bin_col: str, shares: list[float]) -> DataFrame:
    """For each key the least bins that have at least these shares of its rows at or below them.

    Counts by bin first (combined on the map side), so that a group of any size becomes a bounded number of bins.
    """
    counts = rows.groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    below = Window.partitionBy(*keys).orderBy(bin_col)
    total = Window.partitionBy(*keys)
    run = counts.select(*keys, bin_col, F.sum("n").over(below).alias("cum"), F.sum("n").over(total).alias("all"))
    return run.groupBy(*keys).agg(
        *[F.min(F.when(F.col("cum") >= F.col("all") * s, F.col(bin_col))).alias(f"q{i}") for i, s in enumerate(shares)]
    )


def _with_distance(rows: DataFrame, fits: DataFrame, names: list[str]) -> DataFrame:
    """`rows` joined to their group's estimates (lower Cholesky factor l_i_j, centre m_i), with d2 and its bin."""
    out = rows.join(bounded(fits, BROADCAST_FITS), "grp")
    kept = [c for c in out.columns if c[:2] not in ("m_", "l_", "c_")]
    for i, name in enumerate(names):  # forward substitution
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        out = out.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    d2 = reduce(lambda x, y: x + y, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(names))])
    # Bins of squared distances: 32 to each doubling, so that a bin is 2 % wide.
    return out.select(*kept, d2.alias("d2")).withColumn("bin", F.floor(32 * F.log2(F.greatest("d2", F.lit(1e-6)))).cast("int"))


def _factored(cov: DataFrame, keys: list[str], floors: list[float]) -> DataFrame:
    """`keys`, centre m_i, covariance c_i_j, its Cholesky factor l_i_j and log determinant, from a table of a row a group."""
    d, out = range(len(floors)), cov
    for j in d:
        pivot = F.col(f"c_{j}_{j}")
        for k in range(j):
            pivot = pivot - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(floors[j] ** 2 / 2))))
        below = {}
        for i in range(j + 1, len(floors)):
            e = F.col(f"c_{i}_{j}")
            for k in range(j):
                e = e - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = e / F.col(f"l_{j}_{j}")
        out = out.withColumns(below) if below else out
    log_det = reduce(lambda x, y: x + y, [2 * F.log(F.col(f"l_{j}_{j}")) for j in d])
    return out.select(*keys, *[f"m_{i}" for i in d], *[f"{x}_{i}_{j}" for x in "cl" for i in d for j in d if j <= i], log_det.alias("log_det"))


def _starts(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """grp, start and a first estimate: medians, and three covariances from standardised vectors."""
    d = range(len(names))
    # Medians and quartile ranges from counts of bins of 1/64.
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(n) * 64).cast("long").alias("bin")) for i, n in enumerate(names)])).alias("x")).select("grp", "x.dim", "x.bin")
    quart = _quantile_bins(long, ["grp", "dim"], "bin", [0.25, 0.5, 0.75])
    middle = lambda i: F.max(F.when(F.col("dim") == i, (F.col("q1") + 0.5) / 64))
    spread = lambda i: F.greatest(F.max(F.when(F.col("dim") == i, (F.col("q2") - F.col("q0")) / 64 / 1.349)), F.lit(floors[i]))
    about = written(quart.groupBy("grp").agg(*[middle(i).alias(f"m_{i}") for i in d], *[spread(i).alias(f"s_{i}") for i in d]), "robust-medians")
    z = rows.join(bounded(about, BROADCAST_FITS), "grp").select("grp", *[((F.col(n) - F.col(f"m_{i}")) / F.col(f"s_{i}")).alias(f"z_{i}") for i, n in enumerate(names)])
    norm = F.sqrt(F.greatest(reduce(lambda x, y: x + y, [F.col(f"z_{i}") * F.col(f"z_{i}") for i in d]), F.lit(1e-12)))
    z = z.select("*", norm.alias("norm"), *[F.tanh(f"z_{i}").alias(f"t_{i}") for i in d])
    pairs = [(i, j) for i in d for j in d if j <= i]
    products = z.groupBy("grp").agg(
        *[F.avg(F.col(f"t_{i}") * F.col(f"t_{j}")).alias(f"t_{i}_{j}") for i, j in pairs],
        *[(len(names) * F.avg(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("norm") / F.col("norm"))).alias(f"u_{i}_{j}") for i, j in pairs],
    )
    both = products.join(bounded(about, BROADCAST_FITS), "grp")

    def cov(start: int, of) -> DataFrame:
        c = [(of(i, j) * F.col(f"s_{i}") * F.col(f"s_{j}") + F.lit(floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in pairs]
        return both.select("grp", F.lit(start).alias("start"), *[f"m_{i}" for i in d], *c)

    kinds = [lambda i, j: F.lit(float(i == j)), lambda i, j: F.col(f"t_{i}_{j}"), lambda i, j: F.col(f"u_{i}_{j}")]
    return written(_factored(reduce(DataFrame.unionByName, [cov(k, of) for k, of in enumerate(kinds)]), ["grp", "start"], floors), "robust-starts")


def _concentrated(rows: DataFrame, fits: DataFrame, names: list[str], floors: list[float], share: float) -> DataFrame:
    """The estimates of (grp, start) from the rows nearest to the ones before, with the log determinant before."""
    d, keys = range(len(names)), ["grp", "start"]
    sums = [F.sum(names[i]).alias(f"s_{i}") for i in d] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i in d for j in d if j <= i]
    bins = _with_distance(rows, fits, names).groupBy(*keys, "bin").agg(F.count("*").alias("n"), *sums)
    nearer = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # some thousand bins at most
    inside = bins.withColumns({"before": F.coalesce(F.sum("n").over(nearer), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(*keys))}).where(F.col("before") < F.col("all") * share)
    core = inside.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in bins.columns if c not in (*keys, "bin")])
    means = core.select(*keys, "n", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in d], *[c for c in core.columns if c[:2] == "p_"])
    cov = [(F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}") + F.lit(floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in d for j in d if j <= i]
    return _factored(means.select(*keys, *[f"m_{i}" for i in d], *cov), keys, floors)


def estimates(rows: DataFrame, names: list[str], floors: list[float], rules: RobustRules) -> DataFrame:
    """grp, centre and covariance of the lowest determinant met for each group of `rows` (grp and the statistics)."""
    now = written(_concentrated(rows, _starts(rows, names, floors), names, floors, rules.share), "robust-fit")
    best = now
    for step in range(1, rules.most_steps):
        if step == rules.first_steps:
            # Of each group the start with the lowest determinant goes on.
            chosen = best.groupBy("grp").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
            best = written(best.join(chosen, ["grp", "start"]), "robust-best")
            now = written(now.join(chosen, ["grp", "start"]), "robust-fit")
        new = written(_concentrated(rows, now, names, floors, rules.share), "robust-fit")
        was = best.select("grp", "start", F.col("log_det").alias("was"))
        falls = F.col("log_det") < F.col("was") - rules.falls
        now = written(new.join(was, ["grp", "start"]).where(falls).drop("was"), "robust-fit")
        best = written(best.join(now.select("grp", "start"), ["grp", "start"], "left_anti").unionByName(now), "robust-best")
        if step >= rules.first_steps and not now.count():
            break
    chosen = best.groupBy("grp").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    return best.join(chosen, ["grp", "start"]).select("grp", *[c for c in best.columns if c[:2] in ("m_", "c_")])


def _shrunk(own: DataFrame, above: DataFrame, prior: float) -> DataFrame:
    """`own` (with n and parent) drawn towards the estimate of its parent, which counts as `prior` rows."""
    values = [c for c in own.columns if c[:2] in ("m_", "c_")]
    theirs = above.select(F.col("grp").alias("parent"), *[F.col(c).alias(f"above_{c}") for c in values])
    blend = lambda c: ((F.col("n") * F.col(c) + prior * F.col(f"above_{c}")) / (F.col("n") + prior)).alias(c)
    return own.join(theirs, "parent").select("grp", "parent", "n", *[blend(c) for c in values])


def _group(level: int) -> Column:
    """The key of everything (0), a language (1) or a language and source (2)."""
    return F.xxhash64(F.lit(level), *[F.col(c) for c in ("lang", "source")[:level]])


def judge(docs: DataFrame, rules: RobustRules = RobustRules()) -> DataFrame:
    """doc_id, the base counts, base_failed, d2 (scaled squared distance, null if base_failed) and kept."""
    names, floors = list(STATISTICS), list(STATISTICS.values())
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    counts = written(text_counts(docs).withColumn("base_failed", failed), "robust-counts")
    passed = counts.where("NOT base_failed")
    groups = F.array(*[F.struct(_group(k).alias("grp"), _group(max(k - 1, 0)).alias("parent"), F.lit(k).alias("level")) for k in range(3)])
    known = written(passed.groupBy("lang", "source").agg(F.count("*").alias("n")).select("n", F.inline(groups)).groupBy("grp", "parent", "level").agg(F.sum("n").alias("n")), "robust-groups")
    rows = passed.select(F.explode(F.array(*[_group(k) for k in range(3)])).alias("grp"), *names)
    fits = written(estimates(rows, names, floors, rules).join(known, "grp"), "robust-raw")
    at = lambda k: fits.where(F.col("level") == k).drop("level")
    langs = _shrunk(at(1), at(0), rules.prior)
    shrunk = written(_factored(_shrunk(at(2), langs, rules.prior), ["grp", "parent", "n"], floors), "robust-shrunk")

    # Scale so that a group's median distance is the chi-squared one; small groups lean on their language here too.
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = _with_distance(passed.select(_group(2).alias("grp"), *base, *names), shrunk, names)
    middle = _quantile_bins(judged, ["grp"], "bin", [0.5])
    own = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("q0") + 0.5) / 32) / chi2_quantile(0.5, len(names)))
    scales = written(middle.join(shrunk.select("grp", "parent", "n"), "grp").withColumn("own", own), "robust-scales")
    above = scales.groupBy("parent").agg((F.sum(F.col("n") * F.col("own")) / F.sum("n")).alias("above"))
    scale = scales.join(above, "parent").select("grp", ((F.col("n") * F.col("own") + rules.prior * F.col("above")) / (F.col("n") + rules.prior)).alias("scale"))
    d2 = F.col("d2") / F.col("scale")
    found = judged.join(bounded(written(scale, "robust-scale"), BROADCAST_FITS), "grp").select(*base, d2.alias("d2"), (d2 <= chi2_quantile(1 - rules.tail, len(names))).alias("kept"))
    return found.unionByName(counts.where("base_failed").select(*base, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))
