"""Quality classifier: regularised quadratic discriminant analysis over transformed text statistics.

Each class of the labelled texts gets a mean vector and a covariance that is shrunk towards the diagonal of the
pooled one. The Cholesky factors are inverted once and kept in the model; a score is the logistic function of the
difference of the two Mahalanobis log-densities plus the log-odds of the classes. Fitting is one grouped aggregate
(sums and sums of products by class, combined on the map side); scoring is an expression on each row.

Defined cases
- null, empty or blank text: no words; score 0.0.
- label rows with null doc_id or null quality, or without a text: not used. Several labels of a text: each counts.
- null doc_id: held_out false, never used for fitting.
- one class or none among the labels: the score of every text with words is the share of class 1 (0.5 for none).
- repeated rows: each is scored. Extra columns: kept by `keep_good`, whatever their names; not read otherwise.
- empty table: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, bounded, columns_of, words_of, written

FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "capitals", "marks", "distinct", "short_words")
SYMBOLS = "#*$%&|<>!"

#: Rates are smoothed by so many words of plain prose, as few words say little.
TYPICAL = 10

#: A text is predicted good from this score on.
GOOD = 0.7


@dataclass(frozen=True)
class QuadraticModel:
    """Means, inverted Cholesky factors and log-determinants of both classes, with the log-odds of class 1."""

    means: tuple[np.ndarray, np.ndarray] | None
    inverse: tuple[np.ndarray, np.ndarray] | None
    log_det: tuple[float, float]
    log_odds: float

    def score(self, features: list[Column]) -> Column:
        """0 to 1; higher means that label 1 is likelier."""
        x = F.lit(self.log_odds)
        if self.means is not None:
            for c, sign in ((0, 0.5), (1, -0.5)):
                centred = [f - F.lit(float(m)) for f, m in zip(features, self.means[c], strict=True)]
                for row in self.inverse[c]:
                    z = sum((F.lit(float(w)) * v for w, v in zip(row, centred, strict=True) if w), F.lit(0.0))
                    x = x + F.lit(sign) * z * z
                x = x + F.lit(sign * self.log_det[c])
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def with_features(rows: DataFrame) -> DataFrame:
    """`rows` (columns row, text) as row, n_words and the transformed statistics of the whole text."""
    text = F.col("text")
    split = rows.select(
        "row",
        words_of(text).alias("words"),
        F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.coalesce(F.length(F.regexp_replace(text, BLANK + "+", "")), F.lit(0)).alias("n_chars"),
        F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).alias("n_symbols"),
        F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", "")), F.lit(0)).alias("n_capitals"),
        F.coalesce(F.length(text) - F.length(F.translate(text, ".,;:?", "")), F.lit(0)).alias("n_marks"),
    )
    n = F.greatest(F.size("words"), F.lit(1))
    windows = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)),
    )
    # One generated row a text: what is computed of it is computed once, also under a filter on the score.
    statistics = F.struct(
        F.size("words").alias("n_words"),
        ((F.col("n_chars") + 60) / (n + TYPICAL)).alias("mean_word"),
        F.log1p(100 * F.col("n_symbols") / (n + TYPICAL)).alias("symbols"),
        F.sqrt((F.size("lines") - F.size(F.array_distinct("lines"))) / (F.size("lines") + 3)).alias("dup_lines"),
        F.sqrt(F.greatest(F.lit(0), n - 2 - F.size(F.array_distinct(windows))) / (n + TYPICAL)).alias("repeats"),
        F.sqrt((F.col("n_capitals") + 1) / (F.col("n_chars") + 60)).alias("capitals"),
        F.sqrt((F.col("n_marks") + 1.4) / (n + TYPICAL)).alias("marks"),
        # Distinct words against what Heaps' law leaves of a longer text.
        F.log((F.size(F.array_distinct("words")) + TYPICAL) / F.pow((n + TYPICAL).cast("double"), F.lit(0.9))).alias("distinct"),
        ((F.size(F.filter("words", lambda w: F.length(w) <= 3)) + 4) / (n + TYPICAL)).alias("short_words"),
    )
    return split.select("row", F.explode(F.array(statistics)).alias("of")).select("row", "of.*")


def fit(features: DataFrame, label: str, shrinkage: float = 0.3, floor: float = 0.02) -> QuadraticModel:
    """From rows with the features and a 0/1 label: one aggregate, of which a row a class comes to the driver.

    `shrinkage`: weight of the pooled diagonal in each class covariance. `floor`: least standard deviation.
    """
    d = range(len(FEATURES))
    got = {
        r["label"]: r
        for r in features.where("n_words > 0")
        .groupBy(F.col(label).cast("int").alias("label"))
        .agg(
            F.count("*").alias("n"),
            *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i in d for j in d if j <= i],
        )
        .where("label IN (0, 1)")
        .collect()
    }
    if len(got) < 2:
        share = 0.5 if not got else float(1 in got)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QuadraticModel(None, None, (0.0, 0.0), math.log(share / (1 - share)))
    n = [got[c]["n"] for c in (0, 1)]
    means = [np.array([got[c][f"s{i}"] / n[c] for i in d]) for c in (0, 1)]
    covs = [np.array([[got[c][f"p{max(i, j)}_{min(i, j)}"] / n[c] for j in d] for i in d]) - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.diag(covs[0] * n[0] + covs[1] * n[1]) / sum(n))
    roots = [np.linalg.cholesky((1 - shrinkage) * covs[c] + shrinkage * pooled + np.eye(len(d)) * floor**2) for c in (0, 1)]
    return QuadraticModel(
        (means[0], means[1]),
        (np.linalg.inv(roots[0]), np.linalg.inv(roots[1])),
        (2 * float(np.log(np.diag(roots[0])).sum()), 2 * float(np.log(np.diag(roots[1])).sum())),
        math.log(n[1] / n[0]),
    )


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _learn(features: DataFrame, labels: DataFrame) -> QuadraticModel:
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    return fit(features.where(~held_out(F.col("row.doc_id"))).join(marks, F.col("row.doc_id") == F.col("id")), "label")


def _scored(features: DataFrame, model: QuadraticModel) -> DataFrame:
    return features.select("row", "n_words", F.when(F.col("n_words") == 0, 0.0).otherwise(model.score([F.col(f) for f in FEATURES])).alias("score"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_words of every row of `docs`.

    The statistics are computed once and written (some ten numbers a text), then read for the fit and the scores.
    """
    features = written(with_features(docs.select(F.struct("doc_id").alias("row"), "text")), "quality-features")
    scored = _scored(features, _learn(features, labels))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
        F.col("n_words").cast("long").alias("n_words"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` with a score of 0.7 or more, all columns as they were.

    Statistics are computed on the way through, and before that of the labelled rows alone, for the fit.
    """
    known = written(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct(), "labelled-ids")
    labelled = docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(bounded(known), "doc_id", "left_semi")
    model = _learn(with_features(labelled.select(F.struct("doc_id").alias("row"), "text")), labels)
    scored = _scored(with_features(docs.select(F.struct(*columns_of(docs)).alias("row"), docs["text"].alias("text"))), model)
    return scored.where(F.col("score") >= GOOD).select("row.*")
