"""Helpers that the text operators share: the shared folder, written tables, words, text keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.paths import fresh

#: What separates words: space and the ASCII controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet under the shared folder and read again.

    Cuts the lineage: a lost executor costs the reading of a file, not the job that made it. `paths.clear` removes
    what an application has written.
    """
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of keys is broadcast up to so many rows (some tens of MB), and shuffled beyond.
BROADCAST_ROWS = 1_000_000
#: A key with more rows than this, and than a hundred-thousandth of all, is hot.
HOT_ROWS = 10_000


def bounded(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`keys`, a written table of a few numbers a row, with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def joined_by_count(rows: DataFrame, table: DataFrame, keys: list[str], hot: int = HOT_ROWS) -> DataFrame:
    """`rows` joined to `table`, a written table with a row a key and `n`, how many of `rows` the key has.

    Hot keys are broadcast (100 000 at most, by their number of rows), the others shuffled, so that no task of the
    shuffle meets more than the rows of one key that is not hot. The plan is the same at every size.
    """
    limit = max(hot, (table.agg(F.sum("n")).first()[0] or 0) // 100_000)
    often = F.broadcast(table.where(F.col("n") > limit))
    rest = rows.join(often.select(*keys), keys, "left_anti").join(table.where(F.col("n") <= limit), keys)
    return rows.join(often, keys).unionByName(rest)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever is in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def words_of(text: Column) -> Column:
    """Words of a whole text, parted by blanks; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def terms_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a whole text; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(terms: Column, n: int) -> Column:
    """64-bit hashes of all runs of `n` terms, in order. `terms` has to be a plain column: it is read once a run."""
    from functools import reduce

    return F.transform(
        F.slice(terms, 1, F.greatest(F.size(terms) - (n - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *reduce(lambda got, k: [*got, F.get(terms, i + k)], range(1, n), [])),
    )


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: columns key_a and key_b. A null text has the key of no other text."""
    return [
        F.coalesce(F.xxhash64(F.lit(17), text), F.lit(0)).alias("key_a"),
        F.xxhash64(text, F.lit(71), F.length(text)).alias("key_b"),
    ]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))
