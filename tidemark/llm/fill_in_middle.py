"""Fill-in-the-middle transformation of texts, by an Arrow-batched pandas UDF.

A text is cut into units, runs of A-Z and a-z or single other code points, whose end offsets a compact array holds. Two
numbers drawn from the SHA-256 of the document's id choose where prefix and middle end, in units; two lookups in the
array give the offsets at which the text is sliced. Two further numbers choose the form: the text as it is (plain),
prefix - suffix - middle (psm) or suffix - prefix - middle (spm), each part behind its mark. Everything follows from
id and text, so a task that runs again gives the same rows.

Defined cases
- null and empty texts: no units, plain, the empty text. Texts with a mark in them: plain, since they could not be told apart.
- null doc_id: drawn from the salt alone. Negative ids: with their sign.
- long texts: whole; the array takes four bytes a unit. Ties (both cuts at one unit): an empty middle.
- repeated rows: each is transformed, to the same output. Empty table: no rows.
- extra columns: `transform` keeps them, whatever their names; the new ones are in a struct, under a name of the caller's, in the
  place of a column that has it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
OUTPUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Form:
    """Of a hundred texts without marks `moved` are transformed, and of a hundred of these `spm` put the suffix first."""

    moved: int = 90
    spm: int = 20
    salt: str = "1:"


def ends_of(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def draws(doc_id: str, salt: str) -> list[int]:
    """Four numbers of 32 bits that stand for a document."""
    seed = digest(salt + doc_id)
    return [int(seed[k : k + 8], 16) for k in range(0, 32, 8)]


def moved(doc_id: str, text: str, how: Form) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of a text."""
    ends = ends_of(text)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, how.salt)
    if not text or h3 % 100 >= how.moved or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    if h4 % 100 < how.spm:
        return n, SPM, p, m - p, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, p, m - p, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that `moved` made `output` of. No part holds a mark, so each mark is where it is first found."""
    if form == PLAIN:
        return output
    mark = SUFFIX if form == PSM else PREFIX
    one, _, rest = output[len(mark) :].partition(mark)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == PSM else (two, one)
    return prefix + middle + suffix


def _transformed(how: Form) -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
    def of(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            n, form, p, m, output = moved(doc_id, text, how)
            rows.append((n, form, p, m, output, digest(output), digest(restored(output, form))))
        out = pd.DataFrame(rows, columns=[f.split(" ")[0] for f in OUTPUT.split(", ")])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return of


def transform(docs: DataFrame, how: Form = Form(), into: str = "fim") -> DataFrame:
    """`docs` with a struct `into`: n, form, prefix_chars, middle_chars, output, and the digests of the output and of the text rebuilt from it."""
    made = F.pandas_udf(_transformed(how), OUTPUT)
    kept = [F.col(quoted(c)) for c in docs.columns if c != into]
    return docs.select(*kept, made(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias(into))


def judge(docs: DataFrame, how: Form = Form()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row of `docs`."""
    fields = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return transform(docs.select("doc_id", "text"), how).select("doc_id", *[F.col("fim").getField(c).alias(c) for c in fields])
