"""URL filter: host and path rules and a list of canonical URLs, looked up through a blocked Bloom filter.

Rules are plain prefixes: a rule fits its host and all subdomains if the url's path, as written, starts with the
rule's. There are few of them; they are joined by host.

The list is a table of canonical URLs, however many. Canonical is a host without user part, port and dots at its end,
in lower case, and a path with its escapes decoded, without empty and `.` segments and without a slash at its end.
An entry fits its host and all subdomains, and the pages below its path by whole segments: `/a` fits `/a/b`, not
`/ab`. The keys of a url are each suffix of its canonical host with each prefix of its path's segments, as many as the
list has. The blocked Bloom filter, one row of 512 bits a block, is joined to the keys by block; keys whose bits are
all set go on to an exact join by host and path, which removes false positives. Rules come before the list, and among
the fitting entries of a kind the longest wins.

The filter has 16 bits an entry and is a table like any other: it is broadcast while its counted blocks are few and
shuffled by block otherwise. Different urls are judged once, so that a host or url that many pages share is no burden.

Defined cases
- null url, no `://`: host and path are empty and no entry fits, so the verdict is allow.
- a host with an empty label (`a..com`): each suffix after a dot is a key as written; an empty suffix is none.
- escapes that are none (`%zz`): the path stays as written but for its segments.
- the same entry twice, also as other spellings of one canonical URL: one stays, block before allow.
- entries with a null host or path, or without a host: fit nothing.
- very long urls: judged whole. Of a host only as many labels from its end make keys as a rule or an entry has, and of a
  path as many segments, so the keys of a url do not grow with its length.
- repeated rows and ids: each row is judged. Null ids: kept. Extra columns are not read.
- empty tables: no rows; with no entries every verdict is allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, written

#: Bits of a block are held in so many longs.
LONGS = 8
#: Bits that an entry sets in its block.
PROBES = 6
BITS_PER_ENTRY = 16

#: Blocks are broadcast up to so many (64 bytes each), and shuffled beyond.
BROADCAST_BLOCKS = 500_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _places(host: Column, path: Column, blocks: int) -> tuple[Column, Column]:
    """Block of a key, and the bits in it that the key sets, as an array."""
    block = F.pmod(F.xxhash64(F.lit(1), host, path), F.lit(blocks))
    second = F.xxhash64(F.lit(2), host, path)
    return block, F.array(*[F.pmod(F.shiftright(second, 9 * k), F.lit(64 * LONGS)).cast("int") for k in range(PROBES)])


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """block, bits: a row for each block that has an entry."""
    block, bits = _places(F.col("host"), F.col("path"), blocks)
    set_bits = entries.select(block.alias("block"), F.explode(bits).alias("bit"))
    return set_bits.groupBy("block").agg(
        F.array(
            *[
                F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, bit % 64)"))), F.lit(0).cast("long"))
                for i in range(LONGS)
            ]
        ).alias("bits")
    )


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """The canonical host of a lower-cased one, and the segments of the canonical path."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(bare, r"\.+$", ""), F.filter(F.split(decoded, "/"), lambda x: (x != "") & (x != "."))


def _joined_path(segments: Column) -> Column:
    return F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.array_join(segments, "/"))).otherwise("")


def _suffixes(host: Column, most: int) -> Column:
    """The host and the domains above it, as far as they have `most` labels at most: longer ones are in no list."""
    labels = F.split(F.substring_index(host, ".", -most), r"\.") if most else F.array().cast("array<string>")
    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.when(i <= F.size(labels), F.array_join(F.slice(labels, i, most), "."))), lambda x: x.isNotNull() & (x != ""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def by_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url_host, url_path, rule, verdict: the longest rule that fits each url that has one."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block before allow
    known = written(known, "url-rules")
    most = known.agg(F.coalesce(F.max(_labels(F.col("host"))), F.lit(0))).first()[0]
    at = urls.select("url_host", "url_path", F.explode(_suffixes(F.col("url_host"), most)).alias("host"))
    fits = at.join(bounded(known), "host").where(F.startswith("url_path", "path"))
    best = F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), F.length("host") + F.length("path"))
    return fits.groupBy("url_host", "url_path").agg(best.alias("hit")).select("url_host", "url_path", "hit.rule", "hit.verdict")


def by_list(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """url_host, url_path, entry: the longest listed URL that fits each url that has one."""
    host, segments = canonical(F.lower("host"), F.col("path"))
    entries = listed.where("host IS NOT NULL AND path IS NOT NULL").select(host.alias("host"), _joined_path(segments).alias("path"), F.size(segments).alias("depth")).where("host <> ''").distinct()
    entries = written(entries, "listed-urls")
    n, depth, most = entries.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.max(_labels(F.col("host"))), F.lit(0))).first()
    blocks = max(1, -(-n * BITS_PER_ENTRY // (64 * LONGS)))
    filters = written(bloom_blocks(entries, blocks), "bloom-blocks")

    host, segments = canonical(F.col("url_host"), F.col("url_path"))
    split = urls.select("url_host", "url_path", host.alias("canonical"), F.slice(segments, 1, depth).alias("segments") if depth else F.array().cast("array<string>").alias("segments"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda k: _joined_path(F.slice("segments", 1, k)))
    keys = split.select("url_host", "url_path", F.explode(_suffixes(F.col("canonical"), most)).alias("host"), "segments").select("url_host", "url_path", "host", F.explode(prefixes).alias("path"))
    block, bits = _places(F.col("host"), F.col("path"), blocks)
    possible = (
        keys.select("*", block.alias("block"), bits.alias("want"))
        .join(bounded(filters, BROADCAST_BLOCKS), "block")
        .where(F.forall("want", lambda b: _bit(F.col("bits"), b)))
        .select("url_host", "url_path", "host", "path")
    )
    longest = F.max_by(F.concat("host", "path"), F.length("host") + F.length("path"))
    return possible.join(entries, ["host", "path"]).groupBy("url_host", "url_path").agg(longest.alias("entry"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, entry (of the list) and by (rule, list or null) of every row of `pages`.

    `rules`: host, path, verdict. `listed`: host, path of blocked URLs.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = written(parts.select(F.col("host").alias("url_host"), F.col("path").alias("url_path")).where("url_host <> ''").distinct(), "urls")
    both = by_rules(urls, rules).join(by_list(urls, listed), ["url_host", "url_path"], "full")
    found = written(both, "url-hits")
    judged = parts.join(found, (parts["host"] == found["url_host"]) & (parts["path"] == found["url_path"]), "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("verdict", F.when(F.col("entry").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        "entry",
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("entry").isNotNull(), "list").alias("by"),
    )


def _bit(bits: Column, b: Column) -> Column:
    return F.getbit(F.get(bits, F.floor(b / 64).cast("int")), b % 64) == 1
