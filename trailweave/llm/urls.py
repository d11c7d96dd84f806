"""URL filters by a Bloom filter cascade; DataFrame functions only.

Method: a url's *keys* are its host and every parent domain, each with every prefix of
the path that is as long as some rule's path.  Level 1 of the cascade is a Bloom filter
of the listed keys.  Level 2 encodes those keys of the corpus's complete key universe
that pass level 1 without being listed, level 3 the listed keys that pass level 2, and
so on until a level lets nothing false through.  A key is listed exactly if the first
level that it fails is an even one, so within the universe membership is exact and the
pages are filtered without a join: the levels are bit arrays that reach the scan as
scalar subqueries.  Block and allow rules have a cascade each.

Sizes: level 1 has as many hashes as the universe needs to let about one false key
through for each listed one (``hashes_for``: they grow with the logarithm of the
universe), so level 2 is about as large as the list, and each later level a fraction of
one before it.  The count of a level's keys is checked before its bits are gathered: if
more pass than ``SLACK`` times the list (and ``LEAST``), level 1 is built anew with more
hashes.  A list of more than ``PER_CASCADE`` rules gets several cascades, so a bit array
stays at some megabytes however long the list (which the caller holds in memory) is.

Passes: the pages are read once to count keys, once for the universe's keys that pass
any level 1 (few; written as a table, from which all further levels are built), and
once for the verdicts.

Verdict: the longest fitting rule (host and path together; of equal ones the longer
host) wins, and of equal keys ``block``; a page that fits no rule is not listed and gets
``default``.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no
rule; an empty host has no keys; ports and user names are part of the host as they
stand; rows that repeat are judged alike; an empty table or an empty rule list is fine;
rules given twice count once; other columns pass through, and columns named like the
results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import others, pick, table

BITS, HASHES = 16, 4  # of the levels after the first: bits for each key, places of a key
PER_CASCADE = 1_000_000
SLACK, LEAST = 4, 1024
_MAX_LEVELS = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_array(host: Column, path: Column, lengths: list[int]) -> Column:
    """``host + path prefix`` for the host and its parent domains, and each length that the path has."""
    labels = F.split(host, r"\.", -1)
    hosts = F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def hashes_for(listed: int, universe: int) -> int:
    """Hashes of level 1, at half of its bits set: about ``listed`` of ``universe`` keys pass by chance."""
    return max(HASHES, math.ceil(math.log2(max(universe, 1) / max(listed, 1))))


class Cascade:
    """Levels of bit arrays; ``holds(key)`` is the membership test as a column."""

    def __init__(self) -> None:
        self.levels: list[tuple[DataFrame, int, int]] = []
        self.left: list[str] = []

    @staticmethod
    def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits)) for i in range(hashes)]

    def add(self, keys: DataFrame, count: int, bits_a_key: int | None = None, hashes: int | None = None) -> None:
        """A level that encodes the column ``key`` of ``keys``, ``count`` of them; its words are made in parallel and meet in one short row."""
        hashes = hashes or HASHES
        words = max(1, -(-count * (bits_a_key or BITS) // 64))
        level = len(self.levels)
        spots = keys.select(F.explode(F.array(*self._places(F.col("key"), level, words * 64, hashes))).alias("p"))
        spots = spots.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
        every = keys.sparkSession.range(words).withColumnRenamed("id", "w").join(spots, "w", "left")
        array = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("a"))
        self.levels.append((table(array.select(F.transform("a", lambda s: s["bits"]).alias("a")), "level"), words * 64, hashes))

    def attach(self, frame: DataFrame, prefix: str) -> DataFrame:
        """``frame`` with each level's bits as a column (scalar subqueries), for ``holds`` inside higher-order functions."""
        return frame.withColumns({f"{prefix}{n}": level.scalar() for n, (level, _, _) in enumerate(self.levels)})

    def passes(self, key: Column, level: int, prefix: str | None = None) -> Column:
        frame, bits, hashes = self.levels[level]
        array = frame.scalar() if prefix is None else F.col(f"{prefix}{level}")
        test = F.lit(True)
        for p in self._places(key, level, bits, hashes):
            test = test & (F.getbit(F.get(array, (p / 64).cast("int")), (p % 64).cast("int")) == 1)
        return test

    def holds(self, key: Column, prefix: str | None = None) -> Column:
        test = F.lit(len(self.levels) % 2 == 1)  # after the last level
        if self.left:
            test = F.when(key.isin(self.left), ~test).otherwise(test)
        for level in reversed(range(len(self.levels))):
            test = F.when(self.passes(key, level, prefix), test).otherwise(F.lit(level % 2 == 1))
        return test


def build(lists: list[list[str]], universe: DataFrame) -> list[Cascade]:
    """A cascade for each list of keys, exact on every key of ``universe`` (a column ``key``, repeats allowed); one pass over the universe serves all."""
    spark = universe.sparkSession
    size = universe.count()
    lists = [list(dict.fromkeys(x)) for x in lists]
    listed = [table(spark.createDataFrame([(k,) for k in x], "key string"), "listed") for x in lists]
    hashes = [hashes_for(len(x), size) for x in lists]
    while True:
        cascades = [Cascade() for _ in lists]
        for cascade, keys, x, h in zip(cascades, listed, lists, hashes, strict=True):
            cascade.add(keys, len(x), math.ceil(h / math.log(2)), h)
        passing = [c.passes(F.col("key"), 0) for c in cascades]
        some = universe.where(F.array_contains(F.array(*passing), True)).distinct()
        some = table(some.withColumn("by", F.array(*passing)), "passing")
        counts = some.agg(*[F.count_if(F.get("by", F.lit(n))).alias(f"n{n}") for n in range(len(lists))]).first()
        over = [n for n, x in enumerate(lists) if counts[n] > len(x) + max(LEAST, SLACK * len(x))]
        if not over:
            break
        for n in over:
            hashes[n] += 4
    for n, (cascade, keys) in enumerate(zip(cascades, listed, strict=True)):
        _finish(cascade, keys, some.where(F.get("by", F.lit(n))).select("key"))
    return cascades


def _finish(cascade: Cascade, listed: DataFrame, passing: DataFrame) -> None:
    """The levels after the first, from the keys of the universe that pass it."""
    inside, outside = listed, table(passing.join(listed, "key", "left_anti"), "outside")
    rest, count = outside, outside.count()
    while count:
        if len(cascade.levels) == _MAX_LEVELS:  # no more than a few keys by now
            cascade.left = [r.key for r in rest.collect()]
            return
        cascade.add(rest, count)
        level = len(cascade.levels) - 1
        rest = table((inside if level % 2 else outside).where(cascade.passes(F.col("key"), level)), "rest")
        inside, outside = (rest, outside) if level % 2 else (inside, rest)
        count = rest.count()


def _hits(cascade: Cascade, prefix: str, verdict: str) -> Column:
    """The listed keys of a page, as (size, size of the host, verdict, rule)."""
    hits = F.filter("keys", lambda k: cascade.holds(k, prefix))
    return F.transform(hits, lambda k: F.struct(F.length(k).alias("size"), F.length(F.substring_index(k, "/", 1)).alias("host_size"), F.lit(verdict).alias("verdict"), k.alias("rule")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that decides, else null) and verdict.

    ``rules``: (verdict, host, path) with verdict ``allow`` or ``block``; a rule fits its
    host and all subdomains if the url's path starts with the rule's path.
    """
    own = others(pages, "host", "path", "rule", "verdict")
    plain = [f"own{i}" for i in range(len(own))]
    lengths = sorted({len(p) for _, _, p in rules})
    named = pages.select(*[c.alias(p) for c, p in zip(pick(own), plain, strict=True)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = named.withColumn("keys", key_array(F.col("host"), F.col("path"), lengths))
    lists = []
    for verdict in ("allow", "block"):
        keys = [h + p for v, h, p in rules if v == verdict]
        lists += [(verdict, keys[at : at + PER_CASCADE]) for at in range(0, len(keys), PER_CASCADE)]
    if not lists:
        return named.select(*plain, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).toDF(*own, "host", "path", "rule", "verdict")
    found = []
    for n, ((verdict, _), cascade) in enumerate(zip(lists, build([keys for _, keys in lists], keyed.select(F.explode("keys").alias("key"))), strict=True)):
        keyed = cascade.attach(keyed, f"level{n}_")
        found.append(_hits(cascade, f"level{n}_", verdict))
    best = keyed.withColumn("best", F.array_max(F.concat(*found)))
    return best.select(*plain, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).toDF(*own, "host", "path", "rule", "verdict")
