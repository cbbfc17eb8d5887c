"""URL rules by a cascade of Bloom filters, in DataFrame operations alone.

Keys are a host's last labels followed by a prefix of the path, in the numbers of labels and lengths of path that rules have; so a url has as many keys as rules have
such shapes at most, however many labels its host has. The first level holds the listed keys;
a scan of the corpus finds every other key that it takes for listed, and the second level holds those; then the listed keys that the second level takes
for them, and so on with alternating sides until a level errs on nothing. So for each key of the corpus the level that first says no tells on which side
it is, without error and without a join. The first level's bits are set so that its errors are about as many as the listed keys: all levels together are
a few dozen bits a listed key however large the corpus.

A level's bits travel with the plan as one array of numbers. Lists of over ``MOST`` keys are cut by a hash of the key into parts of about that size, each with a cascade
of its own over its share of the corpus's keys; pages go through the parts one after the other, so that no plan carries more than one part's levels.

A url that is null, empty or has no ``://`` has an empty host and path, and no rule. Rows are independent; repeated and null ids keep a row each. A url that no
rule fits gets ``default``; of a key that is listed under several verdicts the first in alphabetical order holds. An empty list of rules makes no level, an empty table
gives no rows. Urls of any length are read whole. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import array
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm.common import drop_written, mark, written

#: Listed keys a part; its levels have about 40 bits a key, so an array of at most 20 MB.
MOST = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), UPPER, LOWER), part(2)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a url that a rule could have: for each shape (labels of the domain, length of the path) the host's last labels and the path's beginning, if there are as many."""
    has = [F.when((labels(host) >= d) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -d), F.substring(path, 1, n))) for d, n in shapes]
    return F.filter(F.array(*has), lambda k: k.isNotNull())


def numbers(spark: SparkSession, words: list[int]) -> Column:
    """An array of 64-bit numbers as one literal, handed over in bytes."""
    context = spark.sparkContext
    out = context._gateway.new_array(context._jvm.long, len(words))
    data = context._jvm.java.nio.ByteBuffer.wrap(bytearray(array.array("q", words).tobytes())).order(context._jvm.java.nio.ByteOrder.nativeOrder())
    data.asLongBuffer().get(out)
    return type(F.lit(0))(context._jvm.org.apache.spark.sql.functions.lit(out))


@dataclass
class Level:
    words: Column
    bits: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for p in _positions(key, self.bits, self.hashes, self.seed):
            out = out & (F.getbit(F.get(self.words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)
        return out


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    a, b = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    return [F.pmod(F.pmod(a, F.lit(bits)) + F.lit(k) * F.pmod(b, F.lit(bits)), F.lit(bits)) for k in range(hashes)]


def level(own: DataFrame, n: int, error: float, seed: int) -> Level:
    """A filter of the n keys of ``own`` that errs on a share ``error`` of others."""
    hashes = max(1, round(-math.log2(error)))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    places = own.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    rows = places.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("x")).collect()  # at most bits / 64 rows
    words = [0] * math.ceil(bits / 64)
    for r in rows:
        words[r.w] = r.x
    return Level(numbers(own.sparkSession, words), bits, hashes, seed)


class Cascade:
    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def lists(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k, one in reversed([*enumerate(self.levels)]):
            out = F.when(~one.holds(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: key (string); the universe has every key that will be asked, listed or not, once each."""
    listed = written(listed.where("key is not null").distinct(), "listed")
    if not (n := listed.count()):
        return Cascade([])
    levels = [level(listed, n, min(0.5, n / (math.sqrt(2) * max(universe.count(), 1))), 0)]
    own, others = listed, universe.where(levels[0].holds(F.col("key"))).join(listed, "key", "left_anti")
    while True:
        others = written(others, "errors")
        if not (n := others.count()):
            return Cascade(levels)
        own, others = others, own
        levels.append(level(own, n, 0.5, len(levels)))
        others = others.where(levels[-1].holds(F.col("key")))


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. rules: (verdict, host and path), or a table of verdict and rule; the longest that fits a url decides."""
    spark, since = pages.sparkSession, mark()
    if isinstance(rules, list):
        empty = spark.range(0).select(F.lit("").alias("verdict"), F.lit("").alias("rule"))
        rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]))) if rules else empty
    rules = written(rules.select("verdict", F.col("rule").alias("key"), (F.length("rule") - F.length(F.split_part("rule", F.lit("/"), F.lit(1)))).alias("n")).where("key IS NOT NULL"), "rules")
    verdicts = {r.verdict: r.parts for r in rules.groupBy("verdict").agg(F.ceil(F.countDistinct("key") / F.lit(MOST)).alias("parts")).collect()}  # a row a verdict
    shapes = sorted((r.d, r.n) for r in rules.select(labels(F.split_part("key", F.lit("/"), F.lit(1))).alias("d"), "n").distinct().collect())  # as many as rules have
    host, path = host_and_path(F.col("url"))
    urls = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    asked = keys(F.col("host"), F.col("path"), shapes) if shapes else F.array().cast("array<string>")
    universe = written(urls.select("host", "path").distinct().select(F.explode(asked).alias("key")).distinct(), "keys") if shapes else None
    parts = max(verdicts.values(), default=0)
    part = lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))
    best = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    urls = urls.withColumn("best", best)
    for p in range(parts):
        inside = F.lit(True) if parts == 1 else part(F.col("key")) == p
        cascades = {v: cascade(rules.where((F.col("verdict") == v) & inside).select("key"), universe.where(inside)) for v in sorted(verdicts)}
        verdict = lambda key, cascades=cascades: F.coalesce(*[F.when(c.lists(key), F.lit(v)) for v, c in cascades.items()])
        here = lambda k: part(k) == p  # noqa: B023, E731  used before p goes on
        own = asked if parts == 1 else F.filter(asked, here)
        fits = F.filter(F.transform(own, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), verdict(k).alias("verdict"))), lambda x: x["verdict"].isNotNull())
        urls = urls.withColumn("best", F.array_max(fits) if parts == 1 else F.greatest("best", F.array_max(fits)))
        if p + 1 < parts:
            urls = written(urls, "judged")
    if parts == 1:
        drop_written(spark, since)
    return urls.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
