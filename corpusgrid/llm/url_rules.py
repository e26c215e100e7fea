"""URL filters as a sort-merge range join (native: DataFrame functions only).

A rule ``host/path`` fits its host, all subdomains, and every path that starts with its own. Host
labels are reversed, so a rule's host becomes a key prefix: an interval ``[key, key + FF)`` in byte
order. Two sorted sweeps answer all urls:

1. url paths against the distinct rule paths: the stack of active intervals holds every rule path
   that is a prefix of the url's path (nested, so few);
2. for each such path, ``path FE reversed host`` against the rules' keys: the top of the stack is
   the rule with the longest host for that path.

The longest match (characters of host and path, then of path) over the second sweep's tops wins.

A sweep is a window over points and interval boundaries in key order. A boundary carries the stack
that holds from there on (known from the rules alone, by an equi-join on key prefixes), so a point
takes the last stack at or before it. Windows run for each (range, salt), about ``POINTS`` points each,
so their number follows the input: ranges come from a sample of about ``SAMPLE`` keys (drawn by a hash
from a known count, their first ``PREFIX`` bytes), each range has as many salts as its share of the
sample asks for (so a hot url is split), and a range starts with the stacks of the intervals that reach
into it. The urls with their
numbers, and what the first sweep finds, are written to the shared checkpoint folder: a number stays a
row's own if an executor is lost, and nothing is swept twice.

Defined results: a null url, or one without ``://``, has empty host and path and fits no rule; a
url without a rule gets the default verdict; repeated urls and ids keep their rows; an empty table
gives an empty result; extra columns are ignored. A rule without a host fits every host. Rules must be unique in
(host, path).
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgrid.runtime import cut

#: Keys sampled for ranges and their bytes; ranges at least and at most; groups that the ranges' salts
#: make in all, at least; points of a group and groups of a range where there are more points.
SAMPLE, PREFIX, RANGES, MOST, GROUPS, POINTS, SALTS = 4096, 64, 32, 256, 512, 500_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a DataFrame."""
    made = F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r)]) for r in rules]))
    return spark.range(1).select(made)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bytes(*parts: Column) -> Column:
    return F.concat(*[p.cast("binary") for p in parts])


def _mark(code: str) -> Column:
    return F.unhex(F.lit(code))


def _stacks(intervals: DataFrame) -> DataFrame:
    """Each interval with the stack of all that enclose it, itself last: key, depth, stack."""
    named = intervals.select("key", "value")
    sizes = sorted(r[0] for r in intervals.select(F.length("key")).distinct().collect())  # at most the longest key's bytes
    inside = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length("key")) if sizes else F.array().cast("array<int>")
    cuts = F.transform(inside, lambda n: F.substr(F.col("key"), F.lit(1), n))
    prefixes = named.select("key", F.explode(cuts).alias("prefix"))
    outer = named.select(F.col("key").alias("prefix"), F.struct(F.length("key").alias("n"), F.col("value")).alias("entry"))
    found = prefixes.join(outer, "prefix").groupBy("key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    return found.select("key", F.size("stack").alias("depth"), F.transform("stack", lambda e: e["value"]).alias("stack"))


def layout(points: int, ranges: int = RANGES, groups: int = GROUPS, size: int = POINTS) -> tuple[int, int]:
    """Ranges and groups for this many points: groups of about ``size`` points; ranges grow too, up to
    ``MOST`` of them, so that an interval's boundaries go to fewer groups than there are."""
    groups = max(groups, -(-points // size))
    return max(ranges, min(MOST, groups // SALTS)), groups


def _splits(points: DataFrame, ranges: int, groups: int, size: int) -> tuple[list[bytes], list[int]]:
    """Split keys and each range's salts, from about ``SAMPLE`` rows drawn by a hash."""
    held = points.count()
    ranges, groups = layout(held, ranges, groups, size)
    lot = F.pmod(F.xxhash64("key", "uid"), F.lit(max(1, held)))
    sample = points.filter(lot < SAMPLE).select(F.substring("key", 1, PREFIX)).limit(4 * SAMPLE).collect()
    keys = sorted(bytes(r[0]) for r in sample)
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    edges = [0, *(bisect_left(keys, c) for c in cuts), len(keys)]
    return cuts, [max(1, -(-(b - a) * groups // max(1, len(keys)))) for a, b in pairwise(edges)]


def sweep(points: DataFrame, intervals: DataFrame, ranges: int = RANGES, groups: int = GROUPS, size: int = POINTS) -> DataFrame:
    """``points`` (key binary, uid, ...) with ``stack``: the values of all intervals whose key is a
    prefix of the point's key, outermost first (null or empty if none)."""
    cuts, counts = _splits(points, ranges, groups, size)
    splits = F.array(*[F.unhex(F.lit(c.hex())) for c in cuts]) if cuts else F.array().cast("array<binary>")

    def range_of(key: Column) -> Column:
        return F.size(F.filter(splits, lambda s: s <= key))

    others = [c for c in points.columns if c not in ("key", "stack")]
    kind = dict(points.dtypes)
    salts = F.element_at(F.array(*map(F.lit, counts)), F.col("part") + 1)
    all_salts = F.explode(F.sequence(F.lit(0), salts - 1))
    stacks = _stacks(intervals)
    held = "array<" + dict(intervals.dtypes)["value"] + ">"
    ends = F.concat(F.col("key"), _mark("FF"))
    entered = stacks.select(
        F.explode(F.sequence(range_of(F.col("key")), range_of(ends))).alias("part"),
        F.col("key"), "depth", "stack", range_of(F.col("key")).alias("own"),
    ).select(
        "part", F.when(F.col("part") == F.col("own"), F.col("key")).otherwise(F.element_at(splits, F.greatest("part", F.lit(1)))).alias("key"),
        "depth", "stack",
    )
    left = stacks.select(
        range_of(ends).alias("part"), ends.alias("key"), (F.col("depth") - 1).alias("depth"),
        F.slice("stack", F.lit(1), F.col("depth") - 1).alias("stack"),
    )
    edges = entered.unionByName(left).select(
        "part", all_salts.alias("salt"), "key", F.lit(0).alias("is_point"), "depth", F.col("stack").cast(held).alias("edge"),
        *[F.lit(None).cast(kind[c]).alias(c) for c in others],
    )
    asked = points.withColumn("part", range_of(F.col("key"))).select(
        "part", F.pmod(F.hash("uid"), salts).alias("salt"), "key",
        F.lit(1).alias("is_point"), F.lit(0).alias("depth"), F.lit(None).cast(held).alias("edge"), *others,
    )
    order = W.partitionBy("part", "salt").orderBy("key", "is_point", "depth").rowsBetween(W.unboundedPreceding, 0)
    swept = edges.unionByName(asked).withColumn("stack", F.last("edge", ignorenulls=True).over(order))
    return swept.filter("is_point = 1").select("key", *others, "stack")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url").cast("string"))
    urls = cut(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("uid")))
    paths = rules.select("path").distinct().select(F.col("path").cast("binary").alias("key"), F.col("path").alias("value"))
    first = sweep(urls.withColumn("key", F.col("path").cast("binary")), paths)
    asked = cut(first.select("page_id", "host", "path", "uid", F.explode_outer("stack").alias("at")).withColumn(
        "key", _bytes(F.coalesce("at", F.lit("")), _mark("FE"), host_key(F.col("host")))
    ))
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("n"), F.length("path").alias("path_n"),
        F.concat("host", "path").alias("rule"), F.col("verdict"),
    )
    labels = F.when(F.col("host") == "", "").otherwise(host_key(F.col("host")))
    keyed = rules.select(_bytes(F.col("path"), _mark("FE"), labels).alias("key"), entry.alias("value"))
    second = sweep(asked.drop("at"), keyed)
    top = F.when(F.size("stack") > 0, F.element_at("stack", -1))
    best = second.withColumn("top", top).groupBy("uid").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("top").alias("top")
    )
    return best.select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )
