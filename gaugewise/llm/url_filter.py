"""URL filters: host and path rules met by a sorted sweep over reversed-host keys, in DataFrame functions only.

A rule (host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's. Written as ``reversed host / path`` (``net.example//en/``) a rule is a prefix, and what
it fits on one host is the interval from that prefix up to the prefix and byte 0xFF, which UTF-8 never
holds. Two such intervals are nested or apart. A url asks once for each of its host's suffixes that
a rule could have (``net//en/9``, ``net.example//en/9``, ...), with its path cut at the longest rule's,
so that urls which no rule can tell apart ask together.

The sweep sorts rule starts, rule ends and asked keys. A running sum of starts less ends is the height
of the stack of open rules, and the last rule that started at that height is its top: the innermost
rule of the key. Keys are dealt over ranges between sampled bounds; a rule that is open where a range begins is
repeated there. A url takes the longest of its keys' rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewise.llm._common import col, fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Asked keys looked at for each bound between two ranges.
OVERSAMPLE = 16
#: Most ranges: their bounds, a key each, stand in the plan.
MAX_RANGES = 512


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_from(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from (verdict, host, path)."""
    kind = "array<struct<verdict: string, host: string, path: string>>"
    rows = F.array(*[F.struct(*map(F.lit, r)) for r in rules]).cast(kind) if rules else F.lit(None).cast(kind)
    return spark.range(1).select(F.inline(rows))


def _key(labels: Column, path: Column) -> Column:
    """Labels from the last one on, then the path; as bytes, whose order is the sweep's."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path).cast("binary")


def _range_of(key: Column, bounds: list[bytes]) -> Column:
    """How many of the sorted bounds are at most ``key``: a search by halves."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[F.lit(bytearray(b)) for b in bounds])
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at),
    )


def innermost(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The keys (``key`` binary, distinct) that lie inside a rule, with the ``rule`` of the innermost one.

    ``rules``: ``key`` binary, distinct, and ``rule``, of any type. Bounds come from the keys of least hash,
    as many as the shuffle partitions ask for.
    """
    n = min(MAX_RANGES, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = sorted(bytes(r[0]) for r in keys.orderBy(F.xxhash64("key"), "key").limit(OVERSAMPLE * n).collect())
    bounds = sorted(set(some[OVERSAMPLE // 2 :: OVERSAMPLE]))[: n - 1]
    end, nothing = F.concat("key", F.lit(bytearray(b"\xff"))), F.lit(None).cast(rules.schema["rule"].dataType).alias("rule")
    starts = rules.select(F.explode(F.sequence(_range_of(F.col("key"), bounds), _range_of(end, bounds))).alias("range"), "key", F.lit(1).alias("kind"), "rule")
    ends = rules.select(_range_of(end, bounds).alias("range"), end.alias("key"), F.lit(-1).alias("kind"), nothing)
    asked = keys.select(_range_of(F.col("key"), bounds).alias("range"), "key", F.lit(0).alias("kind"), nothing)
    # At one key a rule starts before the url asks: a rule fits its own key.
    order, so_far = [F.col("key"), F.col("kind").desc()], (Window.unboundedPreceding, Window.currentRow)
    events = starts.unionByName(ends).unionByName(asked)
    events = events.withColumn("height", F.sum("kind").over(Window.partitionBy("range").orderBy(*order).rowsBetween(*so_far)))
    top = F.last(F.when(F.col("kind") == 1, F.col("rule")), ignorenulls=True)
    events = events.withColumn("top", top.over(Window.partitionBy("range", "height").orderBy(*order).rowsBetween(*so_far)))
    return events.where("kind = 0 AND height > 0").select("key", F.col("top").alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the longest fitting rule, else null) and ``verdict``
    (that rule's, else ``default``); columns of ``pages`` called so are replaced.

    ``rules`` has ``host`` (A-Z taken as lower case), ``path`` and ``verdict``. Rules with a null host or path are left
    out; of rules with the same host and path one that blocks holds. Longest counts characters of host and
    path, then those of the host. A null url or one without ``://`` has an empty host and path, which only a
    rule with an empty host fits. Every row stays, repeated rows and null ids too; an empty table stays empty, and
    without rules all take ``default``. What the sweep reads, a row for each host end and path start that
    rules can tell apart, is written to the shared folder before this returns.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max_by("verdict", F.struct(F.col("verdict") == "block", "verdict")).alias("verdict"))
    deepest, longest = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    pages = pages.withColumns({"host": host_of(col(url)), "path": path_of(col(url))})
    if deepest is None:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    tail, head, best = fresh(pages, "tail", "head", "best")
    pages = pages.withColumns({tail: F.substring_index("host", ".", -deepest), head: F.substring("path", 1, longest)})
    kinds = written(pages.select(col(tail).alias("tail"), col(head).alias("head")).distinct(), "url-kinds")
    labels = F.split("tail", r"\.")
    asks = kinds.select("tail", "head", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: _key(F.slice(labels, -k, k), F.col("head")))).alias("key"))
    name = F.concat("host", "path")
    prefixes = rules.select(_key(F.split("host", r"\."), F.col("path")).alias("key"), F.struct(F.length(name).alias("size"), F.length("host").alias("host_size"), name.alias("name"), "verdict").alias("rule"))
    found = asks.join(innermost(asks.select("key").distinct(), prefixes), "key").groupBy(F.col("tail").alias(tail), F.col("head").alias(head)).agg(F.max("rule").alias(best))
    out = pages.join(found, [tail, head], "left")
    out = out.withColumns({"rule": col(best)["name"], "verdict": F.coalesce(col(best)["verdict"], F.lit(default))})
    return out.select(*[col(c) for c in dict.fromkeys([*pages.columns, "rule", "verdict"]) if c not in (tail, head)])
