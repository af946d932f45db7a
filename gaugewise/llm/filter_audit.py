"""Filter interaction audit: what each filter removes in every order of the filters.

A document is reduced to the set of filters that it fails, a bit mask. Documents of a part with the same
mask are one cell with its counts, so what follows does not depend on the number of documents. Cells
are unpivoted against the steps of all orders; a running bitwise or over the steps before tells who was
removed earlier, conditional sums give the counts of a step, and a window over all steps of a filter its total.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewise.llm._common import col

#: Filters audited at most: seven have 5040 orders of seven steps.
MOST_FILTERS = 7
#: What parts words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]+"


def text_tests(text: Column, min_words: int = 200) -> dict[str, Column]:
    """Failure conditions of a text that is not null. A: few words; B: few of them distinct; C: many capitals; D: holds a sign of markup."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, tests: Mapping[str, Column], repeats: str | None = None, text: str = "text", part: str = "source", key: str = "doc_id") -> DataFrame:
    """Counts of documents by ``part`` and ``mask`` (bit i: the i-th test fails): ``n``, ``n_good`` (label quality 1), ``n_toxic``.

    ``repeats`` names a last filter, which fails a document whose text stands under a smaller key anywhere
    in the table. Rows of the least key, rows alike too, and rows of a null key do not fail it. Null texts are empty, a null part is
    the empty string. A document with several labels has what any of them gives; labels of null keys count for none.
    """
    body = F.coalesce(col(text), F.lit(""))
    bits = [F.when(F.coalesce(test, F.lit(False)), 1 << i).otherwise(0) for i, test in enumerate(tests.values())]
    mask = F.lit(0)
    for bit in bits:
        mask = mask.bitwiseOR(bit)
    rows = docs.select(F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), col(key).alias("key"), mask.alias("mask"), (F.unhex(F.sha2(body.cast("binary"), 256)) if repeats else F.lit(None)).alias("digest"))
    flags = labels.where(col(key).isNotNull()).groupBy(col(key).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(flags, "key", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic")]
    kind = ["part", "mask", "good", "toxic"]
    if repeats is None:
        return rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("n")).groupBy("part", "mask").agg(*sums)
    # Copies of one text shrink to a row for each kind before they meet, however many there are.
    by_key = rows.groupBy("digest", *kind, "key").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("key").isNotNull()
    copies = by_key.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"), F.min(F.when(known, F.struct("key", "n"))).alias("least"))
    first = F.col("least.key") == F.min("least.key").over(Window.partitionBy("digest"))
    copies = copies.withColumn("n_first", F.col("n_null") + F.when(first, F.col("least.n")).otherwise(0))
    fate = F.array(F.struct(F.col("mask"), F.col("n_first").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(bits))).alias("mask"), (F.col("n") - F.col("n_first")).alias("n")))
    return copies.select("part", "good", "toxic", F.inline(fate)).where("n > 0").groupBy("part", "mask").agg(*sums)


def interactions(counted: DataFrame, filters: list[str]) -> DataFrame:
    """``cells`` against every order of the filters: a row per part, ``filter_order`` and ``step``.

    Of a part's documents: ``kept`` after the step, ``removed`` here, ``redundant`` (fails this filter, removed
    before), ``unique_fails`` (fails this filter only), ``good_lost`` and ``toxic_lost`` (labelled so, removed here), and
    ``shapley``, the filter's ``removed`` summed over all orders. A part has all its rows, zeros included; no cells give no rows.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    orders = F.array(*[F.struct(F.lit("".join(filters[i] for i in p)).alias("filter_order"), F.array(*[F.lit(1 << i) for i in p]).alias("bits")) for p in permutations(range(len(filters)))])
    steps = counted.select("*", F.inline(orders)).select("part", "mask", "n", "n_good", "n_toxic", "filter_order", F.posexplode("bits").alias("at", "bit"))
    failing = F.col("mask").bitwiseAND(F.col("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumns({"failing": failing, "earlier": F.coalesce(F.bit_or(failing).over(before), F.lit(0))})
    here = (F.col("failing") != 0) & (F.col("earlier") == 0)

    def total(which: Column, count: str = "n") -> Column:
        return F.sum(F.when(which, F.col(count)).otherwise(0)).cast("long")

    out = steps.groupBy("part", "filter_order", "at", "bit").agg(
        total((F.col("failing") == 0) & (F.col("earlier") == 0)).alias("kept"), total(here).alias("removed"), total((F.col("failing") != 0) & (F.col("earlier") != 0)).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(here, "n_good").alias("good_lost"), total(here, "n_toxic").alias("toxic_lost"),
    )
    return out.select("part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "bit")).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame, min_words: int = 200, text: str = "text", part: str = "source", key: str = "doc_id") -> DataFrame:
    """The text tests A to D and E (a repeated text) over whole texts, in all 120 orders.

    Defined for any table as ``cells`` and ``interactions`` say; columns beyond text, part and key are not read.
    """
    tests = text_tests(F.coalesce(col(text), F.lit("")), min_words)
    return interactions(cells(docs, labels, tests, "E", text, part, key), [*tests, "E"])
