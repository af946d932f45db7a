"""Line dedup: removal of lines that spread over many sites, in DataFrame functions only.

Every line's hash gets a HyperLogLog sketch of the sites it occurs on; partial sketches merge in
the aggregation, so a line that a third of all rows holds costs one small row per task. Lines whose
estimate lies near the threshold are counted exactly. Lines on ``min_sites`` sites or more are
boilerplate and leave every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewise.llm._common import col, fresh, written

#: log2 of the registers of a sketch: relative standard error 1.04 / 2**6 = 1.6 %.
LG_K = 12
MIN_SITES = 10
#: Up to this many boilerplate lines, their hashes (8 bytes each) go to all tasks, which cut lines as they read
#: a text; beyond, the lines are joined with them by a shuffle.
FEW_KEYS = 4096
#: Tasks that the occurrences of one boilerplate line are dealt over.
SALTS = 32


def line_key(line: Column) -> Column:
    """Hash of a line without outer and repeated blanks; null for a blank line, which is never boilerplate."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\f")
    plain = F.trim(F.when(odd, F.regexp_replace(line, r"[ \t\r\f]+", " ")).otherwise(line))
    return F.when(plain != "", F.xxhash64(plain))


def site_spread(lines: DataFrame, key: str, site: str, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """The keys that occur on ``min_sites`` distinct sites or more, one row each; a null site is a site."""
    (estimate,) = fresh(lines, "estimate")
    sited = lines.where(col(key).isNotNull()).select(col(key), F.coalesce(col(site).cast("string"), F.lit("\0")).alias(site))
    spread = sited.groupBy(col(key)).agg(F.hll_sketch_estimate(F.hll_sketch_agg(col(site), lg_k)).alias(estimate))
    margin = max(1.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = spread.where(col(estimate) >= min_sites - margin)
    sure = spread.where(col(estimate) > min_sites + margin).select(col(key))
    near = spread.where(col(estimate) <= min_sites + margin).select(col(key))
    exact = (
        sited.distinct()
        .join(near, key, "left_semi")
        .groupBy(col(key))
        .agg(F.count(F.lit(1)).alias(estimate))
        .where(col(estimate) >= min_sites)
        .select(col(key))
    )
    return sure.unionByName(exact)


def _cut_in_rows(docs: DataFrame, text: str, keys: list[int]) -> DataFrame:
    """``docs`` without the lines of these hashes, and the new columns of ``dedup_lines``."""
    lines = F.split(col(text), "\n")
    marked = F.array(F.struct(lines.alias("lines"), F.transform(lines, lambda x: F.coalesce(line_key(x).isin(keys), F.lit(False))).alias("cut")))

    def parts(row: Column) -> Column:
        def picked(which: bool) -> Column:
            return F.filter(row["lines"], lambda _, i: F.get(row["cut"], i) == which)

        some = F.exists(row["cut"], lambda x: x)
        return F.struct(F.when(some, F.array_join(picked(False), "\n")).alias("text"), F.when(some, picked(True)).alias("removed"), F.size(row["lines"]).alias("n"))

    (found,) = fresh(docs, "found")
    with_parts = docs.withColumn(found, F.when(col(text).isNotNull(), F.transform(marked, parts)[0]))
    none = F.array().cast("array<string>")
    new = {text: F.coalesce(col(found)["text"], col(text)), "n_lines": F.coalesce(col(found)["n"], F.lit(0)), "removed_lines": F.coalesce(col(found)["removed"], none)}
    return with_parts.select(*[(new[c] if c == text else col(c)).alias(c) for c in docs.columns], *[new[c].alias(c) for c in ("n_lines", "removed_lines")])


def dedup_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id", by_text: bool = False
) -> DataFrame:
    """``docs`` with boilerplate lines cut out of ``text``, and what was cut.

    New columns: ``n_lines`` int, ``removed_lines`` array of the cut lines in their order. All other
    columns and all rows stay. A null text stays null with 0 lines; an empty text is one blank line;
    rows that repeat count as one site each time; input columns called n_lines or removed_lines are
    replaced. ``by_text``: all copies of one text stand on one site, the least of theirs, so that a
    document does not lose its lines for being copied to many sites.
    """
    docs = docs.drop("n_lines", "removed_lines")
    mark, pos, line, key, cut = fresh(docs, "text_mark", "line_pos", "line", "line_key", "cut_lines")
    marked = docs.withColumn(mark, F.xxhash64(col(text)))
    lines = (
        marked.where(col(text).isNotNull())
        .select(col(doc_id), col(mark), col(site), F.posexplode(F.split(col(text), "\n")).alias(pos, line))
        .select(col(doc_id), col(mark), col(site), col(pos), line_key(col(line)).alias(key))
        .where(col(key).isNotNull())
    )
    lines = written(lines, "lines")  # hashes only; three readers follow
    # a line that many documents hold is dealt over SALTS tasks; only boilerplate keys are repeated for that
    (salt,) = fresh(lines, "salt")
    sited = lines.groupBy(col(key), col(mark)).agg(F.min(F.coalesce(col(site).cast("string"), F.lit("\0"))).alias(site)) if by_text else lines
    spread = written(site_spread(sited, key, site, min_sites), "boilerplate")
    few = [r[0] for r in spread.limit(FEW_KEYS + 1).collect()]
    if len(few) <= FEW_KEYS:
        return _cut_in_rows(docs, text, few)
    spread = spread.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    cuts = (
        lines.select(col(doc_id).alias("id"), col(mark).alias("mark"), col(pos), col(key), F.pmod(F.xxhash64(col(doc_id), col(pos)), F.lit(SALTS)).cast("int").alias(salt))
        .join(spread, [key, salt], "left_semi")
        .groupBy("id", "mark")
        .agg(F.collect_set(col(pos)).alias(cut))
    )
    left = marked.alias("docs").join(
        cuts.alias("cuts"), F.col(f"docs.`{doc_id}`").eqNullSafe(F.col("cuts.id")) & (F.col(f"docs.`{mark}`") == F.col("cuts.mark")), "left"
    )
    # by the table's name: a bare name inside a lambda would mean the new text
    array = F.split(F.col(f"docs.`{text}`"), "\n")
    every = F.sequence(F.lit(0), F.size(array) - 1)
    kept = F.array_except(every, F.col(f"cuts.`{cut}`"))
    has = F.col(f"cuts.`{cut}`").isNotNull()

    def pick(places: Column) -> Column:
        """The lines at these places; the text is cut once, not for each of them."""
        return F.transform(F.array(array), lambda lines: F.transform(places, lambda i: F.get(lines, i)))[0]

    new = {
        text: F.when(has, F.array_join(pick(kept), "\n")).otherwise(col(text)),
        "n_lines": F.when(col(text).isNull(), 0).otherwise(F.size(array)),
        "removed_lines": F.when(has, pick(F.sort_array(F.col(f"cuts.`{cut}`")))).otherwise(F.array().cast("array<string>")),
    }
    return left.select(*[(new[c] if c == text else col(c)).alias(c) for c in docs.columns], *[new[c].alias(c) for c in ("n_lines", "removed_lines")])
