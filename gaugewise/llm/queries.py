"""The operators over the whole tables, as queries, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewise.llm import decontaminate, filter_audit, language_id, license_scan, line_dedup, merkle, near_dup, packing, sharding, token_count, topk_search, toxicity, url_filter
from gaugewise.llm._common import table

SHARDS = 16
TOKENIZER = "byte_bpe_50k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    digests = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard(digests, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), F.length("text").alias("n_kept_chars"), F.md5("text").alias("kept_md5"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT doc_id, coalesce(source, chr(1)) AS site, line, pos, nullif(trim(regexp_replace(line, '[ \\t\\r\\f]+', ' ', 'g')), '') AS plain FROM lines
), spread AS (
  SELECT plain FROM keyed WHERE plain IS NOT NULL GROUP BY plain HAVING count(DISTINCT site) >= 10
), marked AS (
  SELECT keyed.*, spread.plain IS NOT NULL AS cut FROM keyed LEFT JOIN spread ON keyed.plain = spread.plain
), cleaned AS (
  SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN cut THEN 1 ELSE 0 END) AS n_removed,
         coalesce(string_agg(CASE WHEN NOT cut THEN line END, chr(10) ORDER BY pos), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_removed AS INTEGER) AS n_removed,
       CAST(length(kept) AS INTEGER) AS n_kept_chars, md5(kept) AS kept_md5
FROM cleaned
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    machine = language_id.train(docs, use=~held)
    return language_id.identify(docs.select("doc_id", "text"), machine).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("license_sentences", ",").alias("sentence_ids"), F.size("license_sentences").alias("n_sentences"))


def _op5_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def values(pairs: dict[str, str]) -> str:
        return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in sorted(pairs.items()))

    def shows(way: list[str]) -> str:
        never = "".join(f" AND NOT contains(framed, {quoted(f' {s[1:]} ')})" for s in way if s[0] == "!")
        return f"(regexp_matches(framed, {quoted(license_scan.rule_pattern(way))}){never})"

    ls = license_scan
    rules = " UNION ALL ".join(f"SELECT doc_id, {quoted(name)} AS licence FROM sequences WHERE {' OR '.join(map(shows, ways))}" for name, ways in ls.RULES.items())
    shapes = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(i)}" for p, i in ls.PATTERNS.items())
    comment = ls.COMMENT
    return f"""
WITH known(sentence, id) AS (VALUES {values(ls.SENTENCES)}),
names(name, licence) AS (VALUES {values(ls.LICENCE_NAMES)}),
bare AS (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), {quoted(comment)}, '\\1', 'g') AS t FROM documents),
clean AS (SELECT doc_id, regexp_replace(regexp_replace(t, {quoted(ls.ABBREVIATION)}, '\\1\\2\\3\\4\\5', 'g'), 'SPDX-License-Identifier:[ \\t]*', 'SPDX-License-Identifier ', 'g') AS t FROM bare),
lines AS (SELECT doc_id, t, string_split(regexp_replace(t, '([^.!?:;\\n])\\n[ \\t]*([a-z(])', '\\1 \\2', 'g'), chr(10)) AS parts FROM clean),
views AS (
  SELECT doc_id, 1 AS view, array_to_string(list_transform(parts, lambda x: x || CASE WHEN length(trim(x)) >= {ls.WRAPPED} THEN ' ' ELSE chr(10) END), '') AS t FROM lines
  UNION ALL SELECT doc_id, 2, t FROM clean
), cut AS (SELECT doc_id, view, string_split(regexp_replace(t, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM views),
sentences AS (
  SELECT doc_id, view, pos, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS s
  FROM (SELECT doc_id, view, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM cut)
), told AS (
  SELECT doc_id, view, pos, s, known.id AS known_id,
    trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(regexp_replace(s, {quoted(ls.FILLER)}, '', 'g')), {quoted(ls.VERSION)}, '\\1', 'g'), {quoted(ls.NOTICE)}, 1), {quoted(ls.TAIL)}, ''), {quoted(ls.LATER)}, '')) AS name
  FROM sentences LEFT JOIN known ON s = known.sentence
), mapped AS (
  SELECT doc_id, view, pos,
    CASE WHEN known_id IS NOT NULL THEN known_id
         WHEN contains(s, ' name') AND contains(s, ' software') THEN CASE {shapes} END
         WHEN regexp_matches(s, '^spdx|{ls._VERBS} (?:under|by|to) ') AND NOT regexp_matches(s, {quoted(ls.DENIAL)}) THEN 'notice:' || names.licence END AS id
  FROM told LEFT JOIN names ON told.name = names.name
), whole AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM mapped WHERE view = 1 AND id IS NOT NULL GROUP BY doc_id),
alone AS (SELECT doc_id, list(DISTINCT id) AS ids FROM mapped WHERE view = 2 AND id IS NOT NULL GROUP BY doc_id),
sequences AS (
  SELECT d.doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS framed FROM (
    SELECT d.doc_id, list_concat(coalesce(whole.ids, []), list_sort(list_filter(coalesce(alone.ids, []), lambda x: NOT list_contains(coalesce(whole.ids, []), x)))) AS ids
    FROM documents d LEFT JOIN whole ON d.doc_id = whole.doc_id LEFT JOIN alone ON d.doc_id = alone.doc_id
  ) d
), licences AS ({rules} UNION ALL SELECT doc_id, id[8:] FROM (SELECT doc_id, unnest(ids) AS id FROM sequences) WHERE starts_with(id, 'notice:')),
shown AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses FROM licences GROUP BY doc_id)
SELECT s.doc_id, coalesce(shown.licenses, '') AS licenses, array_to_string(s.ids, ',') AS sentence_ids, CAST(len(s.ids) AS INTEGER) AS n_sentences
FROM sequences s LEFT JOIN shown ON s.doc_id = shown.doc_id
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    machine = toxicity.train(docs, labels, use=~held)
    out = toxicity.score(docs.select("doc_id", "text"), machine)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL
), parts AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x) AS score
  FROM parts q JOIN parts c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digest=True)
    return out.select("doc_id", "start", "length", packing.id_digest().alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_audit.audit_filters(docs, table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH flags AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), split AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), failing AS (
  SELECT part, doc_id,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM split
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM failing LEFT JOIN flags ON failing.doc_id = flags.doc_id GROUP BY part, fails
), letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT part, fails, n, n_good, n_toxic, filter_order, step, filter_order[step] AS name,
    contains(fails, filter_order[step]) AS bad, length(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS gone
  FROM counted, orders, range(1, 6) AS r(step)
), counts AS (
  SELECT part, filter_order, step, name,
    sum(n) FILTER (WHERE NOT bad AND NOT gone) AS kept, sum(n) FILTER (WHERE bad AND NOT gone) AS removed, sum(n) FILTER (WHERE bad AND gone) AS redundant,
    sum(n) FILTER (WHERE fails = name) AS unique_fails, sum(n_good) FILTER (WHERE bad AND NOT gone) AS good_lost, sum(n_toxic) FILTER (WHERE bad AND NOT gone) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, name
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, name), 0) AS BIGINT) AS shapley
FROM counts
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", url_filter.UPPER, url_filter.LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lowered))
    rows = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], carry=tampered)
    folded = merkle.fold(F.coalesce("item", "leaf"), F.col("proof"))
    rows = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op12_sql(levels: int = 8) -> str:
    """Levels written out: 16**8 documents of a source, and as many sources."""

    def tree(name: str) -> str:
        out = []
        for i in range(levels):
            at = f"{name}{i}"
            out.append(f"""{at}s AS (
  SELECT g, i, d, n, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS b,
    CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS a
  FROM {at}
), {name}{i + 1} AS (SELECT g, i // 16 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d, (n + 15) // 16 AS n FROM {at} GROUP BY g, i // 16, n)""")
        return ", ".join(out)

    def path(name: str, place: str, root: str) -> tuple[str, str, str]:
        joins = " ".join(f"JOIN {name}{i}s AS {name}_{i} ON {root} = {name}_{i}.g AND {place} // {16**i} = {name}_{i}.i" for i in range(levels))
        proof = " || ".join(f"coalesce({name}_{i}.b || {name}_{i}.a, '')" for i in range(levels))
        steps = ", ".join(f"{{'b': {name}_{i}.b, 'a': {name}_{i}.a}}" for i in range(levels))
        return joins, proof, steps

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    (low, low_proof, low_steps), (up, up_proof, up_steps) = path("l", "p.i", "p.g"), path("u", "w.i", "0")
    return f"""
WITH RECURSIVE poly(i, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8
), d AS (
  SELECT doc_id, source, {digest("text")} AS leaf, {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS other,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 5 = 0 AS changed
  FROM documents, crc
), p AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), l0 AS (SELECT g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM p
), {tree("l")}, u0 AS (SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM l{levels}
), {tree("u")}, w AS (SELECT i, d FROM u0
), paths AS (
  SELECT p.doc_id, p.leaf, w.d AS subroot, u{levels}.d AS root, sha256({low_proof} || {up_proof}) AS proof_sha256,
    CASE WHEN changed THEN other ELSE leaf END AS node, [{low_steps}, {up_steps}] AS steps
  FROM p {low} JOIN w ON p.g = w.i {up} CROSS JOIN u{levels}
), folded AS (
  SELECT *, list_reduce(list_prepend({{'b': '', 'a': node}}, list_filter(steps, lambda s: s.b IS NOT NULL)), lambda x, s: {{'b': '', 'a': sha256(s.b || x.a || s.a)}}).a AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.rules_from(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(map(str, URL_RULES))}),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  SELECT u.n, arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) AS best
  FROM u JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY u.n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN fits ON u.n = fits.n
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_line_dedup, op3_language_id, op4_near_dup, op5_license_scan, op6_toxicity, op7_token_count, op8_topk_search, op9_packing, op10_decontamination, op11_filter_audit, op12_merkle_manifest, op13_url_filter)
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op5_license_scan": _op5_sql(), "op8_topk_search": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": _op12_sql(), "op13_url_filter": OP13_SQL}
