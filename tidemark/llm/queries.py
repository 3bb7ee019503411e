"""One query per corpus operator, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_format, exact_topk, host_rules, language_id, lexical, mixing, near_dup, packing, secret_scan, sharding, token_files,
    turn_repair, url_filter,
)
from tidemark.llm.common import table
from tidemark.plans.registry import Entry

ENTRIES: dict[str, Entry] = {}


def _query(sql: str | None = None):
    def add(run):
        ENTRIES[run.__name__] = Entry(run, sql)
        return run

    return add


def load() -> dict[str, Entry]:
    return dict(ENTRIES)


def _op1_sql() -> str:
    """A match begins after all pieces between matches up to it, and all matches before it."""
    each = []
    for number, r in enumerate(secret_scan.RULES):
        pattern = r.pattern.replace("'", "''")
        each.append(f"""SELECT doc_id, {number} AS number, '{r.kind}' AS kind, start, start + length(m) AS stop FROM (
    SELECT doc_id, m, g, sum(length(p)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
      SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[:len(ms)]) AS p FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {r.group}) AS gs,
          string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}')))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE length(g) >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (number = {i}) AS n_{k}" for i, k in enumerate(secret_scan.BASE))
    written, base = "kind || ':' || start || ':' || stop", len(secret_scan.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({' UNION ALL '.join(each)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({written}, ',' ORDER BY start, number) FILTER (number < {base}), '')) AS base_sha256,
  coalesce(string_agg({written}, ',' ORDER BY start, number), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


@_query(_op1_sql())
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    kinds = [r.kind for r in secret_scan.RULES]
    base = F.filter("spans", lambda s: s["number"] < len(secret_scan.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["number"] == kinds.index(kind))).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


URL_RULES = (
    url_filter.UrlRule("block", "net", "/"), url_filter.UrlRule("allow", "example.net", "/en/"),
    url_filter.UrlRule("block", "example.com", "/de/"), url_filter.UrlRule("allow", "org", "/fr/"),
)

_OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(url, '') AS u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS asked
  FROM pages
), c AS (
  SELECT *, CASE WHEN contains(u, '://') THEN
    regexp_replace(regexp_replace(regexp_replace(host, '(:80|:443)?$', ''), '\.+$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '/+$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS entry
  FROM p
), again AS (SELECT entry FROM c WHERE entry IS NOT NULL GROUP BY entry HAVING count(DISTINCT page_id) > 1),
r AS (
  SELECT c.*, again.entry IS NOT NULL AS listed, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN again ON c.entry = again.entry
)
SELECT page_id, host, path, rule, listed, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@_query(_OP2_SQL)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds every canonical URL that the crawl has under more than one page id."""
    pages = table(spark, sf_dir, "pages")
    entry = url_filter.canonical(F.col("url")).alias("entry")
    ids = pages.select(entry, "page_id").where("entry IS NOT NULL").groupBy("entry").agg(
        F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    return url_filter.judge(pages, ids.where("low < high"), URL_RULES, ["page_id"])


@_query()
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shards(table(spark, sf_dir, "documents"), 40, ["doc_id"])
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) AS r WHERE rank <= 5
"""


@_query(_OP4_SQL)
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@_query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ["doc_id"])


@_query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@_query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels, model = language_id.prototypes(docs, ~held_out)
    return language_id.predict(docs, [F.col("doc_id"), held_out.alias("held_out")], labels, model)


@_query()
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By weights alone, the same call as the pipeline's stage."""
    found = near_dup.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


@_query()
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixing.mix(sizes).select(
        "doc.doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), g AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM w, unnest(range(1, len(words) - 1)) AS u(i) WHERE len(words) >= 3
), again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) AS x WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) AS y GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, n_symbols > n_words AS symbols,
    2 * n_dup_lines > n_lines AS lines_bad FROM m
), h AS (
  SELECT source, rule, count(*) AS n, sum(CAST(bad AS INT)) AS k FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, unnest([short, repeats, symbols, lines_bad]) AS bad FROM f
  ) AS z GROUP BY source, rule
), p AS (
  SELECT rule, sum(k) / sum(n) AS mean, greatest(sum(CAST(k AS DOUBLE) * k / n) / sum(n) - pow(sum(k) / sum(n), 2), 0) AS apart
  FROM h GROUP BY rule
), v AS (
  SELECT source, max((k + mean * weight) / (n + weight)) > 0.5 AS host_failed FROM (
    SELECT source, k, n, mean, CASE WHEN apart > 1e-12 THEN least(greatest(mean * (1 - mean) / apart - 1, 1), 1000) ELSE 1000 END AS weight
    FROM h JOIN p USING (rule)
  ) AS q GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT host_failed AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


@_query(_OP10_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_OP11_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    length(regexp_replace(replace(role, '\', '\\'), '<s>|</s>|<<SYS>>|<</SYS>>|<\|(?:turn|say|end|im_start|im_end|endoftext)\|>|\[/?INST\]', '\0+', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '<s>|</s>|<<SYS>>|<</SYS>>|<\|(?:turn|say|end|im_start|im_end|endoftext)\|>|\[/?INST\]', '\0+', 'g')) + 22 AS size
  FROM r
), s AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS size_until, i = max(i) OVER (PARTITION BY conv_id) AS final FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(size_until) FILTER (role = 'assistant' OR final), 0) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


@_query(_OP11_SQL)
def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.examples(chat_format.planted(table(spark, sf_dir, "conversations"))))


_OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), c AS (SELECT count(*) AS docs, sum(len(t)) AS length FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) AS x GROUP BY doc_id, n, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term) AS y, c),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
) AS r WHERE rank <= 20
"""


@_query(_OP12_SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@_query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))
