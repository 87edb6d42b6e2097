"""The text operators as named queries on the given tables, with the SQL that checks them where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import (
    decontaminate, language, line_rules, packing, periodic, phrases, pii, relative, simhash, token_counts, toxicity,
    url_filter, warc,
)
from quadrat.llm.common import split_words
from quadrat.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_of(modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = part_of(4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    read = warc.read_archives(spark, folder).filter(F.col("problem").isNull())
    return read.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), "first")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base_spans", lambda x, k=k: x["kind"] == k)).cast("long").alias(f"n_{name}")
              for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_text("base_spans"), 256).alias("base_sha256"),
                        pii.span_text("spans").alias("spans"))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = part_of(5) == 0
    model = language.fit(docs.filter(~held))
    return language.detect(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def _repeated_tail(docs: DataFrame) -> DataFrame:
    """Documents of the contract: a tenth of the texts repeat a stretch of their words from one place on."""
    g, n = F.floor(F.col("h") / 10), F.size("words")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    tenth = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    rows = rows.withColumn("words", F.when(tenth, split_words(F.col("text"))))
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    word = lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    tail = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return rows.select("doc_id", F.when(F.coalesce(n > 0, F.lit(False)), tail).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_repeated_tail(table(spark, sf_dir, "documents")))
    top = F.sort_array(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("top", F.get(top, F.lit(0))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relative.drop_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLES["op2_warc"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h,
             min(page_id) OVER (PARTITION BY sha1(payload)) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
    substr('{_BASE32}', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::INT >> (15 - 5 * j)::INT) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d"""


def _url_sql() -> str:
    """The rules by length, then a boundary search for each term."""
    has = lambda t: f"regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
    strict = " OR ".join(has(t) for t in url_filter.STRICT)
    soft = " + ".join(f"{has(t)}::INT" for t in url_filter.SOFT)
    weight = " + ".join(f"{w} * {has(t)}::INT" for t, w in url_filter.SOFT.items())
    ranked = sorted(url_filter.RULES, key=lambda r: -len(r[0]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ranked)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in ranked)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE {rule} END AS rule FROM h)
SELECT page_id, host, path, rule, CASE {verdict} WHEN {strict} OR (({soft}) >= {url_filter.LEAST_SOFT}
  AND ({weight}) >= {url_filter.LEAST_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict FROM j"""


ORACLES["op5_url_filter"] = _url_sql()


def _lines_sql(rules: line_rules.LineRules = line_rules.LineRules()) -> str:
    quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
    ends = quoted(line_rules.END_MARKS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
win AS (SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT row, count(DISTINCT k) AS n FROM (SELECT row, i + unnest([0, 1, 2]) AS k FROM
        (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM win) WHERE c > 1) GROUP BY row),
l AS (SELECT row, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw
      FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)),
f AS (SELECT row, line, len(lw) AS n, len(list_filter(lw, lambda x: x IN ({quoted(line_rules.MENU_MARKS)}))) AS marks,
             length(line) - length(translate(line, '{line_rules.SYMBOLS}', '')) AS symbols, right(lw[-1], 1) AS last FROM l),
j AS (SELECT *, CASE WHEN n = 0 THEN false WHEN marks * 100 > n * {rules.max_menu_percent} THEN true
        WHEN symbols * 100 > length(line) * {rules.max_symbol_percent} THEN true
        WHEN n <= {rules.boilerplate_words} AND regexp_matches(lower(line), '{"|".join(line_rules.BOILERPLATE)}') THEN true
        WHEN n <= {rules.fragment_words} AND last NOT IN ({ends}) THEN true ELSE false END AS bad FROM f),
t AS (SELECT row, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(n) FILTER (NOT bad), 0) AS kept FROM j GROUP BY row),
b AS (SELECT w.*, len(words) AS n_words, coalesce(rep.n, 0) AS n_repeat_words, t.dup, t.kept AS kept_words
      FROM w LEFT JOIN rep USING (row) LEFT JOIN t USING (row))
SELECT doc_id, n_words::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{line_rules.SYMBOLS}', '')))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AS base_failed,
  NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words
       OR (n_words - kept_words) * 100 > n_words * {rules.max_lost_percent}) AS kept
FROM b"""


ORACLES["op7_line_rules"] = _lines_sql()
ORACLES["op10_decontaminate"] = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(words[i:i + 12], ' ') AS g, least(len(words), 13) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT row, i, n, array_to_string(words[i:i + n - 1], ' ') AS g
  FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT row, i, dw.n, item_id FROM dw JOIN iw USING (g)),
pos AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS k FROM hit) GROUP BY row),
items AS (SELECT row, count(DISTINCT item_id) AS n_items,
  array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM d LEFT JOIN pos USING (row) LEFT JOIN items USING (row)"""

ORACLES["op13_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 49], ' ')) AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS k FROM w JOIN f USING (g) WHERE doc_id > first),
lists AS (SELECT doc_id, count(*) AS n, list(k) AS ks FROM gone GROUP BY doc_id),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY k) AS text FROM p ANTI JOIN gone USING (doc_id, k) GROUP BY p.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""

ORACLES["op12_collocations"] = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m))
  GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score
  FROM k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(ws[i:i + z - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2)))
  GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase,
  a, l, r, n.n, score::BIGINT AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) <= 2000"""
