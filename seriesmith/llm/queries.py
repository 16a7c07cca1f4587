"""The queries op1 to op10 over whole tables, with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.llm import chat, exact_dedup, line_dedup, mixing, packing, quality, secrets, simhash, urls, warc
from seriesmith.llm.common import read_table

#: The rules of the URL filter in order, and the names whose hosts it blocks beside them, under each domain and wherever else
#: pages have them.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCKED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_secrets(docs).drop("text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.score(docs).drop("source")


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sizes(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path())


def url_list(spark: SparkSession, pages: DataFrame | None = None) -> DataFrame:
    """entry, action, is_rule: the rules, the hosts of BLOCKED_NAMES in DOMAINS, and the canonical URL of every page whose host
    has a blocked name among its labels."""
    rows = [(e, a, True) for e, a in URL_RULES] + [(f"{n}.{d}/", "block", False) for n in BLOCKED_NAMES for d in DOMAINS]
    fields = [F.struct(F.lit(e).alias("entry"), F.lit(a).alias("action"), F.lit(r).alias("is_rule")) for e, a, r in rows]
    fixed = spark.range(1).select(F.inline(F.array(*fields)))
    if pages is None:
        return fixed
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    junk = pages.filter(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, BLOCKED_NAMES))))
    found = junk.select(urls.canonical(host, path).alias("entry"), F.lit("block").alias("action"), F.lit(False).alias("is_rule"))
    return fixed.unionByName(found.distinct())


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, url_list(spark, pages)).select("page_id", "host", "path", "rule", "verdict")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_dedup(docs).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.range(1).select(F.inline(F.array(*planted))))
    formatted = chat.format_chats(chat.conversations_as_records(rows))
    turns = formatted.select("conv_id", "layout", "formatted", chat.parse(F.col("formatted")).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["text"]), "")
    return turns.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_source_mixing": op4_source_mixing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filters": op7_url_filters,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_chat_formatting": op10_chat_formatting,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)),
f AS (SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 10 * n_symbols > n_words AS r3, 20 * n_dup_lines > n_words AS r4,
  word_chars < 2 * n_words OR word_chars > 14 * n_words AS r5 FROM m),
h AS (SELECT source, k, count(*)::DOUBLE AS n, sum(r::INT)::DOUBLE AS f FROM
  (SELECT source, unnest([1, 2, 3, 4, 5]) AS k, unnest([r1, r2, r3, r4, r5]) AS r FROM f) GROUP BY source, k),
t AS (SELECT k, sum(f) / sum(n) AS p, sum(n) AS n, (count(*) - 1) / sum(n) AS noise, sum(n * n) AS squares, sum(f * f / n) AS q FROM h GROUP BY k),
s AS (SELECT k, p, CASE WHEN p * (1 - p) * (1 - squares / (n * n) - noise) > 0
  THEN (q / n - p * p - p * (1 - p) * noise) / (p * (1 - p) * (1 - squares / (n * n) - noise)) ELSE 0 END AS rho FROM t),
b AS (SELECT k, p, 1 / least(greatest(rho, 1 / 1000001.0::DOUBLE), 1 - 1e-6) - 1 AS strength FROM s),
v AS (SELECT h.source, max((h.f + b.p * b.strength) / (h.n + b.strength)) <= 0.5 AS host_kept FROM h JOIN b USING (k) GROUP BY h.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (r1 OR r2) AS base_failed, host_kept, NOT (r1 OR r2) AND host_kept AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), g AS (SELECT html, max(page_id) AS head FROM p GROUP BY html),
d AS (SELECT page_id, html, sha1(html) AS h FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + (k // 4) * 5, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM d JOIN g USING (html)
"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM tot),
w AS (SELECT *, ([5, 2, 1])[1 + rk % 3] AS weight FROM r),
n AS (SELECT *, source_size::DOUBLE / weight AS need FROM w),
b AS (SELECT *, coalesce(sum(source_size) OVER o, 0)::BIGINT AS before, (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS weight_left,
  (sum(source_size) OVER ())::BIGINT AS total FROM n WINDOW o AS (ORDER BY need, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * before) / weight_left AS unit FROM b),
k AS (SELECT unit FROM u WHERE 2.0::DOUBLE * need > unit ORDER BY need, rk LIMIT 1),
g AS (SELECT source, source_size, least(coalesce((SELECT unit FROM k) * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target FROM u),
p AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS times FROM g),
h AS (SELECT source, hash, sum(size)::BIGINT AS tokens FROM d GROUP BY source, hash),
c AS (SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY hash))::BIGINT AS upto FROM h),
e AS (SELECT c.source, hash, tokens, p.target - p.times * p.source_size - (upto - tokens) AS remains FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
l AS (SELECT source, CASE WHEN 2 * remains >= tokens THEN hash + 1 ELSE hash END AS threshold FROM e WHERE remains >= 0 AND remains < tokens)
SELECT d.doc_id, d.size, p.source_size, p.target, (d.size * (p.times + CASE WHEN d.hash < coalesce(l.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_LETTERS})) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP7_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_LETTERS}), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT rule, action, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM
  (VALUES {", ".join(f"('{e}', '{a}')" for e, a in URL_RULES)}) AS v(rule, action)),
b AS (SELECT n || '.' || d AS h, '/' AS p FROM (SELECT unnest([{", ".join(map(repr, BLOCKED_NAMES))}]) AS n), (SELECT unnest([{", ".join(map(repr, DOMAINS))}]) AS d)
  UNION SELECT host, path || CASE WHEN ends_with(path, '/') THEN '' ELSE '/' END FROM u
  WHERE list_has_any(string_split(host, '.'), [{", ".join(map(repr, BLOCKED_NAMES))}])),
best AS (SELECT host, path, max(struct_pack(n := length(rule), rule := rule, action := action)) AS r FROM (SELECT DISTINCT host, path FROM u)
  JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
hit AS (SELECT DISTINCT host, path FROM (SELECT DISTINCT host, path FROM u) JOIN b ON host = h OR ends_with(host, '.' || h)
  WHERE starts_with(CASE WHEN ends_with(path, '/') THEN path ELSE path || '/' END, p))
SELECT page_id, u.host, u.path, r.rule AS rule, coalesce(r.action, CASE WHEN hit.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (host, path) LEFT JOIN hit USING (host, path)
"""

OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM w WHERE n > 0),
g AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM p GROUP BY doc_id),
r AS (SELECT a.doc_id, a.i, b.i AS j FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i
  WHERE b.upto - a.upto + a.n >= 50 AND (b.upto - b.n - a.upto + a.n < 50 OR b.upto - a.upto < 50)),
c AS (SELECT r.*, array_to_string(list_slice(ls, r.i, r.j), chr(10)) AS body FROM r JOIN g USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM c),
x AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE nth > 1),
kept AS (SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.k) AS text FROM w LEFT JOIN p USING (doc_id, k) LEFT JOIN x ON x.doc_id = p.doc_id AND x.i = p.i
  WHERE x.i IS NULL GROUP BY w.doc_id),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM p GROUP BY doc_id), m AS (SELECT doc_id, count(*)::BIGINT AS n FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text, coalesce(n.n, 0) AS n_lines, coalesce(m.n, 0) AS n_deleted
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP10_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles,
  sum(CASE WHEN role = 'assistant' THEN 10 ELSE 16 END + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>)', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  CASE WHEN roles = 'user,assistant' THEN 'prompt' WHEN roles = 'system,user,assistant' THEN 'instruction_input' ELSE 'messages' END AS layout FROM g
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op3_warc_salvage": OP3_SQL,
    "op4_source_mixing": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_url_filters": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_chat_formatting": OP10_SQL,
}
