"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stewardry.llm import (
    best_fit, bpe, chat, content_sort, imatch, jaccard, langid, lexical, packing, prefix_trie, suffix_lm, toxicity, warc,
)
from stewardry.llm.frames import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op5_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return suffix_lm.score(docs, suffix_lm.learn(docs))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.code_documents(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.crawl_of(table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", warc.header_text(F.col("headers")))


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return imatch.edited_likeness(docs, imatch.lexicon(docs))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.units(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(prefix_trie.rebuilt(own))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_whole(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_chat, op3_jaccard, op4_langid, op5_suffix_lm, op6_bpe, op7_toxicity,
        op8_warc_revisits, op9_imatch, op10_exact_dedup, op11_prefix_trie, op12_best_fit, op13_lexical_search,
    )
}

NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

CHAT = r"""
WITH added AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM added
), placed AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prior,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM turns
), checked AS (
  SELECT *, CASE WHEN prior IS NULL THEN role IN ('system', 'user')
                 WHEN prior = 'user' THEN role = 'assistant' ELSE role = 'user' END AS ok,
         length(role) + length(text)
           + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) + length('### : </turn>') + 1 AS chars
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(ok) AS valid,
       bool_and(ok) AND max(CASE WHEN back = 1 THEN role END) = 'assistant' AS complete
FROM checked GROUP BY conv_id
"""

WARC = r"""
WITH base AS (
  SELECT CAST(page_id AS BIGINT) AS p, url, md5(coalesce(html, '')) AS old, md5(coalesce(html, '') || '!') AS new,
         sha256(coalesce(html, '')) AS old_sha, sha256(coalesce(html, '') || '!') AS new_sha
  FROM pages
), responses AS (
  SELECT p * 4 AS id, url, p * 10 AS t, old AS tag, old_sha AS sha FROM base
  UNION ALL SELECT p * 4 + 1, url, p * 10 + 2000, new, new_sha FROM base WHERE p % 3 = 0
), revisits AS (
  SELECT p * 4 + 2 AS id,
         CASE WHEN p % 2 = 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=x'
              ELSE regexp_replace(url, '^https?://', 'HTTPS://www.') END AS url,
         p * 10 + 1 + (p * 7919) % 4000 AS t, CASE WHEN p % 5 <> 0 THEN 'W/"' || old || '"' END AS tag, p
  FROM base
  UNION ALL
  SELECT p * 4 + 3, url, p * 10 - 5 + (p * 31) % 300,
         CASE WHEN p % 7 <> 0 THEN 'W/"' || old || '"' ELSE '"x"' END, p
  FROM base
), parts AS (
  SELECT 'f' AS side, id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM responses
  UNION ALL
  SELECT 'v', id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') FROM revisits
), keyed AS (
  SELECT side, id,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS site,
         regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM parts
), urls AS (
  SELECT side, id, site || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key FROM keyed
), met AS (
  SELECT v.id AS record_id, u.url_key, v.t, v.tag, v.p, f.id AS refers_to, f.t AS refers_at, f.tag AS old, f.sha
  FROM revisits v JOIN urls u ON u.side = 'v' AND u.id = v.id
  LEFT JOIN (SELECT r.*, k.url_key FROM responses r JOIN urls k ON k.side = 'f' AND k.id = r.id) f
    ON f.url_key = u.url_key AND f.t < v.t
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY f.t DESC NULLS LAST, f.id DESC) = 1
), judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'missing'
                 WHEN tag IS NOT NULL THEN CASE WHEN replace(tag, 'W/', '') = '"' || old || '"' THEN 'resolved' ELSE 'changed' END
                 WHEN p % 4 <> 1 AND refers_at = p * 10 THEN 'resolved' ELSE 'changed' END AS status
  FROM met
)
SELECT record_id, url_key, status, refers_to, refers_at,
       CASE WHEN status = 'resolved' THEN
         'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: day ' || t || chr(10)
         || 'etag: ' || coalesce(tag, '"' || old || '"') || chr(10) || 'expires: day ' || (t + 9) || chr(10)
         || 'last-modified: day ' || refers_at
       ELSE
         'content-length: 0' || chr(10) || 'date: day ' || t || chr(10)
         || CASE WHEN tag IS NULL THEN '' ELSE 'etag: ' || tag || chr(10) END || 'expires: day ' || (t + 9)
         || CASE WHEN p % 4 <> 1 THEN chr(10) || 'last-modified: day ' || (p * 10) ELSE '' END
       END AS headers,
       CASE WHEN status = 'resolved' THEN sha END AS payload_sha256
FROM judged
"""

TRIE = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT c, CAST(c AS VARCHAR) AS name FROM turns
), summed AS (
  SELECT c, name, xor(CAST(4294967295 AS BIGINT), list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, z: xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 6 AS h
  FROM ids
), rebuilt AS (
  SELECT s.c, t.nth AS d, t.role, t.text FROM summed s JOIN turns t ON t.c = s.c - s.c % 100 AND t.nth <= s.h
  UNION ALL
  SELECT s.c, t.nth - s.h + least(s.h, coalesce(b.n, 0)), t.role, t.text
  FROM summed s JOIN turns t ON t.c = s.c AND t.nth > s.h
  LEFT JOIN (SELECT c, count(*) AS n FROM turns GROUP BY c) b ON b.c = s.c - s.c % 100
), prefixes AS (
  SELECT c, d, length(text) AS chars,
         string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d) AS path
  FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM ids
), members AS (
  SELECT path, d, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY path, d
), ends AS (
  SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
  FROM (SELECT c, path FROM prefixes QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY path
), children AS (
  SELECT substring(path, 1, 64 * (d - 1)) AS path, count(*) AS n FROM members WHERE d > 0 GROUP BY 1
), above AS (
  SELECT substring(m.path, 1, 64 * u.up) AS path, (k.n IS NULL)::INT AS leaf, (m.n_convs - 1) * m.chars AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM members) u JOIN members m ON m.path = u.path
  LEFT JOIN children k ON k.path = m.path
), sums AS (
  SELECT path, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY path
)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs,
       coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM members m JOIN sums s ON s.path = m.path
LEFT JOIN members p ON m.d > 0 AND p.path = substring(m.path, 1, 64 * (m.d - 1))
LEFT JOIN children k ON k.path = m.path
LEFT JOIN ends e ON e.path = m.path
"""

SEARCH = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (
  SELECT doc_id, terms, len(terms) AS n FROM folded WHERE len(terms) > 0
), whole AS (
  SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS total FROM sized
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL
), posted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * texts + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM posted, whole GROUP BY term, texts
), scored AS (
  SELECT item_id, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * texts) // total)))) AS BIGINT) AS score
  FROM wanted JOIN posted USING (term) JOIN weighed USING (term), whole GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INT) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {
    "op2_chat": CHAT,
    "op8_warc_revisits": WARC,
    "op11_prefix_trie": TRIE,
    "op13_lexical_search": SEARCH,
    "op10_exact_dedup": f"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, {NORMAL} AS t FROM documents
), ranked AS (
  SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth
  FROM normal WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM ranked
""",
}
