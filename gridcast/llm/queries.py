"""One registered query per operator, in the form its contract fixes, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import bpe, chat, codes, contamination, exact, mixing, near, negatives, pii, quality, revisits, sharding, urls
from gridcast.llm.common import hash60, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_reshard(spark: SparkSession, folder: str) -> DataFrame:
    """From 16 shards by document key to 24 of nearly equal bytes."""
    found = sharding.reshard(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's marks."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(rows))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: Captures lie within so many seconds from the start of 2024.
SEASON, START = 90 * 86_400, 1_704_067_200


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of ``pages``: a full response for each, and a not-modified answer to a later or earlier visit of its url.

    Times come from a hash of the page id. A quarter of the answers each has the page's tag in weak form, the tag itself,
    another tag, or none but the time of last change.
    """
    at = lambda what: START + F.pmod(hash60(F.lit(what), F.col("page_id")), F.lit(SEASON))
    body = F.md5(F.coalesce(F.col("html"), F.lit("")))
    changed = (at("capture") - 86_400).cast("string")
    tag = F.concat(F.lit('"'), body, F.lit('"'))
    sort = F.pmod(hash60(F.lit("tag"), F.col("page_id")), F.lit(4))
    shown = F.when(sort == 0, F.concat(F.lit("W/"), tag)).when(sort == 1, tag).when(sort == 2, F.lit('"other"'))
    name = F.col("page_id").cast("string")
    response = pages.select(
        F.concat(F.lit("response-"), name).alias("record_id"), F.lit("response").alias("kind"), "url", at("capture").alias("captured_at"),
        tag.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), at("capture").cast("string"), F.lit("etag"), tag).alias("headers"), body.alias("payload"),
    )
    revisit = pages.select(
        F.concat(F.lit("revisit-"), name).alias("record_id"), F.lit("revisit").alias("kind"), F.concat("url", F.lit("#again")).alias("url"), at("visit").alias("captured_at"),
        shown.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), at("visit").cast("string"), F.lit("expires"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op6_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = revisits.resolve_revisits(captures(table(spark, folder, "pages").select("page_id", "url", "html")))
    fields = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k)))
    return found.select("record_id", "canonical_url", "captured_at", "outcome", "refers_to", "payload", F.array_join(fields, "\n").alias("headers"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contaminated_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))
    counts = [pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS]
    digest = F.sha2(pii.joined_spans(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.joined_spans(F.col("spans")).alias("spans"))


def op9_mix(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def op11_compress(spark: SparkSession, folder: str) -> DataFrame:
    found, books = codes.compress(table(spark, folder, "embeddings"))
    written = F.concat_ws("", F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))))
    return codes.with_label_error(found).select(
        F.col("id").alias("vec_id"), written.alias("code"), "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256")
    )


def op12_encode(spark: SparkSession, folder: str, file: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(file)
    found = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    ids = F.sha2(F.array_join("token_ids", ",").cast("binary"), 256)
    back = F.sha2(bpe.decoded(spark, F.col("token_ids"), path), 256)
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), back.alias("decoded_sha256"))


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, moved)


QUERIES: dict[str, Query] = {
    "op1_reshard": op1_reshard,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_revisits": op6_revisits,
    "op7_decontaminate": op7_decontaminate,
    "op8_personal_data": op8_personal_data,
    "op9_mix": op9_mix,
    "op10_exact": op10_exact,
    "op11_compress": op11_compress,
    "op12_encode": op12_encode,
    "op13_negatives": op13_negatives,
}

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1::BIGINT, 0::BIGINT, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(32 + length(role) + length(t) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(t, '<\\*\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP4_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT r, arg_max(rhost || rpath, 1000 * length(rhost || rpath) + length(rhost)) AS rule, arg_max(verdict, 1000 * length(rhost || rpath) + length(rhost)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (r)
"""

OP5_SQL = r"""
WITH RECURSIVE folded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, list_sort(list_distinct(CASE WHEN len(w) < 5 THEN [hash(w)] ELSE
    list_transform(list_zip(w[:-5], w[2:-4], w[3:-3], w[4:-2], w[5:]), lambda t: hash(t)) END)) AS s FROM folded WHERE len(w) > 0
), nodes AS (
  SELECT min(r) AS node, s, len(s) AS n FROM sets GROUP BY s
), rowed AS (
  SELECT r, node, n FROM sets JOIN nodes USING (s)
), single AS (
  SELECT node, n, unnest(s) AS x FROM nodes
), links AS (
  SELECT a.node AS a, b.node AS b FROM single AS a JOIN single AS b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT node AS node, node AS root FROM nodes WHERE node IN (SELECT a FROM edges)
  UNION SELECT edges.b, reach.root FROM reach JOIN edges ON reach.node = edges.a AND edges.b > reach.root
), roots AS (
  SELECT node, min(root) AS root FROM (SELECT * FROM reach UNION ALL SELECT node, node FROM nodes) AS x GROUP BY node
), classed AS (
  SELECT r, n, min(doc_id) OVER (PARTITION BY root) AS component_id FROM rowed JOIN roots USING (node) JOIN folded USING (r)
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id,
       doc_id IS NOT DISTINCT FROM (CASE WHEN n IS NULL THEN doc_id ELSE component_id END) AS kept
FROM folded LEFT JOIN classed USING (r)
"""

OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS body, coalesce(page_id::VARCHAR, 'null') AS i FROM pages
), t AS (
  SELECT *, 1704067200 + ('0x' || substr(md5('capture|' || i), 1, 15))::BIGINT % 7776000 AS captured,
         1704067200 + ('0x' || substr(md5('visit|' || i), 1, 15))::BIGINT % 7776000 AS visited, ('0x' || substr(md5('tag|' || i), 1, 15))::BIGINT % 4 AS sort,
         regexp_extract(url, '://([^/?#]*)', 1) AS authority, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS fields
  FROM p
), u AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(translate(regexp_replace(authority, '^.*@', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  CASE WHEN url ILIKE 'http://%' THEN ':(80)?$' WHEN url ILIKE 'https://%' THEN ':(443)?$' ELSE ':$' END, ''), '^www[0-9]*\.', '')
    || (CASE WHEN path = '' THEN '/' ELSE path END) || (CASE WHEN fields = '' THEN '' ELSE '?' || fields END) END AS canonical_url
  FROM t
), v AS (
  SELECT 'revisit-' || page_id::VARCHAR AS record_id, canonical_url, visited AS captured_at,
         CASE sort WHEN 0 THEN 'W/"' || body || '"' WHEN 1 THEN '"' || body || '"' WHEN 2 THEN '"other"' END AS etag, (captured - 86400)::VARCHAR AS last_modified, row_number() OVER () AS r FROM u
), found AS (
  SELECT r, arg_max(struct_pack(id := 'response-' || page_id::VARCHAR, body := body, captured := captured), struct_pack(a := captured, b := 'response-' || page_id::VARCHAR)) AS f
  FROM v JOIN u ON u.canonical_url = v.canonical_url AND captured < captured_at GROUP BY r
), judged AS (
  SELECT v.*, f, CASE WHEN canonical_url IS NULL THEN 'no_key' WHEN f IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = '"' || f.body || '"' THEN 'resolved' ELSE 'mismatch' END
    WHEN last_modified = (f.captured - 86400)::VARCHAR THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM v LEFT JOIN found USING (r)
)
SELECT record_id, canonical_url, captured_at, outcome, f.id AS refers_to, CASE WHEN outcome = 'resolved' THEN f.body END AS payload,
       CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || captured_at || chr(10) || 'etag: "' || f.body || '"' || chr(10) || 'expires: 0' END AS headers
FROM judged
"""

OP7_SQL = r"""
WITH folded AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM items, unnest(range(1, greatest(1, len(w) - 8))) AS u(i) WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT k FROM windows
), runs AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM folded, lengths, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k
), found AS (
  SELECT r, k, i, item_id FROM runs JOIN windows USING (k, t)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + k)) AS u(p) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM found) GROUP BY r
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 11))::BIGINT AS h, row_number() OVER () AS r
  FROM documents
), s AS (
  SELECT k, any_value(source) AS source, sum(size)::HUGEINT AS source_size FROM d GROUP BY k
), placed AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::HUGEINT AS weight,
         2 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), levels AS (
  SELECT *, sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE) AS below,
         sum(weight) OVER () - sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE) AS lighter FROM placed
), fulls AS (
  SELECT *, 2 * (below * weight + cap * lighter) <= 3 * total * weight AS is_full FROM levels
), spent AS (
  SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS spent, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS remaining FROM fulls
), targets AS (
  SELECT k, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * (3 * total - 2 * spent))::DOUBLE / (2 * remaining)::DOUBLE END AS target FROM spent
), budgets AS (
  SELECT *, CASE WHEN source_size = 0 OR target < source_size THEN 0 WHEN target >= 2 * source_size THEN 2 ELSE 1 END AS whole FROM targets
), summed AS (
  SELECT d.*, sum(size) OVER (PARTITION BY k ORDER BY h, r ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto FROM d
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN 2 * upto - size < 2 * (target - whole * source_size::DOUBLE) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed JOIN budgets USING (k)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
_WHOLE = "list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT)"


def _assigned(books: str) -> str:
    return f"""
  SELECT r, p, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM (
    SELECT r, p, e, sum((y - z) * (y - z)) AS d FROM c JOIN {books} USING (p, i) GROUP BY r, p, e) AS measured GROUP BY r, p"""


def _moved(books: str, assigned: str) -> str:
    return f"""
  SELECT p, e, i, coalesce((s - ((s % n) + n) % n) // n, z) AS z FROM {books} LEFT JOIN (
    SELECT p, e, i, sum(y) AS s, count(*) AS n FROM c JOIN {assigned} USING (r, p) GROUP BY p, e, i) AS used USING (p, e, i)"""


OP11_SQL = f"""
WITH k AS (
  SELECT r, vec_id, label, x, row_number() OVER (ORDER BY vec_id, x) - 1 AS e, len(x) // 16 AS w
  FROM (SELECT row_number() OVER () AS r, vec_id, label, {_WHOLE} AS x FROM embeddings WHERE {_USABLE}) AS v
), c AS (
  SELECT r, (i - 1) // w AS p, (i - 1) % w AS i, x[i] AS y FROM k, unnest(range(1, len(x) + 1)) AS u(i)
), b0 AS (
  SELECT p, e, i, y AS z FROM c JOIN k USING (r) WHERE e < 64
), a0 AS ({_assigned("b0")}
), b1 AS ({_moved("b0", "a0")}
), a1 AS ({_assigned("b1")}
), b2 AS ({_moved("b1", "a1")}
), a2 AS ({_assigned("b2")}
), coded AS (
  SELECT r, string_agg(format('{{:02x}}', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r
), books AS (
  SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (r), books
"""

OP13_SQL = f"""
WITH k AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE}::DOUBLE[] AS x
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE}
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM k AS a JOIN k AS b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS no FROM s WHERE same QUALIFY no <= 5
)
SELECT pos.anchor_id, positive_id, row_number() OVER (PARTITION BY a, no ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (a) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""

SQL: dict[str, str] = {
    "op11_compress": OP11_SQL,
    "op13_negatives": OP13_SQL,
    "op2_chat": OP2_SQL,
    "op4_urls": OP4_SQL,
    "op5_near_duplicates": OP5_SQL,
    "op6_revisits": OP6_SQL,
    "op9_mix": OP9_SQL,
    "op10_exact": OP10_SQL,
    "op7_decontaminate": OP7_SQL,
}
