"""The queries opN_<name> over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import chat, decontamination, fingerprints, language, mixing, near_duplicates, pii, sharding, substring_dedup, url_filter
from cotejo.llm._common import spread, table

SHARDS = 8
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = sharding.assign_shards(rows, "doc_id", SHARDS)
    rows = sharding.assign_shards(rows, "doc_id", SHARDS + 1, shard_col="grown_shard")
    out = sharding.number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path")
    )
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_offset_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = pii.span_list(F.filter("pii", lambda s: s["base"]))
    n = {f"n_{k}": pii.count_of(F.col("pii"), k) for k in pii.KINDS}
    return found.select(
        "doc_id", *[c.alias(k) for k, c in n.items()], F.sha2(base, 256).alias("base_sha256"), pii.span_list(F.col("pii")).alias("spans")
    )


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_shingles", "component_id")


def op5_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", F.col("dedup.n_words").alias("n_words"), F.col("dedup.n_removed").alias("n_removed"), F.sha2("dedup.kept", 256).alias("kept_sha256")
    )


def op6_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    found = language.predict_language(docs.select("doc_id", "text"), language.fit_centroids(docs))
    return found.select("doc_id", (~language.in_training(F.col("doc_id"))).alias("held_out"), "language.*")


def op7_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words(F.col("contamination.hits"))
    return found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: A conversation whose texts hold control strings, besides those of the table.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes = chat.chain_nodes(said.unionByName(spark.createDataFrame(PROBE, said.schema)))
    branches = chat.format_branches(nodes).withColumn("back", chat.read_back("formatted", "loss_spans"))
    return branches.select(
        F.col("tree").alias("conv_id"),
        F.col("back.n_turns").alias("n_turns"),
        F.sha2("back.turns", 256).alias("turns_sha256"),
        F.length("back.loss").cast("long").alias("loss_chars"),
        F.sha2("back.loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Target weights of op9 and the pipeline: each source's rows to this power.
MIX_POWER = 0.5


def op9_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    weights = mixing.target_weights(docs, "source", MIX_POWER)
    return mixing.mix_sources(docs, ["doc_id"], "source", weights)


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = fingerprints.with_next(docs, "doc_id", ["text", "anchors"], F.col("text"), lambda rows: fingerprints.add_fingerprint(rows, "text", "anchors"))
    n = F.length("text")
    cut_at = (n - F.floor(n / 4)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), cut_at), F.substring("next_text", F.lit(1), n - cut_at))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", "next_anchors")
    docs = fingerprints.add_fingerprint(docs, "edited", "edited_anchors")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("anchors")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        fingerprints.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


QUERIES = {f.__name__: f for f in (op1_jump_hash, op2_digest_array, op3_offset_pii, op4_parity_join, op5_rabin_karp, op6_centroids, op7_wu_manber, op8_reply_trees, op9_pfair, op10_syncmers)}

# -- SQL ----------------------------------------------------------------------------------


def _jump_sql(name: str, shards: int) -> str:
    """Recursive steps of the generator in 128-bit integers, for every doc_id."""
    return f"""
{name}(doc_id, key, b, j) AS (
  SELECT doc_id, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END, -1::BIGINT, 0::BIGINT
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, k, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS k FROM {name} WHERE j < {shards})
)"""


# CRC-32 bit by bit over the hex digits of the UTF-8 bytes, with a table of the 256 remainders.
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(9), lambda c, i: CASE WHEN i = 0 THEN c WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n))"

_SPACE_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD_CHARS = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPES = r"len(regexp_extract_all({x}, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]'))"

_RULES = ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_jump_hash": f"""
WITH RECURSIVE {_jump_sql("s8", SHARDS)},
{_jump_sql("s9", SHARDS + 1)},
a AS (SELECT doc_id, max(b) FILTER (j >= {SHARDS}) AS shard FROM s8 GROUP BY doc_id),
g AS (SELECT doc_id, max(b) FILTER (j >= {SHARDS + 1}) AS grown FROM s9 GROUP BY doc_id),
t AS (SELECT {_CRC_TABLE} AS crc),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, strlen(h) // 2 + 1 AS size, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(strlen(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda acc, x: xor(acc // 256, crc[(xor(acc % 256, x) + 1)::INTEGER]))) AS text_crc32 FROM d, t)
SELECT c.doc_id, c.size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY c.doc_id, text_crc32, c.size) - 1 AS slot, grown::INTEGER AS grown_shard
FROM c JOIN a ON a.doc_id IS NOT DISTINCT FROM c.doc_id JOIN g ON g.doc_id IS NOT DISTINCT FROM c.doc_id""",
    "op2_digest_array": rf"""
WITH p AS (
  SELECT page_id, coalesce({_LOWER.format(x="regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, rule) AS (VALUES {_RULES}),
s AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r),
m AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN s ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path""",
    "op4_parity_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACE_WORDS.format(x=_LOWER.format(x="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
u AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM reach r JOIN u ON r.y = u.x)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = s.doc_id""",
    "op5_rabin_karp": f"""
WITH w AS (SELECT doc_id, {_SPACE_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT h, min(doc_id) AS d FROM k GROUP BY h HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT k.doc_id, k.i + o.o AS i FROM k JOIN f ON k.h = f.h AND f.d < k.doc_id, (SELECT unnest(range(13)) AS o) o),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w),
c AS (SELECT x.doc_id, count(r.i) AS n_removed, coalesce(string_agg(t, ' ' ORDER BY x.i) FILTER (r.i IS NULL), '') AS kept FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN c ON c.doc_id = w.doc_id""",
    "op7_wu_manber": f"""
WITH d AS (SELECT doc_id, {_WORD_CHARS.format(x=_LOWER.format(x="coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORD_CHARS.format(x=_LOWER.format(x="coalesce(text, '')"))} AS w FROM benchmark),
q AS (SELECT item_id, least(len(w), 10) AS m, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS p FROM q),
o AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, o.m, i FROM o JOIN pat ON pat.m = o.m AND pat.p = o.p),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op9_pfair": f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n, sqrt(count(*)) AS p, row_number() OVER (ORDER BY source IS NOT NULL, source) AS i FROM documents GROUP BY source),
e AS (SELECT *, greatest({mixing.PERIOD}, 10 * count(*) OVER ()) AS period, p / sum(p) OVER () * greatest({mixing.PERIOD}, 10 * count(*) OVER ()) AS exact FROM c),
f AS (SELECT *, greatest(1, floor(exact)::BIGINT) AS least, row_number() OVER (ORDER BY floor(exact) - exact, coalesce(source, 'None')) AS turn FROM e),
wt AS (SELECT source, n, i, period, least + CASE WHEN turn <= period - sum(least) OVER () THEN 1 ELSE 0 END AS w FROM f),
l AS (SELECT list(w ORDER BY i) AS w, any_value(period) AS period, count(*) AS k FROM wt),
s(t, done, chosen) AS (
  SELECT -1::BIGINT, list_transform(w, lambda x: 0::BIGINT), NULL::BIGINT FROM l
  UNION ALL SELECT t, list_transform(done, lambda x, i: CASE WHEN i = chosen THEN x + 1 ELSE x END), chosen FROM (
    SELECT t + 1 AS t, done, list_min(list_transform(list_filter(range(1, k + 1), lambda i: done[i] < w[i] AND done[i] * period < (t + 2) * w[i]),
      lambda i: ceil((done[i] + 1) * period / w[i])::BIGINT * 1000000 + i)) % 1000000 AS chosen FROM s, l WHERE t + 1 < period)),
plan AS (SELECT chosen AS i, t AS slot, row_number() OVER (PARTITION BY chosen ORDER BY t) - 1 AS nth FROM s WHERE t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents),
b AS (SELECT d.doc_id, d.source, d.n, wt.i, wt.w, wt.period, d.n // {mixing.BLOCK_ROWS} AS block FROM d JOIN wt ON d.source IS NOT DISTINCT FROM wt.source),
x AS (SELECT b.*, block // w * period AS base, plan.nth, plan.slot AS own FROM b JOIN plan ON plan.i = b.i AND plan.nth = block % w),
z AS (SELECT min(blocks // w * period + plan.slot) AS stop FROM (SELECT *, ceil(n / {mixing.BLOCK_ROWS})::BIGINT AS blocks FROM wt) q JOIN plan ON plan.i = q.i AND plan.nth = blocks % w)
SELECT doc_id, source, w::BIGINT AS weight, block, (base + floor(nth * period / w))::BIGINT AS release, (base + ceil((nth + 1) * period / w))::BIGINT AS deadline, (base + own)::BIGINT AS slot,
  base + own < stop AS within_target, row_number() OVER (ORDER BY base + own, n) - 1 AS position FROM x, z""",
    "op8_reply_trees": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {", ".join(str(x) for x in PROBE)})))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length(role) + length(text) + {_ESCAPES.format(x="role")} + {_ESCAPES.format(x="text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
}
