"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.centroids import clustered, with_inertia
from orrery.llm.chat_format import digest_formatted, format_conversations
from orrery.llm.collocations import collocations
from orrery.llm.exact_dedup import exact_groups
from orrery.llm.html_extract import extract
from orrery.llm.language_id import fit, identify, learnable
from orrery.llm.near_dedup import components
from orrery.llm.packing import pack
from orrery.llm.quality_rules import quality
from orrery.llm.secret_scan import find_secrets
from orrery.llm.sentencepiece_codec import round_trip
from orrery.llm.sharding import interleaved_shards
from orrery.llm.url_filter import PATTERN_RULES, SITE_RULES, judge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs, learnable()))
    held_out = F.coalesce(~learnable(), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), repository=F.xxhash64("text"), owner=F.col("source"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Conversation -1: control strings as the text of a user and of an assistant.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    return digest_formatted(format_conversations(turns.unionByName(own)))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = interleaved_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(table(spark, sf_dir, "embeddings")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), (*SITE_RULES, *PATTERN_RULES)).select("page_id", "host", "path", "rule", "verdict", "pattern")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_html_extract": op9_html_extract,
    "op10_sharding": op10_sharding,
    "op11_centroids": op11_centroids,
    "op12_collocations": op12_collocations,
    "op13_url_filter": op13_url_filter,
}

OP6_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text
    FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
e AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram IS NOT NULL),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY rid),
f AS (
    SELECT w.rid, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM w LEFT JOIN c USING (rid)),
r AS (
    SELECT *, CASE WHEN n_words > 0 THEN 1000 * greatest(0, n_symbols - 1) // n_words ELSE 0 END AS symbol_rate,
           CASE WHEN n_lines > 0 THEN 1000 * greatest(0, n_dup_lines - 1) // n_lines ELSE 0 END AS dup_line_rate,
           CASE WHEN n_words > 0 THEN 1000 * greatest(0, n_repeat_words - 6) // n_words ELSE 0 END AS repeat_rate,
           CASE WHEN n_words > 0 THEN 10 * word_chars // n_words ELSE 0 END AS word_length
    FROM f),
m AS (
    SELECT lang, source, measure, v FROM r, LATERAL (
        SELECT unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS measure, unnest([symbol_rate, dup_line_rate, repeat_rate, word_length]) AS v)),
s AS (
    SELECT lang, source, measure, CASE WHEN v < 32 THEN v ELSE 16 * (length(bin(v)) - 5) + (v >> (length(bin(v)) - 5)::INTEGER) END AS bucket,
           2 - grouping(source) - grouping(lang) AS depth, count(*) AS n
    FROM m GROUP BY GROUPING SETS ((lang, source, measure, bucket), (lang, measure, bucket), (measure, bucket))),
u AS (
    SELECT *, sum(n) OVER (PARTITION BY depth, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY depth, lang, source, measure) AS total,
           CASE WHEN bucket < 32 THEN bucket ELSE ((bucket - 16 * ((bucket - 16) // 16) + 1) << ((bucket - 16) // 16)::INTEGER) - 1 END AS top
    FROM s),
q AS (
    SELECT depth, lang, source, measure, total, min(top) FILTER (100 * upto >= 10 * total) AS lower, min(top) FILTER (100 * upto >= 50 * total) AS median,
           min(top) FILTER (100 * upto >= 90 * total) AS upper
    FROM u GROUP BY ALL),
k AS (
    SELECT depth, lang, source, measure, total::BIGINT AS total, greatest(0, lower - 3 * (median - lower))::BIGINT AS low, (upper + 3 * (upper - median))::BIGINT AS high FROM q),
l AS (
    SELECT k.lang, k.measure, (k.total * k.low + 20 * a.low) // (k.total + 20) AS low, (k.total * k.high + 20 * a.high) // (k.total + 20) AS high
    FROM k JOIN k a ON k.depth = 1 AND a.depth = 0 AND a.measure = k.measure),
t AS (
    SELECT k.lang, k.source, k.measure, (k.total * k.low + 20 * l.low) // (k.total + 20) AS low, (k.total * k.high + 20 * l.high) // (k.total + 20) AS high
    FROM k JOIN l ON k.depth = 2 AND k.lang = l.lang AND k.measure = l.measure),
x AS (
    SELECT rid, string_agg(measure, ',' ORDER BY list_position(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length'], measure)) AS failed
    FROM (SELECT rid, lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS measure, unnest([symbol_rate, dup_line_rate, repeat_rate, word_length]) AS v FROM r)
    JOIN t USING (lang, source, measure)
    WHERE v > high OR (measure = 'word_length' AND v < low) GROUP BY rid),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed, '') AS failed, NOT base_failed AND failed IS NULL AS kept
FROM y LEFT JOIN x USING (rid)
"""

OP8_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER () AS n FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 0 UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 0),
g AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<\|im_start\|>|<\|im_end\|>')) AS guarded FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(3 + length(role) + 1 + CASE WHEN role = 'assistant' THEN 0 ELSE 7 END + guarded + 6)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""

OP7_SQL = """
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP10_SQL = """
WITH RECURSIVE
poly(byte, k, v) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL
    SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM poly WHERE k < 8),
lookup AS (SELECT list(v ORDER BY byte) AS crc FROM poly WHERE k = 8),
d AS (
    SELECT doc_id, coalesce('=' || source, '') AS source, strlen(coalesce(text, '')) + 1 AS size,
           xor(list_reduce(
               list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
               lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32,
           md5('mixture-1:' || doc_id::VARCHAR) AS key
    FROM documents, lookup),
r AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32) - 1 AS in_source,
           count(*) OVER (PARTITION BY source) AS n_source, count(*) OVER () AS n_rows
    FROM d),
f AS (SELECT *, (2 * in_source + 1)::DOUBLE / (2 * n_source)::DOUBLE AS fraction FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, source, in_source) - 1 AS position FROM f),
s AS (SELECT *, (position * 8) // n_rows AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       position - (shard * n_rows + 7) // 8 AS slot, NULL::INTEGER AS grown_shard
FROM s
"""



def _op11_sql(rounds: int = 10) -> str:
    """Rounds as pairs of common tables: a{k} assigns, c{k} holds the centroids after round k."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT rid, cluster, {far} AS d FROM v, c{k} c) GROUP BY rid)"
        )
        if k < rounds:
            steps.append(
                f"""s{k} AS (SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.cluster, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{k} a JOIN v USING (rid)) GROUP BY cluster, i),
m{k} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{k} GROUP BY cluster),
c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m USING (cluster))"""
            )
    last = f"a{rounds}"
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, q) - 1)::INTEGER AS cluster, q FROM v
    ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, q LIMIT 8),
{", ".join(steps)}
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM {last} a JOIN v USING (rid) JOIN c{rounds} c ON a.cluster = c.cluster
"""


OP11_SQL = _op11_sql()

OP12_SQL = r"""
WITH p AS (
    SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
s AS (SELECT pid, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p),
t AS (
    SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM s WINDOW o AS (PARTITION BY pid ORDER BY i)),
f AS (
    SELECT lang, 1 AS size, w1 AS phrase, count(*) AS a FROM t GROUP BY lang, w1
    UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM t WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
    UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM t WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
    UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM t WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (
    SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, (2000000::HUGEINT * k.a) // (l.a + r.a) AS score
    FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k.k + 1:], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, size, a, w, unnest(range(2, size)) AS m FROM c),
b AS (SELECT lang, a, w, m, unnest(range(1, size - m + 2)) AS i FROM m),
g AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM b GROUP BY ALL),
z AS (
    SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM y LEFT JOIN g USING (lang, phrase) WHERE g.longer IS NULL OR 100 * g.longer < 80 * y.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""

_PATTERNS = ", ".join(f"('{r.pattern}', '{r.verdict}')" for r in PATTERN_RULES)

OP13_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
    SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u),
s AS (
    SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                   WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                   WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                   WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM h),
r AS (
    SELECT pattern, verdict, CASE WHEN starts_with(pattern, '||') THEN '^([^/]*[.])?' ELSE '' END
           || replace(replace(replace(ltrim(pattern, '|'), '.', '[.]'), '*', '.*'), '^', '([^a-z0-9]|$)') AS expression
    FROM (VALUES {_PATTERNS}) AS t(pattern, verdict)),
m AS (
    SELECT rid, arg_min(r.pattern, (-length(r.pattern), r.pattern)) AS pattern, arg_min(r.verdict, (-length(r.pattern), r.pattern)) AS verdict
    FROM s JOIN r ON s.rule IS NULL AND regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r.expression, 's')
    GROUP BY rid)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(m.verdict, 'allow') END AS verdict, m.pattern AS pattern
FROM s LEFT JOIN m USING (rid)
"""

ORACLES: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op8_chat_format": OP8_SQL, "op7_exact_dedup": OP7_SQL, "op10_sharding": OP10_SQL, "op11_centroids": OP11_SQL, "op12_collocations": OP12_SQL, "op13_url_filter": OP13_SQL}
