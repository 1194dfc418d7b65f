"""The ten contract queries, and the pipeline, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, huffman, lines, packing, quality, repeats, sharding, simhash, warc
from .work import Work, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 2048, end_id=1)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, removed lines (numbers from 0), and a digest of the text that stays."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(given.unionByName(extra)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Work(spark, "token-files").path("ids")
    huffman.write(table(spark, sf_dir, "documents"), path, end_id=2)
    return huffman.read(spark, path, digest=True)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.score(table(spark, sf_dir, "documents")).select(*columns, "n_stop_words", "n_lines")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Work(spark, "warc").path("files")
    warc.write(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_pages(spark, path)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_line_dedup, op4_sharding, op5_chat, op6_token_files, op7_quality, op8_decontamination, op9_warc, op10_simhash)
}

def _quality_sql() -> str:
    blank, stop = r"[\x20\x09-\x0D]", str(list(dict.fromkeys(quality.STOP_WORDS)))
    tests = ["NOT base_failed"]
    for r in quality.RULES:
        base = "1" if r.base == "one" else r.base
        bounds = [f"1000 * {r.feature} >= {r.low} * {base}"] * (r.low is not None) + [f"1000 * {r.feature} <= {r.high} * {base}"] * (r.high is not None)
        tests.append(f"(n_words < {r.least_words} OR ({' AND '.join(bounds)}))")
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{blank}+', '', 'g') <> '') AS ls FROM t),
starts AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w), win AS (SELECT rid, i, list_slice(ws, i, i + 4) AS g FROM starts),
twice AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1), rep AS (SELECT rid, i FROM win SEMI JOIN twice USING (rid, g)),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(ws, lambda x: list_contains({stop}, lower(x)))) AS BIGINT) AS n_stop_words, CAST(len(ls) AS BIGINT) AS n_lines FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, {' AND '.join(tests)} AS kept FROM b"""


_ESCAPED = "(length({0}) + len(regexp_extract_all({0}, '\\\\|</?s>|\\[/?INST\\]')))"
_CHAT_SQL = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) x),
turns AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + 2 + {_ESCAPED.format("role")} + length(role) - length(replace(role, chr(10), '')) + {_ESCAPED.format("text")} AS size FROM said)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id"""

_WARC_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, upper(sha1(body)) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) % 32, 1)), '') AS payload_digest,
CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM h"""

# Lines of equal word sets are settled first; of the others, those that share one of their rarest words are compared.
_LINES_SQL = r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), each AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d),
l AS MATERIALIZED (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(ls[i + 1], '[^\x20\x09-\x0D]+'))) AS ws FROM each),
w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, i) AS r, doc_id, i, ws FROM l WHERE len(ws) > 0),
k AS MATERIALIZED (SELECT min(r) AS r, ws, len(ws) AS n FROM w GROUP BY ws), t AS (SELECT r, n, unnest(ws) AS word FROM k), f AS (SELECT word, count(*) AS f FROM t GROUP BY word),
o AS (SELECT r, n, word, row_number() OVER (PARTITION BY r ORDER BY f, word) - 1 AS pos FROM t JOIN f USING (word)), p AS MATERIALIZED (SELECT r, n, word, pos FROM o WHERE pos < n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT a.r AS x, b.r AS y FROM p a JOIN p b ON a.word = b.word AND b.r < a.r WHERE 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n AND 9 * least(a.n - a.pos, b.n - b.pos) >= 4 * (a.n + b.n)),
compared AS (SELECT x, a.n + b.n AS n, len(list_intersect(a.ws, b.ws)) AS same FROM pairs JOIN k a ON a.r = x JOIN k b ON b.r = y),
gone AS (SELECT DISTINCT x AS r FROM compared WHERE 5 * same >= 4 * (n - same)), lost AS (SELECT w.doc_id, w.i FROM w JOIN k USING (ws) WHERE w.r > k.r OR k.r IN (SELECT r FROM gone)),
told AS (SELECT each.doc_id, count(lost.i) AS n, string_agg(CASE WHEN lost.i IS NOT NULL THEN each.i END, ',' ORDER BY each.i) AS removed, string_agg(CASE WHEN lost.i IS NULL THEN each.ls[each.i + 1] END, chr(10) ORDER BY each.i) AS kept FROM each LEFT JOIN lost ON lost.doc_id = each.doc_id AND lost.i = each.i GROUP BY each.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM d LEFT JOIN told USING (doc_id)"""

# Bytes are pairs of hex digits.
_REPEATS_SQL = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT *, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
win AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM n WHERE n >= 50)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)), hit AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE doc_id > f),
cut AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 50 THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)), isle AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM cut),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM isle GROUP BY doc_id, k),
part AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
told AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM part JOIN d USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM n LEFT JOIN told USING (doc_id)"""

#: SQL can't say the others: they tokenise, hash with XXH64, cut by a search, or judge templates.  Their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": _REPEATS_SQL, "op3_line_dedup": _LINES_SQL, "op5_chat": _CHAT_SQL, "op7_quality": _quality_sql(), "op9_warc": _WARC_SQL}
