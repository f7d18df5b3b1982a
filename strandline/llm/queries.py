"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.substring_dedup import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), window=35, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels"), with_text=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), length=400, with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.chat import digests, format_chats

    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    return digests(format_chats(turns.unionByName(more)))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandline.llm.shared import new_path
    from strandline.llm.token_files import read_token_files, write_token_files

    path = new_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path, with_ids=False)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.ogg import media_columns, read_media

    stored = media_columns(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    return read_media(stored).drop("error")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandline.llm.bpe import bpe_round_trip

    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, with_text=False)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.minhash_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, part=80, whole=100, with_text=False)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.order_minhash import order_fingerprints

    return order_fingerprints(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"), _table(spark, sf_dir, "labels"), with_text=False)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.shared import new_path
    from strandline.llm.warc import read_archives, write_archives

    path = new_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archives(spark, path)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.periodic import periodic_runs, planted

    return periodic_runs(_table(spark, sf_dir, "documents", "doc_id", "text"), least=6, times=4, rewrite=planted, with_text=False)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.resampling import importance_resample

    docs, target = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text")
    return importance_resample(docs, target, most_words=1, buckets=10_000, least_words=20, part=(10, 100), seed="2024")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_chat_format": op2_chat_format,
        "op3_token_files": op3_token_files,
        "op4_quality": op4_quality,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_ogg_media": op6_ogg_media,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_order_minhash": op9_order_minhash,
        "op10_mixing": op10_mixing,
        "op11_warc": op11_warc,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_importance_resampling": op13_importance_resampling,
    }


_OP1 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), rep AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN rep USING (s))
), x AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), k AS (
  SELECT x.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""


_OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    replace(replace(replace(role, '\', '\\'), '[', '[\'), '<', '<\') AS safe_role, replace(replace(replace(text, '\', '\\'), '[', '[\'), '<', '<\') AS safe_text,
    role || chr(10) || text AS x
  FROM t
), f AS (
  SELECT *, contains(x, '<s>') OR contains(x, '</s>') OR contains(x, '[INST]') OR contains(x, '[/INST]') OR contains(x, '\\') OR contains(x, '[\') OR contains(x, '<\') AS conflict FROM e
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN conflict THEN length(safe_role) + length(safe_text) ELSE length(role) + length(text) END + CASE WHEN role = 'assistant' THEN 16 ELSE 18 END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

_OP5 = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), blocks AS (
  SELECT doc_id, n, j, substr(x, 2000 * j + 1, 2798) AS y FROM (SELECT *, unnest(range(0, (n + 999) // 1000)) AS j FROM t)
), w AS (
  SELECT doc_id, 1000 * j + o AS p, sha256(substr(y, 2 * o + 1, 800)) AS s FROM (SELECT *, unnest(range(0, greatest(0, least(1000, n - 399 - 1000 * j)))) AS o FROM blocks)
), begins AS (
  SELECT doc_id, p FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
), b AS (
  SELECT doc_id, 1000 * j + o AS p, substr(y, 2 * o + 1, 2) AS h FROM (SELECT *, unnest(range(0, least(1000, n - 1000 * j))) AS o FROM blocks)
), f AS (
  SELECT b.doc_id, b.p, h, max((begins.p IS NOT NULL)::INTEGER) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone
  FROM b LEFT JOIN begins ON begins.doc_id = b.doc_id AND begins.p = b.p
), g AS (
  SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f
), k AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans, string_agg(h, '' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id
)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""

_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), half AS (
  SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), link AS (
  SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.seen
), c AS (
  SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


_OP11 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT h, min(page_id) AS first,
    array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
      lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * g::INTEGER, 5))::BIGINT >> s) & 31)::INTEGER, 1)), '')), '') AS payload_digest
  FROM p GROUP BY h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN d USING (h)
"""


#: DuckDB has no CRC-32: its table by eight shifts, and a fold over the bytes of each distinct word.
_OP13 = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), e AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), f AS (
  SELECT doc_id, unnest(ws) AS w FROM d
), u AS (
  SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM e)
), b AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INTEGER + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS b
  FROM u, crc
), s AS (
  SELECT b, count(*) AS s FROM f JOIN b USING (w) GROUP BY b
), t AS (
  SELECT b, count(*) AS t FROM e JOIN b USING (w) GROUP BY b
), g AS (
  SELECT k.b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS b) AS k LEFT JOIN s ON s.b = k.b LEFT JOIN t ON t.b = k.b
), w AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN b USING (w) JOIN g USING (b) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w ON w.doc_id = d.doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k FROM c
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= (SELECT 10 * count(*) // 100 FROM c WHERE n_features >= 20) THEN k END AS rank FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": _OP1, "op2_chat_format": _OP2, "op5_suffix_dedup": _OP5, "op8_minhash_dedup": _OP8, "op11_warc": _OP11, "op13_importance_resampling": _OP13}
