"""Queries of this subpackage for the driver: opN_<name> over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bit_sliced import top_k
from .bpe import encode_and_decode
from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle, restored
from .filter_audit import audit_filters
from .html_extract import extract_main_text
from .katz import score_documents
from .packing import pack_documents
from .quality import score_quality
from .simhash import simhash_components
from .syncmers import compare_with_edits
from .url_filters import filter_urls, rule_table
from .warc import archive_pages

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("form"), F.col("output")), 256)}
    return made.withColumns(digests).drop("output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_simhash": op2_simhash,
        "op3_url_filters": op3_url_filters,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_html_extraction": op6_html_extraction,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_warc": op8_warc,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_fingerprints": op10_fingerprints,
        "op11_filter_audit": op11_filter_audit,
        "op12_top_k": op12_top_k,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
        "op3_url_filters": r"""
            WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
                     ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
                 rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
                 split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
            SELECT s.page_id, s.host, s.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
                   coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
            FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
            GROUP BY s.page_id, s.host, s.path""",
        "op11_filter_audit": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
                 l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
                 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                              [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
                               doc_id > min(doc_id) OVER (PARTITION BY text)] AS fails FROM d LEFT JOIN l USING (doc_id)),
                 m AS (SELECT part, list_sum(list_transform(range(5), lambda i: CASE WHEN fails[i + 1] THEN (1 << i) ELSE 0 END))::INTEGER AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
                 x AS (SELECT chr(65 + i::INTEGER) AS x, i::INTEGER AS i FROM range(5) t(i)),
                 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
                 s AS (SELECT filter_order, k::INTEGER AS step, ascii(substr(filter_order, k::INTEGER, 1)) - 65 AS place,
                              coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(substr(filter_order, j::INTEGER, 1)) - 65))), 0)::INTEGER AS before FROM o, range(1, 6) t(k)),
                 c AS (SELECT part, filter_order, step, place, sum(CASE WHEN mask & (before | (1 << place)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & (1 << place) <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                              sum(CASE WHEN mask & (1 << place) <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = 1 << place THEN n ELSE 0 END) AS unique_fails,
                              sum(CASE WHEN mask & (1 << place) <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & (1 << place) <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
            SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
                   (sum(removed) OVER (PARTITION BY part, place))::BIGINT AS shapley FROM c""",
        "op12_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings),
                 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
                 r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op13_fill_in_middle": r"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS words, sha256('42:' || doc_id) AS h FROM documents),
                 n AS (SELECT *, CAST(len(words) AS BIGINT) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, (1 + 8 * i)::INTEGER, 8))::BIGINT) AS g FROM d),
                 c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
                              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 50 THEN 'plain' WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
                 t AS (SELECT doc_id, n, form, text, array_to_string(words[1:a], '') AS prefix, array_to_string(words[a + 1:b], '') AS middle, array_to_string(words[b + 1:], '') AS suffix FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM t""",
    }
