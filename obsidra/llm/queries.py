"""The production query of each corpus operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread


def op1_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recompression import substring_dedup

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The vocabulary file of the SentencePiece query; read on the driver only.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode, load

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode(docs, load(PIECE_MODEL)).select("doc_id", "n_ids", "ids", "round_trip")


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rangejoin import near_vectors

    return near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("matches")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import suffix_dedup

    done = suffix_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orderhash import near_duplicates

    return near_duplicates(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import graded, score, train

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = train(docs, graded(read_table(spark, sf_dir, "labels")))
    return score(docs, model).drop("text")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")), with_text=False)


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hashforest import search

    return search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filteraudit import audit, document_cells

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return audit(document_cells(docs, read_table(spark, sf_dir, "labels")), "ABCDE", lost={"good_lost": "good", "toxic_lost": "toxic"})


#: The vocabulary file of the byte-level queries; read on the driver only.
BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenalign import align

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return align(docs, Path(BYTE_VOCABULARY).read_text(), Path(PIECE_MODEL).read_bytes())


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bestpack import pack

    return pack(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), Path(BYTE_VOCABULARY).read_text())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_recompression_dedup": op1_recompression_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_pivot_range_join": op4_pivot_range_join,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_order_minhash": op7_order_minhash,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_hash_prefix_forest": op10_hash_prefix_forest,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_alignment": op12_token_alignment,
    "op13_pattern_packing": op13_pattern_packing,
}

OP1_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
    SELECT doc_id, unnest(range(1, len(words) - 18)) AS p, words FROM w WHERE len(words) >= 20
), windows AS (
    SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(words[p : p + 19], ' ') ORDER BY doc_id, p) AS nth FROM starts
), gone AS (
    SELECT doc_id, list(DISTINCT p + k) AS places FROM (SELECT doc_id, p, unnest(range(0, 20)) AS k FROM windows WHERE nth > 1) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: NOT coalesce(list_contains(places, i), false)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""

OP4_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
    SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id != b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, least(v.vec_id, coalesce(r.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(r.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON v.vec_id = l.a LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON v.vec_id = r.a
"""



def op5_sql() -> str:
    """The scan in SQL: every place of a template's key phrase is tried, without an index."""
    from .licenses import BASE, TEMPLATES

    listed = ", ".join(f"({k}, '{t.label}', {t.words!r}, {t.places[0][0]}, {t.places[0][1]!r})" for k, t in enumerate(TEMPLATES))
    phrases = ", ".join(f"({k}, {at}, {phrase!r})" for k, t in enumerate(TEMPLATES) for at, phrase in t.places)
    base = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM o WHERE words[i + 1 : i + {len(phrase.split())}] = {phrase.split()!r}" for phrase, label in BASE.items()
    )
    return rf"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), t(k, label, notice, lead, key) AS (VALUES {listed}
), ph(k, lead, phrase) AS (VALUES {phrases}
), o AS (
    SELECT doc_id, words, unnest(range(0, len(words))) AS i, unnest(words) AS word FROM d
), place AS (
    SELECT o.doc_id, o.words, t.k, t.label, t.notice, o.i - t.lead AS off FROM o JOIN t ON o.word = t.key[1] AND o.words[o.i + 1 : o.i + len(t.key)] = t.key
), whole AS (
    SELECT doc_id, label, off, any_value(words) AS words, any_value(notice) AS notice
    FROM place JOIN ph ON place.k = ph.k GROUP BY doc_id, place.k, label, off HAVING bool_and(off + ph.lead >= 0 AND words[off + ph.lead + 1 : off + ph.lead + len(phrase)] = phrase)
), aligned AS (
    SELECT doc_id, label, len(list_filter(range(0, len(notice)), lambda j: off + j >= 0 AND off + j < len(words) AND words[off + j + 1] = notice[j + 1])) / CAST(len(notice) AS DOUBLE) AS share FROM whole
), found AS (
    SELECT doc_id, label, share FROM aligned WHERE share >= 0.5
), base AS ({base}
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
       coalesce(f.share, CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM d
LEFT JOIN (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id) b ON d.doc_id = b.doc_id
LEFT JOIN (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id) f ON d.doc_id = f.doc_id
LEFT JOIN (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY doc_id) l ON d.doc_id = l.doc_id
"""


#: Every order of the filters is run through, step by step.
OP11_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
            'D': regexp_matches(text, '[#$%&*|]'), 'E': w.doc_id > min(w.doc_id) OVER (PARTITION BY text)} AS fails
    FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), letters(letter) AS (
    VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders(o) AS (
    SELECT '' UNION ALL SELECT o || letter FROM orders JOIN letters ON NOT contains(o, letter)
), kinds AS (
    SELECT part, good, toxic, list_sort(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: struct_extract(fails, 'A') AND x = 'A' OR struct_extract(fails, 'B') AND x = 'B'
           OR struct_extract(fails, 'C') AND x = 'C' OR struct_extract(fails, 'D') AND x = 'D' OR struct_extract(fails, 'E') AND x = 'E')) AS failed, count(*) AS n
    FROM f GROUP BY ALL
), steps AS (
    SELECT o AS filter_order, step, o[step] AS letter, string_split(o[1 : step - 1], '') AS before, string_split(o[1 : step], '') AS after
    FROM orders, range(1, 6) s(step) WHERE length(o) = 5
), done AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN NOT list_has_any(failed, after) THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN list_contains(failed, letter) AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN list_contains(failed, letter) AND list_has_any(failed, before) THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = [letter] THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN good AND list_contains(failed, letter) AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS good_lost,
           sum(CASE WHEN toxic AND list_contains(failed, letter) AND NOT list_has_any(failed, before) THEN n ELSE 0 END) AS toxic_lost
    FROM kinds, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM done
"""

ORACLES: dict[str, str] = {"op11_filter_audit": OP11_SQL, "op5_license_scan": op5_sql(), "op4_pivot_range_join": OP4_SQL, "op1_recompression_dedup": OP1_SQL}
