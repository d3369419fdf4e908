"""The opN_* queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=75)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the public model, which is BPE: its scores are merge ranks, so that the cut with
    the greatest sum (``kind="unigram"``, Viterbi) is not what its library gives.  The same
    single pass over the automaton's output links is made, but a link is relaxed by whether its
    piece goes with the last one of the prefix before it, which gives the library's ids.
    """
    from driftlens.llm.pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.gif import media

    return media(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.fim import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftlens.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_line_dedup": r"""
            WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
            ), lines AS (
                SELECT r, doc_id, i, line,
                       translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM docs)
            ), often AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE o.key IS NOT NULL) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
            FROM lines l LEFT JOIN often o ON l.key = o.key GROUP BY r, doc_id
        """,
        "op12_fill_in_middle": r"""
            WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS hash FROM documents
            ), u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM h
            ), g AS (SELECT *, len(units) AS n, [CAST('0x' || hash[8 * i + 1 : 8 * i + 8] AS UBIGINT) for i in range(4)] AS r FROM u
            ), c AS (
                SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS low, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS high,
                       CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g
            ), t AS (SELECT *, coalesce(array_to_string(units[1 : low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1 : high], ''), '') AS middle, coalesce(array_to_string(units[high + 1 : n], ''), '') AS suffix FROM c
            ), o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END AS output FROM t)
            SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
                   sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
        """,
    }
