"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docshape.llm.common import table, tokenizer_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.common import written
    from docshape.llm.media import audio_features, store_wav, with_feature_digest

    # The media column is a table of its own, and features come from what is read back from there.
    return with_feature_digest(audio_features(written(store_wav(table(spark, sf_dir, "documents")), "media")))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.chat import fit_roles, parse_transcripts, transcripts_of

    transcripts = transcripts_of(table(spark, sf_dir, "conversations"))
    return parse_transcripts(transcripts, fit_roles(transcripts), keep=("conv_id", "held_out", "n_true", "true_roles"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.quality import apply_quality_rules

    judged = apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docshape.llm.sentence_dedup import dedup_sentences

    return dedup_sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS t FROM s),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 60 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a)
SELECT n.doc_id, n.n AS n_shingles, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_similar, (SELECT min(root) FROM r WHERE r.a = n.doc_id) AS component_id FROM n
"""


def oracle_sql() -> dict[str, str]:
    """SQL of whole results. The others use hashes, transforms, tokenizers or fitted models that SQL lacks; tests compare them with brute force."""
    return {"op3_ngram_jaccard_join": _OP3}
