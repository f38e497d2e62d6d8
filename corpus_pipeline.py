"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's ``docs``; all but the last return the documents' columns.

1. quality rules: documents that the base rules or the learnt cutoffs reject go;
2. near duplicates: of documents linked by n-gram Jaccard similarity one stays;
3. secret scans: every secret in a text is masked, the document stays;
4. mixing: documents are repeated or left out until each source gives its share;
5. packing: documents are tokenized and packed into sequences.

Defined cases, in every stage: columns beside doc_id, text, lang, source are kept as they
are, whatever their names; an empty table gives an empty one; texts of any length are
read whole. Null or empty texts fail the quality rules (stage 1); given to the others
they stay (2: each is a group of its own; 3: null stays null; 5: the end token alone),
but a mix takes no document without words (4). A null id is the largest (2) and stays
null; a null language or source is one of its own. Of rows that are equal in id and
text one stays (2); elsewhere each counts for itself. Of equal texts the smallest id
stays (2); equal sizes are chosen from by hash (4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshape.llm.common import drop_written, table, tokenizer_path, written
from docshape.llm.jaccard import one_per_group
from docshape.llm.mixing import mixed_documents
from docshape.llm.packing import pack_documents
from docshape.llm.quality import keep_good
from docshape.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scans", secret_scans), ("source mixing", source_mixing), ("packing", packing),
]

#: No SQL: the learnt cutoffs, the Markov chains and the packing are beyond it; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if spent is not None:
            drop_written(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
