"""A training corpus from `documents`: language ID, near-duplicates, decontamination, source mix, token ids.

Each stage reads what its predecessor wrote. All but the last return the columns of documents. In every stage texts are
read whole, however long, columns other than those named are handed on whatever their names, and an empty table gives an
empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkplan.llm.common import scratch, stored
from inkplan.llm.decontaminate import without_overlaps
from inkplan.llm.jaccard import one_of_each
from inkplan.llm.langid import fit, held_out, in_a_language
from inkplan.llm.mixing import mixture
from inkplan.llm.tokens import token_output

TOKENIZER = "word_bpe_49k.json"
#: Share of a document's letters that its main language has to hold.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language holds LEAST_SHARE of the letters, go.

    So null and empty texts go. Null langs are not fitted on; null doc_ids are kept by their text. Repeated rows all stay or
    all go; of languages that tie the first by code point counts.
    """
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return in_a_language(docs, model, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more, the smallest doc_id stays.

    Null and empty texts link with nothing and stay, rows with a null doc_id stay too. Of rows that repeat doc_id and text one
    stays; rows of one doc_id and different texts are one document and stay or go together.
    """
    return one_of_each(docs, k=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with an item of the benchmark go.

    Null and empty texts overlap with nothing and stay; null doc_ids and repeated rows are judged by their text alike. An empty benchmark removes
    nothing.
    """
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take up 5 : 2 : 1 of the words in turn; a document stands there as often as the mix takes it.

    Texts without words, null or empty, are never taken. A null source is one of its own, last; a null doc_id is like any
    other. Rows that repeat in doc_id, source and text are taken together; other ties go by a seeded hash.
    """
    return mixture(docs, (5, 2, 1))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as wavelet matrix shards, read back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone. Null doc_ids come first; repeated rows stand side by side, ties go by the text.
    """
    return token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: SQL can't express these stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{base}/{i}")
    return docs
