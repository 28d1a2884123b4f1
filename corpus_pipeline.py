"""A corpus pipeline of five stages: language ID, near-duplicates, pseudonyms, mixing, and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns that they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from xancestry.llm import bpe, langid, minhash, mixing, pii
from xancestry.llm.common import cut, deleted, exact, fresh, released
from xancestry.llm.queries import BPE_FILE, DEMO_KEY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter go."""
    pred = fresh(docs, "lang_pred")
    model = langid.train(langid.learnable(docs))
    out = langid.with_language(docs, model, "text", pred, fresh(docs, "ambiguous"))
    return out.where(exact(pred) != "und").select(*map(exact, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (five-word shingles, Jaccard similarity 0.8), the one with the smallest id.

    Candidates come from SimHash, of the 4 bits that its own query asks for, and then from MinHash bands, as those bits find 4 of 48
    such pairs (README) and of more bits SimHash has no index that prunes. Every one is verified.
    """
    return minhash.one_of_each(docs, threshold=0.8)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return pii.pseudonymise(docs, DEMO_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of 150 % of all words takes them, each source twice at most."""
    return mixing.repeated(docs, weights=(5, 2, 1), percent=150, epochs=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with the digests of what was encoded and decoded."""
    return bpe.encode_documents(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("pseudonyms", private_data),
    ("mixing", mixture),
    ("tokens", tokens),
]

#: SQL can express neither the classifier nor the tokens; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again; what no stage reads any more is deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = cut(out)
        released(out)
        deleted(last)
        last = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
