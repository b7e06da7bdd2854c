"""A corpus pipeline: toxicity, near-duplicates, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
`documents`; the last returns one row per document with its mix and token columns digested.

Where a stage joins what it found back to its rows, the row travels as one struct and the join is by its doc_id, a hash of its
text and, in the mixing, its source: no name of an input column can clash, and rows that share a doc_id are told apart.

Defined results: null and empty texts pass every stage unchanged (the mixing gives them no words, so they are taken as its
thresholds say); repeated rows are decided alike; of equal texts the one with the smallest doc_id stays, and exact repetitions of
that row stay with it; ties in the mixing are broken by a hash of the row; very long texts are read whole; a null doc_id is never a
duplicate; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.llm import minhash, mixing, pieces, substrings, toxicity
from tallyspark.session import cut

#: Near-duplicates: words of a shingle and least similarity in percent.
SHINGLE_WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labels of all documents at hand; documents that are predicted toxic go. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return toxicity.keep_clean(docs, model)


def _rows(docs: DataFrame) -> DataFrame:
    """row (all columns), id, key (a hash of the text)."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; documents without words stay."""
    found = minhash.decided(docs, SHINGLE_WORDS, PERCENT)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("id"), "key").distinct()
    return _rows(docs).join(gone, ["id", "key"], "left_anti").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out; documents that lose nothing keep their text as it is.

    A changed text is its remaining words joined by one space, and n_chars follows it.
    """
    changed = substrings.changed_texts(docs).select(F.col("doc_id").alias("id"), "key", "new_text").distinct()
    joined = _rows(docs).join(changed, ["id", "key"], "left")
    new = {"text": F.coalesce("new_text", "row.text")}
    if "n_chars" in docs.columns:
        kept = F.when(F.col("new_text").isNotNull(), F.length("new_text")).otherwise(F.col("row.n_chars"))
        new["n_chars"] = kept.cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes: none, one or two rows."""
    copies = (mixing.mix(docs).where(F.col("copies") > 0)
              .groupBy(F.col("doc_id").alias("id"), "source", "hash").agg(F.max("copies").alias("copies")))
    rows = _rows(docs).withColumns({"source": F.col("row.source"), "hash": mixing.row_hash("row.")})
    x, y = rows.alias("x"), copies.alias("y")
    joined = x.join(y, F.col("x.id").eqNullSafe(F.col("y.id")) & F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.hash") == F.col("y.hash")))
    return joined.select("x.row", F.explode(F.sequence(F.lit(1), F.col("y.copies"))).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return pieces.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The toxicity model and the tokenizer have no form in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs)
    return docs
