"""A cleaned, mixed and packed corpus: the stages in order, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``.

1. language: documents whose language can't be told are rejected; the others keep their label, and
   get the predicted one where they have none.
2. exact: of equal texts one stays.
3. near: of each class of near copies one stays.
4. mix: sources are mixed to their target weights; a document comes once per turn of the mix, with
   the words that the turn takes.
5. pack: documents become token pieces in sequences of 2048 tokens; the result is one row per piece.

Defined cases are those of the operators: a null or empty text has no language and leaves in the first
stage, as does one without a letter; of repeated rows and ties the exact stage keeps one; a null key
stays null; an empty table gives an empty result; other columns pass through to the packing, which
keeps the key only.
"""

from towerlens.llm import exact_dedup, jaccard_join, language, mixing, packing  # isort: skip

import public_tokenizers
from pyspark.sql import functions as F

from towerlens.session import small_batches, work_folder

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"


def keep_known_languages(spark, docs, sf_dir):
    small_batches(spark)
    found = language.predict(docs, language.fit(docs)).filter("accepted")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def keep_one_of_equal(spark, docs, sf_dir):
    return exact_dedup.survivors(docs)


def keep_one_of_near(spark, docs, sf_dir):
    small_batches(spark)
    return jaccard_join.representatives(docs)


def mix_sources(spark, docs, sf_dir):
    small_batches(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    small_batches(spark)
    pieces = packing.pieces(docs, public_tokenizers.path(TOKENIZER), CAPACITY)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim, CAPACITY)


STAGES = [
    ("language", keep_known_languages),
    ("exact", keep_one_of_equal),
    ("near", keep_one_of_near),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

# No SQL: compression sizes, pseudorandom draws and packing have none; tests use plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over ``documents``; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
