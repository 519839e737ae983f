"""The corpus pipeline: documents filtered by language and toxicity, freed of near duplicates, redacted and packed.

Each stage takes (spark, docs, sf_dir) and works on all documents the one before it kept; all but the last return the
columns of ``documents``. Learned models are fitted on the stage's own input and the labels of ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactsheet.llm import langid, ngram_join, packing, pii, queries, toxicity
from contactsheet.llm._common import crc_mod, materialise

#: A text is of none of the learned languages if its score is below so much of what nearly all learned texts of the nearest
#: one reach (all but one in a thousand).
LANGUAGE_MARGIN = 0.8


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification recognises: their score is not far below those of the texts that their
    language was learned from.

    Texts that are null, empty or without letters go. A null id or language takes no part in learning but is judged;
    repeated rows are judged each; whole texts are read, however long; an empty table gives an empty table. Columns
    ``__lang`` and ``__score`` of ``docs`` would be replaced; all others stay as they are.
    """
    train = ~(crc_mod("doc_id", 4) == 2)
    profiles = langid.learn(docs, train)
    least = langid.low_scores(docs, train, profiles)
    judged = langid.identify(docs, profiles, lang_as="__lang", score_as="__score")
    bound = F.lit(None).cast("double")
    for lang, low in least.items():  # one for each learned language
        bound = F.when(F.col("__lang") == lang, low * LANGUAGE_MARGIN).otherwise(bound)
    return judged.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= F.coalesce(bound, F.lit(0.0)))).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7.

    Null and empty texts have no toxic neighbours and stay; a null id stays and is judged; rows that repeat are judged
    each and alike; whole texts are read; further columns are carried, whatever their names. Without labels, or without
    both of them, no text is told toxic by its neighbours. An empty table gives an empty table.
    """
    model, rows = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=docs.columns)
    return toxicity.clean(model, rows).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8: the one of the least id, a null id
    last; of rows that repeat id and text one stays.

    Null and empty texts, and texts without words, are linked with nothing and all stay. Whole texts are compared; further
    columns are carried. An empty table gives an empty table.
    """
    return ngram_join.drop_near_duplicates(docs).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by their kinds; n_chars follows the new text.

    Null and empty texts stay what they are; ids may be null or repeat; whole texts are read; further columns are carried.
    An empty table gives an empty table.
    """
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into training sequences; the columns are those of ``packing.pack``.

    A null or empty text is its end id alone; null ids are carried, repeated rows packed each, and equal pieces that tie
    may change places. Further columns are ignored. An empty table gives an empty table.
    """
    return packing.pack(docs, queries.TOKENIZER, queries.RANKS, queries.PATTERN)


STAGES = [
    ("language", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages learn models and run automata, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole table of documents; each stage's output is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
