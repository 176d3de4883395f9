"""A training corpus from the table of documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the columns
of their docs. Rows with a null doc_id pass the stages that compare documents unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinset.llm.anchors import id_filter, matching, rows_in
from kinset.llm.mixing import mixed_rows
from kinset.llm.ngram_join import ngram_jaccard_join, with_set_key
from kinset.llm.pieces import encode_texts
from kinset.llm.queries import held_out, table, tokenizer_path
from kinset.llm.repeats import remove_repeats
from kinset.llm.text import fresh
from kinset.llm.toxicity import score, train
from kinset.plans.session import settle

#: Words of an n-gram in the stage of near duplicates.
WORDS = 5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, by the cut of their language.

    Null and empty texts have the score of no words; rows with a null doc_id are judged like all
    others. Repeated rows have equal scores, so all of them stay or go.
    """
    net = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    out, *names = fresh(docs.columns, "score", "cut", "rejected")
    # The scores come in columns of these names.
    aside = dict(zip(("cut", "rejected"), names, strict=True))
    kept = score(docs.withColumnsRenamed(aside), net, out=out, accepted_only=True)
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Texts are judged each for itself, also where rows repeat a doc_id: then the text that links
    with another goes, and one that resembles nothing stays. Of rows that repeat a doc_id and a
    text (or its set of n-grams) one stays. Null and empty texts resemble nothing; rows with a
    null doc_id stay as they are.
    """
    found = settle(ngram_jaccard_join(docs, words=WORDS).where("doc_id is not null"))
    name, first = fresh(docs.columns, "key", "first")
    kept = found.where("n_shingles > 0").groupBy("text_group").agg(F.min(F.struct("doc_id", "set_key")).alias("best"))
    members = found.where("n_shingles > 0").join(kept, "text_group")
    gone = members.where(F.struct("doc_id", "set_key") != F.col("best")).select("doc_id", F.col("set_key").alias(name))
    gone = settle(gone.distinct().withColumn(first, F.lit(1)))
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Only rows that may go, or that repeat an id, are moved.
    bits = id_filter(gone.select("doc_id").unionByName(again))
    shared = spark.sparkContext.broadcast(bits)  # fixed size
    moved = with_set_key(docs, "text", WORDS, name, lambda part: matching(part, "doc_id", shared.value))
    moved = moved.join(gone, ["doc_id", name], "left").where(F.col(first).isNull()).drop(first)
    # An empty set says nothing about its text.
    moved = moved.withColumn(name, F.when(F.col(name) != 0, F.col(name)).otherwise(F.xxhash64("text")))
    one = moved.dropDuplicates(["doc_id", name]).select(*docs.columns)
    return one.unionByName(rows_in(docs, "doc_id", bits, wanted=False))


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 200-byte strings that repeat (to whole characters); those of which
    nothing remains go.

    Null, empty and short texts stay as they are, and so do rows with a null doc_id. Repeated rows
    count as equal texts, of which nothing remains if they are as long as that.
    """
    cut = remove_repeats(docs, whole_characters=True)
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    return cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources: every row as often as it is taken, in the shuffled order of its shard.

    A null source is a source. Rows without words have no size and are not taken; repeated rows
    are rows of their own, and a null doc_id is a value like others.
    """
    return mixed_rows(docs, tuple(fresh(docs.columns, "shard", "place"))).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and the text decoded from them.

    A null text counts as empty and has no ids; every row, repeated or with a null doc_id, stays.
    """
    coded = encode_texts(docs, tokenizer_path())
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_array", suffix_array),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Learnt scores and hashed draws have no SQL; tests/llm compares the stages with plain models.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
