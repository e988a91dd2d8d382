"""A corpus pipeline of four stages: language ID, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and reread as the next stage's docs. All but the last return the
columns of docs, whatever further ones there are. Rows are never merged but
where a stage says so, and no stage needs an id to be there or to be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespark.llm.common import document_key, materialize, release, written
from clonespark.llm.language import UNDECIDED, identify, remainder, train
from clonespark.llm.minhash import near_duplicates
from clonespark.llm.mixing import mix_sources, taken_words
from clonespark.llm.packing import pack_documents

#: Of the n-grams of a text in a language that was learned, more than this share is known to it.
LEAST_KNOWN = 0.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one that was learned.

    The model learns from the labelled documents; a document goes if its text
    is null, has no letter, or is in none of the languages. Without labelled
    documents none stays.
    """
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    found = identify(docs, model, names=("__lang", "__score", "__known"))
    return found.filter((F.col("__lang") != UNDECIDED) & (F.col("__known") > LEAST_KNOWN)).select(*docs.columns)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id.

    Documents without words, null and empty texts too, are copies of nothing
    and stay, but for repeated rows: of those alike in id and text one stays.
    """
    found = materialize(near_duplicates(docs).select("key", "first"), "found")
    kept = docs.withColumn("__kept_key", document_key("doc_id", "text")).join(found.filter("first").select(F.col("key").alias("__kept_key")), "__kept_key", "left_semi")
    return one_each(kept, found).select(*docs.columns)


def one_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with one row for each kept_key; the texts are shuffled only where keys has repeats."""
    if keys.groupBy("key").count().filter("count > 1").isEmpty():
        return docs
    return docs.dropDuplicates(["__kept_key"])


def first_words(text: str, n: Column) -> Column:
    """The first n words of a text, with the white space before each."""
    return F.concat_ws("", F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, and their first words where it takes no more.

    The schedule goes through a source's line round by round, so of a document
    it takes whole copies and, where the last round ends, some first words:
    these become a row of their own, with n_chars to match if there is such a
    column. The words of a source's rows are what the mix takes, to the word.
    Documents without words, null and empty texts too, are in no mix. Rows alike
    in id and text are taken together.
    """
    taken = materialize(taken_words(*mix_sources(docs)).select("key", "size", "taken"), "taken")
    whole = F.floor(F.col("taken") / F.col("size"))
    some = F.col("taken") % F.col("size")
    cuts = F.concat(F.array_repeat(F.lit(None).cast("long"), whole.cast("int")), F.when(some > 0, F.array(some)).otherwise(F.array().cast("array<bigint>")))
    of_key = taken.filter("taken > 0").select(F.col("key").alias("__kept_key"), F.explode(cuts).alias("__words"))
    # A key's cuts come together once; rows alike in all else give as many rows as all of them are taken.
    often = materialize(of_key.groupBy("__kept_key", "__words").agg(F.count("*").alias("__times")), "often")
    keyed = docs.withColumn("__kept_key", document_key("doc_id", "text"))
    mixed = one_each(keyed, taken).join(often, "__kept_key")
    dealt = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__times")))
    cut = F.col("__words").isNotNull()
    out = dealt.withColumn("text", F.when(cut, first_words("text", F.col("__words"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences; a null or empty text is an end id alone."""
    return pack_documents(docs)


STAGES = [("language ID", language_stage), ("near-duplicates", duplicates_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Hashing, mixing and tokenizing have no SQL; the tests compare to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. What a stage wrote on its way goes once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
