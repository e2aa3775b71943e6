"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns documents (same columns),
the last one the pieces of packed sequences.  A stage works on all that its
predecessor kept, and what it decides takes effect:

1. language identification: documents that it rejects go, with them null and
   empty texts and those without a letter;
2. line deduplication: later repeated runs of lines go from the texts (n_chars
   follows), and documents of which no line with a word is left;
3. SimHash near-duplicates: one row of each group stays, that with the smallest
   doc_id (null counts as the largest; of texts with the same doc_id that with
   the smallest digest, of rows that repeat both any one);
4. benchmark decontamination: documents with an occurring window go;
5. packing of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import contamination, language, lines, packing, simhash
from cartulary.llm.common import cut
from cartulary.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the language is recognised; a model is fitted to the labelled ones first.

    Null texts, texts without a letter and texts like no learned language go.
    Repeated rows and rows without an id are judged one by one; an empty table,
    or one without a labelled text, gives an empty one.
    """
    judged = language.identify(docs, language.fit(docs), docs.columns)
    return judged.where("not __rejected").select(*docs.columns)


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier one has; n_chars follows where it is there.

    A document of which all lines with a word go goes too; null and empty texts,
    which have none, stay.  Rows without an id neither take nor lose lines; an
    empty table stays empty.
    """
    shortened = lines.remove_lines(docs)
    left = shortened.where("__removed = 0 or __removed < __lines")
    if "n_chars" in docs.columns:
        length = F.when(F.col("__removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, also where ids repeat or are null.

    Null, empty and wordless texts have one fingerprint and so are one group.
    An empty table stays empty.
    """
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce(F.md5("text"), F.lit("none")))
    keyed = docs.withColumn("__row", row)
    groups = simhash.near_duplicates(keyed, carry=("__row",))
    counted = groups.groupBy("root", "__row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row", "n"))
    kept = cut(counted.groupBy("root").agg(first.alias("row")).select("row.__row", "row.n"))
    left = keyed.join(kept.where("n = 1"), "__row", "left_semi")
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():  # else the texts need not be dealt out once more
        left = left.unionAll(keyed.join(repeated, "__row", "left_semi").dropDuplicates(["__row"]))
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs; null and empty texts are clean, as all are for an empty benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.decontaminate(docs, benchmark, docs.columns)
    return found.where("__found.n_hit = 0").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null or empty text is its end token alone, an empty table gives none."""
    pieces = packing.pack(docs, *vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "key")


STAGES = [
    ("language identification", identify_language),
    ("line deduplication", deduplicate_lines),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can state neither the trained language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # the next stage reads its documents more than once
            docs = cut(docs)
    return docs
