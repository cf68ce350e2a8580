"""Pipeline over documents: toxic documents and near copies go, repeated passages are cut, documents with benchmark passages go, the rest is tokenized."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm import bpe, decontam, jaccard, suffix, toxicity
from rivulet.llm.common import discard, stored, table


def beside(docs: DataFrame, made: list[str], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """apply(docs) with the columns of docs; those whose names apply uses itself (made) have others meanwhile."""
    names: dict[str, str] = {}
    for c in docs.columns:
        if c in made:
            names[c] = f"{c}_of_input"
            while names[c] in docs.columns or names[c] in made:
                names[c] += "_"
    return apply(docs.withColumnsRenamed(names)).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def row_key() -> Column:
    """Tells rows apart whose ids are null or repeated, but for those equal in id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.3. Null and empty texts stay; a row's fate depends on its text only, so repeated rows share it."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return beside(docs, ["toxicity", "toxic_spans"], lambda d: toxicity.scored(d, "text", model).filter("toxicity < 0.3"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more: the smallest id (a null one last), then the lowest hash.

    Decided by row, so rows with a null id, or different texts of one id, are
    documents like others. Of rows equal in id and text one stays. Null and
    empty texts are linked with nothing.
    """

    def apply(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("row_key", row_key())
        found = stored(jaccard.jaccard_components(keyed, "row_key", "text", width=5, percent=80), "groups")
        ids = keyed.select(F.col("row_key").alias("id"), F.col("doc_id").isNull().alias("last"), "doc_id")
        first = found.join(ids, "id").groupBy("component_id").agg(F.min(F.struct("last", "doc_id", "id")).alias("first")).select(F.col("first.id").alias("row_key"))
        one = Window.partitionBy("row_key", "doc_id", "text").orderBy("n_chars")
        return keyed.join(first, "row_key", "left_semi").withColumn("row_place", F.row_number().over(one)).filter("row_place = 1")

    return beside(docs, ["row_key", "row_place"], apply)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that occur earlier (characters cut in two stay whole); n_chars follows.

    A document of which nothing but white space is left goes; one that had no
    more before stays. Null and short texts stay as they are.
    """

    def apply(d: DataFrame) -> DataFrame:
        out = suffix.without_repeats(d, "doc_id", "text", whole_characters=True)
        lost = F.coalesce((F.col("n_removed") > 0) & (F.trim(F.regexp_replace("kept", r"\s+", " ")) == ""), F.lit(False))
        text = F.when(F.col("text").isNotNull(), F.col("kept"))
        return out.filter(~lost).withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return beside(docs, ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "__doc", "__tag", "__runs"], apply)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, whole or paraphrased. Decided by row, null ids too; null and empty texts stay."""

    def apply(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("row_key", row_key())
        found = decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), "row_key").select(F.col("id").alias("row_key")).distinct()
        return keyed.join(found, "row_key", "left_anti")

    return beside(docs, ["row_key", "__id"], apply)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    import public_tokenizers

    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return bpe.encoded(docs.select("doc_id", "lang", "source", "text"), "text", codec).drop("text")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("tokenization", tokenized),
]
#: Learned scores and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
