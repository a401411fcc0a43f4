"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next one reads it.
All but the last return the columns of documents. Rows with a null id are documents like others; they have no
earlier copy to lose lines to in line_dedup, and lose to a copy with an id in near_duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.jaccard import jaccard_components
from lodestone.llm.langid import UNDETERMINED, identify, learn
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.mixing import WORD, mix_sources
from lodestone.llm.packing import pack_documents
from lodestone.scratch import materialize, release, tidy
from lodestone.sources.corpus import spread

import public_tokenizers  # isort: skip - behind lodestone.llm, whose absence the entry point looks for

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text stays if its language has the majority of its letters and a letter is no more than e**5 times less likely in it
#: than in text learned from. Clean short texts with a license line in English reach 0.5 and -4; text in a language that
#: wasn't learned lies at -7 and below.
LEAST_SHARE, LEAST_FIT = 0.5, -5.0
MIX_SEED = 7
MIX_WEIGHTS = {"lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 8}}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, without a language that has the majority, or in none that was learned; fills in languages that are missing."""
    model = learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    named = identify(docs.select(*COLUMNS), model)
    kept = named.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SHARE) & (F.col("fit") >= LEAST_FIT))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of passages; documents that are nothing else go."""
    cut = dedup_lines(docs.select(*COLUMNS))
    left = cut.where((F.col("removed_words") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return left.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every component: the smallest id, a null id last, of one id the row with the least hash.

    Rows are told apart by a hash of all their columns, so several texts of one id are several documents and
    rows that are equal throughout are one.
    """
    rows = docs.select(*COLUMNS).distinct().withColumn("row", F.xxhash64(*COLUMNS))
    rows = materialize(rows, "rows")
    found = jaccard_components(rows, count_links=False, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))
    hung = materialize(found.where("row <> root"), "hung")
    members = hung.union(hung.select("root", "root").distinct()).join(rows.select("row", "doc_id"), "row")
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("root", "first.row")
    others = materialize(members.select("root", "row").join(first, ["root", "row"], "left_anti").select("row"), "others")
    return rows.join(others.hint("merge"), "row", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the target mixture takes in one epoch; the document in which a leaf's prefix ends is cut there.

    The languages get their weights: the scarcest of them is taken whole, the others as much as its weight allows. Within a language sources share
    by weight, and those that run short leave the rest to the others.
    Rows with the same id and text are taken together.
    """
    keyed = docs.select(*COLUMNS).withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")))
    taken = mix_sources(keyed, {"lang": F.col("lang"), "source": F.col("source")}, MIX_WEIGHTS, None, MIX_SEED, id_col="key")
    chosen = taken.groupBy(F.col("doc_id").alias("key")).agg(F.max("take_tokens").alias("take"), F.max("n_tokens").alias("whole"))
    chosen = materialize(chosen.select("key", "take", (F.col("take") < F.col("whole")).alias("cut")), "chosen")
    rows = keyed.join(chosen.hint("merge"), "key")
    words = F.regexp_extract_all("text", F.lit(rf"[ \t\n\x0B\f\r]*{WORD}"), F.lit(0))  # each with the blanks before it
    prefix = F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("cut"), prefix).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens along the Hilbert curve."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: Language ID and packing can't be written as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        with tidy(spark) as kept:
            after = materialize(stage(spark, docs, sf_dir), name)
            kept.append(after)
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
