"""Views of the corpus, and readers and writers for id lists and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.records import paper_key, yes

RAW_RECORD = (
    "id string, source string, title string, authorString string, pmid string, pmcid string, doi string, abstractText string, pubYear string, isOpenAccess string, hasPDF string, inEPMC string, "
    "authorList struct<author: array<struct<firstName: string, lastName: string, fullName: string, authorAffiliationDetailsList: struct<authorAffiliation: array<struct<affiliation: string>>>>>>, "
    "fullTextIdList struct<fullTextId: string>, fullTextUrlList struct<fullTextUrl: string>, journalInfo struct<journal: struct<title: string>>"
)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores if it comes in fewer partitions than there are: a small file's one row group can't be split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): the distinct lines of a text file, trimmed, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records of a JSON file that holds one array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def with_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is listed."""
    return records.join(ids, "id", "left_semi")


def missing_ids(ids: DataFrame, records: DataFrame) -> DataFrame:
    """The listed ids that no record has, in order."""
    return ids.join(records.select("id"), "id", "left_anti").orderBy("id")


def papers(docs: DataFrame) -> DataFrame:
    """documents as papers: title and abstract are the first two lines, keys and flags follow from the id by rule."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    text = lambda c: F.coalesce(c, F.lit(""))
    five = F.col("doc_id") % 5 == 0
    out = docs.select(
        "doc_id",
        F.when(~five, F.col("doc_id").cast("string")).otherwise("").alias("pmid"),
        F.when(five & (F.col("doc_id") % 10 != 0), F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string"))).otherwise("").alias("doi"),
        text(F.get(lines, F.lit(0))).alias("title"),
        text(F.get(lines, F.lit(1))).alias("abstract"),
        (F.lit(2000) + F.col("doc_id") % 25).cast("string").alias("year"),
        F.coalesce(F.col("n_chars") > 2000, F.lit(False)).alias("in_store"),
        F.col("source"),
        F.col("lang"),
        F.col("text"),
    )
    return out.withColumn("paper_id", paper_key(F.col("pmid"), F.col("doi"), F.col("title")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text): the lines of documents that aren't blank, repeated ones once, at their first place. Nothing is shuffled."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda t, i: F.struct(t.alias("text"), i.alias("para_idx")))
    lines = F.array_sort(F.filter(lines, lambda x: F.trim(x["text"]) != ""))
    # in order, equal lines are neighbours; the array is bound to a name so that it is sorted once
    first = F.get(F.transform(F.array(lines), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["text"] != x["text"]))), F.lit(0))
    return docs.select("doc_id", F.explode(first).alias("line")).select("doc_id", "line.para_idx", "line.text")


def records_to_papers(raw: DataFrame) -> DataFrame:
    """Raw search records (RAW_RECORD) as papers with defaults. fullTextId and fullTextUrl may be one value or a list of them."""
    ids, urls = F.col("fullTextIdList.fullTextId"), F.col("fullTextUrlList.fullTextUrl")
    url = "struct<availabilityCode: string, url: string>"
    id_list = F.when(ids.startswith("["), F.from_json(ids, "array<string>")).when(F.coalesce(ids, F.lit("")) != "", F.array(F.regexp_replace(ids, '^"|"$', ""))).otherwise(F.array().cast("array<string>"))
    url_list = F.when(urls.startswith("["), F.from_json(urls, f"array<{url}>")).when(urls.startswith("{"), F.array(F.from_json(urls, url))).otherwise(F.array().cast(f"array<{url}>"))
    from lodestone.functions.records import affiliation_text, article_url, author_name, free_full_text

    people = F.coalesce(F.transform("authorList.author", lambda a: F.struct(author_name(a["firstName"], a["lastName"], a["fullName"]).alias("name"), F.coalesce(F.get(a["authorAffiliationDetailsList"]["authorAffiliation"], F.lit(0))["affiliation"], F.lit("")).alias("affiliation"))), F.array().cast("array<struct<name:string,affiliation:string>>"))
    given = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    out = raw.select(
        given("title", "No title").alias("title"), given("authorString", "Unknown authors").alias("authors"), given("id").alias("record_id"), given("source").alias("source_code"), given("pmid").alias("pmid"), given("pmcid").alias("pmcid"), given("doi").alias("doi"),
        given("abstractText").alias("abstract"), given("journalInfo.journal.title").alias("journal"), given("pubYear").alias("year"), yes(F.col("isOpenAccess")).alias("is_open_access"), yes(F.col("hasPDF")).alias("has_pdf"), yes(F.col("inEPMC")).alias("in_store"),
        people.alias("people"), id_list.alias("full_text_ids"), url_list.alias("full_text_urls"), article_url("https://example.org/article", F.col("source"), F.col("id")).alias("url"),
    )
    names = F.filter(F.transform("people", lambda p: p["name"]), lambda n: n != "")
    return out.withColumn("author_names", names).withColumn("affiliations", affiliation_text(F.col("people"))).withColumn("has_free_full_text", free_full_text(F.col("full_text_ids"), F.col("full_text_urls")))
