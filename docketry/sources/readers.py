"""Readers of case folders, metadata, labels and model responses; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "itemid string, appno string, doctypebranch string, respondent string, decisiondate string, extractedappno string, conclusion string, importance int, kpthesaurus string, judgementdate string"
MESSAGE = "struct<role:string,content:string>"
RESPONSE = (
    "id string, custom_id string, response struct<status_code:int,request_id:string,body:struct<id:string,object:string,created:long,model:string,"
    f"choices:array<struct<index:int,message:{MESSAGE},logprobs:string,finish_reason:string>>,usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>,system_fingerprint:string>>, error string"
)


def read_texts(spark: SparkSession, folder: str, column: str, recursive: bool = False) -> DataFrame:
    """(filename, folder, column): one row a file, whole text; a missing folder raises."""
    df = spark.read.option("recursiveFileLookup", recursive).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("filename"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"), F.col("value").alias(column))


def read_facts_and_law(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Texts below ``fact_section`` folders, and those of all other folders."""
    both = read_texts(spark, folder, "text", recursive=True)
    facts = both.filter("folder = 'fact_section'").select("filename", F.col("text").alias("facts"))
    return facts, both.filter("folder <> 'fact_section'").select("filename", F.col("text").alias("the_law"))


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON-lines files of a folder by column name; missing fields are null, further ones dropped."""
    return spark.read.schema(METADATA).json(folder, pathGlobFilter="*.json")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(file, custom_id, content) of batch responses."""
    df = spark.read.schema(RESPONSE).json(path)
    return df.select(F.col("_metadata.file_name").alias("file"), "custom_id", F.get("response.body.choices", F.lit(0))["message"]["content"].alias("content"), "response")


def read_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=separator, header=header)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(names): one row with the map of a file that holds one JSON object of texts."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("names"))
