"""Job documents merged out of what pages wrote, and kept in a partitioned table.

A page hands in two texts, its recognition and its changes.  Those that can't be read
are set aside with a reason and leave the others alone; a job always gets both of its
documents, empty ones included, so that nothing stays of an attempt before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions of the table of job documents.
BUCKETS = 64


def _reason(text: Column, parsed: Column, entries: Column | None) -> Column:
    kind = F.schema_of_variant(parsed)
    reason = F.when(text.isNull(), "missing").when(parsed.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_an_object") if entries is not None else F.when(text.isNull(), "missing").when(parsed.isNull(), "not_json")
    if entries is not None:
        reason = reason.when(F.variant_get(parsed, "$.pages", "variant").isNotNull() & entries.isNull(), "no_list_of_pages")
    return reason


def read_pages(pages: DataFrame) -> DataFrame:
    """job_id, page_id, entries and changes (JSON texts) of pages(job_id, page_id, ocr,
    changes), and why either can't be read (ocr_error, changes_error)."""
    rows = pages.withColumn("_o", F.try_parse_json("ocr")).withColumn("_c", F.try_parse_json("changes"))
    entries = F.try_variant_get("_o", "$.pages", "array<variant>")
    rows = rows.withColumn("ocr_error", _reason(F.col("ocr"), F.col("_o"), entries)).withColumn("changes_error", _reason(F.col("changes"), F.col("_c"), None))
    listed = F.to_json(F.transform(entries, lambda e: e))
    inner = F.coalesce(F.substring(listed, F.lit(2), F.length(listed) - 2), F.lit(""))
    return rows.select("job_id", "page_id", F.when(F.col("ocr_error").isNull(), inner).alias("entries"), F.when(F.col("changes_error").isNull(), F.to_json("_c")).alias("changes"), "ocr_error", "changes_error")


def merged_pages(jobs: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of jobs(job_id), and the pages set aside.

    First: job_id, ocr, changes: {"job_id": ..., "pages": [...]} with the entries of all
    readable pages in order, for every job.  Second: job_id, page_id, file, reason.
    """
    read = read_pages(pages)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("page_id", c)))), lambda x: x[c]), ",")
    by_job = read.groupBy("job_id").agg(in_order("entries").alias("entries"), in_order("changes").alias("changes"))
    whole = lambda c: F.concat(F.lit('{"job_id":'), F.to_json(F.array("job_id")).substr(F.lit(2), F.length(F.to_json(F.array("job_id"))) - 2), F.lit(',"pages":['), F.coalesce(c, F.lit("")), F.lit("]}"))
    documents = jobs.select("job_id").distinct().join(by_job, "job_id", "left").select("job_id", whole(F.col("entries")).alias("ocr"), whole(F.col("changes")).alias("changes"))
    aside = read.select("job_id", "page_id", F.explode(F.array(F.struct(F.lit("ocr").alias("file"), F.col("ocr_error").alias("reason")), F.struct(F.lit("changes").alias("file"), F.col("changes_error").alias("reason")))).alias("x")).select("job_id", "page_id", "x.file", "x.reason").where("reason is not null and reason <> 'missing'")
    return documents, aside


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def save_documents(documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Puts job documents into the table at ``path``, in place of those the jobs had.

    Only the partitions of these jobs are written anew, with the documents of their
    other jobs; the others stay as they are.
    """
    spark = documents.sparkSession
    new = documents.withColumn("bucket", _bucket(buckets))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        touched = new.select("bucket").distinct()
        kept = spark.read.schema(new.schema).parquet(path).join(F.broadcast(touched), "bucket", "left_semi").join(new.select("job_id"), "job_id", "left_anti")
        new = new.unionByName(kept)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def saved_documents(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
