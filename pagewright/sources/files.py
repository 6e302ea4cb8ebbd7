"""File sources: type by magic bytes, digest, the validation ladder, page ranges, plain-text and glossary formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .raster import clean_png
from .structure import oriented_size, structure


def magic_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("255044462D"), "pdf").when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg").otherwise("unsupported")


def validated_files(files: DataFrame, most_bytes: int = 300 << 20) -> DataFrame:
    """Files (path, content) with type, sha256, page_count, width and height (as an image
    is looked at), orientation, valid and error; never fails on a bad file.

    The first of these is the error: missing, empty, too_large, unsupported_type,
    encrypted, damaged_pdf, damaged_image, no_area.
    """
    kind = magic_type(F.col("content"))
    size = F.octet_length("content")
    fits = F.col("content").isNotNull() & (size <= most_bytes)
    rows = files.select("path", "content", kind.alias("type"), size.cast("long").alias("size_bytes"))
    seen = rows.withColumn("s", structure(F.when(fits & (kind != "unsupported"), F.col("content"))))
    error = F.when(F.col("content").isNull(), "missing").when(size == 0, "empty").when(size > most_bytes, "too_large").when(F.col("type") == "unsupported", "unsupported_type").when(F.col("s.locked"), "encrypted").otherwise(F.col("s.fault"))
    sides = oriented_size(F.col("s.width"), F.col("s.height"), F.coalesce("s.orientation", F.lit(1)))
    valid = error.isNull()
    return seen.select("path", "type", "size_bytes", F.sha2("content", 256).alias("sha256"), F.when(valid, F.col("s.pages")).alias("page_count"), sides["width"].alias("width"), sides["height"].alias("height"), F.col("s.orientation").alias("orientation"), valid.alias("valid"), error.alias("error"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return validated_files(spark.read.format("binaryFile").load(path))


def page_numbers(documents: DataFrame, first: int | None = None, last: int | None = None, only: list[int] | None = None) -> DataFrame:
    """doc_id, page_id of documents(doc_id, n_pages): an inclusive range clamped to the document, or a set of pages."""
    pages = documents.where("n_pages >= 1").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_id"))
    if only is not None:
        return pages.where(F.col("page_id").isin(*only) if only else F.lit(False))
    return pages.where((F.col("page_id") >= (first or 1)) & F.lit(last is None) | F.col("page_id").between(first or 1, last or 0))


def file_pages(files: DataFrame, first: int | None = None, last: int | None = None, only: list[int] | None = None) -> DataFrame:
    """path, page_id of valid files: the pages of a PDF; an image is exactly page 1."""
    return page_numbers(files.where("valid").select(F.col("path").alias("doc_id"), F.col("page_count").alias("n_pages")), first, last, only).withColumnRenamed("doc_id", "path")


def page_totals(files: DataFrame, first: int | None = None, last: int | None = None, only: list[int] | None = None) -> DataFrame:
    """path, status, total_pages, processed_pages: a valid file none of whose pages are
    asked for is completed with none, another one fails."""
    asked = file_pages(files, first, last, only).groupBy("path").agg(F.count("*").alias("processed_pages"))
    got = files.select("path", F.when(F.col("valid"), "completed").otherwise("failed").alias("status"), F.coalesce("page_count", F.lit(0)).alias("total_pages"))
    return got.join(asked, "path", "left").withColumn("processed_pages", F.coalesce("processed_pages", F.lit(0).cast("long")))


def parsed_glossary(lines: DataFrame) -> DataFrame:
    """Lines (set_id, ord, line) of ``!term``, ``~a => b`` or ``a => b``; others have an error."""
    t = F.trim("line")
    pair = F.regexp_extract(t, r"^(~?)\s*(.+?)\s*=>\s*(.+)$", 2), F.regexp_extract(t, r"^(~?)\s*(.+?)\s*=>\s*(.+)$", 3)
    keep, loose, both = t.startswith("!"), t.startswith("~"), t.contains("=>")
    source = F.when(keep, F.trim(F.substring(t, F.lit(2), F.length(t)))).otherwise(pair[0])
    return lines.where(t != "").select(
        "set_id",
        "ord",
        source.alias("source"),
        F.when(keep, "").otherwise(pair[1]).alias("target"),
        keep.alias("case_sensitive"),
        keep.alias("do_not_translate"),
        F.when(keep, "preserved").when(loose, "transliterated").otherwise("translated").alias("mode"),
        F.when(~keep & ~both, "syntax").when(source == "", "empty").alias("error"),
    )


def resolved_variant(files: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """doc_id, path of the first variant in ``order`` that exists, sources over 20 MB left out."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("variant"))
    return files.where((rank > 0) & (F.col("size_bytes") <= 20 << 20)).groupBy("doc_id").agg(F.min_by("path", rank).alias("path"), F.min_by("variant", rank).alias("variant"))


def written_equal(df: DataFrame, path: str) -> bool:
    """Writes, reads back and compares as multisets."""
    df.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()


def checked_covers(covers: DataFrame, most_bytes: int = 10 << 20, most_pixels: int = 16_000_000, most_clean: int = 20 << 20) -> DataFrame:
    """cover_id, type, width, height, clean, error of covers(cover_id, encoded): base64 of a
    PNG or JPEG of bounded size.

    The first of these is the error: too_large, encoding, type, too_many_pixels, damaged,
    too_large_decoded.  ``clean`` is what a package takes: a PNG encoded anew from its
    pixels, without anything else that the file held; a JPEG, which is decoded by the
    host, as it is.
    """
    content = F.when(F.length("encoded") <= most_bytes * 7 // 5, F.try_to_binary(F.col("encoded"), F.lit("base64")))
    rows = covers.select("cover_id", (F.length("encoded") > most_bytes * 7 // 5).alias("_long"), content.alias("_c"))
    rows = rows.withColumn("type", magic_type(F.col("_c"))).withColumn("_s", structure(F.when(F.col("type").isin("png", "jpeg") & (F.octet_length("_c") <= most_bytes), F.col("_c"))))
    size = F.col("_s.width").cast("long") * F.col("_s.height")
    error = F.when(F.col("_long") | (F.octet_length("_c") > most_bytes), "too_large").when(F.col("_c").isNull(), "encoding").when(~F.col("type").isin("png", "jpeg"), "type").when(size > most_pixels, "too_many_pixels").when(F.col("_s.fault").isNotNull(), "damaged")
    rows = rows.withColumn("error", error)
    rows = rows.withColumn("clean", F.when(F.col("error").isNull() & (F.col("type") == "jpeg"), F.col("_c")).otherwise(clean_png(F.when(F.col("error").isNull() & (F.col("type") == "png"), F.col("_c")))))
    late = F.when(F.col("clean").isNull(), "damaged").when(F.octet_length("clean") > most_clean, "too_large_decoded")
    rows = rows.withColumn("error", F.coalesce("error", late))
    return rows.select("cover_id", F.when(F.col("_c").isNotNull(), F.col("type")).alias("type"), F.col("_s.width").alias("width"), F.col("_s.height").alias("height"), F.when(F.col("error").isNull(), F.col("clean")).alias("clean"), "error")


def accepted_uploads(files: DataFrame, extensions=("pdf", "png", "jpg", "jpeg"), most_bytes: int = 300 << 20) -> DataFrame:
    """files(name, size_bytes, ...) with safe_name and error."""
    base = F.element_at(F.split(F.replace("name", F.lit("\\"), F.lit("/")), "/"), -1)
    safe = F.substring(F.regexp_replace(base, r"[^\p{L}\p{M}\p{N}._ -]", "_"), -120, 120)
    extension = F.lower(F.regexp_extract(base, r"\.([A-Za-z0-9]+)$", 1))
    error = F.when(F.trim(base) == "", "name").when(~extension.isin(*extensions), "extension").when(F.col("size_bytes") > most_bytes, "too_large").when(F.col("size_bytes") <= 0, "empty")
    return files.withColumn("safe_name", safe).withColumn("error", error)


def capped(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of keys with ``most`` rows at most, and the keys that have more: refused whole, never cut."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    over = n.where(F.col("n") > most)
    return rows.join(over.select(key), key, "left_anti"), over
