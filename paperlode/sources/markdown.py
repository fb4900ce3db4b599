"""Sources: Markdown files, and HTML pages as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def markdown_paths(spark: SparkSession, *paths: str) -> list[str]:
    """The paths that hold Markdown, each once: folders, and files that end in .md in any case. Others, and those that are not
    there, are skipped."""
    out: dict[str, str] = {}
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            status = fs.getFileStatus(at)
            if status.isDirectory() or path.lower().endswith(".md"):
                out.setdefault(status.getPath().toString(), path)
    return list(out.values())


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """source_path, file_hash, text, error for every .md file under the paths, each once. Text that is not UTF-8 is an error."""
    found = markdown_paths(spark, *paths)
    if not found:
        return as_files(spark.createDataFrame([], FILES))
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]")
    # folders may lie in one another: those inside another are left out, and a file inside a folder too
    tops = [p for p in found if not any(q != p and p.rstrip("/").startswith(q.rstrip("/") + "/") for q in found)]
    return as_files(source.load(tops))


def path_order(path: Column | str) -> Column:
    """Paths in this order come component by component (a/x before a-b/x)."""
    return F.split(path, "/")


def as_files(files: DataFrame) -> DataFrame:
    """read_markdown() for rows of the binaryFile source."""
    text = F.expr("try_validate_utf8(cast(content as string))")
    rows = files.select(F.regexp_replace("path", "^file:/+", "/").alias("source_path"), F.sha2("content", 256).alias("file_hash"), text.alias("text"))
    return rows.withColumn("error", F.when(F.col("text").isNull(), F.lit("not valid UTF-8")))


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, n_paragraphs, title, heading, text (paragraphs joined by blank lines) of HTML pages, tags and entities removed."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    paragraphs = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1)), plain)
    return pages.select(
        "page_id",
        plain(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        plain(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1)).alias("heading"),
        F.size(paragraphs).cast("long").alias("n_paragraphs"),
        F.array_join(paragraphs, "\n\n").alias("text"),
    )
