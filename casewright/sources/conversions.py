"""A cache of file conversions by content, and the files that nothing needs any more.

Files are read by Spark's binary source, which passes over empty ones, and known by the hash of their content. The cache is a folder of JSON lines, appended to:
an entry has the hash, the converted pages and a digest of them. An entry that can't be read, lacks its pages or whose
digest differs counts as none, so its file is converted again. An append that is repeated after a loss adds entries that
are equal by hash; one of them is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.session import cut
from casewright.operators.study import orphans
from casewright.sources.archive import content_hash

ENTRY = "sha256 string, pages array<string>, digest string"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, content) of the files below a folder; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def _digest(pages: Column) -> Column:
    return F.sha2(F.to_json(pages), 256)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, pages) of the cache's whole entries, one a hash; a folder that isn't there has none."""
    try:
        lines = spark.read.schema(ENTRY).option("mode", "PERMISSIVE").json(folder)
    except AnalysisException:
        return spark.createDataFrame([], ENTRY).select("sha256", "pages")
    whole = lines.where(F.col("sha256").rlike("^[0-9a-f]{64}$") & F.col("pages").isNotNull() & F.col("digest").eqNullSafe(_digest(F.col("pages"))))
    return whole.groupBy("sha256").agg(F.first("pages").alias("pages"))


def converted(found: DataFrame, folder: str, convert: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, sha256, pages, hit) of every file: from the cache, else converted and added to it.

    ``convert`` maps files (sha256, content), one a content, to (sha256, pages); what it gives no pages for stays null and
    isn't kept. Contents are hashed where they are read, and only those of misses go further.
    """
    spark = found.sparkSession
    # what was known before is fixed before anything is added
    hashed = cut(content_hash(found).join(cached(spark, folder).select("sha256", F.lit(True).alias("hit")), "sha256", "left").select("path", "sha256", F.coalesce("hit", F.lit(False)).alias("hit")))
    wanted = hashed.where("NOT hit").groupBy("sha256").agg(F.min("path").alias("path"))
    fresh = convert(found.select("path", "content").join(wanted, "path").select("sha256", "content"))
    fresh.where(F.col("pages").isNotNull()).select("sha256", "pages", _digest(F.col("pages")).alias("digest")).write.mode("append").json(folder)
    return hashed.join(cached(spark, folder), "sha256", "left").select("path", "sha256", "pages", "hit")


def unneeded(found: DataFrame, live: DataFrame) -> DataFrame:
    """(path, name, length) of files whose stem is no hash of ``live`` (hash), and of unfinished ones: what a cleaning would remove."""
    return orphans(found.select("path", "name", "length"), live).select("path", "name", "length")


def removed(found: DataFrame, live: DataFrame, dry_run: bool = True) -> tuple[int, int]:
    """(files, bytes) that are not needed; they are deleted unless it is a dry run. Paths stream through the driver one at a time."""
    spark, gone, size = found.sparkSession, 0, 0
    for r in unneeded(found, live).toLocalIterator():
        gone, size = gone + 1, size + r["length"]
        if not dry_run:
            path = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return gone, size
