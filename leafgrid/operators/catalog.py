"""The document catalog: accepted files, fingerprints, search by name."""

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid import constants as K
from leafgrid.functions.search import containing
from leafgrid.functions.text import nfc


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(_file_name(path), r"(?s)^(.+)\.[^.]+$", "$1")


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, ``""`` if there is none."""
    return F.lower(F.regexp_extract(_file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def catalog_documents(files: DataFrame) -> DataFrame:
    """Judge files by their metadata alone (``path, size_bytes, mtime``).

    ``reason`` is null for accepted files; size is tested before the kind of file.
    """
    ext = F.col("ext")
    mime = F.create_map(*[F.lit(x) for pair in K.MIME_TYPES.items() for x in pair])
    supported = ext.isin(*K.MIME_TYPES)
    named = files.select(
        "path", "size_bytes", "mtime", stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("ext")
    )
    return named.select(
        "*",
        (ext == ".pdf").alias("is_pdf"),
        F.coalesce(F.try_element_at(mime, ext), F.lit(K.DEFAULT_MIME)).alias("mime"),
        F.when(F.col("size_bytes") > K.MAX_FILE_BYTES, "too_large")
        .when(~supported, "unsupported_ext")
        .alias("reason"),
    )


def fingerprint_documents(documents: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of the bytes; the first 16 digits key the cache, the first 8 file names."""
    sha = F.sha2(F.col(content), 256)
    out = documents.withColumn("sha256", sha)
    return out.select(
        *[c for c in documents.columns if c != content],
        "sha256",
        F.substring("sha256", 1, 16).alias("sha16"),
        F.substring("sha256", 1, 8).alias("sha8"),
    )


def search_documents(catalog: DataFrame, terms, listed: int = K.SEARCH_LISTED) -> DataFrame:
    """Files whose stem contains a term, newest first; one status per term.

    Upper and lower case and composed and decomposed letters do not matter.  A list of terms
    is matched inside the row; a DataFrame with a column ``term``, of any size, by runs of characters
    both sides share (``functions/search.py``).  The listing keeps its top rows map-side
    (window group limit); the counts are plain partial aggregates.
    """
    files = catalog.filter(F.col("ext").isin(*K.MIME_TYPES))
    if isinstance(terms, DataFrame):
        asked, found = _find_many(files, terms)
    else:
        asked, found = _find_few(files, terms)
    newest = Window.partitionBy("term").orderBy(F.col("mtime").desc(), "path")
    top = found.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= listed)
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n_matches"))
    n = F.coalesce("n_matches", F.lit(0))
    status = F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous")
    return (
        asked.join(counts, "term", "left")
        .join(top, "term", "left")
        .select(
            "term",
            status.alias("status"),
            n.alias("n_matches"),
            F.greatest(n - listed, F.lit(0)).alias("overflow"),
            "rank",
            "path",
        )
    )


def _find_many(files: DataFrame, terms: DataFrame):
    asked = terms.select("term").where("term IS NOT NULL").distinct()
    needles = asked.select("term", F.lower(nfc(F.col("term"))).alias("needle"))
    files = files.groupBy("path").agg(F.max("mtime").alias("mtime"), F.min("stem").alias("stem"))
    files = files.select("path", "mtime", F.lower(nfc(F.col("stem"))).alias("stem"))
    found = containing(files, ["path"], "stem", needles, keep=["mtime"])
    return asked, found.join(needles, "needle").select("term", "path", "mtime")


def _find_few(files: DataFrame, terms: list):
    spark = files.sparkSession
    terms = list(dict.fromkeys(terms))
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    needle = {t: unicodedata.normalize("NFC", t).lower() for t in terms}
    wanted = F.array(
        *[F.struct(F.lit(t).alias("term"), F.lit(needle[t]).alias("needle")) for t in terms]
    )
    found = (
        files.withColumn("_stem", F.lower(nfc(F.col("stem"))))
        .select(
            "path",
            "mtime",
            F.explode(F.filter(wanted, lambda w: F.contains(F.col("_stem"), w.needle))).alias("_w"),
        )
        .groupBy(F.col("_w.term").alias("term"), "path")
        .agg(F.max("mtime").alias("mtime"))
    )
    return asked, found


def recent_documents(catalog: DataFrame, n: int = K.RECENT_LISTED) -> DataFrame:
    """The newest ``n`` accepted kinds of files of each folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    newest = Window.partitionBy("folder").orderBy(F.col("mtime").desc(), "path")
    files = catalog.filter(F.col("ext").isin(*K.MIME_TYPES)).select(folder.alias("folder"), "path", "mtime")
    return (
        files.withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= n)
        .select("folder", "rank", "path")
    )
