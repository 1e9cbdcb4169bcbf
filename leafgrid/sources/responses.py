"""Read parse responses and document files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.schemas import CORRUPT, NAMED, RESPONSE_OR_CORRUPT

_BY_LINE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def read_responses(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Response files; ``path`` of the file, typed columns, and the raw text of rows that
    are not valid JSON in ``_corrupt_record``.  Unknown fields are ignored."""
    reader = spark.read.schema(RESPONSE_OR_CORRUPT).options(**_BY_LINE, multiLine=str(multiline).lower())
    return reader.json(path).withColumn("path", F.col("_metadata.file_path"))


def parse_responses(raw: DataFrame, column: str = "raw") -> DataFrame:
    """The same for responses that arrive as a text column, for instance from a table."""
    parsed = raw.withColumn("_r", F.from_json(column, RESPONSE_OR_CORRUPT, _BY_LINE))
    keep = [c for c in raw.columns if c != column]
    return parsed.select(*keep, "_r.*")


def with_variant(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``response VARIANT``: the whole response with fields no schema names, null if it is no JSON."""
    return responses.withColumn("response", F.try_parse_json(raw))


def response_field(path: str, kind: str, response: str = "response"):
    """A field of the variant by its path, null if it is absent or of another kind."""
    return F.try_variant_get(response, path, kind)


def unnamed_fields(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row per top-level field that the schema does not name: ``field`` and its ``value VARIANT``."""
    keep = [c for c in responses.columns if c != response]
    fields = responses.sparkSession.tvf.variant_explode(F.col(response).outer())
    found = responses.lateralJoin(fields).where(~F.col("key").isin(*NAMED))
    return found.select(*keep, F.col("key").alias("field"), "value")


def read_raw(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Response files as text (``path, raw``), a row per line or per file."""
    return spark.read.text(path, wholetext=multiline).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def valid(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantine(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col(CORRUPT).isNotNull())


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """File metadata of a folder tree; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")
    )


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")
