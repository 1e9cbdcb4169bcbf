"""Responses that keep arriving: element rows and labels as a stream.

These steps look at one response at a time, so they need no state and no watermark; the
captions and numbers of a document are computed in batch from the written elements.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.operators.elements import classify_elements, explode_elements
from leafgrid.schemas import CORRUPT, RESPONSE_OR_CORRUPT


def response_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New response files of a folder; ``doc_id`` is the file name without its ending."""
    options = {"columnNameOfCorruptRecord": CORRUPT, "maxFilesPerTrigger": str(files_per_batch)}
    stream = spark.readStream.schema(RESPONSE_OR_CORRUPT).options(**options).json(folder)
    return stream.withColumn("doc_id", F.regexp_extract("_metadata.file_name", r"^(.+)\.[^.]+$", 1))


def element_stream(responses: DataFrame) -> DataFrame:
    good = responses.filter(F.col(CORRUPT).isNull())
    return classify_elements(explode_elements(good))


def write_stream(elements: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; each response file is processed exactly once."""
    writer = elements.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
