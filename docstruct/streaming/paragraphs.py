"""Documents as they arrive: the stateless text steps on a stream of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.functions import text as X


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def paragraph_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, paragraph, is_caption, has_math of every line that is not blank; the same for streams and tables."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(X.trim_white(F.col("line")) != "")
    p = X.sentence_spacing(X.suffix_hyphens(F.col("line")))
    return lines.select(key, "line_no", p.alias("paragraph"), X.is_caption(F.col("line")).alias("is_caption"), X.contains_math(F.col("line")).alias("has_math"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append rows to Parquet exactly once; ``once`` takes what is there and ends."""
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
