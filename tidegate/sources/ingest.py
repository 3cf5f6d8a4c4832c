"""Tool responses as JSON requests, from files or a stream of them: one parser for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import MODALITIES
from ..functions.text import strip

REQUEST = "seq long, session string, content string, modality string, tool_name string, source_url string, image_path string, image_base64 string"
MAX_BYTES = 20_000_000


def requests(lines: DataFrame, line: str = "line", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The fields of a request, `image` (its bytes) and `problem`: null, too_large, not_json, bad_modality, bad_image or no_image.

    Lines without a problem go on to triage, the others to a table of dead letters.
    A missing modality is text; a missing session is `default`.  A line over the
    limit isn't parsed.
    """
    small = F.octet_length(line) <= max_bytes
    body = F.when(small, F.col(line))
    read = lines.withColumn("_r", F.from_json(body, REQUEST)).withColumn("_ok", F.startswith(F.coalesce(F.schema_of_variant(F.try_parse_json(body)), F.lit("")), F.lit("OBJECT")))
    field = lambda n: F.col(f"_r.{n}")
    modality = F.lower(F.coalesce(F.nullif(strip(field("modality")), F.lit("")), F.lit("text")))
    given = F.nullif(field("image_base64"), F.lit(""))
    read = read.withColumns({"_modality": modality, "image": F.try_to_binary(given, F.lit("base64")), "_given": given.isNotNull()})
    nowhere = (F.col("_modality") == "image") & ~F.col("_given") & (F.coalesce(field("image_path"), F.lit("")) == "")
    problem = F.when(~small, "too_large").when(~F.col("_ok"), "not_json").when(~F.col("_modality").isin(*MODALITIES), "bad_modality").when(F.col("_given") & F.col("image").isNull(), "bad_image").when(nowhere, "no_image")
    names = [f.split()[0] for f in REQUEST.split(", ")]
    own = {"session": F.coalesce(field("session"), F.lit("default")), "modality": F.col("_modality")}
    kept = [own.get(n, field(n)).alias(n) for n in names if n != "image_base64"]
    return read.select(*kept, "image", problem.alias("problem"))


def stream_requests(spark: SparkSession, folder: str, max_files: int = 1000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """requests of the JSON lines that arrive in a folder, as a stream; each trigger reads a bounded number of files."""
    arrived = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).withColumnRenamed("value", "line")
    return requests(arrived.where(strip(F.col("line")) != ""), max_bytes=max_bytes)
