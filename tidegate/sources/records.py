"""Sources and sinks of records: tolerant and strict JSON lines, folders, attack lists, images, score caches, audit logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import _c, content_key, strip
from ..operators.datasets import drop_reason, label_from_path

PDF_SCHEMA = "label string, context string, user_intent string, source string"
WEB_SCHEMA = "id string, text string"


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """line: every line of text files that is not blank, with its file."""
    return spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).where(strip(F.col("line")) != "")


def parse(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """lines with `r`, the parsed record, and `corrupt`, true where a line is no JSON object."""
    data = F.try_parse_json(line)
    kind = F.schema_of_variant(data)
    return lines.withColumn("corrupt", data.isNull() | ~F.startswith(F.coalesce(kind, F.lit("")), F.lit("OBJECT"))).withColumn("r", F.from_json(line, schema)).withColumn("_v", data)


def json_kind(variant, path: str) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL(...), DOUBLE of a field, null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(_c(variant), path, "variant"))


def zero_or_one(variant, path: str = "$.label") -> Column:
    """0 or 1 of a JSON number or boolean; strings and all else: null."""
    kind = F.coalesce(json_kind(variant, path), F.lit("VOID"))
    number = F.try_variant_get(_c(variant), path, "double")
    flag = F.try_variant_get(_c(variant), path, "boolean")
    return F.when(kind == "BOOLEAN", flag.cast("int")).when((kind != "STRING") & number.isin(0.0, 1.0), number.cast("int"))


def any_integer(variant, path: str = "$.label") -> Column:
    """The integer of a JSON number (cut off), boolean or integer string; null otherwise."""
    kind = F.coalesce(json_kind(variant, path), F.lit("VOID"))
    text = F.try_variant_get(_c(variant), path, "string")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(_c(variant), path, "boolean").cast("int"))
        .when(kind == "STRING", F.when(F.regexp_like(text, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(text).try_cast("int")))
        .otherwise(F.floor(F.abs(F.try_variant_get(_c(variant), path, "double"))).cast("int") * F.signum(F.try_variant_get(_c(variant), path, "double")).cast("int"))
    )


def pdf_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines with a reason) of raw PDF lines; a label must be 0 or 1."""
    read = parse(lines, PDF_SCHEMA).withColumn("label", zero_or_one("_v"))
    why = F.when(F.col("corrupt"), "not_json").when(F.col("label").isNull(), "bad_label")
    read = read.withColumn("reason", why)
    good = read.where("reason is null").select("label", F.col("r.context").alias("context"), F.col("r.user_intent").alias("user_intent"), F.coalesce("r.source", F.lit("unknown")).alias("source"), *[c for c in lines.columns if c not in ("line", "label")])
    return good, read.where("reason is not null").select(*lines.columns, "reason")


def web_records(lines: DataFrame, file: str = "file") -> DataFrame:
    """Raw web lines with label (parent folder) and category (file stem) from the file's path."""
    parsed = parse(lines, WEB_SCHEMA)
    return parsed.select("corrupt", F.col("r.id").alias("raw_id"), strip(F.col("r.text")).alias("text"), label_from_path(file).alias("label"), F.regexp_extract(file, r"([^/]+)\.[^./]+$", 1).alias("category"))


def combined_records(lines: DataFrame, domain: str) -> tuple[DataFrame, DataFrame]:
    """(records, dropped) for the combined set: lines that can't be read are skipped, empty ones dropped with a reason."""
    read = parse(lines, "text string, category string, extracted_text string, ocr_status string").withColumn("label", any_integer("_v"))
    rows = read.where(~F.col("corrupt") & F.col("label").isNotNull())
    rows = rows.withColumn("reason", drop_reason(F.lit(domain), "r.text", "r.extracted_text", "r.ocr_status"))
    own = [c for c in lines.columns if c != "line"]
    kept = rows.where("reason is null").select(strip(F.col("r.text")).alias("text"), "label", F.lit(domain).alias("domain"), F.coalesce("r.category", F.lit(domain)).alias("category"), *own)
    return kept, rows.where("reason is not null").select("label", F.coalesce("r.category", F.lit(domain)).alias("category"), "reason", *own)


def training_records(lines: DataFrame, text_field: str = "text", label_field: str = "label") -> tuple[DataFrame, DataFrame]:
    """(records, dropped) for training; reasons: not_json, missing_label, bad_label, empty_text."""
    read = parse(lines, f"`{text_field}` string, domain string").withColumn("label", any_integer("_v", f"$.{label_field}"))
    missing = json_kind("_v", f"$.{label_field}").isNull()
    text = strip(F.coalesce(F.col("r").getField(text_field), F.lit("")))
    why = F.when(F.col("corrupt"), "not_json").when(missing, "missing_label").when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "bad_label").when(text == "", "empty_text")
    read = read.withColumn("reason", why)
    own = [c for c in lines.columns if c != "line"]
    return read.where("reason is null").select(text.alias("text"), "label", F.coalesce("r.domain", F.lit("unknown")).alias("domain"), *own), read.where("reason is not null").select("reason", *own)


def read_strict(spark: SparkSession, paths, schema: str) -> DataFrame:
    """JSON lines where a bad line stops the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def attack_list(frame: DataFrame, column: str = "line") -> DataFrame:
    """category, attack from a JSON object of category -> texts; blanks are left out."""
    each = frame.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("category", "texts"))
    return each.select("category", F.explode("texts").alias("attack")).select("category", strip(F.col("attack")).alias("attack")).where("attack <> ''")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, label, category, sha256 of images under a folder, sub-folders included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    images = files.where(F.regexp_like(F.lower("path"), F.lit(r"\.(png|jpg|jpeg|webp|bmp|tiff)$")))
    return images.select("path", "content", label_from_path("path").alias("label"), F.element_at(F.split("path", "/"), -2).alias("category"), content_key("content").alias("sha256"))


def with_files(records: DataFrame, files: DataFrame, *path_cols: str) -> tuple[DataFrame, DataFrame]:
    """(records with the first of their paths that exists, records without any)."""
    known = files.select(F.col("path").alias("_p")).distinct()
    tried = records.withColumn("_try", F.filter(F.array(*path_cols), lambda x: x.isNotNull())).withColumn("_row", F.xxhash64(*records.columns))
    hits = tried.select("_row", F.posexplode("_try").alias("_i", "_p")).join(known, "_p").groupBy("_row").agg(F.min_by("_p", "_i").alias("file"))
    met = tried.join(hits, "_row", "left").drop("_try", "_row")
    return met.where("file is not null"), met.where("file is null").drop("file")


def first_folder(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first candidate that exists and is not empty, on whatever file system it lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        fs = p.getFileSystem(conf)
        if fs.exists(p) and len(fs.listStatus(p)):
            return c
    return None


def file_or_text(value: str, exists) -> str:
    """A file's text if the value names a file, else the value; PDF sources are turned away."""
    text = exists(value)
    if (text or value).startswith("%PDF-"):
        raise ValueError("raw PDF bytes: extract the text first")
    return value if text is None else text


# ------------------------------------------------------------------ sinks
def write_splits(records: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split, without content keys."""
    records.drop("sha256").write.partitionBy("split").mode("overwrite").json(path)


def report_json(row: DataFrame) -> DataFrame:
    """One JSON text for each row of aggregates."""
    return row.select(F.to_json(F.struct("*")).alias("report"))


def audit_rows(deliveries: DataFrame, raw: str = "raw_content") -> DataFrame:
    """Deliveries as they are logged: the raw content's hash and length, never the content."""
    return deliveries.withColumn("content_sha256", content_key(F.coalesce(F.col(raw), F.lit("")))).withColumn("content_chars", F.length(raw)).drop(raw, "secure_content")


def append_audit(deliveries: DataFrame, path: str):
    """A streaming query that appends audit rows; a batch that is run again writes its own folder again."""

    def put(batch: DataFrame, epoch: int) -> None:
        audit_rows(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return deliveries.writeStream.foreachBatch(put)


def save_state(states: DataFrame, path: str) -> None:
    states.write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def score_cache(scored: DataFrame, path: str) -> DataFrame:
    """Scored records written once and read from there."""
    scored.write.mode("overwrite").parquet(path)
    return scored.sparkSession.read.schema(scored.schema).parquet(path)
