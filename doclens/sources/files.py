"""Readers: documents by kind of file, labelled folders, dictionaries, landing folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of files by suffix.
IMAGES = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"]
DOCUMENTS = [".pdf"]
DATASET_IMAGES = [".png", ".jpg", ".jpeg", ".tif", ".tiff"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def input_type(path: Column) -> Column:
    """image, pdf, or null for a kind that is not supported."""
    return F.when(suffix(path).isin(IMAGES), "image").when(suffix(path).isin(DOCUMENTS), "pdf")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their kind; the bytes are read only if a later step uses them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.withColumn("file_name", F.regexp_extract("path", r"([^/\\]+)$", 1)).withColumn("input_type", input_type(F.col("path")))


def supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supported files, and those to set aside with a message."""
    bad = files.where("input_type IS NULL").withColumn("error_message", F.concat(F.lit("Unsupported file type: "), suffix(F.col("path"))))
    return files.where("input_type IS NOT NULL"), bad


def labelled_images(spark: SparkSession, root: str, split: str = "test") -> DataFrame:
    """Images below ``root/split`` whose folder is their class."""
    files = read_binary(spark, f"{root}/{split}").where(suffix(F.col("path")).isin(DATASET_IMAGES))
    return files.withColumn("label", F.element_at(F.split("path", "/"), -2)).withColumn("split", F.lit(split))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each text file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of OCR results kept as JSON, see ``ocr_lines``."""
    return ocr_lines(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"), "value")


def ocr_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Lines of OCR results, the JSON of ``content``: text, confidence (0..1 as per cent too), and their place in the file; other columns stay."""
    schema = "array<struct<text:string,confidence:double,bbox:array<array<double>>>>"
    own = [f"`{c}`" for c in files.columns if c != content]
    rows = files.select(*own, F.from_json(F.col(content).cast("string"), schema).alias("_rows")).select(*own, F.posexplode("_rows").alias("line_no", "_row"))
    score = F.when(F.col("_row.confidence") <= 1, F.col("_row.confidence") * 100).otherwise(F.col("_row.confidence"))
    return rows.select(*own, "line_no", "_row.text", score.alias("confidence"), "_row.bbox")


def read_dictionary(spark: SparkSession, path: str) -> list[str]:
    """Words of a JSON list; what is not a list is none."""
    value = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("words")).first()
    return [w for w in (value.words or []) if w] if value else []


#: A settings file of more bytes is taken for something else.
MAX_SETTINGS_BYTES = 1 << 20


def read_settings(spark: SparkSession, path: str) -> dict[str, dict[str, str | int | float | bool | None]]:
    """Settings by section and name from a file of sections (``name:``) with indented ``name: value`` lines; names outside a section are in
    the section of empty name. Values are numbers, true or false, or text, quoted or not; ``#`` after a blank begins a comment."""
    if (spark.read.format("binaryFile").load(path).select("length").first() or (0,))[0] > MAX_SETTINGS_BYTES:
        raise ValueError(f"not a settings file: {path}")
    found = spark.read.text(path, wholetext=True).first()
    out, section = {}, ""
    for line in (found.value if found else "").splitlines():
        line = re.sub(r"""^((?:[^'"#]|'[^']*'|"[^"]*"|(?<=\S)#)*)(?<!\S)#.*""", r"\1", line).rstrip()
        name, colon, value = line.partition(":")
        if not line.strip() or line == "---":
            continue
        if not colon:
            raise ValueError(f"not a setting: {line}")
        if line[0].isspace():
            out.setdefault(section, {})[name.strip()] = setting(value.strip())
        elif value.strip():
            out.setdefault("", {})[name.strip()] = setting(value.strip())
        else:
            section = name.strip()
            out.setdefault(section, {})
    return out


def setting(value: str) -> str | int | float | bool | None:
    if value in ("", "~", "null"):
        return None
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value[1:-1] if value[:1] in "'\"" and value[-1:] == value[:1] and len(value) > 1 else value
