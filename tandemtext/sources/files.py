"""Sources and sinks: CSV, JSON lines, plain text, versions and reports."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a missing value in CSV files, and columns by the names they come under.
NULL_TOKENS = ("", "NA", "N/A", "null", "NULL", "None", "nan", "NaN")
AI_NAMES, HUMAN_NAMES = ("AI Text", "ai_text", "ai", "source"), ("Human Text", "human_text", "human", "target")
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: str, columns: Iterable[str] = ()) -> DataFrame:
    """CSV with quoted line breaks; null tokens become null; ``columns`` names those wanted and present."""
    df = spark.read.schema(schema).options(**CSV).csv(path)
    df = df.select(*[F.when(F.col(f"`{c}`").isin(*NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    wanted = [c for c in columns if c in df.columns]
    return df.select(*[f"`{c}`" for c in wanted]) if wanted else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, text: Iterable[str] = ("text", "AI Text", "input")) -> DataFrame:
    """One object per line; ``body`` is the first non-empty of the text columns."""
    df = spark.read.schema(schema).json(path)
    return df.withColumn("body", F.coalesce(*[F.nullif(F.col(f"`{c}`"), F.lit("")) for c in text if c in df.columns]))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def extract(texts: DataFrame, pattern: str, column: str = "value") -> DataFrame:
    """All first groups of a pattern in the texts, one row each."""
    return texts.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("part"))


def resolve(df: DataFrame, names: Iterable[str], required: bool = True) -> str | None:
    """The column for one of the names: same name without case, else one that contains it."""
    low = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in low:
            return low[n.lower()]
    for n in names:
        for k, c in low.items():
            if n.lower() in k:
                return c
    if required:
        raise ValueError(f"none of {list(names)} in {df.columns}")
    return None


def academic_part(name):
    """Whether a document's name is of the academic corpus and a whole text or a chunk of one."""
    return name.startswith("acad_") & (name.contains("@chunk") | ~name.contains("@"))


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def discover(spark: SparkSession, folder: str, explicit: str | None = None, preferred: Iterable[str] = ("all_scored.csv", "base_clean.csv")) -> str:
    """The input of a folder: the one named, else the first preferred one there, else its only CSV; several are an error."""
    if explicit:
        return first_existing(spark, [explicit, f"{folder}/{explicit}"])
    fs, place = _file_system(spark, folder)
    there = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().endswith(".csv"))
    for name in preferred:
        if name in there:
            return f"{folder}/{name}"
    if len(there) != 1:
        raise ValueError(f"{len(there)} CSV inputs in {folder}: name one")
    return f"{folder}/{there[0]}"


def write_metadata(spark: SparkSession, path: str, values: dict) -> None:
    """One JSON object (facts of a run) as a text table of one line."""
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """What :func:`write_metadata` wrote; ``default`` where there is nothing."""
    fs, place = _file_system(spark, path)
    if not fs.exists(place):
        return dict(default or {})
    return json.loads(spark.read.text(path).first()[0])


def backup_once(spark: SparkSession, path: str) -> str:
    """Copy a Parquet table beside itself under its number of rows, if no such copy is there yet."""
    table = spark.read.parquet(path)
    to = f"{path}_backup_{table.count()}"
    fs, place = _file_system(spark, to)
    if not fs.exists(place):
        table.write.parquet(to)
    return to


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """The first path that exists, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_with_retry(read: Callable[[], DataFrame], empty: Callable[[], DataFrame], attempts: int = 3, wait: float = 2.0) -> DataFrame:
    for turn in range(attempts):
        try:
            return read()
        except Exception:  # noqa: BLE001 - any failure of a source is tried again
            if turn + 1 < attempts:
                time.sleep(wait)
    return empty()


def backup(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Rename an existing output to a version beside it; null where there is none.  A stamp is used once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}_before_{stamp}")
    fs = old.getFileSystem(conf)
    if not fs.exists(old) or fs.exists(new):
        return None
    fs.rename(old, new)
    return f"{path}_before_{stamp}"


def write_split(df: DataFrame, path: str, accepted) -> None:
    """One pass, two outputs: accepted and rejected rows as partitions of one table."""
    df.withColumn("outcome", F.when(F.coalesce(accepted, F.lit(False)), "accepted").otherwise("rejected")).write.mode("overwrite").partitionBy("outcome").parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A (small, aggregated) table as Markdown; above ``most`` rows it is refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])
