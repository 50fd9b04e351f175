"""JSON Lines sources and sinks with explicit schemas.

Presence of a key is not the same as a value: an explicit null is present and reads as the text ``None``. from_json
cannot tell the two apart, so presence comes from json_object_keys. Lines that are blank, malformed or not objects
are skipped, as is invalid UTF-8's damage: the reader replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import POOL_INSTRUCTION, SYSTEM_PROMPT, strip

TEXTS = ("id", "instruction", "input", "output", "function", "reference", "prompt", "token_seq", "source_file", "chosen", "rejected", "system_prompt")
TEXT_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in TEXTS])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 1-based number, blank ones included: (line_no, value).

    Numbers follow the files' names and the lines' places within. Files are read in blocks; a block's lines are together
    in one task, so a line's number is that of its block's first line plus its distance from it. Blocks are counted in
    one pass and numbered in one small table, a row a block, which lines are joined with; nothing is collected.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *block, F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"])
    return placed.select((F.col("before") + F.col("at") - F.col("first") + 1).cast("long").alias("line_no"), "value")


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that hold a JSON object, with ``keys`` and the text fields in ``r``."""
    held = lines.withColumn("keys", F.json_object_keys(strip(F.col(value)))).where(F.col("keys").isNotNull())
    return held.withColumn("r", F.from_json(strip(F.col(value)), TEXT_SCHEMA))


def has(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.array_contains("keys", n)
    return out


def text_of(name: str) -> Column:
    """The field as stripped text; a present null is ``None``, a missing field null."""
    return F.when(has(name), F.coalesce(strip(F.col(f"r.{name}")), F.lit("None")))


def identity(prefix: str) -> Column:
    return F.when(has("id"), F.coalesce(F.col("r.id"), F.lit("None"))).otherwise(F.concat(F.lit(prefix), F.col("line_no").cast("string")))


def pool_samples(lines: DataFrame) -> DataFrame:
    """Samples from the three pool layouts, tried in the order A, C, B; blank functions or references are dropped.

    A: instruction, input, output. C: instruction, function, reference; a blank function falls back on token_seq.
    B: prompt, reference, token_seq; its prompt is not used.
    """
    rows = parsed(lines)
    a, c, b = has("instruction", "input", "output"), has("instruction", "function", "reference"), has("prompt", "reference", "token_seq")
    own = text_of("function")
    function = F.when(a, text_of("input")).when(c, F.when((own == "") & has("token_seq"), text_of("token_seq")).otherwise(own)).when(b, text_of("token_seq"))
    picked = rows.where(a | c | b).select(
        identity("dpo_pool_").alias("id"),
        F.when(a | c, text_of("instruction")).otherwise(F.lit(POOL_INSTRUCTION)).alias("instruction"),
        function.alias("function"),
        F.when(a, text_of("output")).otherwise(text_of("reference")).alias("reference"),
        text_of("source_file").alias("source_file"),
        text_of("token_seq").alias("token_seq"),
        "line_no",
    )
    return picked.where((F.col("function") != "") & (F.col("reference") != ""))


def sft_samples(lines: DataFrame, drop_blank: bool = True) -> DataFrame:
    """id, instruction, function and comment of lines with instruction, input and output. Predictions keep blank ones."""
    rows = parsed(lines).where(has("instruction", "input", "output"))
    out = rows.select(identity("sample_").alias("id"), text_of("instruction").alias("instruction"), text_of("input").alias("function"), text_of("output").alias("comment"), "line_no")
    return out.where((F.col("instruction") != "") & (F.col("function") != "") & (F.col("comment") != "")) if drop_blank else out


def prediction_samples(lines: DataFrame) -> DataFrame:
    return sft_samples(lines, drop_blank=False).withColumnRenamed("comment", "reference")


def pair_samples(lines: DataFrame) -> DataFrame:
    """Training pairs: id, prompt, chosen, rejected and system_prompt, which has a default; blank ones are dropped."""
    rows = parsed(lines).where(has("id", "prompt", "chosen", "rejected"))
    system = F.when(has("system_prompt"), text_of("system_prompt")).otherwise(F.lit(SYSTEM_PROMPT))
    out = rows.select(*[text_of(k).alias(k) for k in ("id", "prompt", "chosen", "rejected")], system.alias("system_prompt"))
    return out.where((F.col("prompt") != "") & (F.col("chosen") != "") & (F.col("rejected") != ""))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records under a schema of one's own; blank and malformed lines are skipped."""
    lines = spark.read.text(path).where(F.json_object_keys(strip(F.col("value"))).isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of an earlier output; none where there is no output yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], "id string")
    return read_records(spark, path, "id string").where(F.col("id").isNotNull()).distinct()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_records(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON Lines; null fields are left out, other characters than ASCII stay."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_log(train: DataFrame, evals: DataFrame, path: str) -> None:
    """Appends training and evaluation rows to one log; each row has the fields of its own kind only."""
    write_records(train.unionByName(evals, allowMissingColumns=True), path, append=True)


def write_summary(row: DataFrame, output_path: str) -> str:
    """A run's one-row summary beside its output, as ``<output>.summary.json``."""
    path = f"{output_path.removesuffix('.jsonl')}.summary.json"
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def swap_records(df: DataFrame, path: str) -> None:
    """Replaces records that ``df`` may itself be reading: written aside, then moved into place. The old ones are moved
    away before and deleted after, so a crash in between leaves them, or the new ones, beside the path."""
    spark = df.sparkSession
    fresh, aside = f"{path.rstrip('/')}.next", f"{path.rstrip('/')}.previous"
    df.write.mode("overwrite").json(fresh)
    jvm = spark.sparkContext._jvm
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, aside))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(gone, True)
    if fs.exists(old) and not fs.rename(old, gone) or not fs.rename(new, old):
        raise OSError(f"{path} could not be replaced; see {fresh} and {aside}")
    fs.delete(gone, True)
