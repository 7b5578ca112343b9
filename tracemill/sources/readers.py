"""Readers and writers of question sets, probe logs and results. Paths are Hadoop paths; Spark does the reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.relational import numbered

#: Spellings of true, and the schema of a probe log.
TRUE = ("1", "true", "t", "yes", "y")
PROBE_RECORD = (
    "qid string, idx int, probe_idx int, final_cause string, step_tokens_final int, probe_record struct<step:int, kind:string, probe_text:string, "
    "slot:map<string,string>, feats:map<string,string>, classifier_prob:double, classifier_letter:string, early_stop_triggered:string, qa_mode:string>"
)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, JSON lines, a JSON array or CSV, by the extension (Parquet if none is known)."""
    lower = path.lower()
    if lower.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if lower.endswith(".json"):
        return read_json(spark, path)
    if lower.endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character that is not white space."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
    array = head is not None and head["value"].lstrip().startswith("[")
    return spark.read.option("multiLine", array).json(path)


def read_csv(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """CSV with a header; with `lines`, values may hold line breaks, and each file is one task."""
    return spark.read.csv(path, header=True, multiLine=lines, escape='"')


def read_probe_log(spark: SparkSession, path: str) -> DataFrame:
    """(qid, step, kind, qa_mode, probe_answer, has_answer, early_stop, feats): lines that are blank, no JSON or of no
    question are skipped; a log without any probe is an error when its rows are used."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", PROBE_RECORD).alias("r")).select("r.*").filter(F.col("qid").isNotNull() & (F.col("qid") != ""))
    r = F.col("probe_record")
    step = F.coalesce(r["feats"]["step"].cast("double").cast("int"), r["step"], F.lit(0))
    letter = F.upper(F.coalesce(r["classifier_letter"], r["slot"]["probe_letter"], F.lit("")))
    closed = r["qa_mode"] == "closeqa"
    answer = F.when(closed, letter).otherwise(F.trim(F.coalesce(r["probe_text"], F.lit(""))))
    # A closed question without a letter counts as answered, as an empty text is part of every text.
    has = F.when(closed, answer.isin("", "A", "B", "C", "D", "AB", "BC", "CD", "ABC", "BCD", "ABCD")).otherwise(answer != "")
    return parsed.select("qid", step.alias("step"), r["kind"].alias("kind"), r["qa_mode"].alias("qa_mode"), answer.alias("probe_answer"), has.cast("int").alias("has_answer"), F.lower(F.trim(r["early_stop_triggered"])).isin(*TRUE).alias("early_stop"), r["feats"].alias("feats"))


def read_numbered_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON arrays of a folder's files with file_id, the first number in the file's name (-1 if none), to order by. A file
    whose top level is no array is an error."""
    heads = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.substring(F.ltrim(F.regexp_replace(F.substring("value", 1, 4096), r"^\s+", "")), 1, 1).alias("head"))
    odd = heads.filter("head <> '['").first()
    if odd is not None:
        raise ValueError(f"{odd['file']} holds no JSON array")
    df = spark.read.option("multiLine", True).json(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn("file_id", F.coalesce(F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).cast("long"), F.lit(-1)))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, completion): the first two turns of conversations of JSON, array<struct<value>>, with two turns at least."""
    turns = F.col("conversations")
    return spark.read.json(path).filter(F.size(turns) >= 2).select(turns[0]["value"].alias("prompt"), turns[1]["value"].alias("completion"))


def read_bursts(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(prompt_tokens, output_tokens) of a trace in CSV: a model's requests that got an answer."""
    rows = spark.read.csv(path, header=True).filter((F.col("Model") == model) & (F.col("Response tokens").cast("long") > 0))
    return rows.select(F.col("Request tokens").cast("long").alias("prompt_tokens"), F.col("Response tokens").cast("long").alias("output_tokens"))


def question_kind(df: DataFrame) -> str:
    """choice or math, by the columns."""
    if {"sent1", "ending0", "ending1", "ending2", "ending3"} <= set(df.columns):
        return "choice"
    if "problem" in df.columns:
        return "math"
    raise ValueError("neither a choice nor a math question set")


def with_defaults(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns that are missing become empty."""
    return df.withColumns({c: F.lit("") for c in columns if c not in df.columns})


def question_ids(df: DataFrame, order: str, unique: str = "unique_id") -> DataFrame:
    """qid: the unique id, or the row's number where that is empty."""
    return numbered(df, order, name="__row").withColumn("qid", F.coalesce(F.nullif(F.col(unique), F.lit("")), F.col("__row").cast("string"))).drop("__row")


def default_features(df: DataFrame, wanted: list[str] | None, usual: list[str], excluded: list[str]) -> list[str]:
    """Configured features that exist, else the usual ones that do, else all numeric columns but the excluded."""
    if wanted:
        return [c for c in wanted if c in df.columns]
    found = [c for c in usual if c in df.columns]
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return found or [c for c, kind in df.dtypes if kind in numeric and c not in excluded]


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_nested(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_probe_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_one_per_item(df: DataFrame, key: str, path: str, total: int) -> None:
    """A folder per item, the key padded to the digits of the total, four at least; longer keys stay whole, and a minus
    stays in front."""
    width = max(4, len(str(total)))
    name = F.col(key).cast("string")
    sign = F.when(name.startswith("-"), "-").otherwise("")
    rest = F.substr(name, F.length(sign) + 1)
    padded = F.concat(sign, F.lpad(rest, F.greatest(F.length(rest), width - F.length(sign)), "0"))
    df.withColumn("item", padded).repartition("item").write.mode("overwrite").partitionBy("item").json(path)


def append_missing(df: DataFrame, path: str, key: str = "_id") -> int:
    """Appends the rows whose key the JSON at path does not have yet; returns how many."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        df = df.join(spark.read.json(path).select(key).distinct(), key, "left_anti")
    count = df.count()
    if count:
        df.write.mode("append").json(path)
    return count


def write_metrics(df: DataFrame, path: str, by: str = "data_source") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)
