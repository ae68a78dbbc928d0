"""Readers. Files hold one JSON document (object or array) with ``multiline``, else JSON lines;
lines are splittable and are the form to keep large tables in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rubricon import schemas
from rubricon.functions.text import trim_space
from rubricon.sources.trees import FolderTree


def _json(spark: SparkSession, path, schema: str, multiline: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def file_stem():
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def answers(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Answer runs; the model is the stem of the file name."""
    return _json(spark, path, schemas.ANSWERS, multiline).select("*", file_stem().alias("model"))


def partitioned_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer runs kept as JSON lines under ``model=<name>`` folders."""
    return spark.read.schema(schemas.ANSWERS + ", model string").json(path)


def facts(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Facts files, one per model; unequal question counts are an error."""
    out = _json(spark, path, schemas.FACTS, multiline)
    sizes = out.groupBy("model").agg(F.count_distinct("question").alias("n")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi")
    ).first()
    if sizes["lo"] != sizes["hi"]:
        raise ValueError(f"models cover between {sizes['lo']} and {sizes['hi']} questions")
    return out


def rubrics(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Rubric records; a file may hold one record or an array of them."""
    return _json(spark, path, schemas.RUBRICS, multiline)


def keyed_rubrics(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Rubric records kept as one JSON object per file (or line), by a key that is dropped. A text that
    is no such object is an error."""
    texts = spark.read.text(path, wholetext=multiline).where(trim_space(F.col("value")) != "")
    records = F.from_json("value", f"map<string, struct<{_fields(schemas.RUBRICS)}>>", {"mode": "FAILFAST"})
    return texts.select(F.explode(F.map_values(records)).alias("_r")).select("_r.*")


def _fields(columns: str) -> str:
    """Column definitions as the fields of a struct."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(columns))


def grades(spark: SparkSession, path, labels: dict[str, str] | None = None, multiline: bool = True) -> DataFrame:
    """One row per graded question. ``labels`` maps file stems to display names."""
    raw = _json(spark, path, schemas.GRADES, multiline).withColumn("stem", file_stem())
    name = F.coalesce("model", "stem")
    if labels:
        pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
        name = F.coalesce(F.try_element_at(pairs, F.col("stem")), name)
    return raw.select(name.alias("model"), F.posexplode("results").alias("pos", "_r")).select("model", "pos", "_r.*")


def taxonomy(spark: SparkSession, path) -> DataFrame:
    """Question taxonomy; required columns are checked before anything runs."""
    out = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in schemas.TAXONOMY_REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def questions(spark: SparkSession, path) -> DataFrame:
    """One question per line, stripped, blank lines dropped."""
    text = trim_space(F.col("value"))
    return spark.read.text(path).select(text.alias("question")).where(text != "")


def plain_answers(spark: SparkSession, path, question: str) -> DataFrame:
    """Whole text files as answers to one question."""
    return spark.read.text(path, wholetext=True).select(F.lit(question).alias("question"), F.col("value").alias("answer"))


def inline_answer(spark: SparkSession, text: str, question: str) -> DataFrame:
    return spark.createDataFrame([(question, text)], "question string, answer string")


def any_answers(spark: SparkSession, source: str, question: str, is_path: bool = True) -> DataFrame:
    """Answers given as a JSON list file, a plain text file or the text itself. What is not a
    list becomes one answer to ``question``."""
    if not is_path:
        return inline_answer(spark, source, question)
    first = questions(spark, source).first()
    if first is not None and first[0].startswith("["):
        return answers(spark, source).select("question", "answer")
    return plain_answers(spark, source, question)


def turn_logs(spark: SparkSession, paths: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """Agent turns; model, run, question and turn come from
    ``.../<model>/<run>/<question>/turns/<turn>/<file>``. Folder names with a colon must be
    listed one by one, since globs over them fail; ``turn_log_tree`` reads a whole tree."""
    logs = _json(spark, paths, schemas.TURNS, multiline)
    return _placed(logs.select("*", F.col("_metadata.file_path").alias("_path")))


def turn_log_tree(spark: SparkSession, folder: str, name: str = "result.json") -> DataFrame:
    """Agent turns of a whole tree of logs, with any folder names: one row per file ``name`` under
    ``<model>/<run>/<question>/turns/<turn>/``. An unreadable file gives a row of nulls."""
    spark.dataSource.register(FolderTree)
    files = spark.read.format("folder_tree").option("name", name).load(folder)
    return _placed(files.select(F.from_json("value", schemas.TURNS).alias("_log"), F.col("path").alias("_path")).select("_log.*", "_path"))


def _placed(logs: DataFrame) -> DataFrame:
    part = lambda n: F.element_at(F.split(F.col("_path"), "/"), -n)
    return logs.withColumns({"model": part(6), "run": part(5), "question": part(4), "turn": part(2)}).drop("_path")
