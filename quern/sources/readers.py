"""Sources: text folders, JSON arrays, CSV with and without header, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QA

#: Encodings of question-answer files, in the order in which they are tried.
QA_ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a folder: file_path, suffix (lower case, with its dot), text.

    Files are read whole by the executors.  Only text formats are decoded here;
    office formats need a parser, which ``parsed_documents`` takes as a function.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return raw.select(name.alias("file_path"), suffix_of(name).alias("suffix"), F.col("value").alias("text"))


def parsed_documents(spark: SparkSession, path: str, parse) -> DataFrame:
    """As ``documents``, with ``parse(content: bytes, suffix: str) -> str`` run on each file by the executors."""
    read = F.udf(lambda content, suffix: parse(bytes(content), suffix))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    raw = raw.select(F.col("path").alias("file_path"), suffix_of(F.col("path")).alias("suffix"), "content")
    return raw.select("file_path", "suffix", read("content", "suffix").alias("text"))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path, header, line_no (from 0) and line of every data line that is not blank."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    split = raw.select("file_path", lines.alias("lines")).where(F.size("lines") > 0)
    return split.select("file_path", F.element_at("lines", 1).alias("header"), F.posexplode(F.expr("slice(lines, 2, size(lines))")).alias("line_no", "line"))


def question_answers(spark: SparkSession, path: str, names: str = "*.csv") -> DataFrame:
    """Questions and answers of headerless CSV files in one of QA_ENCODINGS, cleaned.

    A file is decoded by the first encoding under which it is valid.  Null cells
    are empty, both are trimmed, rows without a question are dropped.
    """
    def decoded(content):
        for encoding in QA_ENCODINGS:
            try:
                return bytes(content).decode(encoding)
            except UnicodeDecodeError:
                continue
        raise ValueError("a file is in none of " + ", ".join(QA_ENCODINGS))

    raw = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    text = raw.select(F.udf(decoded)("content").alias("text"))
    rows = text.select(F.explode(F.udf(_cells, "array<array<string>>")("text")).alias("cells"))
    return clean_questions(rows.select(F.expr("try_element_at(cells, 1)").alias("question"), F.expr("try_element_at(cells, 2)").alias("answer")))


def _cells(text: str) -> list[list[str]]:
    import csv
    import io

    return [row[:2] for row in csv.reader(io.StringIO(text, newline="")) if row]


def clean_questions(rows: DataFrame) -> DataFrame:
    """Trimmed question and answer; null is empty; rows without a question are dropped."""
    trimmed = {c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "") for c in ("question", "answer")}
    return rows.withColumns(trimmed).where(F.col("question") != "").select(*QA.replace(" string", "").split(", "))


def stopwords(words: DataFrame) -> DataFrame:
    """Distinct trimmed words, and the lower case of those in ASCII (column ``word``)."""
    own = words.select(F.regexp_replace("word", r"(?U)^\s+|\s+$", "").alias("word")).where("word <> ''")
    return own.unionByName(own.where(F.col("word").rlike(r"\A[\x00-\x7F]*\z")).select(F.lower("word").alias("word"))).distinct()


def collection(spark: SparkSession, name: str) -> DataFrame:
    """A stored collection: a catalog table, or a Parquet folder if the name holds a slash."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def by_ids(rows: DataFrame, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows whose id is in ``ids`` (column id), as a semi-join that grows with either side."""
    found = rows.join(ids.select("id"), "id", "left_semi")
    return found.select(*fields) if fields else found


def databases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES")
