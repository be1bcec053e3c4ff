"""Files in and out: question sets, flashcard and metric tables, file stores."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTIONS = "document STRING, questions ARRAY<STRUCT<question: STRING, question_type: STRING, relevant_chunk_ids: ARRAY<BIGINT>, relevant_pages: ARRAY<BIGINT>>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(document, question, question_type, relevant_chunk_ids, relevant_pages) of a JSON set; an item without a question or without either kind of relevance is an error."""
    q = spark.read.schema(QUESTIONS).json(path, multiLine=True).select("document", F.explode("questions").alias("q")).select("document", "q.*")
    bad = F.col("question").isNull() | (F.trim("question") == "") | (F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) + F.coalesce(F.size("relevant_pages"), F.lit(0)) <= 0)
    return q.withColumn("question", F.when(bad, F.raise_error(F.concat(F.lit("bad question in "), F.coalesce("document", F.lit("?"))))).otherwise(F.col("question")))


def write_flashcards(cards: DataFrame, path: str) -> None:
    """front, back, page as CSV in the order of ids; a missing page is empty."""
    cards.orderBy("id").select("front", "back", F.coalesce(F.col("page").cast("string"), F.lit("")).alias("page")).write.mode("overwrite").csv(path, header=True, quoteAll=False)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").csv(path, header=True)


def read_store(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of a folder's files. Paths that leave the folder are refused."""
    if ".." in path.split("/") or ".." in pattern.split("/"):
        raise ValueError("the path leaves the store")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def delete_from_store(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """Delete the named files of a folder and return those that there were. A name that leaves the folder is refused before any is deleted."""
    if bad := [n for n in names if not n or "/" in n or n in (".", "..")]:
        raise ValueError(f"the path leaves the store: {bad[0]}")
    file = spark._jvm.org.apache.hadoop.fs.Path
    fs = file(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in names if fs.delete(file(f"{path.rstrip('/')}/{n}"), False)]


def vector_id(owner: str, document: str, chunk: str) -> Column:
    """The same id for the same vector in every run: a digest of its owner, document and chunk."""
    return F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in (owner, document, chunk))), 256)


def checked_vectors(new: DataFrame, vector: str, length: int) -> DataFrame:
    """new, where a vector of another length is an error."""
    n = F.size(vector)
    bad = F.raise_error(F.concat(F.lit(f"a vector must have {length} parts, not "), n.cast("string")))
    return new.withColumn(vector, F.when(n == length, F.col(vector)).otherwise(bad))


def export_blocks(sections: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, level, text): the blocks of a document to render, in order: a heading for each section, its paragraph, and a bullet for each item. sections has (key, number, title, body, items)."""
    heading = F.struct(F.lit("heading").alias("kind"), F.lit(2).alias("level"), F.col("title").alias("text"))
    paragraph = F.struct(F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), F.col("body").alias("text"))
    bullets = F.transform(F.coalesce("items", F.array()), lambda x: F.struct(F.lit("bullet").alias("kind"), F.lit(0).alias("level"), x.alias("text")))
    blocks = F.filter(F.concat(F.array(heading, paragraph), bullets), lambda b: F.coalesce(b["text"], F.lit("")) != "")
    rows = sections.select(key, "number", F.posexplode(blocks).alias("at", "b"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("number", "at")).cast("long") - 1
    return rows.select(key, pos.alias("pos"), "b.kind", F.col("b.level").cast("long").alias("level"), "b.text")


def overwrite_keys(new: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys that occur in new; the rest stays."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
