"""From raw documents to token files: rules, duplicates, benchmark passages, mixture, ids.

Every stage is one operator of ``tradebook.llm``. ``STAGES`` are run one after the other, each over
all rows that the one before kept and wrote; ``run`` applies them to ``documents``. Filters judge each row by itself, under
a number that its file and its place there give it: rows that share an id may differ in their fate, and rows without an id are
judged like any other. Columns that ``documents`` has besides its own pass through. An empty table passes through
all stages; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tradebook.llm import decontamination, mixing, quality_rules, simhash, token_shards
from tradebook.llm.columns import bounded, read, written
from tradebook.llm.queries import public_tokenizer
from tradebook.sources.files import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame) -> DataFrame:
    """(number, row): each row with a number of its own, the same however often it is read again."""

    def placed(df: DataFrame) -> DataFrame:
        return df.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))

    try:
        rows = placed(docs)
    except AnalysisException:  # not read from files
        rows = placed(written(docs, "rows"))
    # One row for each file; a file has less than 2**40 rows.
    files = rows.select("file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file")).cast("long"))
    return rows.join(bounded(written(files, "files")), "file").select((F.shiftleft("rank", 40) + F.col("place")).alias("number"), "row")


def _under_number(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns of the rows, with the number in the place of doc_id."""
    return rows.select(F.col("number").alias("doc_id"), *(F.col("row")[c].alias(c) for c in columns))


def _without(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows whose number is not among ``numbers`` (doc_id)."""
    out = bounded(written(numbers.select(F.col("doc_id").alias("number")).distinct(), "out"))
    return rows.join(out, "number", "left_anti").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    rows = _numbered(docs)
    return _without(rows, quality_rules.judge(_under_number(rows, "text", "lang", "source")).filter(~F.col("kept")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id (one without an id only where none has any)."""
    rows = _numbered(docs)
    groups = written(simhash.near_duplicates(_under_number(rows, "text")).select("doc_id", "component_id"), "groups")
    ids = rows.select("number", F.col("row")["doc_id"].alias("id"))
    named = groups.join(ids, groups["doc_id"] == ids["number"]).select("number", "id", "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "number"))["number"]
    kept = bounded(written(named.groupBy("component_id").agg(first.alias("number")).select("number"), "kept"))
    return rows.join(kept, "number", "left_semi").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    rows = _numbered(docs)
    return _without(rows, decontamination.leaks(_under_number(rows, "text"), read(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: by file, and by row within a file. A null source is one of its own."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents, in the order that the mixture gave their files: doc_id, start, n_tokens, ids_crc32."""
    try:
        placed = _placed(docs)
    except AnalysisException:  # not read from files
        placed = _placed(written(docs, "mixed"))
    path = scratch_path(spark, "tokens")
    token_shards.write(placed, path, public_tokenizer(), order=("mixture_name_size", "mixture_name", "mixture_row"))
    return token_shards.digests(spark, path)


def _placed(docs: DataFrame) -> DataFrame:
    name = F.col("_metadata.file_name")
    return docs.select(
        "doc_id", "text", F.length(name).alias("mixture_name_size"), name.alias("mixture_name"), F.col("_metadata.row_index").alias("mixture_row")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
    ("token ids", tokens),
]

#: The stages estimate, link and schedule in several passes, which one SQL text cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
