"""Reading source trees, manifests and line files, and writing datasets, as Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that hold no sources of their own.
IGNORED = (
    ".git .hg .svn .idea .mypy_cache .pytest_cache .ruff_cache .tox .venv .vscode __pycache__ build dist env node_modules site-packages target vendor venv"
).split()
# Extensions and the language they stand for.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}
MANIFEST = T.StructType([T.StructField("repository_id", T.StringType()), T.StructField("source_url", T.StringType()), T.StructField("commit_sha", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
QUERIES = T.StructType([T.StructField("repository_id", T.StringType()), T.StructField("query_text", T.StringType()), T.StructField("relevance_grades", T.MapType(T.StringType(), T.DoubleType()))])


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(table, extension)


def source_tree(spark: SparkSession, root: str, largest: int = 1 << 20, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``path, length, language, digest, content`` of the source files under ``root``: known extensions, no ignored folder
    on the way, at most ``largest`` bytes. Size and path are filtered before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(root).where(F.col("length") <= largest)
    inside = F.regexp_replace(F.substring_index("path", root.rstrip("/"), -1), "^/+", "")
    folders = F.slice(F.split(inside, "/"), 1, F.size(F.split(inside, "/")) - 1)
    kept = files.where(~F.arrays_overlap(folders, F.array(*map(F.lit, [*IGNORED, *ignored]))) & language(F.col("path")).isNotNull())
    return kept.select(inside.alias("path"), "length", language(F.col("path")).alias("language"), F.sha2("content", 256).alias("digest"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of repositories. A repeated id is an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    twice = rows.groupBy("repository_id").count().where("count > 1").select("repository_id").take(1)
    if twice:
        raise ValueError(f"repository {twice[0][0]} stands twice in the manifest")
    return rows


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; any bad line is an error."""
    return spark.read.schema(QUERIES).option("mode", "FAILFAST").json(path)


def tolerant_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a line that isn't JSON of this schema becomes an issue, the others are kept."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    text = spark.read.text(path).where(F.trim("value") != "")
    rows = text.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    good = rows.where("r._corrupt_record is null and r is not null").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, rows.where("r._corrupt_record is not null or r is null").select(F.col("value").alias("line"))


def append(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """Adds rows to a folder of parquet, json lines or csv with a header; committed by task, so a retry leaves no halves."""
    writer = df.write.mode("append")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(folder)


def export_splits(df: DataFrame, folder: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """One parquet folder per split, all of the same schema, so that an empty split keeps its types."""
    for split in splits:
        df.where(F.col("split") == split).drop("split").write.mode("overwrite").parquet(f"{folder}/{split}")


def model_cache(df: DataFrame, folder: str) -> None:
    """Rows keyed by repository and commit, one folder each; writing a commit again replaces it alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id", "commit_sha").parquet(folder)
