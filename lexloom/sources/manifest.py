"""Source manifests, text scans, JSON lines, and the knowledge base's record of where it came from.

All paths go through Spark's readers and writers, so they may lie in any store that Spark reaches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize

POLICY = "local_text_only"


def _field(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where the manifest leaves the field out everywhere."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def check_policy(record: DataFrame, policy: str = POLICY) -> None:
    """Raise unless each record (manifests and knowledge bases have one) names the policy."""
    if record.filter(~_field(record, "source_policy", "string").eqNullSafe(F.lit(policy))).limit(1).count():
        raise ValueError(f"source_policy must be {policy!r}")


def read_manifest(spark: SparkSession, path: str, policy: str = POLICY) -> DataFrame:
    """One row per entry of ``documents``. A wrong policy or an empty list raises."""
    manifest = spark.read.json(path, multiLine=True)
    check_policy(manifest, policy)
    if not dict(manifest.dtypes).get("documents", "").startswith("array<struct"):
        raise ValueError("the manifest needs a non-empty list of documents")
    return manifest.select(F.inline("documents"))


def entries(manifest: DataFrame, root: str, enabled_only: bool = True) -> DataFrame:
    """The manifest's rows with clean ``doc_id`` and ``source_path``; a bad entry raises with what is wrong.

    ``enabled`` is true where it is left out. Paths are relative, below ``root``, without ``..``, and end in .txt.
    """
    rows = manifest.withColumns({"doc_id": F.coalesce(F.trim(_field(manifest, "doc_id", "string")), F.lit("")), "source_path": F.coalesce(F.trim(_field(manifest, "source_path", "string")), F.lit(""))})
    if enabled_only:
        rows = rows.filter(F.coalesce(_field(manifest, "enabled", "boolean"), F.lit(True)))
    path = F.col("source_path")
    wrong = (
        F.when(F.col("doc_id") == "", "no doc_id")
        .when(F.count(F.lit(1)).over(W.partitionBy("doc_id")) > 1, "doc_id given twice")
        .when(path == "", "no source_path")
        .when(~path.startswith(root.rstrip("/") + "/") | path.rlike(r"(^|/)\.\.(/|$)"), "source_path outside the text folder")
        .when(~F.lower(path).endswith(".txt"), "source_path is no .txt file")
    )
    bad = rows.select("doc_id", "source_path", wrong.alias("wrong")).filter("wrong is not null").orderBy("doc_id", "source_path").first()
    if bad is not None:
        raise ValueError(f"manifest entry {bad.doc_id!r} ({bad.source_path!r}): {bad.wrong}")
    return rows


def read_texts(spark: SparkSession, base: str, paths: list[str] | None = None, least: int = 500) -> DataFrame:
    """source_path (below ``base``), text: whole files, bytes that are no UTF-8 left out, normalised, at least ``least`` characters."""
    base = base.rstrip("/")
    at = [f"{base}/{p}" for p in paths] if paths is not None else base
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").text(at, wholetext=True)
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substring_index(whole, base.partition("://")[2] or base, -1)
    text = normalize(F.replace(F.make_valid_utf8(F.col("value")), F.lit("�"), F.lit("")))
    return files.select(F.ltrim(below, F.lit("/")).alias("source_path"), text.alias("text")).filter(F.char_length("text") >= least)


def manifest_texts(spark: SparkSession, path: str, base: str, root: str, least: int = 500) -> DataFrame:
    """The enabled entries of the manifest with their texts. The manifest's paths, one file's content, go to the driver."""
    listed = entries(read_manifest(spark, path), root)
    paths = [r.source_path for r in listed.select("source_path").distinct().collect()]
    return listed.join(read_texts(spark, base, paths, least), "source_path") if paths else listed.withColumn("text", F.lit("")).limit(0)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, first: int | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. ``strict`` raises on a bad row, else its fields are null."""
    rows = spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "PERMISSIVE")
    return rows if first is None else rows.limit(first)


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append the rows whose trimmed, lower-case key the JSON lines at ``path`` don't have yet; a rerun adds nothing."""
    spark = rows.sparkSession
    same = lambda c: F.lower(F.trim(c))
    fresh = rows.withColumn("_key", same(F.col(key))).dropDuplicates(["_key"])
    try:
        there = spark.read.schema(rows.schema).json(path).select(same(F.col(key)).alias("_key"))
        fresh = fresh.join(there, "_key", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.drop("_key").write.mode("append").json(path)


def save_base(chunks: DataFrame, sources: DataFrame, path: str, policy: str = POLICY, **settings: str) -> None:
    """Chunks as Parquet, the digest and size of each source (``doc_id, text``), and one record that is written last."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    content = F.encode("text", "UTF-8")
    sources.select("doc_id", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes")).write.mode("overwrite").parquet(f"{path}/sources")
    record = {"source_policy": F.lit(policy), "created_at": F.current_timestamp().cast("string"), "chunk_count": F.lit(spark.read.parquet(f"{path}/chunks").count())}
    spark.range(1).select(*[v.alias(k) for k, v in (record | {k: F.lit(v) for k, v in settings.items()}).items()]).write.mode("overwrite").json(f"{path}/record")


def load_base(spark: SparkSession, path: str, policy: str = POLICY) -> DataFrame:
    """The chunks of a base that has a record with the policy; else it raises."""
    try:
        check_policy(spark.read.json(f"{path}/record"), policy)
    except AnalysisException as e:
        raise FileNotFoundError(f"no record at {path}: build the base first") from e
    return spark.read.parquet(f"{path}/chunks")
