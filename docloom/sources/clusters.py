"""Readers of document clusters: two directory layouts, one table layout.

All give ``documents`` (sample_id, doc_ord, document_id, title, source, text,
lang, dataset) and ``references`` (sample_id, ref_idx, text).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import strip

NEWS_SEPARATOR = r"\|\|\|\|\|"
DATASETS = ("vn_mds", "vims", "multi_news")


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that aren't; the text reader would keep a sign for them."""
    return content.map(lambda b: b.decode("utf-8", "ignore").strip() if b is not None else None)


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, text; no files give an empty table."""
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").load(pattern)
        return files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), _decoded("content").alias("text"))
    except AnalysisException:
        return spark.createDataFrame([], "path string, text string")


def _number(df: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def _finish(docs: DataFrame, refs: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """Only samples with a document and a reference; the first ``limit`` by name."""
    names = docs.select("sample_id").distinct().join(refs.select("sample_id").distinct(), "sample_id", "left_semi")
    if limit:
        names = names.orderBy("sample_id").limit(limit)
    return docs.join(names, "sample_id", "left_semi"), refs.join(names, "sample_id", "left_semi")


def read_vn_mds(spark: SparkSession, root: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    cluster = F.regexp_extract("path", r"/clusters/(cluster_[^/]*)/[^/]*$", 1)
    name = F.regexp_extract("path", r"/([^/]*)$", 1)
    files = _files(spark, f"{root}/clusters/cluster_*/*").withColumn("sample_id", cluster).withColumn("name", name)
    bodies = files.where(F.col("name").endswith(".body.txt")).withColumn("document_id", F.regexp_replace("name", r"\.body\.txt$", ""))
    infos = files.where(F.col("name").endswith(".info.txt")).select("sample_id", F.regexp_replace("name", r"\.info\.txt$", "").alias("document_id"), strip(F.regexp_extract("text", r"\A([^\r\n]*)", 1)).alias("title"))
    docs = _number(bodies.join(infos, ["sample_id", "document_id"], "left"), ["sample_id"], ["name"], "doc_ord")
    docs = docs.select("sample_id", "doc_ord", "document_id", F.coalesce("title", F.lit("")).alias("title"), F.lit("").alias("source"), "text", F.lit("vi").alias("lang"), F.lit("vn_mds").alias("dataset"))
    is_ref = F.col("name").startswith(F.concat("sample_id", F.lit(".ref"))) & F.col("name").endswith(".txt") & ~F.col("name").endswith(".tok.txt")
    refs = _number(files.where(is_ref & (F.col("text") != "")), ["sample_id"], ["name"], "ref_idx").select("sample_id", "ref_idx", "text")
    return _finish(docs, refs, limit)


def read_vims(spark: SparkSession, root: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, f"{root}/original/Cluster_*/original/*.txt")
    files = files.withColumn("sample_id", F.regexp_extract("path", r"/(Cluster_[^/]*)/original/[^/]*$", 1)).withColumn("document_id", F.regexp_extract("path", r"/([^/]*)\.txt$", 1))
    body = strip(F.regexp_extract("text", r"(?ms)^Content:[ \t]*(.*)\z", 1))
    field = lambda label: strip(F.regexp_extract("text", rf"(?m)^{label}:[ \t]*([^\r\n]*)", 1))
    docs = _number(files, ["sample_id"], [F.expr("try_cast(document_id AS bigint)"), "document_id"], "doc_ord")
    docs = docs.select("sample_id", "doc_ord", "document_id", field("Title").alias("title"), field("Source").alias("source"), F.when(body != "", body).otherwise(F.col("text")).alias("text"), F.lit("vi").alias("lang"), F.lit("vims").alias("dataset"))
    gold = _files(spark, f"{root}/summary/*/*.gold.txt").withColumn("sample_id", F.regexp_extract("path", r"/summary/([^/]*)/[^/]*$", 1))
    refs = _number(gold.where("text <> ''"), ["sample_id"], ["path"], "ref_idx").select("sample_id", "ref_idx", "text")
    return _finish(docs, refs, limit)


def split_documents(joined: Column) -> Column:
    """The parts between separators that aren't blank; without any, the whole."""
    parts = F.filter(F.transform(F.split(joined, NEWS_SEPARATOR), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(joined))


def with_row_number(rows: DataFrame, name: str) -> DataFrame:
    """``name``: the number of the row, from 0, in the order of the table.

    No global sort: partitions are counted first (one number for each reaches the
    driver), and a row's number is its place behind the partitions before.
    """
    placed = rows.withColumn("_at", F.monotonically_increasing_id())  # partition << 33 | place
    counts = placed.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()
    before, total = [], 0
    for r in sorted(counts):
        before.append((r["p"], total))
        total += r["n"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_p int, _start long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("_p", F.shiftright("_at", 33).cast("int")).join(starts, "_p")
    return out.withColumn(name, F.col("_start") + place).drop("_at", "_p", "_start")


def read_multi_news(rows: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows``: document(s) as a string with separators or an array, summary or
    summaries.  The sample is the row's number; no row is dropped."""
    kinds = dict(rows.dtypes)

    def pick(*names: str) -> Column:
        parts = []
        for n in names:
            if n in kinds:
                c = F.col(n)
                parts.append(F.when(F.size(c) > 0, c) if kinds[n].startswith("array") else F.when(c != "", F.array(c)))
        return F.coalesce(*parts, F.array().cast("array<string>"))

    if limit:
        rows = rows.limit(limit)
    numbered = with_row_number(rows.select(pick("document", "documents").alias("_d"), pick("summary", "summaries").alias("_s"), *[c for c in rows.columns if c in ("document", "documents")]), "sample_id")
    numbered = numbered.withColumn("sample_id", F.col("sample_id").cast("string"))
    single = [n for n in ("document", "documents") if n in kinds and not kinds[n].startswith("array")]
    texts = F.when(F.size("_d") == 0, F.col("_d")).otherwise(split_documents(F.get("_d", F.lit(0)))) if single else F.col("_d")
    docs = numbered.select("sample_id", F.posexplode(texts).alias("doc_ord", "text"))
    docs = docs.select("sample_id", "doc_ord", F.concat("sample_id", F.lit("_"), F.col("doc_ord").cast("string")).alias("document_id"), F.lit("").alias("title"), F.lit("").alias("source"), "text", F.lit("en").alias("lang"), F.lit("multi_news").alias("dataset"))
    refs = numbered.select("sample_id", F.posexplode(F.filter("_s", lambda s: strip(s) != "")).alias("ref_idx", "text"))
    return docs, refs


def read_samples(spark: SparkSession, dataset: str, root: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    if dataset == "vn_mds":
        return read_vn_mds(spark, root, limit)
    if dataset == "vims":
        return read_vims(spark, root, limit)
    if dataset == "multi_news":
        return read_multi_news(spark.read.parquet(root), limit)
    raise ValueError(f"unknown dataset: {dataset}")


def sample_list(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """sample_id, dataset, documents, reference_count of the complete samples."""
    solid = F.col("text").rlike(r"(?U)\S")
    d = docs.where(solid).groupBy("sample_id").agg(F.any_value("dataset").alias("dataset"), F.countDistinct("doc_id").alias("documents"))
    r = refs.where(solid).groupBy("sample_id").agg(F.count("*").alias("reference_count"))
    return d.join(r, "sample_id")
