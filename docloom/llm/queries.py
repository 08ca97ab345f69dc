"""The queries of the training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import canonical, mixing, neardup, reading, sentences, spans, splitting, tokens, truncation
from docloom.llm.language import learn_languages
from docloom.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "ref_texts"))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record how much of it also stands elsewhere."""
    return spans.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "ref_texts"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.latest(table(spark, sf_dir, "llm_results"), "llm_result", "call_id", "llm_model", "text", "loaded_at").unionByName(
        truncation.latest(table(spark, sf_dir, "results"), "result", "result_id", "llm_model", "generated_summary", "loaded_at")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judge(_answers(spark, sf_dir)).where("truncated").select("record_kind", "record_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's texts are cut."""
    return truncation.rates(truncation.judge(_answers(spark, sf_dir)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_no").alias("id"), "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.similar(_records(spark, sf_dir))
    return neardup.all_pairs(members, links, full_links=True)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: its class of copies and its links to other texts."""
    members, links = neardup.similar(_records(spark, sf_dir))
    return neardup.classes(members, links)


def _split(spark: SparkSession, sf_dir: str, with_text: bool) -> list[tuple[str, DataFrame]]:
    return [
        ("document", splitting.split_oversized(table(spark, sf_dir, "documents"), "doc_id", with_text=with_text)),
        ("chunk", splitting.split_oversized(table(spark, sf_dir, "chunks"), "chunk_no", with_text=with_text)),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = (splitting.found(df, kind) for kind, df in _split(spark, sf_dir, False))
    return docs.unionByName(chunks)


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = (df.select(F.lit(kind).alias("record_kind"), "record_id", F.inline("pieces")) for kind, df in _split(spark, sf_dir, True))
    return docs.unionByName(chunks)


_FIELD = ["record_kind", "record_id", "field_name"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.affected(canonical.fields(table(spark, sf_dir, "documents"), table(spark, sf_dir, "ref_texts")), _FIELD)


def p5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalize(canonical.fields(table(spark, sf_dir, "documents"), table(spark, sf_dir, "ref_texts")), _FIELD)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = learn_languages(docs)
    return sentences.split_sentences(docs, sentences.learn(docs, languages=languages), languages=languages)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each target source has to give."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0).select(mixing.source_key("source").alias("key"), F.length("text").alias("n"))
    goals = table(spark, sf_dir, "mix_targets").where("source is not null").withColumn("key", mixing.source_key("source"))
    sizes = docs.groupBy("key").agg(F.count("*").alias("documents"), F.sum("n").alias("chars"))
    return goals.join(F.broadcast(sizes.join(F.broadcast(goals.select("key")), "key", "left_semi")), "key", "left").fillna(0, ["documents", "chars"]).select(
        "source", "documents", "chars", (F.col("chars") * F.col("max_repeats")).alias("most_chars")
    )


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between class representatives; p3_classes has the membership."""
    _, links = neardup.similar(_records(spark, sf_dir))
    return links.select(F.col("kind").alias("record_kind"), F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("likeness", 6).alias("likeness"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    return levels.select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean difficulty of each dataset and level."""
    docs = table(spark, sf_dir, "documents")
    levels = reading.reading_levels(docs, table(spark, sf_dir, "reading_labels"))
    return levels.join(docs.select("doc_id", "dataset"), "doc_id").groupBy("dataset", "reading_level").agg(
        F.count("*").alias("documents"), F.round(F.avg("difficulty"), 4).alias("mean_difficulty")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_shares, p2_found, p2_rates, p3_found, p3_classes, p3_links, p4_found, p4_pieces, p5_found, p5_canonical,
        p6_found, p7_ids, p8_mix, p8_copies, p8_pool, p9_found, p9_profile,
    )
}

_LONG = """
SELECT '{kind}' AS record_kind, CAST({key} AS BIGINT) AS record_id,
       MAX(CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\\s\\p{{Z}}\\p{{P}}\\x1c-\\x1f\\x85\\x0b]'), lambda x: length(x))) > 2000
           THEN 1 ELSE 0 END) AS hard_cut
FROM {table} WHERE length(text) > 2000 GROUP BY {key}"""

ORACLES: dict[str, str] = {
    "p8_pool": """
SELECT t.source, count(d.k) AS documents, coalesce(sum(d.n), 0)::BIGINT AS chars, (coalesce(sum(d.n), 0) * any_value(t.max_repeats))::BIGINT AS most_chars
FROM mix_targets t LEFT JOIN (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS k, length(text) AS n FROM documents WHERE length(text) > 0) d
ON lower(regexp_replace(t.source, '^\\s+|\\s+$', '', 'g')) = d.k GROUP BY t.source""",
    "p4_found": _LONG.format(kind="document", key="doc_id", table="documents") + " UNION ALL " + _LONG.format(kind="chunk", key="chunk_no", table="chunks"),
}
