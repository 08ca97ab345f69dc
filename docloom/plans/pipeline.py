"""The summarization pipeline over all samples at once.

Input ``docs``: sample_id, doc_ord, document_id, title, source, text, lang,
dataset.  Every stage is one plan over all samples; a sample is a key, not a
loop.  Work on a text stays in its row; pairs within a sample run in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import SUMMARY_BUDGETS, GraphWeights, PipelineConfig
from docloom.functions import text as TX
from docloom.functions.vectors import EmbeddingProvider, HashEmbedding, with_embedding
from docloom.operators import dedup, evaluate, graph, phrases, salience, segments
from docloom.operators.recognise import Recogniser
from docloom.plans import prompts
from docloom.plans.providers import LeadSummarizer, Summarizer, with_summary
from docloom.runtime import spread, written

SAMPLE, CHUNK = "sample_id", "chunk_idx"
POSITIONS = 1_000_000  # chunk_idx = doc_ord * POSITIONS + position keeps the order of documents


@dataclass
class Run:
    """The relations of one run."""

    config: PipelineConfig
    docs: DataFrame
    chunks: DataFrame
    phrases: DataFrame
    groups: DataFrame | None
    edges: DataFrame | None
    communities: DataFrame
    members: DataFrame
    community_summaries: DataFrame
    merges: DataFrame
    summaries: DataFrame


def budgets(dataset: Column, config: PipelineConfig) -> tuple[Column, Column]:
    def one(index: int, given: int | None) -> Column:
        if given is not None:
            return F.lit(given)
        out = F.lit(None).cast("int")
        for name, values in SUMMARY_BUDGETS.items():
            out = F.when(dataset == name, F.lit(values[index])).otherwise(out)
        return out

    return one(0, config.max_summary_words), one(1, config.max_output_tokens)


def language_code(column: str = "lang") -> Column:
    return F.lower(F.substring(F.coalesce(F.col(column), F.lit("")), 1, 2))


def prepare(docs: DataFrame) -> DataFrame:
    """The columns the pipeline reads; rows without a sample are left out."""
    return spread(docs).where(F.col(SAMPLE).isNotNull()).select(
        F.col(SAMPLE).cast("string").alias(SAMPLE),
        F.col("doc_ord").cast("long").alias("doc_ord"),
        "document_id",
        "title",
        "source",
        F.coalesce("text", F.lit("")).alias("text"),
        language_code().alias("lang"),
        "dataset",
    )


def make_chunks(docs: DataFrame, config: PipelineConfig, provider: EmbeddingProvider) -> DataFrame:
    keys = [SAMPLE, "doc_ord", "document_id", "dataset", "lang"]
    if config.chunking == "simple":
        made = segments.simple_chunks(docs, keys, config.target_min_tokens, config.target_max_tokens)
    else:
        made = segments.semantic_chunks(
            docs, keys, config.target_min_tokens, config.target_max_tokens, config.semantic_percentile, config.semantic_min_chunk, provider
        )
    return made.withColumn(CHUNK, F.col("doc_ord") * POSITIONS + F.col("position"))


def _support_rows(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chosen segments of the chunks kept in each community."""
    kept = members.where("kept").select(SAMPLE, "community_idx", CHUNK)
    rows = kept.join(chunks.select(SAMPLE, CHUNK, "document_id", "units", "support"), [SAMPLE, CHUNK])
    rows = rows.select(SAMPLE, "community_idx", CHUNK, "document_id", "units", F.posexplode("support").alias("rank", "unit"))
    return rows.select(SAMPLE, "community_idx", CHUNK, "document_id", "rank", F.get("units", F.col("unit")).alias("u"))


def _sentences(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = rows.select(*keys, "document_id", F.col("u.center").alias("center"), F.posexplode("u.texts").alias("offset", "sentence"))
    return out


def _joined(df: DataFrame, keys: list[str], order: list[str], text: str, glue: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["_text"]), glue).alias(text))


@dataclass
class Base:
    """What doesn't depend on the edge weights: computed once for a whole grid."""

    docs: DataFrame
    chunks: DataFrame
    phrases: DataFrame
    groups: DataFrame | None
    parts: DataFrame | None


def run(docs: DataFrame, config: PipelineConfig | None = None, provider: EmbeddingProvider | None = None, summarizer: Summarizer | None = None, models: Mapping[str, Callable[[], Recogniser]] | None = None) -> Run:
    """All relations of a run over all samples.

    Samples without any sentence still get a (merged, empty) summary.  Null
    texts count as empty.  Repeated documents are separate documents of their
    sample.
    """
    config, provider = config or PipelineConfig(), provider or HashEmbedding()
    return finish(base(docs, config, provider, models), config, provider, summarizer)


def run_grid(
    docs: DataFrame,
    weights: list[GraphWeights],
    config: PipelineConfig | None = None,
    provider: EmbeddingProvider | None = None,
    summarizer: Summarizer | None = None,
    models: Mapping[str, Callable[[], Recogniser]] | None = None,
) -> Iterator[Run]:
    """One run for each setting of the weights; everything before them is shared."""
    config, provider = config or PipelineConfig(), provider or HashEmbedding()
    shared = base(docs, config, provider, models)
    for w in weights:
        yield finish(shared, replace(config, alpha=w.alpha, beta=w.beta), provider, summarizer)


def base(docs: DataFrame, config: PipelineConfig, provider: EmbeddingProvider, models: Mapping[str, Callable[[], Recogniser]] | None = None) -> Base:
    docs = prepare(docs)
    chunks = salience.chunk_support(
        make_chunks(docs, config, provider), provider, config.evidence_max_tokens, config.salience, config.pacsum_beta, config.pacsum_lambda1, config.pacsum_lambda2
    )
    chunks = written(chunks, "chunks")
    slim = chunks.select(SAMPLE, CHUNK, "document_id", "position", "embedding")

    extracted = phrases.extract(chunks, [SAMPLE, CHUNK], "text", "lang", models)
    mapped = written(phrases.phrase_map(extracted, [SAMPLE, CHUNK]), "phrases")
    typed = written(phrases.canonicalise(mapped, SAMPLE, [CHUNK], config.entity_merge_threshold, provider), "phrases")

    groups = None
    if config.dedup_chunks:
        shared = typed if config.dedup_require_shared_phrase else None
        groups = dedup.duplicate_groups(slim, SAMPLE, CHUNK, ["document_id", "position"], "embedding", config.dedup_threshold, shared)
        groups = written(groups, "duplicates")

    parts = None
    if config.use_graph:
        candidates = written(graph.candidate_edges(slim, SAMPLE, CHUNK, "document_id", "position", "embedding", config.k_neighbors), "candidates")
        idf = phrases.phrase_idf(typed, chunks, SAMPLE, CHUNK)
        similarity = phrases.phrase_similarity(typed, idf, candidates, SAMPLE, CHUNK)
        parts = graph.edge_components(candidates, slim, SAMPLE, CHUNK, "document_id", "position", "embedding", similarity, groups, config.tau)
        parts = written(parts, "edges")
    return Base(docs, chunks, typed, groups, parts)


def finish(shared: Base, config: PipelineConfig, provider: EmbeddingProvider, summarizer: Summarizer | None = None) -> Run:
    summarizer = summarizer or LeadSummarizer()
    docs, chunks, typed, groups = shared.docs, shared.chunks, shared.phrases, shared.groups
    edges = graph.weigh(shared.parts, config.weights(), config.duplicate_edge_factor) if shared.parts is not None else None
    communities = written(graph.communities(chunks, edges, SAMPLE, CHUNK, config.resolution, config.seed), "communities")

    if groups is not None and config.community_dedup:
        members = dedup.community_representatives(communities, groups, [SAMPLE, "community_idx"], CHUNK, CHUNK)
    else:
        members = communities.select("*", F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("boolean").alias("is_representative"), F.lit(True).alias("kept"))
    members = written(members, "members")

    about = docs.groupBy(SAMPLE).agg(F.min("dataset").alias("dataset"), F.min("lang").alias("lang"))
    words, most = budgets(F.col("dataset"), config)
    about = about.withColumn("max_words", words).withColumn("max_tokens", most)
    by = [SAMPLE, "community_idx"]
    kept = members.where("kept").join(chunks.select(SAMPLE, CHUNK, "document_id", "position", "text"), [SAMPLE, CHUNK])
    support = written(_support_rows(members, chunks), "support")
    source = _joined(kept.select(*by, "document_id", "position", F.col("text").alias("source_text")), by, ["document_id", "position"], "source_text", "\n\n")
    backing = salience.compact_support(_sentences(support, by), by, ["document_id", "center", "offset"], "sentence")
    anchors = phrases.entity_list(typed.join(members.where("kept").select(*by, CHUNK), [SAMPLE, CHUNK]), by)
    topics = source.join(backing, by, "left").join(anchors, by, "left").join(about, SAMPLE)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    topics = topics.select(
        *by, "max_words", "max_tokens", prompts.topic_prompt(F.col("source_text"), blank("support"), blank("entities"), F.col("lang"), F.col("dataset"), F.col("max_words")).alias("prompt")
    )
    partial = written(with_summary(topics, summarizer), "community-summaries")

    per_sample = partial.groupBy(SAMPLE).agg(
        F.count("*").alias("communities"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.min(F.col("summary")).alias("only")
    )
    many = about.join(per_sample, SAMPLE, "left").fillna(0, ["communities", "tokens_in", "tokens_out"])
    to_merge = many.where("communities <> 1")
    merged = _joined(partial.select(SAMPLE, "community_idx", F.col("summary").alias("summaries")), [SAMPLE], ["community_idx"], "summaries", "\n")
    pool = _merge_support(support, merged, to_merge, config, provider)
    all_anchors = phrases.entity_list(typed.join(members.where("kept").select(SAMPLE, CHUNK), [SAMPLE, CHUNK]), [SAMPLE])
    merges = to_merge.join(merged, SAMPLE, "left").join(pool, SAMPLE, "left").join(all_anchors, SAMPLE, "left")
    merges = merges.select(
        SAMPLE, "max_words", "max_tokens", prompts.merge_prompt(blank("summaries"), blank("support"), blank("entities"), F.col("lang"), F.col("dataset"), F.col("max_words")).alias("prompt")
    )
    merges = written(with_summary(merges, summarizer), "merges")
    chunk_count = chunks.groupBy(SAMPLE).agg(F.count("*").alias("chunk_count"))
    final = many.join(merges.select(SAMPLE, "summary", "input_tokens", "output_tokens"), SAMPLE, "left").join(chunk_count, SAMPLE, "left")
    text = F.when(F.col("communities") == 1, F.col("only")).otherwise(F.coalesce("summary", F.lit("")))
    summaries = final.select(
        SAMPLE,
        "dataset",
        "lang",
        TX.trim_to_words(text, F.col("max_words")).alias("summary"),
        (F.col("tokens_in") + F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        (F.col("tokens_out") + F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        (F.col("communities") + F.when(F.col("communities") == 1, 0).otherwise(1)).alias("llm_calls"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.col("communities").alias("community_count"),
    )
    return Run(config, docs, chunks, typed, groups, edges, communities, members, partial, merges, written(summaries, "summaries"))


def _merge_support(support: DataFrame, merged: DataFrame, to_merge: DataFrame, config: PipelineConfig, provider: EmbeddingProvider) -> DataFrame:
    """sample, support: the communities' segments, each once in their order, scored
    again by the same method and compacted within the evidence budget."""
    keys = [SAMPLE, "document_id", "center"]
    rows = support.join(to_merge.select(SAMPLE), SAMPLE, "left_semi").withColumn("center", F.col("u.center"))
    first = rows.groupBy(*keys).agg(F.min(F.struct("community_idx", CHUNK, "rank")).alias("place"), F.first("u").alias("u"))
    units = with_embedding(first.select(SAMPLE, "document_id", "center", "place", "u", F.col("u.text").alias("_t"), F.col("u.tokens").alias("tokens")), "_t", provider).drop("_t")
    # the place as one sortable string, so that it can be a key of blocks
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    units = units.withColumn("key", F.concat(pad("place.community_idx", 10), F.lit("|"), pad(f"place.{CHUNK}", 19), F.lit("|"), pad("place.rank", 10)))
    units = written(units, "merge-units")
    if config.salience == "e1":
        centers = with_embedding(merged.select(SAMPLE, F.col("summaries").alias("_t")), "_t", provider)
        scored = salience.centroid_scores(units, centers, [SAMPLE])
    else:
        scores = salience.centrality_scores(
            units, [SAMPLE], "key", "embedding", 2 if config.salience == "e2b" else 1, config.pacsum_beta, config.pacsum_lambda1, config.pacsum_lambda2
        )
        scored = units.join(scores, [SAMPLE, "key"])
    chosen = salience.select_by_budget(scored.select(SAMPLE, "key", "score", "tokens"), [SAMPLE], "key", config.evidence_max_tokens)
    picked = units.join(chosen.select(SAMPLE, "key"), [SAMPLE, "key"])
    return salience.compact_support(_sentences(picked, [SAMPLE]), [SAMPLE], ["document_id", "center", "offset"], "sentence", config.evidence_max_tokens)


def direct(docs: DataFrame, config: PipelineConfig | None = None, summarizer: Summarizer | None = None) -> DataFrame:
    """The baseline: all documents of a sample in one prompt, one call."""
    config, summarizer = config or PipelineConfig(), summarizer or LeadSummarizer()
    asked = direct_prompts(docs, config)
    done = with_summary(asked, summarizer)
    return done.select(
        SAMPLE,
        "dataset",
        "lang",
        TX.trim_to_words(F.col("summary"), F.col("max_words")).alias("summary"),
        "input_tokens",
        "output_tokens",
        F.lit(1).cast("long").alias("llm_calls"),
        "chunk_count",
        F.lit(1).cast("long").alias("community_count"),
        "error",
    )


def direct_prompts(docs: DataFrame, config: PipelineConfig) -> DataFrame:
    docs = prepare(docs)
    body = F.struct("doc_ord", "document_id", "title", "source", "text")
    rows = docs.groupBy(SAMPLE).agg(F.min("dataset").alias("dataset"), F.min("lang").alias("lang"), F.array_sort(F.collect_list(body)).alias("d"), F.count("*").alias("chunk_count"))
    blocks = F.transform("d", lambda x, i: TX.document_block(i + 1, x["document_id"], x["title"], x["source"], x["text"]))
    words, most = budgets(F.col("dataset"), config)
    rows = rows.withColumn("max_words", words).withColumn("max_tokens", most)
    prompt = prompts.direct_prompt(F.array_join(blocks, "\n\n"), F.col("lang"), F.col("dataset"), F.col("max_words"))
    return rows.select(SAMPLE, "dataset", "lang", "chunk_count", "max_words", "max_tokens", prompt.alias("prompt"))


def score(summaries: DataFrame, references: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``summaries`` with the scores against the best of the sample's references
    (blank references don't count)."""
    refs = references.where(F.col("text").rlike(r"(?U)\S")).select(F.col(SAMPLE).cast("string").alias(SAMPLE), F.col("ref_idx").cast("int").alias("ref_idx"), F.col("text").alias("reference"))
    told = summaries.select(SAMPLE, F.col("summary").alias("prediction"), evaluate.tokenizer_for(F.col("lang"), tokenizer).alias("tokenizer"))
    return summaries.join(evaluate.best_scores(told, refs, SAMPLE, [SAMPLE]), SAMPLE)
