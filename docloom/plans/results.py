"""Result rows of the summary contract: one for each sample of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import PipelineConfig
from docloom.operators.evaluate import NUMERIC_COLUMNS

# fixed values: the setting columns of the contract, in their order
GROUP_COLUMNS = (
    "dataset",
    "run_mode",
    "salience",
    "alpha",
    "beta",
    "gamma",
    "use_graph",
    "chunking",
    "target_min_tokens",
    "target_max_tokens",
    "semantic_breakpoint_percentile",
    "semantic_min_chunk_tokens",
    "dedup_chunks",
    "dedup_sim_threshold",
    "dedup_require_shared_phrase",
    "duplicate_edge_factor",
    "community_dedup",
    "max_summary_words",
    "max_output_tokens",
    "embedding_backend",
    "embedding_model",
    "llm",
    "llm_model",
    "pacsum_beta",
    "pacsum_lambda1",
    "pacsum_lambda2",
    "entity_merge_threshold",
    "rouge_backend",
    "rouge_tokenizer",
    "rouge_use_stemmer",
)
# fixed values: the other columns of a result row
OTHER_COLUMNS = ("sample_id", "reference_count", "selected_reference_index", "reference_selector", "generated_summary")
COLUMNS = (*GROUP_COLUMNS, *NUMERIC_COLUMNS, *OTHER_COLUMNS)
# fixed values: names of the modes and of how a reference is chosen
GRAPH, DIRECT, SELECTOR = "graphsum", "pure_llm", "max_rouge_tuple"

# contract column -> field of the configuration; a direct run has none of them
_SETTINGS = {
    "salience": "salience", "alpha": "alpha", "beta": "beta", "use_graph": "use_graph", "chunking": "chunking", "target_min_tokens": "target_min_tokens",
    "target_max_tokens": "target_max_tokens", "semantic_breakpoint_percentile": "semantic_percentile", "semantic_min_chunk_tokens": "semantic_min_chunk",
    "dedup_chunks": "dedup_chunks", "dedup_sim_threshold": "dedup_threshold", "dedup_require_shared_phrase": "dedup_require_shared_phrase",
    "duplicate_edge_factor": "duplicate_edge_factor", "community_dedup": "community_dedup", "pacsum_beta": "pacsum_beta",
    "pacsum_lambda1": "pacsum_lambda1", "pacsum_lambda2": "pacsum_lambda2", "entity_merge_threshold": "entity_merge_threshold",
}


def rouge_settings(lang: Column, explicit: str | None) -> dict[str, Column]:
    """What the scores were made with: words by default, characters in Vietnamese,
    stems in English."""
    stemmed = (lang == "en") if explicit is None else F.lit(explicit == "default_stemmed")
    name = F.when(lang == "vi", "unicode_char").otherwise("default") if explicit is None else F.lit(explicit.removesuffix("_stemmed"))
    return {"rouge_backend": F.lit("docloom"), "rouge_tokenizer": name, "rouge_use_stemmer": stemmed}


def result_rows(scored: DataFrame, mode: str, config: PipelineConfig, budgets: tuple[Column, Column], names: dict[str, str], tokenizer: str | None = None, seconds: float | None = None) -> DataFrame:
    """The contract's columns of scored summaries; settings that a mode hasn't are
    null.  ``names``: embedding_backend, embedding_model, llm, llm_model.
    ``seconds``: wall-clock seconds for each sample."""
    made: dict[str, Column] = {"run_mode": F.lit(mode), "reference_selector": F.lit(SELECTOR), "generated_summary": F.col("summary"), "rougeL": F.col("rougel")}
    none = F.lit(None).cast("string")
    made |= {c: none if mode != GRAPH or getattr(config, f) is None else F.lit(getattr(config, f)) for c, f in _SETTINGS.items()}
    made["gamma"] = F.lit(config.weights().gamma) if mode == GRAPH else none
    if mode == DIRECT:
        made |= {"salience": F.lit("none"), "chunking": F.lit("none"), "use_graph": F.lit(False)}
    made |= {"max_summary_words": budgets[0], "max_output_tokens": budgets[1], "runtime_seconds": F.lit(seconds).cast("double")}
    made |= {k: F.lit(v if mode == GRAPH or not k.startswith("embedding") else "none") for k, v in names.items()}
    made |= rouge_settings(F.col("lang"), tokenizer)
    return scored.select(*[made.get(c, F.col(c)).alias(c) for c in COLUMNS])
