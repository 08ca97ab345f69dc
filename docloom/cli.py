"""Command line: ``python -m docloom.cli run|aggregate ...``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.config import PipelineConfig, config_from_env, read_dotenv, weight_grid
from docloom.functions.vectors import embedder
from docloom.operators import evaluate
from docloom.operators.evaluate import TOKENIZERS, union_results
from docloom.operators.recognise import MODELS
from docloom.plans import pipeline, results
from docloom.plans.providers import summarizer
from docloom.runtime import written
from docloom.sources import tables
from docloom.sources.clusters import DATASETS, read_samples

def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docloom")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="summarise the samples of a dataset and score them")
    run.add_argument("--dataset", required=True, choices=DATASETS)
    run.add_argument("--data-root", required=True)
    run.add_argument("--limit", type=int, default=None)
    run.add_argument("--output", required=True)
    run.add_argument("--direct", action="store_true", help="one prompt for each sample instead of the graph")
    run.add_argument("--grid", action="store_true", help="all 51 settings of the edge weights")
    run.add_argument("--aggregate-output", default=None, help="also write the means by setting")
    run.add_argument("--failures", default=None, help="where rows with an error of the summariser go")
    run.add_argument("--llm", default="dry_run", choices=("dry_run", "openai_compatible"))
    run.add_argument("--llm-model", default="")
    run.add_argument("--llm-base-url", default="")
    run.add_argument("--llm-temperature", type=float, default=0.0)
    run.add_argument("--embedding-backend", default="hash", choices=("hash", "openai_compatible", "sentence_transformers"))
    run.add_argument("--embedding-model", default="")
    run.add_argument("--embedding-base-url", default="")
    run.add_argument("--ner", action="store_true", help="entities by the languages' models instead of capitalised runs")
    run.add_argument("--rouge-tokenizer", default=None, choices=TOKENIZERS)
    run.add_argument("--print-rows", action="store_true", help="a JSON line for each sample on standard output")
    run.add_argument("--env-file", default=".env")
    for f in fields(PipelineConfig):
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            run.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            run.add_argument(flag, type=int if f.default is None else type(f.default), default=None)
    total = sub.add_parser("aggregate", help="means of result files by setting")
    total.add_argument("inputs", nargs="+")
    total.add_argument("--output", required=True)
    return p


def _summary_path(args: argparse.Namespace) -> str | None:
    """Beside the results, for runs with a real model."""
    if args.aggregate_output or args.llm != "openai_compatible":
        return args.aggregate_output
    stem, dot, suffix = args.output.rpartition(".")
    return f"{stem}_summary.{suffix}" if dot and "/" not in suffix else f"{args.output}_summary"


def main(argv: list[str] | None = None) -> int:
    import os
    import time

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    groups, numbers = list(results.GROUP_COLUMNS), list(evaluate.NUMERIC_COLUMNS)
    if args.command == "aggregate":
        frame = tables.read_results(spark, args.inputs)
        tables.write_csv(evaluate.aggregate_results(frame, groups, numbers), args.output)
        return 0
    env = {**read_dotenv(args.env_file), **os.environ}
    config = config_from_env(env, **{f.name: getattr(args, f.name) for f in fields(PipelineConfig)})
    docs, refs = read_samples(spark, args.dataset, args.data_root, args.limit)
    key = env.get("OPENAI_API_KEY", "")
    llm = summarizer(args.llm) if args.llm == "dry_run" else summarizer(args.llm, model=args.llm_model, base_url=args.llm_base_url, api_key=key, temperature=args.llm_temperature)
    options = {"openai_compatible": {"base_url": args.embedding_base_url, "model": args.embedding_model, "api_key": key}, "sentence_transformers": {"model": args.embedding_model}}
    provider = embedder(args.embedding_backend, **options.get(args.embedding_backend, {}))
    names = {"embedding_backend": args.embedding_backend, "embedding_model": args.embedding_model, "llm": args.llm, "llm_model": args.llm_model or "dry_run"}

    def rows(summaries, mode, used, tokenizer, seconds):
        scored = pipeline.score(summaries, refs, tokenizer)
        return results.result_rows(scored, mode, used, pipeline.budgets(F.col("dataset"), used), names, tokenizer, seconds)

    made, failed, began = [], [], time.perf_counter()
    if args.direct:
        done = written(pipeline.direct(docs, config, llm), "direct")
        each = (time.perf_counter() - began) / max(done.count(), 1)
        made.append(rows(done, results.DIRECT, config, args.rouge_tokenizer or "default", each))
        failed.append(done.where("error is not null"))
    else:
        weights = weight_grid() if args.grid else [config.weights()]
        for r in pipeline.run_grid(docs, weights, config, provider, llm, MODELS if args.ner else None):
            each = (time.perf_counter() - began) / max(r.summaries.count(), 1)
            made.append(rows(r.summaries, results.GRAPH, r.config, args.rouge_tokenizer, each))
            failed += [x.where("error is not null") for x in (r.community_summaries, r.merges)]
            began = time.perf_counter()
    out = written(union_results(made), "results")
    tables.write_csv(out, args.output)
    if args.print_rows:
        for row in tables.json_rows(out).toLocalIterator():  # one partition at a time
            print(row["json"])
    if args.failures:
        tables.write_json_lines(union_results(failed), args.failures)
    if path := _summary_path(args):
        tables.write_csv(evaluate.aggregate_results(out, groups, numbers), path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
