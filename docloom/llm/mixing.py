"""Problem 8: mix sources to target shares by entropy balancing.

Each document ``d`` gets a rate ``r_d``.  Among all rates that give every source
its tokens and stay below its cap, those closest in entropy to using the
documents of a source alike are wanted, so that short and long ones are used
alike.  This balance has a closed form: a source's budget over its tokens is one
rate for all of its documents, meets the budget, doesn't exceed the cap (the
budget is cut to what the source can give) and is at no distance from using them
alike.  So nothing is iterated; multipliers by length would all be zero.
The rates are then rounded into whole copies so that each source ends within a
few tokens of its budget, where its documents allow it; a source whose budget
its documents don't reach at their cap is used up, and what it lacks is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.tokens import DEFAULT_VOCABULARY, count_tokens
from docloom.runtime import written

TOLERANCE = 1e-9
BUCKETS = 4096


def source_key(column: str):
    """Sources compare regardless of case and outer white space; null stays null."""
    return F.lower(F.regexp_replace(F.col(column), r"(?U)\A\s+|\s+\z", ""))


def _rate(budget: float, tokens: int, cap: int) -> float:
    """Uses of each document of a source of so many tokens."""
    return budget / tokens if budget < cap * tokens * (1 - TOLERANCE) else float(cap)


def _fill(near: DataFrame, budgets: dict[str, float], passes: int = 3) -> list[tuple[int, int]]:
    """(row, added): what a source still lacks is filled by single documents, each
    pass with the largest one that fits and may be used once more."""
    have = {r["key"]: r["t"] for r in near.groupBy("key").agg(F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("t")).collect()}
    lack = {k: b - have.get(k, 0) for k, b in budgets.items()}
    added: dict[int, int] = {}
    for _ in range(passes):
        open_ = [(k, float(d)) for k, d in lack.items() if d >= 1]
        if not open_:
            break
        wanted = near.sparkSession.createDataFrame(open_, "key string, lack double")
        more = near.sparkSession.createDataFrame(list(added.items()), "row long, added int")
        free = near.join(F.broadcast(wanted), "key").join(F.broadcast(more), "row", "left")
        free = free.where((F.col("tokens") <= F.col("lack") + 0.5) & (F.col("copies") + F.coalesce("added", F.lit(0)) < F.col("cap")))
        for r in free.groupBy("key").agg(F.max_by(F.struct("row", "tokens"), F.struct("tokens", "row")).alias("b")).collect():
            added[r["b"]["row"]] = added.get(r["b"]["row"], 0) + 1
            lack[r["key"]] -= r["b"]["tokens"]
            have[r["key"]] = 1
    # a source with a budget below its shortest document is still represented
    unused = [(k,) for k, b in budgets.items() if b > 0 and not have.get(k)]
    if unused:
        least = near.join(F.broadcast(near.sparkSession.createDataFrame(unused, "key string")), "key").groupBy("key")
        for r in least.agg(F.min_by("row", F.struct("tokens", "row")).alias("row")).collect():
            added[r["row"]] = 1
    return list(added.items())


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, shortfall: float = 0.1, vocabulary: str = DEFAULT_VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """``(copies, report)``.

    ``copies``: doc_id, source (as spelt in ``targets``), tokens, copies: one
    row for each document of a target source that is used at least once.
    ``report``: source, target_share, actual_share (of the mix), size_share (of
    the planned size), tokens, missing_tokens (of the budget), documents,
    copies, max_repeats, most_repeats: one row for each row of ``targets``.

    The size of the mix is ``total_tokens``.  If that is null, it is the largest
    at which sources of at most the part ``shortfall`` of the target shares can't
    reach theirs (0: every source that has documents does); so a source of one
    document doesn't decide about the rest.  A source without documents (or only
    with empty ones) reports zero.  Null, unknown and repeated things:
    documents with a null source or a source without target are not used, null
    and empty texts have no tokens and are not used, repeated doc_ids are
    separate documents, targets with a null source or share are ignored, and
    empty tables give an empty mix.
    """
    goals = (
        targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0))
        .groupBy(source_key("source").alias("key"))
        .agg(
            F.min("source").alias("source"),
            F.sum("target_share").alias("target_share"),
            F.max(F.coalesce(F.col("max_repeats"), F.lit(1))).alias("max_repeats"),
        )
    )
    plan_rows = {r["key"]: r for r in goals.collect()}  # the target table: one row for each source
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(k, r["source"], int(r["max_repeats"])) for k, r in plan_rows.items()], "key string, source string, max_repeats int"
    )
    slim = docs.select(F.col("doc_id"), source_key("source").alias("key"), "text")
    slim = slim.join(F.broadcast(known.select("key")), "key", "left_semi")
    counted = count_tokens(slim, ["doc_id", "key"], vocabulary=vocabulary)
    sized = written(counted.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    have = {r["key"]: r["tokens"] for r in sized.where("tokens > 0").groupBy("key").agg(F.sum("tokens").alias("tokens")).collect()}
    weight = sum(plan_rows[k]["target_share"] for k in have)
    size, short = 0.0, 0.0
    for most, share in sorted((int(plan_rows[k]["max_repeats"]) * have[k] / plan_rows[k]["target_share"], plan_rows[k]["target_share"]) for k in have):
        size, short = most, short + share
        if short > shortfall * weight:
            break
    if total_tokens is not None:
        size = float(total_tokens)
    plan = {}
    for k in have:
        cap = int(plan_rows[k]["max_repeats"])
        budget = min(size * plan_rows[k]["target_share"], float(cap * have[k]))
        plan[k] = {"budget": budget, "cap": cap, "rate": _rate(budget, have[k], cap)}
    rates = spark.createDataFrame([(k, p["cap"], p["budget"], p["rate"]) for k, p in plan.items()], "key string, cap int, budget double, rate double")
    rated = sized.where("tokens > 0").join(F.broadcast(rates), "key")
    rated = rated.withColumn("whole", F.floor("rate").cast("int")).withColumn("part", F.col("rate") - F.col("whole"))
    chance = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rated = rated.withColumn("turn", F.when(F.col("part") > 1e-12, chance / F.col("part")))
    rated = rated.withColumn("bucket", F.floor(F.least(F.col("turn"), F.lit(64.0)) * BUCKETS))
    # prefix sums in two levels, so that no source's documents meet in one task
    by_bucket = rated.groupBy("key", "budget", "bucket").agg(
        F.sum(F.col("whole") * F.col("tokens")).alias("sure"), F.sum("tokens").alias("extra")
    )
    by_source = W.partitionBy("key")
    before = by_source.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    extra = F.when(F.col("bucket").isNotNull(), F.col("extra")).otherwise(0)
    steps = (
        by_bucket.withColumn("need", F.col("budget") - F.sum("sure").over(by_source))
        .withColumn("before", F.coalesce(F.sum(extra).over(before), F.lit(0)))
        .select("key", "bucket", "need", "before", F.col("extra").alias("inside"))
        .where("bucket is not null")
    )
    edge = steps.where("before < need and before + inside > need")
    full = steps.where("before + inside <= need").groupBy("key").agg(F.max("bucket").alias("full"))
    border = rated.join(edge, ["key", "bucket"]).withColumn(
        "ahead", F.col("before") + F.sum("tokens").over(W.partitionBy("key", "bucket").orderBy("turn", "row")) - F.col("tokens")
    )
    border = border.withColumn("more", (F.col("ahead") + F.col("tokens") <= F.col("need")).cast("int"))
    cols = ["row", "doc_id", "key", "tokens", "cap", "whole", "more"]
    rest = rated.join(edge.select("key", "bucket"), ["key", "bucket"], "left_anti").join(full, "key", "left")
    rest = rest.withColumn("more", F.coalesce(F.col("bucket") <= F.col("full"), F.lit(False)).cast("int"))
    near = border.select(*cols).unionByName(rest.select(*cols)).withColumn("copies", F.col("whole") + F.col("more"))
    near = written(near.drop("whole", "more"), "mix-copies")
    extra_rows = _fill(near, {k: p["budget"] for k, p in plan.items()})
    extra = F.broadcast(spark.createDataFrame(extra_rows, "row long, added int"))  # a few rows for each source
    copies = (
        near.join(extra, "row", "left")
        .withColumn("copies", F.col("copies") + F.coalesce("added", F.lit(0)))
        .where("copies > 0")
        .join(F.broadcast(known), "key")
        .select("doc_id", "source", "tokens", "copies")
    )
    copies = written(copies, "mix-copies")
    used = copies.groupBy("source").agg(
        F.sum(F.col("tokens").cast("long") * F.col("copies")).alias("tokens"),
        F.count("*").alias("documents"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_repeats"),
    )
    total = F.sum("tokens").over(W.partitionBy())  # over one row for each source
    report = (
        goals.join(used, "source", "left")
        .fillna(0, ["tokens", "documents", "copies", "most_repeats"])
        .withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)))
        .withColumn("size_share", F.col("tokens") / F.lit(max(size, 1.0)))
        .withColumn("missing_tokens", F.greatest(F.round(F.col("target_share") * F.lit(size)).cast("long") - F.col("tokens"), F.lit(0).cast("long")))
        .select(
            "source", "target_share", "actual_share", "size_share", "tokens", "missing_tokens", "documents", "copies", F.col("max_repeats").cast("int"), "most_repeats"
        )
    )
    return copies, report
