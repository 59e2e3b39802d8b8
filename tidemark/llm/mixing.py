"""Mixing sources to target weights.

Sources have shares p of all tokens. The weights are p ** a, normalised: a = 1 keeps the shares, a = 0 makes
all sources alike. The exponent a is bisected: the weights' entropy falls as a grows, and the most often repeated
source's passes fall too. Each source then gets a budget of tokens, spent in whole passes and one part of a pass. In
the part of a pass the source's blocks come in a permuted order until the budget is spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm import common

#: Inner points of an interval that one job looks at: four halvings of the interval at once.
POINTS = 15


def _sections(low: float, high: float) -> list[float]:
    return [low + (high - low) * k / (POINTS + 1) for k in range(1, POINTS + 1)]


def _bisected(sources: DataFrame, value: Column, target: float, rising: bool, halvings: int) -> float:
    """The least a (rising) or the largest in 0..1 whose value, from sums over the sources, is not above or not below target.

    value is a function of a and of the sources' log shares, given as a list of columns by _entropy or _passes.
    """
    low, high = 0.0, 1.0
    for _ in range(math.ceil(halvings / 4)):
        at = _sections(low, high)
        got = sources.agg(*[value(F.lit(a)).alias(f"v{k}") for k, a in enumerate(at)]).first()
        fits = [got[k] is not None and (got[k] <= target if rising else got[k] >= target) for k in range(POINTS)]
        if rising:  # fits from some point on
            k = next((k for k in range(POINTS) if fits[k]), POINTS)
        else:  # fits up to some point
            k = next((k for k in range(POINTS) if not fits[k]), POINTS)
        low, high = ([low, *at][k], [*at, high][k])
    return high if rising else low


def _entropy(a: Column) -> Column:
    """Entropy of the weights p ** a in nats, over sources with tokens; column lp is ln p."""
    e = F.exp(a * F.col("lp"))
    return F.ln(F.sum(e)) - a * F.sum(e * F.col("lp")) / F.sum(e)


def _passes(a: Column) -> Column:
    """How often the most repeated source is read for a budget of as many tokens as there are."""
    return F.exp((a - 1) * F.min("lp")) / F.sum(F.exp(a * F.col("lp")))


def exponent(sources: DataFrame, budget_share: float, entropy_share: float | None, most_passes: float | None, halvings: int = 32) -> float:
    """The exponent: the largest with entropy of at least entropy_share of the largest entropy, raised to keep to most_passes.

    sources has a row for each source with tokens, lp its log share. If even a = 1 repeats more than most_passes, a is 1.
    """
    n = sources.count()
    if n < 2:
        return 1.0
    a = 0.0 if entropy_share is None else _bisected(sources, _entropy, entropy_share * math.log(n), False, halvings)
    if most_passes is not None:
        got = sources.agg(_passes(F.lit(a)).alias("v")).first().v
        if got * budget_share > most_passes:
            a = max(a, _bisected(sources, _passes, most_passes / budget_share, True, halvings))
    return a


def plan(docs: DataFrame, tokens: Column, source: str, entropy_share: float | None, most_passes: float | None, budget: int | None, docs_per_block: int, seed: int) -> tuple[DataFrame, DataFrame, float]:
    """Sources with weights and budgets, blocks with the tokens before each in the permuted order, and the exponent."""
    blocks = _placed(docs.select(source), docs, source, docs_per_block)
    sums = common.written(blocks.groupBy("mix_source", "mix_block", "mix_blocks").agg(F.sum(tokens).alias("tokens")))
    totals = common.written(sums.groupBy("mix_source").agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > 0))
    whole = totals.agg(F.sum("tokens").alias("t")).first().t or 0
    spend = whole if budget is None else budget
    shares = totals.withColumn("lp", F.ln(F.col("tokens") / F.lit(max(1, whole))))
    a = exponent(shares, spend / max(1, whole), entropy_share, most_passes)
    norm = shares.agg(F.sum(F.exp(F.lit(a) * F.col("lp"))).alias("z")).first().z or 1.0
    weight = F.exp(F.lit(a) * F.col("lp")) / F.lit(norm)
    sources = shares.select("mix_source", F.col("tokens").alias("mix_total"), weight.alias("mix_weight"), F.round(weight * F.lit(float(spend))).cast("long").alias("mix_budget"))
    # The permutation: blocks by a seeded hash. Prefix sums in two steps, so that no task holds all blocks of a source.
    s = sums.withColumn("turn", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_source", "mix_block"), 11) / F.lit(float(1 << 53)))
    s = s.withColumn("part", F.floor(F.col("turn") * F.greatest(F.lit(1), F.ceil(F.sqrt("mix_blocks")))))
    inner = W.Window.partitionBy("mix_source", "part").orderBy("turn", "mix_block").rowsBetween(W.Window.unboundedPreceding, -1)
    outer = W.Window.partitionBy("mix_source").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = s.groupBy("mix_source", "part").agg(F.sum("tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(outer), F.lit(0))).drop("t")
    before = s.withColumn("within", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(common.written(parts), ["mix_source", "part"])
    placed = before.select("mix_source", "mix_block", (F.col("before") + F.col("within")).alias("mix_before"))
    return common.written(sources), common.written(placed), a


def _placed(one: DataFrame, docs: DataFrame, source: str, docs_per_block: int) -> DataFrame:
    """docs with mix_source, mix_at (a place in 0..1) and the mix_block that holds it; blocks are small and of like size whatever the ids are."""
    counts = common.written(one.groupBy(_source(source).alias("mix_source")).agg(F.count("*").alias("n")))
    at = F.col("mix_at")
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(docs_per_block))).cast("long")
    seeded = docs.withColumn("mix_source", _source(source)).withColumn("mix_at", F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col("doc_id"), F.col("text")), 11) / F.lit(float(1 << 53)))
    return seeded.join(counts, "mix_source").withColumn("mix_blocks", n).withColumn("mix_block", F.least(F.floor(at * n), n - 1)).drop("n")


def _source(source: str) -> Column:
    """A null source is a source of its own; its name can't be another's."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def mix(docs: DataFrame, source: str = "source", tokens: Column | None = None, entropy_share: float | None = 0.95, most_passes: float | None = 4.0, budget: int | None = None, docs_per_block: int = 64, seed: int = 17) -> DataFrame:
    """docs in the mixed amounts: each row once for every pass that reads it, numbered by mix_pass from 0.

    Also mix_weight (its source's), mix_tokens and mix_order, a sort key that interleaves the sources evenly.
    budget: tokens in all; as many as docs has, if None. A source's whole passes read every row; its last,
    partial, pass reads its blocks in the order that seed permutes them to, until the source's budget is spent, ending with the row that
    reaches it.
    A source without tokens gets no budget; rows of null source are one source; repeated rows count each; rows without
    words go with their block. An empty table gives an empty one. Columns of the names above are replaced.
    """
    docs = docs.drop("mix_pass", "mix_weight", "mix_tokens", "mix_order")
    tokens = common.n_words(F.col("text")) if tokens is None else tokens
    sources, blocks, _ = plan(docs, tokens, source, entropy_share, most_passes, budget, docs_per_block, seed)
    placed = _placed(docs.select(source), docs.withColumn("mix_tokens", tokens), source, docs_per_block)
    inside = W.Window.partitionBy("mix_source", "mix_block").orderBy("mix_at", "doc_id", "mix_tokens").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = placed.withColumn("mix_within", F.coalesce(F.sum("mix_tokens").over(inside), F.lit(0)))
    rows = rows.join(blocks, ["mix_source", "mix_block"]).join(F.broadcast(sources) if sources.count() <= 10_000 else sources, "mix_source")
    whole = F.floor(F.col("mix_budget") / F.col("mix_total"))
    left = F.col("mix_budget") - whole * F.col("mix_total")
    passes = whole + (F.col("mix_before") + F.col("mix_within") < left).cast("long")
    rows = rows.withColumn("mix_passes", passes).where("mix_passes > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_passes") - 1)))
    # A row's place among its source's budget, in each pass by another permutation: sorting by it interleaves all sources.
    place = (F.col("mix_pass") + F.shiftrightunsigned(F.xxhash64("mix_pass", "doc_id", "mix_at"), 11) / F.lit(float(1 << 53))) * F.col("mix_total") / F.col("mix_budget")
    rows = rows.withColumn("mix_order", place)
    return rows.select(*docs.columns, "mix_pass", "mix_weight", "mix_tokens", "mix_order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", "mix_pass", "mix_tokens", F.round("mix_weight", 9).alias("mix_weight"), "mix_order")
