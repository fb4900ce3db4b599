"""Aggregations, windows, budgets and batches over ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_per_chunk(hits: DataFrame, id_col: str = "chunk_id", score: str = "score_final", arrival: str = "arrival") -> DataFrame:
    """The best hit of each chunk over all runs; of equal scores the first to arrive. An aggregate, so it combines before the shuffle."""
    row = F.struct(*hits.columns)
    return hits.groupBy(id_col).agg(F.max_by(row, F.struct(F.col(score), (-F.col(arrival)).alias("_a"))).alias("_h")).select("_h.*")


def bundle_documents(hits: DataFrame, top: int = 20, score: str = "score_final") -> DataFrame:
    """How many bundles have each document among their best `top` documents: doc_id, matched_bundle_count."""
    best = hits.groupBy("bundle_name", "doc_id").agg(F.max(score).alias("best"))
    kept = best.withColumn("_r", F.row_number().over(W.partitionBy("bundle_name").orderBy(F.desc("best"), "doc_id"))).where(F.col("_r") <= top)
    return kept.groupBy("doc_id").agg(F.count_distinct("bundle_name").alias("matched_bundle_count"))


def top_mean(hits: DataFrame, key: str = "doc_id", score: str = "score_final", tie: str = "chunk_id", n: int = 3) -> DataFrame:
    """key, aggregate_score (mean of its best n), top_ids in order."""
    ranked = hits.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), tie))).where(F.col("_r") <= n)
    return ranked.groupBy(key).agg(F.avg(score).alias("aggregate_score"), F.transform(F.array_sort(F.collect_list(F.struct("_r", tie))), lambda x: x[tie]).alias("top_ids"))


def top_hits(hits: DataFrame, key: str = "doc_id", score: str = "score_final", n: int = 3, ties: tuple[str, ...] = ("arrival", "rank", "chunk_id")) -> DataFrame:
    """key, aggregate_score (mean of its best n), top_chunks: those hits, best first. Hits must have the columns of `ties`."""
    ranked = hits.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), *ties))).where(F.col("_r") <= n)
    row = F.struct(*[c for c in hits.columns])
    found = ranked.groupBy(key).agg(F.avg(score).alias("aggregate_score"), F.array_sort(F.collect_list(F.struct("_r", row.alias("hit")))).alias("_top"))
    return found.select(key, "aggregate_score", F.transform("_top", lambda x: x["hit"]).alias("top_chunks"))


def diverse(hits: DataFrame, per_key: int = 3, total: int = 20, key: str = "doc_id", score: str = "score_final", tie: str = "chunk_id") -> DataFrame:
    """The best `total` hits with at most `per_key` of a document."""
    order = [F.desc(score), F.col(tie)]
    return hits.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= per_key).drop("_r").orderBy(*order).limit(total)


def within_budget(hits: DataFrame, tokens: Column, order: list, budget: int = 120000, reserve: int = 2000, most: int = 100, extra: int = 16) -> DataFrame:
    """The longest prefix of the first `most` hits whose tokens fit the budget (the window sees `most` rows)."""
    first = hits.orderBy(*order).limit(most).withColumn("tokens", (tokens + extra).cast("long"))
    used = F.sum("tokens").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("used", used).where(F.col("used") <= budget - reserve)


def batches(docs: DataFrame, tokens: Column, order: list[str], available: int, most: int = 500, extra: int = 16) -> DataFrame:
    """Greedy batches of the first `most` documents: a batch closes when the next one would overflow it; one that is too
    long alone has its own. A fold over one ordered array of at most `most` items."""
    first = docs.orderBy(*order).limit(most).select(F.struct(*order, (tokens + extra).cast("long").alias("tokens")).alias("d"))
    step = "struct(if(a.used > 0 and a.used + d.tokens > {n}, a.batch + 1, a.batch) as batch, if(a.used > 0 and a.used + d.tokens > {n}, d.tokens, a.used + d.tokens) as used, array_append(a.out, if(a.used > 0 and a.used + d.tokens > {n}, a.batch + 1, a.batch)) as out)".format(n=available)
    folded = first.agg(F.array_sort(F.collect_list("d")).alias("ds")).select("ds", F.expr(f"aggregate(ds, struct(0 as batch, 0L as used, cast(array() as array<int>) as out), (a, d) -> {step}).out").alias("b"))
    return folded.select(F.explode(F.arrays_zip("ds", "b")).alias("x")).select("x.ds.*", F.col("x.b").cast("long").alias("batch_id"))


def early_stop(judged: DataFrame, key: str, rank: str, direct: str, streak: int = 20, window: int = 5, span: int = 4096) -> DataFrame:
    """For each scan: documents, judged (those committed before the scan ends), direct (supports among them), stopped_early.

    The scan stops at the first row that ends `streak` rows without support; window - 1 more are then in flight. A scan is cut
    into spans of rank values, each a group of its own, and only the spans' summaries meet: rows, rows up to the first support,
    rows since the last one, and the first place where a streak within the span ends. So one scan with most of the rows is
    many tasks. rank: whole numbers.
    """
    cut = judged.select(F.col(key).alias("_k"), F.col(rank).cast("long").alias("_rank"), F.col(direct).cast("boolean").alias("_d")).withColumn("_span", F.floor(F.col("_rank") / span))
    w = W.partitionBy("_k", "_span").orderBy("_rank")
    rows = cut.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.max(F.when(F.col("_d"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = F.col("_n") - F.coalesce("_last", F.lit(0))
    ended = F.when(F.col("_last").isNotNull() & (run == streak), F.col("_n"))
    spans = rows.groupBy("_k", "_span").agg(F.count("*").alias("rows"), F.count_if("_d").alias("supports"), F.min(F.when(F.col("_d"), F.col("_n"))).alias("first"), F.max("_last").alias("last"), F.min(ended).alias("ended"))
    # spans in order: what each knows of the rows before it (one row a span: 1 / span of the scan)
    order = W.partitionBy("_k").orderBy("_span")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    spans = spans.withColumn("open", F.col("start") - F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(0)))
    lead = F.coalesce(F.col("first") - 1, F.col("rows"))  # rows before the first support
    met = F.when(F.col("open") + lead >= streak, F.col("start") + F.greatest(F.lit(1), F.lit(streak) - F.col("open")))
    stop = F.least(met, F.col("start") + F.col("ended"))
    stops = spans.groupBy("_k").agg(F.min(stop).alias("_stop"), F.sum("rows").alias("documents"), F.sum("supports").alias("supports"))
    # supports up to the end: whole spans, and the rows of the span where the scan ends
    limit = F.col("_stop") + window - 1
    same = lambda df, name: df.select(F.col("_k").alias(name), *[c for c in df.columns if c != "_k"])  # noqa: E731  (a null key is a key)
    ends = spans.join(same(stops.select("_k", "_stop"), "_sk"), F.col("_k").eqNullSafe(F.col("_sk"))).where(F.col("_stop").isNotNull())
    whole = ends.where(F.col("start") + F.col("rows") <= limit).groupBy("_k").agg(F.sum("supports").alias("whole"))
    part = ends.where((F.col("start") < limit) & (F.col("start") + F.col("rows") > limit)).select(F.col("_k").alias("_pk"), F.col("_span").alias("_ps"), (limit - F.col("start")).alias("take"))
    inside = rows.join(part, F.col("_k").eqNullSafe(F.col("_pk")) & (F.col("_span") == F.col("_ps"))).where(F.col("_n") <= F.col("take")).groupBy("_k").agg(F.count_if("_d").alias("inside"))
    out = stops.join(same(whole, "_wk"), F.col("_k").eqNullSafe(F.col("_wk")), "left").join(same(inside, "_ik"), F.col("_k").eqNullSafe(F.col("_ik")), "left")
    seen = F.coalesce("whole", F.lit(0)) + F.coalesce("inside", F.lit(0))
    stopped = F.col("_stop").isNotNull()
    return out.select(F.col("_k").alias(key), "documents", F.when(stopped, F.least("documents", limit)).otherwise(F.col("documents")).alias("judged"), F.when(stopped, seen).otherwise(F.col("supports")).alias("direct"), stopped.alias("stopped_early"))
