"""Benchmark dataset operators: quotas, seeded selection, samples, review queue, overrides, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, item_id: Column) -> Column:
    """Sort key of a seeded draw: the digest of "seed:item"."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), item_id), 256)


def filter_accessions(filings: DataFrame, forms: list[str], years: tuple[int, int], per_issuer: int) -> DataFrame:
    w = Window.partitionBy("issuer_id").orderBy(F.desc("filed_at"), F.desc("accession"))
    rows = filings.where(F.col("form_type").isin(forms) & F.year("period_end").between(*years))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_issuer).drop("_n")


def sample_issuers(issuers: DataFrame, filings: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` issuers that have filings with the least draw, with their position."""
    rows = issuers.join(filings, "issuer_id", "left_semi").withColumn("key", draw(seed, F.col("issuer_id").cast("string")))
    return rows.orderBy("key").limit(n).withColumn("position", F.row_number().over(Window.orderBy("key"))).drop("key")


def quota_targets(weights: DataFrame, total: int) -> DataFrame:
    """(profile, target) by largest remainder; weights: profile, ordinal, weight (below 0 counts as 0).

    One row a profile; ties of the remainder go by ordinal.
    """
    every = Window.partitionBy()
    raw = total * F.greatest("weight", F.lit(0.0)) / F.sum(F.greatest("weight", F.lit(0.0))).over(every)
    rows = weights.withColumn("raw", raw).withColumn("base", F.floor("raw"))
    left = total - F.sum("base").over(every)
    order = F.row_number().over(Window.orderBy(F.desc(F.col("raw") - F.col("base")), "ordinal"))
    return rows.select("profile", (F.col("base") + (order <= left).cast("int")).alias("target"))


def balanced_select(items: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Of each profile its target's number of items with the least draw; ``short`` is set where a
    profile has fewer."""
    w = Window.partitionBy("profile").orderBy("key", "item_id")
    # The largest target, one number, bounds what a task keeps of a profile.
    most = targets.agg(F.max("target")).first()[0] or 0
    rows = items.withColumn("key", draw(seed, F.col("item_id"))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    sizes = items.groupBy("profile").agg(F.count("*").alias("_have"))
    rows = rows.join(targets.hint("merge"), "profile").where(F.col("_n") <= F.col("target")).join(sizes.hint("merge"), "profile")
    return rows.select("item_id", "profile", (F.col("_have") < F.col("target")).alias("short"))


def stratified_sample(items: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` items: first max(1, n / buckets) of each bucket by draw, then the rest by draw."""
    buckets = items.select(*keys).distinct().agg(F.count("*").alias("_b"))
    w = Window.partitionBy(*keys).orderBy("key", "item_id")
    # What n others of its bucket precede can't be chosen.
    rows = items.withColumn("key", draw(seed, F.col("item_id"))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    # One row: the number of buckets.
    rows = rows.join(F.broadcast(buckets)).withColumn("_late", (F.col("_n") > F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_b")))).cast("int"))
    return rows.orderBy("_late", "key", "item_id").limit(n).select("item_id", *keys)


def latest_annotation(annotations: DataFrame) -> DataFrame:
    """The last row of each item by created_at, then ordinal."""
    names = [c for c in annotations.columns if c != "item_id"]
    last = annotations.groupBy("item_id").agg(F.max_by(F.struct(*names), F.struct("created_at", "ordinal")).alias("_l"))
    return last.select("item_id", "_l.*")


def eligible_overrides(annotations: DataFrame) -> DataFrame:
    """Latest annotations of items with a passed check and a proposal, and no failed check after it."""
    good = latest_annotation(annotations.where("spot_check AND proposed IS NOT NULL"))
    bad = annotations.where("NOT spot_check").select("item_id", F.struct("created_at", "ordinal").alias("_at"))
    last_bad = bad.groupBy("item_id").agg(F.max("_at").alias("_at"))
    rows = good.join(last_bad, "item_id", "left")
    return rows.where(F.col("_at").isNull() | (F.col("_at") < F.struct("created_at", "ordinal"))).drop("_at")


def apply_overrides(items: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Items with each non-null patch field in place of their own, and the list of changed fields."""
    p = patches.select("item_id", *[F.col(c).alias(f"_p_{c}") for c in fields])
    rows = items.join(p, "item_id", "left")
    changed = F.array_compact(F.array(*[F.when(F.col(f"_p_{c}").isNotNull() & ~F.col(f"_p_{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in fields]))
    rows = rows.withColumn("changed", changed)
    return rows.withColumns({c: F.coalesce(f"_p_{c}", c) for c in fields}).drop(*[f"_p_{c}" for c in fields])


def review_queue(items: DataFrame, results: DataFrame, annotations: DataFrame, tier: Column, priority: Column, most: int) -> DataFrame:
    """The first ``most`` items by (tier, -priority, item_id), with their result and last annotation."""
    rows = items.join(results, "item_id").join(latest_annotation(annotations).select("item_id", "failure_class"), "item_id", "left")
    rows = rows.withColumns({"tier": tier, "priority": priority})
    return rows.orderBy("tier", F.desc("priority"), "item_id").limit(most)


def diversity_report(items: DataFrame) -> DataFrame:
    """Per profile: items, distinct issuers, distinct answer types, and their share."""
    g = items.groupBy("profile").agg(F.count("*").alias("n_items"), F.count_distinct("issuer_id").alias("n_issuers"), F.count_distinct("answer_type").alias("n_types"))
    return g.withColumn("issuers_per_item", F.col("n_issuers") / F.col("n_items"))


def scorability_report(items: DataFrame) -> DataFrame:
    return items.groupBy("answer_type").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("scorable"), F.avg((F.col("quality") == 1).cast("double")).alias("coverage"))


def capped_issuers(items: DataFrame, cap: int) -> DataFrame:
    return items.groupBy("profile", "issuer_id").agg(F.count("*").alias("n")).where(F.col("n") >= cap)


def profile_schedule(weights: DataFrame, slots: DataFrame, seed: int) -> DataFrame:
    """A profile for each slot, drawn by weight: the slot's hash in [0, 1) falls into one interval of
    the cumulative weights, which are a row a profile and held in one array."""
    total = F.sum("weight").over(Window.partitionBy())
    ends = weights.withColumn("end", F.sum("weight").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)) / total)
    table = ends.agg(F.array_sort(F.collect_list(F.struct("end", "profile"))).alias("ends"))
    u = F.conv(F.substr(draw(seed, F.col("slot").cast("string")), F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    rows = slots.withColumn("u", u).join(F.broadcast(table))
    hit = F.filter("ends", lambda e: F.col("u") < e["end"])
    return rows.select("slot", F.coalesce(F.get(hit, 0)["profile"], F.element_at("ends", -1)["profile"]).alias("profile"))


def publish_gates(items: DataFrame, least: int, coverage: float, share: float) -> DataFrame:
    """One row: counts, and the violated gates in order."""
    by = items.groupBy("profile").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    g = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), (F.sum("good") / F.sum("n")).alias("coverage"), (F.max("n") / F.sum("n")).alias("largest_share"))
    v = F.array_compact(F.array(F.when(F.col("n_items") < least, "too_few"), F.when(F.coalesce(F.col("coverage"), F.lit(0.0)) < coverage, "coverage"), F.when(F.col("largest_share") > share, "unbalanced")))
    return g.withColumn("violations", F.array_join(v, ","))


def freeze_cohort(tiered: DataFrame) -> DataFrame:
    """Items of tier 1; all items if there is none. The switch is one aggregated row."""
    any_first = tiered.agg(F.coalesce(F.max((F.col("tier") == 1).cast("int")), F.lit(0)).alias("_any"))
    return tiered.join(F.broadcast(any_first)).where("_any = 0 OR tier = 1").select("item_id")


def table_hash(rows: DataFrame, key: str) -> DataFrame:
    """Digest of a table whatever its order: rows are digested, and bucket digests are made of the
    digests sorted by key in each bucket, so no task sees all rows."""
    one = rows.select(F.col(key).alias("_k"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("_h"))
    by = one.groupBy(F.left(F.sha2(F.col("_k").cast("string"), 256), F.lit(3)).alias("_b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"]), "|"), 256).alias("_d"))
    return by.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), "|"), 256).alias("digest"))


def stratified_smoke(items: DataFrame, n: int, priority: Column) -> DataFrame:
    """``n`` item ids: first max(2, n / buckets) of each (profile, answer_type) by id, in the buckets'
    order of priority, then the rest by id."""
    buckets = items.select("profile", "answer_type").distinct().agg(F.count("*").alias("_b"))
    w = Window.partitionBy("profile", "answer_type").orderBy("item_id")
    # What n others of its bucket precede can't be chosen.
    rows = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).withColumn("_p", priority).join(F.broadcast(buckets))  # one row
    first = F.col("_n") <= F.greatest(F.lit(2), F.floor(F.lit(n) / F.greatest("_b", F.lit(1))))
    order = (F.desc(first), F.when(first, F.col("_p")), F.when(first, F.col("profile")), "item_id")
    return rows.orderBy(*order).limit(n).select("item_id", "profile", "answer_type")


def validate_items(items: DataFrame, accessions: DataFrame) -> DataFrame:
    """Add errors and status of (item_id, question, profile, accessions, answer, rubric).

    Unknown accessions are found by one anti-join-like lookup of the exploded bindings.
    """
    wanted = items.select("item_id", F.explode("accessions").alias("accession")).distinct()
    known = accessions.select("accession").distinct().withColumn("_known", F.lit(True))
    missing = wanted.join(known.hint("merge"), "accession", "left").groupBy("item_id").agg(F.count_if(F.col("_known").isNull()).alias("_missing"))
    rows = items.join(missing.hint("merge"), "item_id", "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    codes = F.array_compact(F.array(
        F.when(blank("question"), "empty_question"), F.when(F.size("accessions") <= 0, "missing_accessions"), F.when(F.coalesce("_missing", F.lit(0)) > 0, "accession_not_in_snapshot"),
        F.when((F.col("profile") == "comparison") & (F.size("accessions") < 2), "requires_multi_filing"), F.when(blank("answer") & blank("rubric"), "missing_ground_truth"),
    ))
    return rows.withColumn("errors", codes).drop("_missing").withColumn("status", F.when(F.size("errors") == 0, "accepted").otherwise("rejected"))


def generation_report(validated: DataFrame) -> DataFrame:
    """(code, n): rejected items by error code, with the totals under accepted and rejected."""
    codes = validated.select(F.explode(F.concat("errors", F.array("status"))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("n"))


def resolve_paths(paths: DataFrame, index: DataFrame) -> DataFrame:
    """The best index path (accession, path) for each wanted (item_id, accession, tail), blocked by
    accession: 4 for the accession, 3 for the same key or 2 for the same item, and the shorter key's
    length; ties go to the smaller path. Without a match the row is left out."""
    from ..functions import scalars as S

    have = index.select("accession", "path", S.section_key(S.split_section_path(F.col("path"))["tail"]).alias("_gk"))
    rows = paths.withColumn("_k", S.section_key(F.col("tail"))).join(have.hint("merge"), "accession")
    item, other = S.item_key(F.col("_k")), S.item_key(F.col("_gk"))
    same_item = F.coalesce(item == other, F.lit(False))
    fits = same_item | (F.col("_k") == F.col("_gk")) | F.col("_k").startswith(F.col("_gk")) | F.col("_gk").startswith(F.col("_k"))
    score = 4 + F.when(F.col("_k") == F.col("_gk"), 3).when(same_item, 2).otherwise(0) + F.least(F.length("_k"), F.length("_gk"))
    w = Window.partitionBy("item_id", "accession", "tail").orderBy(F.desc("score"), "path")
    rows = rows.where(fits & (F.col("_k") != "")).withColumn("score", score).withColumn("_n", F.row_number().over(w))
    return rows.where("_n = 1").select("item_id", "accession", "tail", "path", "score")
