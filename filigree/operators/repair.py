"""Repair of benchmark items: section paths that the index knows, canonical numbers, claims, validity.

Items have item_id (unique), profile (numeric, narrative, comparison), question, answer, claims (array),
accessions and paths (arrays, in order), answer_type and is_comparison. An index has accession and
path ("accession/section"); a snapshot has the accessions there are. Arrays of an item are taken
apart by ordinal, answered by joins on few keys, and put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claims as K
from ..functions import comparison as C
from ..functions import intents as I
from ..functions import scalars as S
from ..functions.lineage import written
from .evidence import pick_section_paths
from .navigation import infer_answer_type

# Words by which paths are found to be misplaced.
SECTION_WORDS = ("segment", "revenue", "net sales", "md&a", "item 7")
SHOWN = 80  # characters of a corrupt path in an error
#: Wanted paths that are broadcast to index and snapshot, some hundred bytes each; more are joined by sorting.
MAX_WANTED = 100_000


def _tail(path: Column) -> Column:
    return S.split_section_path(path)["tail"]


def clean_index(index: DataFrame) -> DataFrame:
    """Paths whose section isn't a piece of an answer, each once. A generator makes the section, so that it is
    made once a path and not again in each of the conditions on it."""
    rows = index.select("accession", "path", F.explode(F.array(_tail(F.col("path")))).alias("_tail"))
    return rows.where(~S.is_corrupt_tail(F.col("_tail"))).select("accession", "path").distinct()


def resolve_known(paths: DataFrame, index: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, resolved) for each distinct path that the index answers.

    A path that the index holds is itself. Else sections of the same accession fit, and, where both
    accessions are in the snapshot, those of the same filer (the accession's first part): by the same
    item number, the same key or one key beginning with the other. A path without an accession
    fits the snapshot's sections alike, whose keys it meets by their beginnings. Points: 4 for the accession, 3 for the
    key or 2 for the item, and the shorter key's length; ties go to the least path. The filer's and
    the whole snapshot's sections are first reduced to one path a key, so that no filing's paths
    meet all those of a filer with many filings. Up to ``MAX_WANTED`` paths go to index and snapshot, which stay
    where they are.
    """
    parts = S.split_section_path(F.col("path"))
    key = lambda path: S.section_key(_tail(path))
    wanted = paths.select("path").distinct().withColumns({"accession": parts["accession"], "_k": S.section_key(parts["tail"])}).withColumn("_item", S.item_key(F.col("_k")))
    wanted = written(wanted, "wanted-paths")
    way = "broadcast" if wanted.limit(MAX_WANTED + 1).count() <= MAX_WANTED else "merge"
    known = index.select(F.col("accession").alias("accession"), F.col("path").alias("resolved"), key(F.col("path")).alias("_gk")).withColumn("_gi", S.item_key(F.col("_gk")))
    members = written(snapshot.select("accession"), "members")
    exact = index.join(wanted.hint(way), "path", "left_semi").select("path").distinct().select("path", F.col("path").alias("resolved"), F.lit(1 << 20).alias("score"))

    filer = F.substring_index("accession", "-", 1)
    inside = known.join(members.hint("merge"), "accession", "left_semi")
    by_filer = inside.groupBy(filer.alias("_filer"), "_gk", "_gi").agg(F.min("resolved").alias("resolved"))
    by_filer = written(by_filer, "filer-sections")
    by_key = by_filer.groupBy("_gk", "_gi").agg(F.min("resolved").alias("resolved"))
    by_item = by_key.where("_gi IS NOT NULL").groupBy(F.col("_gi").alias("_item"), F.length("_gk").alias("_n")).agg(F.min("resolved").alias("resolved"))

    same = F.coalesce(F.col("_item") == F.col("_gi"), F.lit(False))
    equal = F.col("_k") == F.col("_gk")
    fits = same | equal | F.startswith("_k", "_gk") | F.startswith("_gk", "_k")
    points = F.when(equal, 3).when(same, 2).otherwise(0) + F.least(F.length("_k"), F.length("_gk"))
    some = wanted.where("_k <> ''")
    own = known.join(some.hint(way), "accession").where(fits).select("path", "resolved", (points + 4).alias("score"))
    here = members.join(some.select("accession").distinct().hint(way), "accession", "left_semi").distinct()
    kin = some.join(here.hint("merge"), "accession").withColumn("_filer", filer)
    kin = kin.join(by_filer.hint("merge"), "_filer").where(fits).select("path", "resolved", points.alias("score"))
    bare = some.where("accession = ''")
    keyed = bare.join(by_key.select(F.col("_gk").alias("_k"), "resolved").hint("merge"), "_k").select("path", "resolved", (F.length("_k") + 3).alias("score"))
    numbered = bare.join(by_item.hint("merge"), "_item").select("path", "resolved", (F.least(F.length("_k"), "_n") + 2).alias("score"))
    beginning = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(c, n)))
    begun = by_key.where("_gk <> ''").select(beginning(F.col("_gk")).alias("_k"), "resolved").groupBy("_k").agg(F.min("resolved").alias("resolved"))
    longer = bare.join(begun.hint("merge"), "_k").select("path", "resolved", F.length("_k").alias("score"))
    shorter = bare.select("path", beginning(F.col("_k")).alias("_gk")).join(by_key.hint("merge"), "_gk").select("path", "resolved", F.length("_gk").alias("score"))
    numbered = numbered.unionByName(longer).unionByName(shorter)
    every = exact.unionByName(own).unionByName(kin).unionByName(keyed).unionByName(numbered)
    best = every.groupBy("path", "score").agg(F.min("resolved").alias("resolved"))
    return best.groupBy("path").agg(F.max_by("resolved", "score").alias("resolved"))


def resolved_paths(items: DataFrame, column: str, index: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(item_id, canonical, unknown): an item's paths resolved in order, and those that aren't."""
    each = items.select("item_id", F.posexplode(column).alias("_at", "path"))
    answered = each.join(resolve_known(each, index, snapshot).hint("merge"), "path", "left")
    rows = F.array_sort(F.collect_list(F.struct("_at", "path", "resolved")))
    known = F.transform(F.filter("_rows", lambda r: r["resolved"].isNotNull()), lambda r: r["resolved"])
    unknown = F.transform(F.filter("_rows", lambda r: r["resolved"].isNull()), lambda r: r["path"])
    return answered.groupBy("item_id").agg(rows.alias("_rows")).select("item_id", known.alias("canonical"), unknown.alias("unknown"))


def misplaced(items: DataFrame) -> Column:
    """Whether an item's paths lead to a section that can't hold its answer: a corrupt one; of a sale of
    assets, only business sections and tagged facts; of a comparison of figures, only risk factors."""
    some = lambda test: F.exists("paths", test)
    every = lambda test: F.forall("paths", test)
    lower = lambda p: F.lower(_tail(p))
    sale = I.divestiture_flags(F.col("question"), F.col("answer"), F.array_join(F.coalesce("claims", F.array().cast("array<string>")), " "))["is_divestiture"]
    business = every(lambda p: (lower(p).contains("item 1") & lower(p).contains("business")) | F.lower(p).contains("xbrl"))
    figures = (F.col("profile") == "comparison") & I.has(F.lower(F.coalesce("question", F.lit(""))), SECTION_WORDS)
    risks = every(lambda p: F.lower(p).contains("1a") | F.lower(p).contains("risk"))
    return (F.size("paths") > 0) & (some(lambda p: S.is_corrupt_tail(_tail(p))) | (sale & business) | (F.coalesce(figures, F.lit(False)) & risks))


def repair_paths(items: DataFrame, index: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add repaired (array), path_changed, reasons and unknown to items.

    reasons, any of corrupt, unresolved, none_known, misplaced, say why paths are picked anew; they are
    also picked where resolving has changed them. Picked is the best path of each bound accession, in
    order; without one the resolved paths stay. Both come from the index, so resolving them again
    changes nothing. Where nothing is left the paths stay as they are. unknown: paths of the result
    that the index doesn't answer.
    """
    clean = written(clean_index(index), "clean-index")
    none = F.array().cast("array<string>")
    items = written(items.withColumns({"paths": F.coalesce("paths", none), "accessions": F.coalesce("accessions", none)}), "items")
    rows = items.join(resolved_paths(items, "paths", clean, snapshot).hint("merge"), "item_id", "left")
    rows = rows.withColumns({"canonical": F.coalesce("canonical", none), "unknown": F.coalesce("unknown", none)})
    corrupt = F.exists("paths", lambda p: S.is_corrupt_tail(_tail(p)))
    reasons = F.array_compact(F.array(F.when(corrupt, "corrupt"), F.when(F.size("unknown") > 0, "unresolved"), F.when(F.size("canonical") == 0, "none_known"), F.when(misplaced(items), "misplaced")))
    rows = written(rows.withColumn("reasons", reasons), "repair-reasons")

    need = rows.where((F.size("reasons") > 0) | (F.col("canonical") != F.col("paths")))
    asked = need.select("item_id", F.posexplode("accessions").alias("_at", "accession"), "question", "answer", F.array_join("claims", " ").alias("truth"))
    picks = pick_section_paths(asked.dropDuplicates(["item_id", "accession"]), clean).select("item_id", "accession", "path")
    picks = asked.select("item_id", "_at", "accession").join(picks.hint("merge"), ["item_id", "accession"])
    picks = picks.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "path"))), lambda r: r["path"]).alias("_picked"))
    rows = rows.join(picks.hint("merge"), "item_id", "left")
    found = F.coalesce("_picked", "canonical")
    kept = (F.size("reasons") == 0) & (F.col("canonical") == F.col("paths"))
    left = ~kept & (F.size(found) == 0)
    changed = ~kept & F.when(left, F.arrays_overlap("reasons", F.array(F.lit("corrupt"), F.lit("unresolved")))).otherwise(found != F.col("paths"))
    return rows.select(
        *items.columns, F.when(kept | left, F.col("paths")).otherwise(found).alias("repaired"), changed.alias("path_changed"), "reasons",
        F.when(left, F.col("unknown")).otherwise(none).alias("unknown"),
    )


def normalized(items: DataFrame) -> DataFrame:
    """Items with answer_type and claims as the answer calls for; items without an answer stay as they are."""
    t = C.trimmed(F.col("answer"))
    infer = F.col("answer_type").isNull() | ((F.col("answer_type") == "narrative") & (F.col("profile") == "numeric") & K.is_label(t))
    guessed = infer_answer_type(F.col("answer"), F.col("profile"), F.coalesce("multi", F.lit(False)), F.coalesce("is_comparison", F.lit(False)), F.size("accessions"))
    rows = items.withColumn("answer_type", F.when((t != "") & infer, guessed).otherwise(F.col("answer_type")))
    made = K.required_claims(F.col("answer_type"), F.col("answer"), F.col("claims"), F.col("question"))
    return rows.withColumn("claims", F.when(t != "", made).otherwise(F.col("claims")))


def item_errors(items: DataFrame, snapshot: DataFrame, paths: str = "repaired") -> DataFrame:
    """Add errors (codes in the order of the rules) and status (accepted or rejected) to items with
    ``unknown``: question, bound accessions, section paths, and what the answer's type asks for."""
    wanted = items.select("item_id", F.explode("accessions").alias("accession")).distinct()
    outside = wanted.join(snapshot.select("accession").hint("merge"), "accession", "left_anti").groupBy("item_id").agg(F.count("*").alias("_outside"))
    rows = items.join(outside.hint("merge"), "item_id", "left")
    t, kind = C.trimmed(F.col("answer")), F.col("answer_type")
    claims = F.filter(F.transform(F.coalesce("claims", F.array().cast("array<string>")), C.trimmed), lambda c: c != "")
    bound = F.size(F.array_distinct("accessions"))
    bad = F.transform(F.filter(F.col(paths), lambda p: S.is_corrupt_tail(_tail(p))), lambda p: F.concat(F.lit("corrupt_section_path:"), F.left(p, F.lit(SHOWN))))
    compared = kind == "comparison"
    several = (kind == "narrative") & ~F.size(claims).between(K.FEWEST, K.MOST)
    comparison = F.coalesce("is_comparison", F.lit(False))
    groups = [
        F.array(
            F.when(C.trimmed(F.col("question")) == "", "empty_question"), F.when(F.size("accessions") == 0, "missing_accessions").when(F.col("_outside") > 0, "accession_not_in_snapshot"),
            F.when((F.col("profile") == "comparison") & (F.size("accessions") < 2), "requires_multi_filing"), F.when(F.size(paths) == 0, "missing_section_paths"),
        ),
        bad, F.transform("unknown", lambda p: F.concat(F.lit("unknown_section_path:"), p)),
        F.when(t == "", F.array(F.lit("missing_answer_gt"))).when(kind.isNull(), F.array(F.lit("missing_answer_type"))).otherwise(F.array(
            F.when(several, "required_claims"), F.when(compared & ~C.is_canonical(t), "invalid_answer_type"), F.when(compared & C.is_boilerplate(t), "boilerplate_comparison_answer"),
            F.when(compared & (bound < 2), "comparison_bindings"), F.when(compared & ~C.claim_support(claims, t)["structured"], "required_claims"),
        )),
        F.array(F.when(comparison & ~(kind.eqNullSafe(F.lit("comparison"))), "invalid_answer_type")),
    ]
    rows = rows.withColumn("errors", F.array_compact(F.concat(*groups))).drop("_outside")
    return rows.withColumn("status", F.when(F.size("errors") == 0, "accepted").otherwise("rejected"))


def repair_items(items: DataFrame, index: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(item_id, paths, answer, answer_type, claims, reasons, path_changed, answer_changed, cohort, errors, status).

    An item whose paths or whose number change is normalized and validated again, and keeps the paths
    that the index answers; one that doesn't change keeps all, and has no errors and no status here.
    cohort: misplaced paths that were mended. Null paths and accessions count as none.
    """
    rows = written(repair_paths(items, index, snapshot), "repaired-paths")
    number = F.when(K.is_number(F.col("answer")), K.canonical_number(F.col("answer"))).otherwise(F.col("answer"))
    rows = rows.withColumns({"answer": number, "answer_changed": ~number.eqNullSafe(F.when(K.is_number(F.col("answer")), C.trimmed(F.col("answer"))).otherwise(F.col("answer")))})
    rows = rows.withColumn("_changed", F.col("path_changed") | F.col("answer_changed"))
    done = item_errors(normalized(rows.where("_changed")), snapshot)
    done = done.withColumn("repaired", F.filter("repaired", lambda p: ~F.array_contains("unknown", p)))
    same = rows.where("NOT _changed").withColumns({"errors": F.lit(None).cast("array<string>"), "status": F.lit(None).cast("string")})
    both = done.unionByName(same.select(*done.columns))
    return both.select(
        "item_id", F.col("repaired").alias("paths"), "answer", "answer_type", "claims", "reasons", "path_changed", "answer_changed",
        (F.array_contains("reasons", "misplaced") & F.col("path_changed")).alias("cohort"), "errors", "status",
    )
