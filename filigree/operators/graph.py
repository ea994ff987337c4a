"""Containment graphs: nodes and edges of documents, closures, bounded paths, checks.

Nodes have node_id, node_type and label; edges source_id, target_id and edge_type. All operators
take tables of sources and answer for all of them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written

EVIDENCE_TYPES = ("CHUNK_PARAGRAPH", "CHUNK_TABLE", "CHUNK_ROW", "CHUNK_XBRL_FACT", "CHUNK_FOOTNOTE")
STRUCTURAL = ("CONTAINS", "NEXT", "REFERENCES", "FOOTNOTE_OF")
WINDOW_CHARS = 4000
#: Concepts that may be broadcast, some 100 bytes each; more are joined by sorting.
MAX_CONCEPTS = 50_000
#: Nodes of a level of a search that may be broadcast, some 100 bytes each; more are joined by sorting.
MAX_NODES = 50_000
#: Nodes of which a task looks for visits; a task sorts and hashes some hundred bytes for each visit.
NODES_PER_TASK = 50_000


def sections_of(documents: DataFrame) -> DataFrame:
    """(node_id, section_id, ordinal, body): the non-empty lines of documents (node_id, text)."""
    rows = documents.select("node_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return rows.where(F.trim("line") != "").select("node_id", F.concat_ws("-s", "node_id", "ordinal").alias("section_id"), "ordinal", F.trim("line").alias("body"))


def section_edges(sections: DataFrame) -> DataFrame:
    """CONTAINS from the document and NEXT from the section before."""
    w = Window.partitionBy("node_id").orderBy("ordinal")
    rows = sections.withColumn("_before", F.lag("section_id").over(w))
    both = F.array(F.struct(F.col("node_id").alias("source_id"), F.lit("CONTAINS").alias("edge_type")), F.struct(F.col("_before").alias("source_id"), F.lit("NEXT").alias("edge_type")))
    return rows.select(F.explode(both).alias("e"), F.col("section_id").alias("target_id")).where("e.source_id IS NOT NULL").select("e.source_id", "target_id", "e.edge_type")


def reference_edges(sections: DataFrame) -> DataFrame:
    """(node_id, source_id, target_id, resolved): sections (with parent_id) and the parents they name.
    Resolved are parents that stand in the same document, no later than the section itself; these are
    its REFERENCES edges, the others are counted by ``materialize_status``."""
    heads = sections.groupBy("node_id", F.col("section_id").alias("target_id")).agg(F.min("ordinal").alias("_at"))
    named = sections.where("parent_id <> ''").select("node_id", F.col("section_id").alias("source_id"), F.col("parent_id").alias("target_id"), "ordinal")
    rows = named.hint("merge").join(heads, ["node_id", "target_id"], "left")
    return rows.select("node_id", "source_id", "target_id", F.coalesce(F.col("_at") <= F.col("ordinal"), F.lit(False)).alias("resolved"))


def chunk_sections(sections: DataFrame, chars: int = WINDOW_CHARS, most: int | None = None) -> DataFrame:
    """(section_id, window, text): all windows of a body over 40 characters, or the first ``most``."""
    n = F.ceil(F.length("body") / chars).cast("int")
    n = n if most is None else F.least(F.lit(most), n)
    rows = sections.where(F.length("body") > 40).select("section_id", "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    return rows.select("section_id", "window", F.substr("body", F.col("window") * chars + 1, F.lit(chars)).alias("text"))


def containment_closure(sources: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """(root_id, node_id, level) of everything under sources (root_id), to a fixed depth: a chain of
    joins, each on the children of the level before."""
    down = edges.where("edge_type = 'CONTAINS'").select("source_id", "target_id")
    level = sources.select("root_id", F.col("root_id").alias("node_id"))
    out = None
    for n in range(1, depth + 1):
        level = level.join(down, F.col("node_id") == F.col("source_id")).select("root_id", F.col("target_id").alias("node_id"))
        found = level.withColumn("level", F.lit(n))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("root_id", "node_id").agg(F.min("level").alias("level"))


def hop_counts(sources: DataFrame, edges: DataFrame, max_hops: int = 6) -> DataFrame:
    """(source_id, node_id, hops): nodes within ``max_hops`` of each source, edges taken both ways.

    One join a level against the edges, with the nodes seen so far taken out; each level is written
    out, and an empty one ends the search.
    """
    some = edges.where(F.col("edge_type").isin(*STRUCTURAL))
    both = written(some.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(some.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).distinct(), "adjacent")
    front = written(sources.select("source_id", F.col("source_id").alias("node_id"), F.lit(0).alias("hops")).distinct(), "hops")
    seen = front
    for n in range(1, max_hops + 1):
        step = front.join(both, F.col("node_id") == F.col("a")).select("source_id", F.col("b").alias("node_id")).distinct()
        front = written(step.join(seen, ["source_id", "node_id"], "left_anti").withColumn("hops", F.lit(n)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_path_tree(sources: DataFrame, edges: DataFrame, max_hops: int = 6) -> DataFrame:
    """(source_id, node_id, hops, parent_id, edge_type): of each node within ``max_hops`` of a source, edges
    taken both ways, the node before it on a shortest path and the edge between them.

    Of several the least parent counts, and of parallel edges the least type; a source is its own row,
    without a parent. Ids may be structs. A level is one join against the edges, aggregated before the
    nodes seen so far are taken out; no path travels along, a row stays as small at any depth.
    """
    some = edges.where(F.col("edge_type").isin(*STRUCTURAL)).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "edge_type")
    back = some.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge_type")
    both = written(some.unionByName(back).groupBy("a", "b").agg(F.min("edge_type").alias("edge_type")), "adjacent")
    start = sources.select("source_id", F.col("source_id").alias("node_id")).distinct()
    none = dict(hops=F.lit(0), parent_id=F.lit(None).cast(start.schema["node_id"].dataType), edge_type=F.lit(None).cast("string"))
    front = seen = written(start.withColumns(none), "path-tree")
    n_front = n_seen = front.limit(MAX_NODES + 1).count()
    for n in range(1, max_hops + 1):
        # A level of few nodes goes to the edges; else all edges would be moved at every level.
        step = both.join(front.select("source_id", F.col("node_id").alias("a")).hint(_way(n_front)), "a")
        step = step.groupBy("source_id", F.col("b").alias("node_id")).agg(F.min(F.struct("a", "edge_type")).alias("_by"))
        new = step.join(seen.select("source_id", "node_id").hint(_way(n_seen)), ["source_id", "node_id"], "left_anti")
        front = written(new.select("source_id", "node_id", F.lit(n).alias("hops"), F.col("_by.a").alias("parent_id"), "_by.edge_type"), "path-tree")
        n_front = front.limit(MAX_NODES + 1).count()
        if not n_front:
            break
        seen, n_seen = seen.unionByName(front), n_seen + n_front
    return seen


def _way(rows: int) -> str:
    return "broadcast" if rows <= MAX_NODES else "merge"


def shortest_paths(pairs: DataFrame, tree: DataFrame, max_hops: int = 6) -> DataFrame:
    """(source_id, node_id, hops, node_ids, edge_types) for each pair (source_id, node_id) that the tree of
    ``shortest_path_tree`` joins; node_ids from the source to the node.

    Paths are read backwards, a join a hop, and grow in front: a row is as long as its hops, and is
    done when it has no parent, so nothing is gathered.
    """
    tree = tree.select("source_id", F.col("node_id").alias("_at"), "parent_id", "edge_type")
    types = lambda *more: F.concat(F.array_compact(F.array(F.col("edge_type"))), *more)
    at = pairs.select("source_id", "node_id").distinct().withColumn("_at", F.col("node_id")).join(tree.hint("merge"), ["source_id", "_at"])
    out = at = written(at.select("source_id", "node_id", F.col("parent_id").alias("_up"), F.array("_at").alias("node_ids"), types().alias("edge_types")), "path-steps")
    for _ in range(max_hops):
        up = at.where("_up IS NOT NULL").withColumnRenamed("_up", "_at")
        if up.isEmpty():
            break
        at = up.join(tree.hint("merge"), ["source_id", "_at"])
        at = written(at.select("source_id", "node_id", F.col("parent_id").alias("_up"), F.concat(F.array("_at"), "node_ids").alias("node_ids"), types("edge_types").alias("edge_types")), "path-steps")
        out = out.unionByName(at)
    return out.where("_up IS NULL").select("source_id", "node_id", (F.size("node_ids") - 1).alias("hops"), "node_ids", "edge_types")


def neighbors(sources: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(node_id, neighbor_id) in either direction."""
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    out = sources.join(e, F.col("node_id") == F.col("source_id")).select("node_id", F.col("target_id").alias("neighbor_id"))
    back = sources.join(e, F.col("node_id") == F.col("target_id")).select("node_id", F.col("source_id").alias("neighbor_id"))
    return out.unionByName(back).distinct()


def outgoing_edges(sources: DataFrame, edges: DataFrame) -> DataFrame:
    return sources.join(edges, F.col("node_id") == F.col("source_id")).select("node_id", "target_id", "edge_type")


def scan_ratio(visited: DataFrame, navigable: DataFrame, full: float = 0.9) -> DataFrame:
    """Per query: visited of the navigable nodes of its filing, and whether that is a full scan.

    Sorted keys shrink so much in a shuffle that partitions of a given number of bytes hold very many
    rows; tasks are cut by the number of nodes instead.
    """
    total = navigable.groupBy("filing_id").agg(F.count("*").alias("navigable"))
    parts = max(int(navigable.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-navigable.count() // NODES_PER_TASK))
    nodes = navigable.distinct().join(total.hint("merge"), "filing_id")
    seen = visited.repartition(parts, "filing_id", "node_id").join(nodes.hint("merge"), ["filing_id", "node_id"])
    hit = seen.repartition(parts, "query_id", "filing_id").groupBy("query_id", "filing_id", "navigable").agg(F.count_distinct("node_id").alias("visited"))
    rows = hit.withColumn("ratio", F.col("visited") / F.col("navigable"))
    return rows.select("query_id", "filing_id", "visited", "navigable", "ratio", (F.col("ratio") >= full).alias("full_scan"))


def table_of_contents(roots: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 40) -> DataFrame:
    """(root_id, section_id, n_children, position): each root's sections with their direct evidence
    children (footnotes aside), by item number and id, the first ``most``. Sections without an item
    number sort as "Z". nodes: node_id, node_type, item_number."""
    down = edges.where("edge_type = 'CONTAINS'").select("source_id", "target_id")
    sections = roots.join(down, F.col("root_id") == F.col("source_id")).select("root_id", F.col("target_id").alias("section_id"))
    item = F.coalesce(F.nullif(F.col("item_number"), F.lit("")), F.lit("Z"))
    items = nodes.where("node_type = 'SECTION'").select(F.col("node_id").alias("section_id"), item.alias("_item"))
    evidence = down.join(nodes.where(F.col("node_type").isin(*EVIDENCE_TYPES[:4])).select(F.col("node_id").alias("target_id")), "target_id")
    counts = evidence.groupBy(F.col("source_id").alias("section_id")).agg(F.count("*").alias("n"))
    rows = sections.join(items, "section_id").join(counts, "section_id", "left")
    w = Window.partitionBy("root_id").orderBy("_item", "section_id")
    rows = rows.select("root_id", "section_id", F.coalesce("n", F.lit(0)).alias("n_children"), F.row_number().over(w).alias("position"))
    return rows.where(F.col("position") <= most)


def orphans(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Evidence nodes that no root contains."""
    reached = containment_closure(roots, edges).select("node_id").distinct()
    return nodes.where(F.col("node_type").isin(*EVIDENCE_TYPES)).join(reached, "node_id", "left_anti").select("node_id")


def _met(table: DataFrame, name: str) -> DataFrame:
    """A table, written, with the hint by which very many rows meet it: few rows are looked up without a shuffle."""
    table = written(table, name)
    return table.hint("broadcast" if table.limit(MAX_CONCEPTS + 1).count() <= MAX_CONCEPTS else "merge")


def same_concept_classes(facts: DataFrame) -> DataFrame:
    """(fact_id, class_id, n_links): facts that share a concept across filings.

    Every two facts of a concept in different filings are linked, so a concept is a class and the
    links of a fact are the class's facts less those of its own filing; pairs needn't be listed.
    """
    own = facts.groupBy("concept", "accession").agg(F.count("*").alias("_own")).where("_own > 1")
    # A row a concept; and as a filing mostly has one fact of a concept, a row for each where it has several.
    heads = _met(facts.groupBy("concept").agg(F.count("*").alias("_all"), F.min("fact_id").alias("class_id")), "concepts")
    rows = facts.where("accession IS NOT NULL").join(heads, "concept").join(_met(own, "several"), ["concept", "accession"], "left")
    return rows.select("fact_id", "class_id", (F.col("_all") - F.coalesce("_own", F.lit(1))).alias("n_links"))


def collapse_parallel(edges: DataFrame, ordinal: Column) -> DataFrame:
    """The last edge of each (source, target) by ``ordinal``."""
    return edges.withColumn("_o", ordinal).groupBy("source_id", "target_id").agg(F.max_by("edge_type", "_o").alias("edge_type"))


def catalog_violations(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("edge_type").isin(*STRUCTURAL, "SEMANTIC_SIMILARITY", "TEMPORAL")).groupBy("edge_type").agg(F.count("*").alias("n"))


def sequence_matches(sequence: Column, patterns: Column) -> Column:
    """Whether some non-empty pattern is a subsequence of the sequence; no pattern at all matches."""
    def within(p: Column) -> Column:
        at = F.aggregate(sequence, F.lit(0), lambda i, e: i + F.when((i < F.size(p)) & (F.get(p, i) == e), 1).otherwise(0))
        return (F.size(p) > 0) & (at == F.size(p))

    return (F.size(patterns) == 0) | F.exists(patterns, within)


def table_nodes_edges(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): each table under its fact bucket if one came before, else the
    last section before it, else the document; and its rows under it.

    tables: node_id, ordinal, is_fact, rows (array of cell arrays); sections: node_id, ordinal, section_id.
    """
    marks = sections.select("node_id", "ordinal", "section_id", F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(False).alias("is_fact"), F.lit(0).alias("t"))
    both = marks.unionByName(tables.select("node_id", "ordinal", F.lit(None).cast("string").alias("section_id"), "rows", "is_fact", F.lit(1).alias("t")))
    w = Window.partitionBy("node_id").orderBy("ordinal", "t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumns({"last": F.last("section_id", ignorenulls=True).over(w), "bucket": F.max(F.col("is_fact").cast("int")).over(before)}).where("t = 1")
    table_id = F.concat_ws("-t", "node_id", "ordinal")
    parent = F.when(F.coalesce("bucket", F.lit(0)) == 1, F.concat("node_id", F.lit("-xbrl-facts"))).otherwise(F.coalesce("last", "node_id"))
    top = rows.select(parent.alias("source_id"), table_id.alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
    down = rows.select(table_id.alias("source_id"), F.posexplode("rows").alias("r", "cells")).select("source_id", F.concat_ws("-r", "source_id", "r").alias("target_id"), F.lit("CONTAINS").alias("edge_type"))
    return top.unionByName(down)


def materialize_status(nodes: DataFrame, edges: DataFrame, references: DataFrame) -> DataFrame:
    """(accession, status, reason, n_nodes, n_edges, n_unresolved) for each filing with nodes.

    nodes: accession, node_id, node_type; edges: accession, source_id, target_id, edge_type;
    references: accession, resolved. A filing without sections and facts fails and counts nothing;
    one with evidence that its document doesn't contain fails as orphans. Failed filings are left out
    of a snapshot by a semi join with the others.
    """
    kinds = nodes.groupBy("accession").agg(F.count("*").alias("n"), F.count_if(F.col("node_type").isin("SECTION", "CHUNK_XBRL_FACT")).alias("_full"))
    roots = nodes.where("node_type = 'DOCUMENT'").select(F.col("node_id").alias("root_id"))
    lost = nodes.select("accession", "node_id").join(orphans(nodes, edges, roots), "node_id", "left_semi").groupBy("accession").agg(F.count("*").alias("_lost"))
    links = edges.groupBy("accession").agg(F.count("*").alias("e"))
    open_ = references.where("NOT resolved").groupBy("accession").agg(F.count("*").alias("u"))
    rows = kinds.join(lost, "accession", "left").join(links, "accession", "left").join(open_, "accession", "left")
    reason = F.when(F.col("_full") == 0, "no_sections_or_facts").when(F.col("_lost") > 0, "orphans")
    counts = [F.when(F.col("_full") == 0, 0).otherwise(F.coalesce(c, F.lit(0))).alias(name) for c, name in (("n", "n_nodes"), ("e", "n_edges"), ("u", "n_unresolved"))]
    return rows.select("accession", F.when(reason.isNull(), "included").otherwise("failed").alias("status"), reason.alias("reason"), *counts)


def slice_ids(items: DataFrame) -> DataFrame:
    """(item_id, slice_id): "slice-" and twelve hex digits of the digest of an item's sorted accessions."""
    return items.select("item_id", F.concat(F.lit("slice-"), F.left(F.sha2(F.array_join(F.array_sort("accessions"), "|"), 256), F.lit(12))).alias("slice_id"))


def merge_snapshots(members: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifests of composites: composite_id, issuer_id, n_snapshots, node_count, edge_count, filings,
    audit_ready, audit_pass_rate.

    members: composite_id, ordinal, issuer_id, snapshot_id. manifests: issuer_id, snapshot_id, node_count,
    edge_count, filings (array), audit_ready, audit_pass_rate. Counts are summed and filings joined in
    order; the audit is the first member's; a composite of one keeps its issuer, others are of issuer
    "composite". Members without a manifest don't count. Nodes and edges themselves stay where they
    are: ``subgraph`` reads them.
    """
    rows = members.join(manifests.hint("merge"), ["issuer_id", "snapshot_id"])
    fields = F.struct("ordinal", "issuer_id", "snapshot_id", "filings", "audit_ready", "audit_pass_rate")
    g = rows.groupBy("composite_id").agg(F.count("*").alias("n_snapshots"), F.sum("node_count").alias("node_count"), F.sum("edge_count").alias("edge_count"), F.array_sort(F.collect_list(fields)).alias("_m"))
    first = F.col("_m")[0]
    issuer = F.when(F.col("n_snapshots") == 1, first["issuer_id"].cast("string")).otherwise("composite")
    return g.select("composite_id", issuer.alias("issuer_id"), "n_snapshots", "node_count", "edge_count", F.flatten("_m.filings").alias("filings"), first["audit_ready"].alias("audit_ready"), first["audit_pass_rate"].alias("audit_pass_rate"))


def slice_members(items: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, unresolved) of the slices that items (item_id, accessions) need: members (composite_id,
    ordinal, issuer_id, snapshot_id), each snapshot once, in the order of the sorted accessions, for the
    distinct slices only; unresolved (item_id, accession) that index (accession, issuer_id,
    snapshot_id) lacks, with a null accession for an item without any."""
    sliced = items.join(slice_ids(items).hint("merge"), "item_id").select("item_id", "slice_id", F.array_sort("accessions").alias("accessions"))
    wanted = sliced.dropDuplicates(["slice_id"]).select(F.col("slice_id").alias("composite_id"), F.posexplode("accessions").alias("_at", "accession"))
    found = wanted.join(index.hint("merge"), "accession").groupBy("composite_id", "issuer_id", "snapshot_id").agg(F.min("_at").alias("_at"))
    members = found.withColumn("ordinal", F.row_number().over(Window.partitionBy("composite_id").orderBy("_at", "issuer_id", "snapshot_id"))).drop("_at")
    each = items.select("item_id", F.explode_outer("accessions").alias("accession")).distinct()
    return members, each.join(index.select("accession").distinct().hint("merge"), "accession", "left_anti").select("item_id", "accession")


def subgraph(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (issuer_id, snapshot_id, ...) of the snapshots in members, once each: a semi join on
    the columns by which snapshots are partitioned, so that only their folders are read."""
    some = members.select("issuer_id", "snapshot_id").distinct()
    return tuple(df.join(some, ["issuer_id", "snapshot_id"], "left_semi") for df in (nodes, edges))


def attach_footnotes(scope: DataFrame, edges: DataFrame, direction: str = "table_to_footnote") -> DataFrame:
    """Nodes in scope (query_id, node_id) and the footnotes tied to them by FOOTNOTE_OF."""
    here, there = ("source_id", "target_id") if direction == "table_to_footnote" else ("target_id", "source_id")
    more = scope.join(edges.where("edge_type = 'FOOTNOTE_OF'"), F.col("node_id") == F.col(here)).select("query_id", F.col(there).alias("node_id"))
    return scope.select("query_id", "node_id").unionByName(more).distinct()


def sections_for_filings(bound: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, section_id): sections directly under the bound documents (query_id, root_id)."""
    down = edges.where("edge_type = 'CONTAINS'").select(F.col("source_id").alias("root_id"), F.col("target_id").alias("section_id"))
    kinds = nodes.where("node_type = 'SECTION'").select(F.col("node_id").alias("section_id"))
    return bound.join(down, "root_id").join(kinds, "section_id", "left_semi").select("query_id", "section_id")


def audit_sample(nodes: DataFrame, n: int, seed: int, fact_share: float = 0.6) -> DataFrame:
    """``n`` evidence nodes in draw order: facts up to their share first, then the rest."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("node_id")), 256)
    rows = nodes.where(F.col("node_type").isin(*EVIDENCE_TYPES)).withColumn("_k", key)
    fact = F.col("node_type").isin("CHUNK_XBRL_FACT", "CHUNK_TABLE")
    first = rows.where(fact).orderBy("_k").limit(int(fact_share * n))
    rest = rows.join(first.select("node_id"), "node_id", "left_anti").orderBy("_k")
    return first.withColumn("_o", F.lit(0)).unionByName(rest.limit(n).withColumn("_o", F.lit(1))).orderBy("_o", "_k").limit(n).select("node_id", "node_type")


def reachability_sample(nodes: DataFrame, n: int = 100, seed: int = 42, fact_share: float = 0.6) -> DataFrame:
    """At most ``n`` nodes of each snapshot, with ``kind``: first facts up to their share (one at least), then
    table rows with a digit, then what else there is of facts and rows; each in the order of a seeded
    digest. nodes: snapshot_id, node_id, node_type, label and any others, which pass through."""
    fact, row = F.col("node_type") == "CHUNK_XBRL_FACT", F.col("node_type") == "CHUNK_ROW"
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("node_id")), 256)
    kind = F.when(fact, "xbrl_fact").otherwise("table_row")
    rows = nodes.where(fact | row).withColumns({"kind": kind, "_digest": digest, "_class": F.when(fact, 0).when(F.coalesce(F.col("label").rlike("[0-9]"), F.lit(False)), 1).otherwise(2)})
    # No class gives more than n, so all windows are cut short early.
    each = Window.partitionBy("snapshot_id", "_class").orderBy("_digest", "node_id")
    rows = rows.withColumn("_k", F.row_number().over(each)).where(F.col("_k") <= n)
    quota = max(1, int(n * fact_share))
    phase = F.when((F.col("_class") == 0) & (F.col("_k") <= quota), 0).when(F.col("_class") == 1, 1).otherwise(2)
    first = Window.partitionBy("snapshot_id").orderBy("_phase", "_digest", "node_id")
    rows = rows.withColumn("_phase", phase).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n)
    return rows.drop("_digest", "_class", "_k", "_phase", "_n")


def reachability_audit(nodes: DataFrame, edges: DataFrame, hop_budget: int = 6, n: int = 100, pass_threshold: float = 0.95, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(entries, report) of many snapshots: whether a sample of facts and table rows is reached from its
    document by structural edges, by which path, and the share that is.

    nodes: snapshot_id, node_id, node_type, label, root_id (the node's document); edges: snapshot_id,
    source_id, target_id, edge_type. entries: snapshot_id, node_id, kind, reachable, hops, node_ids,
    edge_types (nulls where there is no path). report: snapshot_id, sample_size, reached, pass_rate,
    audit_ready. A snapshot without facts and rows isn't reported.
    """
    key = lambda c: F.struct("snapshot_id", F.col(c).alias("id"))
    sample = written(reachability_sample(nodes, n, seed), "audit-sample")
    inside = edges.select(key("source_id").alias("source_id"), key("target_id").alias("target_id"), "edge_type")
    pairs = sample.select(key("root_id").alias("source_id"), key("node_id").alias("node_id"))
    paths = shortest_paths(pairs, shortest_path_tree(pairs, inside, hop_budget), hop_budget)
    paths = paths.select(F.col("node_id.snapshot_id").alias("snapshot_id"), F.col("source_id.id").alias("root_id"), F.col("node_id.id").alias("node_id"), "hops", F.col("node_ids.id").alias("node_ids"), "edge_types")
    entries = sample.join(paths.hint("merge"), ["snapshot_id", "root_id", "node_id"], "left")
    entries = written(entries.select("snapshot_id", "node_id", "kind", F.col("hops").isNotNull().alias("reachable"), "hops", "node_ids", "edge_types"), "audit-entries")
    report = entries.groupBy("snapshot_id").agg(F.count("*").alias("sample_size"), F.count_if("reachable").alias("reached"))
    rate = F.col("reached") / F.col("sample_size")
    return entries, report.withColumns({"pass_rate": rate, "audit_ready": rate >= pass_threshold})
