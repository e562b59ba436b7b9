"""Snapshots, upserts and deletions of node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.session import materialize


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, change) added, deleted or changed between two snapshots with one row per key."""
    h = F.xxhash64(*cols).alias
    a, b = old.select(key, h("_a")), new.select(key, h("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values win, values that the new row lacks keep the old ones."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias("_n_" + c) for c in cols if c in new.columns])
    pick = [F.coalesce("_n_" + c, c).alias(c) if c in new.columns else F.col(c) for c in cols]
    return old.join(n, key, "full_outer").select(key, *pick)


def last_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def connected_edges(edges: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """One edge per (src, type, dst); edges with an unknown end are left out."""
    ids = nodes.select(id_col).distinct()
    e = edges.join(ids.select(F.col(id_col).alias("src")), "src", "left_semi").join(ids.select(F.col(id_col).alias("dst")), "dst", "left_semi")
    return e.dropDuplicates(["src", "type", "dst"])


def duplicate_ids(nodes: DataFrame, id_col: str = "id") -> DataFrame:
    return nodes.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files (file_path); edges go with either end."""
    keep = nodes.join(files.select("file_path").distinct(), "file_path", "left_anti")
    ids = keep.select("id").distinct()
    e = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return keep, e


def affected_files(changed: DataFrame, deleted: DataFrame, includes: DataFrame) -> DataFrame:
    """Changed files, those that include them, and deleted ones (file_path)."""
    by = includes.join(changed.select(F.col("file_path").alias("included")), "included", "left_semi").select("file_path")
    return changed.select("file_path").union(by).union(deleted.select("file_path")).distinct()


def assemble(functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the containment graph: repository, directories, files, classes, functions.

    Nodes are (label, id, name, file_path), edges (type, src, dst).
    """
    fn = functions.where("id IS NOT NULL AND file_path IS NOT NULL").select("id", "name", "file_path", "parent_class")
    files = fn.select("file_path").distinct()
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = files.where(F.col("file_path").contains("/")).select(F.explode(above).alias("d")).distinct()
    classes = fn.where("parent_class IS NOT NULL").select(F.concat("file_path", F.lit(":"), "parent_class").alias("id"), F.col("parent_class").alias("name"), "file_path").distinct()
    none = F.lit(None).cast("string")
    node = lambda df, label, id_, name, path: df.select(F.lit(label).alias("label"), id_.alias("id"), name.alias("name"), path.alias("file_path"))
    d, p = F.col("d"), F.col("file_path")
    did = F.concat(F.lit("dir:"), d)
    nodes = (
        node(fn.sparkSession.range(1), "Repository", F.lit("repo:1"), F.lit("repository"), none)
        .unionByName(node(dirs, "Directory", did, F.substring_index("d", "/", -1), none))
        .unionByName(node(files, "File", p, F.substring_index("file_path", "/", -1), p))
        .unionByName(node(classes, "Class", F.col("id"), F.col("name"), p))
        .unionByName(node(fn, "Function", F.col("id"), F.col("name"), p))
    )
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), a.alias("src"), b.alias("dst"))
    up = lambda c: F.when(F.col(c).contains("/"), F.concat(F.lit("dir:"), F.regexp_replace(c, "/[^/]*$", ""))).otherwise("repo:1")
    edges = (
        edge(dirs, "CONTAINS", up("d"), did)
        .unionByName(edge(files, "CONTAINS", up("file_path"), p))
        .unionByName(edge(fn, "CONTAINS", p, F.col("id")))
        .unionByName(edge(classes, "CONTAINS", p, F.col("id")))
        .unionByName(edge(fn.where("parent_class IS NOT NULL"), "HAS_METHOD", F.concat("file_path", F.lit(":"), "parent_class"), F.col("id")))
    )
    return nodes, edges


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, file_path, old_path): added A, modified M, deleted D and renamed R files between two states (file_path, h).

    A content that only one vanished and only one new path holds was renamed;
    ``old_path`` is set for these alone.
    """
    both = old.select("file_path", F.col("h").alias("was")).join(new.select("file_path", F.col("h").alias("is")), "file_path", "full_outer")
    both = materialize(both)
    gone, come = both.where("`is` IS NULL"), both.where("was IS NULL")
    single = lambda df, h, p: df.groupBy(F.col(h).alias("h")).agg(F.min("file_path").alias(p), F.count("*").alias("n")).where("n = 1").drop("n")
    renamed = materialize(single(gone, "was", "old_path").join(single(come, "is", "file_path"), "h"))
    none = F.lit(None).cast("string").alias("old_path")
    added = come.join(renamed.select("file_path"), "file_path", "left_anti").select(F.lit("A").alias("change"), "file_path", none)
    deleted = gone.join(renamed.select(F.col("old_path").alias("file_path")), "file_path", "left_anti").select(F.lit("D").alias("change"), "file_path", none)
    modified = both.where("was <> `is`").select(F.lit("M").alias("change"), "file_path", none)
    return renamed.select(F.lit("R").alias("change"), "file_path", "old_path").unionByName(added).unionByName(deleted).unionByName(modified)


def header_cascade(changed: DataFrame, includes: DataFrame) -> DataFrame:
    """(file_path, why): the changed files (file_path) and those that include a changed header by its name.

    ``includes`` has (file_path, header); as in an include line, the header's
    last part tells.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    own = changed.select("file_path").distinct()
    headers = own.where(F.col("file_path").rlike(r"\.(h|hpp)$")).select(base("file_path").alias("base")).distinct()
    by = includes.withColumn("base", base("header")).join(headers, "base", "left_semi").select("file_path").distinct()
    return own.withColumn("why", F.lit("changed")).unionByName(by.join(own, "file_path", "left_anti").withColumn("why", F.lit("includes")))
