"""A Merkle manifest of a dataset, as a content-addressed graph, and inclusion proofs from it.

Rows are leaves; the leaves of a group make a tree of fan-out FAN, and the roots of the groups make
the tree of the dataset. Every inner node is a record (digest, children). A proof is found from the
root down: a leaf request follows the digits of its rank through the records, keeps the children it
did not choose, and has its path when the segments are read in reverse.

All is done with DataFrame functions. What shrinks by FAN with each level is written below
`spark.checkpoint.dir`; the driver sees the root, the height and nothing of a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import met, union_all, written
from .order import numbered

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose ids have a checksum that this divides are tampered with.
TAMPERED = 3
_BITS = FAN.bit_length() - 1


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: each value as its byte count, a colon and itself, `-` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(
            F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return digest(F.concat(*parts))


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, at (rank in the tree), leaf, and the rows' own columns.
    levels: for each height from 1 a table tree, at, digest, children, of inner nodes.
    trees: tree, n (leaves), number (rank of the tree), subroot; top: like levels, over subroots.
    root: None without rows.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]
    root: str | None

    def records(self) -> DataFrame:
        """The graph: one row (digest, children) for each different inner node."""
        return union_all([*self.levels, *self.top]).select("digest", "children").distinct()


def _folded(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Inner nodes by height, from tree, at, digest; a tree grows while it has several nodes."""
    levels = []
    while True:
        several = nodes.groupBy("tree").agg(F.max("at").alias("last")).filter("last > 0")
        if several.isEmpty():
            return levels
        growing = met(nodes, several.select("tree"), ["tree"], f"{label}_growing")
        runs = growing.groupBy("tree", F.shiftright("at", _BITS).alias("at")).agg(
            F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run")
        )
        children = F.transform("run", lambda x: x.getField("digest"))
        level = runs.select(
            "tree", "at", digest(F.array_join(children, "")).alias("digest"),
            children.alias("children"),
        )
        levels.append(written(level, f"{label}_level"))
        nodes = levels[-1].select("tree", "at", "digest")


def tree_name(group: Column) -> Column:
    """A text that orders groups bytewise with null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows with tree, doc_id, leaf and any further columns.

    Leaves ascend by doc_id in each tree, null ids first, rows of equal id by leaf. Runs of FAN are
    grouped by tree and rank, so a tree that holds most of the rows spreads like any other.
    """
    ordered = numbered(
        rows, F.col("tree"), F.col("doc_id"), F.col("leaf"), name="place", label="leaves"
    )
    sizes = written(
        ordered.groupBy("tree").agg(F.count("*").alias("n"), F.min("place").alias("first")), "trees"
    )
    leaves = written(
        ordered.join(sizes.select("tree", "first"), "tree")
        .withColumn("at", F.col("place") - F.col("first"))
        .drop("place", "first"),
        "ranked",
    )
    levels = _folded(leaves.select("tree", "at", F.col("leaf").alias("digest")), "tree")
    ends = union_all([
        leaves.select("tree", "at", F.col("leaf").alias("digest"), F.lit(0).alias("height")),
        *[
            level.select("tree", "at", "digest", F.lit(h).alias("height"))
            for h, level in enumerate(levels, 1)
        ],
    ]).filter("at = 0")
    subroots = ends.groupBy("tree").agg(F.max_by("digest", "height").alias("subroot"))
    trees = written(
        numbered(
            sizes.select("tree", "n").join(subroots, "tree"), F.col("tree"), name="number",
            label="numbers",
        ),
        "subroots",
    )
    top = _folded(
        trees.select(F.lit("").alias("tree"), F.col("number").alias("at"), F.col("subroot").alias("digest")),
        "top",
    )
    last = top[-1].select("digest") if top else trees.select("subroot")
    found = last.first()
    return Manifest(leaves, levels, trees, top, found[0] if found else None)


def _segment(digit: Column) -> Column:
    """The children beside the one of a digit."""
    return F.struct(
        F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice("children", digit + 2, F.lit(FAN)), "").alias("right"),
    )


def _found(paths: DataFrame, records: DataFrame, label: str) -> DataFrame:
    """Paths with the children of their node. A record is found by its digest alone; equal subtrees
    share it."""
    return met(paths, records.select("digest", "children").dropDuplicates(["digest"]), ["digest"], label)


def _chosen(paths: DataFrame, records: DataFrame, label: str) -> DataFrame:
    """Paths one level down: each goes on as one path for each child, with the children left out.

    paths: tree, at, digest, path.
    """
    child = _found(paths, records, label).select(
        "tree", F.col("at").alias("above"), "path", "children",
        F.posexplode("children").alias("digit", "digest"),
    )
    return child.select(
        "tree", (F.col("above") * FAN + F.col("digit")).alias("at"), "digest",
        F.concat("path", F.array(_segment(F.col("digit")))).alias("path"),
    )


def _wanted(paths: DataFrame, prefixes: DataFrame | None, height: int) -> DataFrame:
    """Paths that a request follows: its rank's leading digits are the path's."""
    if prefixes is None:
        return paths
    here = prefixes.select("tree", F.shiftright("at", _BITS * height).alias("at")).distinct()
    return paths.join(written(here, "prefixes"), ["tree", "at"], "left_semi")


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The requested leaves with subroot and path: segments (left, right) from the leaf upwards.

    `requests` are some rows of `manifest.leaves`; without it all leaves are. Requests whose ranks
    begin alike descend as one until their digits differ, so a level is as large as its nodes.
    left and right are the digests beside the path in its run, joined.
    """
    trees = manifest.trees
    empty = F.array().cast("array<struct<left:string,right:string>>")
    leaves = manifest.leaves if requests is None else requests
    start = manifest.top[-1] if manifest.top else trees.select(
        F.lit("").alias("tree"), F.col("number").alias("at"), F.col("subroot").alias("digest")
    )
    paths = start.select("tree", "at", "digest", empty.alias("path"))
    for records in reversed(manifest.top):
        paths = written(_chosen(paths, records, "top_records"), "top_paths")
    # A tree's descent begins at its subroot, at the height of its own tree.
    height = F.lit(0)
    for h in range(len(manifest.levels)):
        height = F.when(F.col("n") > FAN**h, h + 1).otherwise(height)
    roots = written(
        trees.withColumn("height", height).withColumnRenamed("number", "at")
        .join(paths.select("at", "path"), "at")
        .select("tree", F.lit(0).cast("long").alias("at"), F.col("subroot").alias("digest"), "path", "height", "subroot"),
        "roots",
    )

    def start_at(h: int) -> DataFrame:
        return roots.filter(F.col("height") == h).select("tree", "at", "digest", "path")

    whole = leaves.join(
        roots.filter("height = 0").select("tree", "subroot", F.reverse("path").alias("path")), "tree"
    )
    if not manifest.levels:
        return whole
    paths = start_at(len(manifest.levels))
    for h in range(len(manifest.levels), 1, -1):
        chosen = _chosen(_wanted(paths, requests, h), manifest.levels[h - 1], "records")
        paths = written(chosen, "paths").unionByName(start_at(h - 1))
    # The last digit is followed by all requests of a run together, so that a path is moved once a
    # run and not once a leaf.
    asked = leaves.groupBy("tree", F.shiftright("at", _BITS).alias("run")).agg(
        F.collect_list(F.struct(*leaves.columns)).alias("asked")
    )
    runs = _found(paths.withColumnRenamed("at", "run"), manifest.levels[0], "runs")
    each = written(runs, "run_paths").join(written(asked, "asked"), ["tree", "run"]).select(
        "path", "children", F.explode("asked").alias("r")
    )
    digit = F.col("r.at").bitwiseAND(F.lit(FAN - 1)).cast("int")
    path = F.reverse(F.concat("path", F.array(_segment(digit))))
    found = each.select("r.*", path.alias("path")).join(roots.select("tree", "subroot"), "tree")
    return found.unionByName(whole)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(
        path, leaf,
        lambda below, s: digest(F.concat(s.getField("left"), below, s.getField("right"))),
    )


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf upwards, left to right."""
    runs = F.transform(path, lambda s: F.concat(s.getField("left"), s.getField("right")))
    return digest(F.array_join(runs, ""))


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def manifest_report(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text",
                    fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows whose id's checksum is divisible by TAMPERED are proved with their text in lower case, so
    `verified` is false for those in which that changes a letter. A null id is not tampered with.
    Null groups are a tree of their own, the first. Rows of equal id keep a row each; no rows, no
    result. Columns other than `fields` are not read; texts leave the scan as digests alone.
    """
    whole = [F.col(f"`{c}`") for c in fields]
    changed = [lowered(c) if name == text_col else c for name, c in zip(fields, whole)]
    touched = F.crc32(F.col(id_col).cast("string").cast("binary")) % TAMPERED == 0
    rows = written(
        docs.select(
            tree_name(F.col(group_col)).alias("tree"),
            F.col(id_col).alias("doc_id"),
            leaf_digest(whole).alias("leaf"),
            F.when(touched, leaf_digest(changed)).alias("tampered"),
        ),
        "digests",
    )
    made = build(rows)
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return (
        proofs(made)
        .select("doc_id", "leaf", "subroot", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
        .select(
            "doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), "proof_sha256", "folded_root",
            (F.col("folded_root") == F.lit(made.root)).alias("verified"),
        )
    )
