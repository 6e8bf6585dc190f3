"""Digest trees of tables: SHA-256 over ranges of row hashes, with a fixed fan-out.

A row's hash is the SHA-256 of its canonical text. Leaves are the ranges of hashes that share their first
hexadecimal digits; a leaf's digest is the SHA-256 of its rows' hashes in order, each with the number of times that it occurs. Every
inner node's digest is the SHA-256 of its sixteen children's, empty ones left out, so the
root vouches for every row in any row order, and two trees differ at the leaves that hold what was changed, and nowhere else.

Hashes are even, so leaves are; copies of a row are counted before they meet. The depth, and
with it the number of leaves, grows with the table; a manifest keeps it, and verification uses the manifest's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import published, written

#: Children of a node (one hexadecimal digit), and rows of a leaf, about.
FANOUT, LEAF_ROWS = 16, 4096


def canonical(df: DataFrame) -> Column:
    """A row as text: for each column in the order of names its length in bytes, a colon and its value; null is a minus sign.

    Nested values count as JSON with sorted map keys. Equal rows have equal texts, different ones differ.
    """

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            value = F.lower(F.hex(c))
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            value = F.to_json(sorted_maps(c, f.dataType), {"ignoreNullFields": "false"})
        else:
            value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat_ws("|", *[text(f) for f in sorted(df.schema, key=lambda f: f.name)])


def sorted_maps(c: Column, kind: T.DataType) -> Column:
    """A nested value with its maps as arrays of entries in the order of keys, at any depth."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[sorted_maps(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_maps(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(sorted_maps(e["key"], kind.keyType).alias("key"), sorted_maps(e["value"], kind.valueType).alias("value"))))
    return c


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """The least depth at which a leaf holds ``leaf_rows`` rows at most, on average; 1 at least."""
    depth = 1
    while rows > leaf_rows * FANOUT**depth:
        depth += 1
    return depth


def tree(df: DataFrame, depth: int) -> DataFrame:
    """(level, node, rows, sha256) of every node that holds rows: the root is level 0 and node ''; an empty table has its root alone."""
    hashes = df.select(_sha(canonical(df)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    level = hashes.groupBy(F.substring("h", 1, depth).alias("node")).agg(F.sum("n").alias("rows"), _sha(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("h"), F.lit("*"), F.col("n").cast("string")))), ",")).alias("sha256"))
    level = written(level.select(F.lit(depth).alias("level"), "node", "rows", "sha256"), "leaves")
    levels = [level]
    for k in range(depth - 1, -1, -1):
        by = [F.substring("node", 1, k).alias("node")] if k else []
        # A node has sixteen children at most.
        level = level.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), _sha(F.array_join(F.sort_array(F.collect_list(F.concat(F.substring(F.col("node"), k + 1, 1), F.lit("="), F.col("sha256")))), ",")).alias("sha256"))
        level = level.select(F.lit(k).alias("level"), F.col("node") if k else F.lit("").alias("node"), "rows", "sha256")
        levels.append(level)
    out = levels[-1]
    for x in levels[-2::-1]:
        out = out.unionByName(x)
    return out


def digest(df: DataFrame, depth: int | None = None) -> DataFrame:
    """(rows, depth, sha256) of a table, in any row order: the root of its tree. Without a depth, the row count chooses it."""
    depth = depth_for(df.count()) if depth is None else depth
    return tree(df, depth).where("level = 0").select("rows", F.lit(depth).alias("depth"), "sha256")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, node, rows, other_rows) of the nodes at which two trees of one depth differ; none when the tables hold the same rows."""
    other = b.select("level", "node", F.col("rows").alias("other_rows"), F.col("sha256").alias("other"))
    both = a.join(other, ["level", "node"], "full")
    return both.where("not (sha256 <=> other)").select("level", "node", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("other_rows", F.lit(0)).alias("other_rows"))


def changed_rows(df: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """The rows of ``df`` in the named leaves (column ``node``): what a verification that fails has to look at."""
    return df.withColumn("__leaf", F.substring(_sha(canonical(df)), 1, depth)).join(leaves.select(F.col("node").alias("__leaf")).distinct(), "__leaf", "left_semi").drop("__leaf")


def publish_and_verify(df: DataFrame, name: str, issues: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """Write a snapshot (never over one that exists) and its tree as a manifest, read it back and compare: (dataset, rows, depth, sha256, verified, bad_leaves).

    ``issues`` is a quality report (see ``validation.quality_report``): a blocked one stops before anything is written.
    """
    if issues is not None and issues.where("blocked").head(1):
        raise ValueError(f"{name}: the quality report blocks publishing")
    df = written(df, f"{name}-staged")
    depth = depth_for(df.count()) if depth is None else depth
    said = written(tree(df, depth), f"{name}-manifest")
    back = published(df, name)
    return verify(back, said, depth).select(F.lit(name).alias("dataset"), "rows", "depth", "sha256", "verified", "bad_leaves")


def verify(df: DataFrame, manifest: DataFrame, depth: int) -> DataFrame:
    """(rows, depth, sha256, verified, bad_leaves) of a table against the tree in its manifest: the manifest's root, whether the table has it, and at how many leaves it differs."""
    root = manifest.where("level = 0").select("rows", "sha256")
    bad = differences(manifest, tree(df, depth)).agg(F.count_if(F.col("level") == depth).alias("bad_leaves"), F.count("*").alias("bad"))
    return root.join(bad, F.lit(True)).select("rows", F.lit(depth).alias("depth"), "sha256", (F.col("bad") == 0).alias("verified"), "bad_leaves")


def manifests(df: DataFrame, by: str, order: str, dataset: str = "bars", source: str = "tables", depth: int = 1) -> DataFrame:
    """One manifest a group: (dataset, snapshot_id, row_count, content_sha256, metadata, source, schema_version, data_files, valid). A group's leaves are bounded in number and even, whatever its size."""
    h = df.select(F.col(by).alias("__by"), F.col(order).alias("__at"), _sha(canonical(df)).alias("h"))
    spans = h.groupBy("__by").agg(F.count("*").alias("row_count"), F.min("__at").alias("lo"), F.max("__at").alias("hi"))
    leaves = h.groupBy("__by", "h").agg(F.count("*").alias("n")).groupBy("__by", F.substring("h", 1, depth).alias("leaf")).agg(_sha(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("h"), F.lit("*"), F.col("n").cast("string")))), ",")).alias("sha256"))
    roots = leaves.groupBy(F.col("__by").alias("__of")).agg(_sha(F.array_join(F.sort_array(F.collect_list(F.concat(F.col("leaf"), F.lit("="), F.col("sha256")))), ",")).alias("content_sha256"))
    m = spans.join(roots, F.col("__by").eqNullSafe(F.col("__of")))
    m = m.select(F.lit(dataset).alias("dataset"), F.lower(F.regexp_replace("__by", " ", "-")).alias("snapshot_id"), "row_count", "content_sha256", F.create_map(F.lit("start"), F.col("lo").cast("string"), F.lit("end"), F.col("hi").cast("string")).alias("metadata"))
    m = m.withColumns({"source": F.lit(source), "schema_version": F.lit(1), "data_files": F.array(F.concat_ws("/", "dataset", F.concat("snapshot_id", F.lit(".parquet"))))})
    return m.withColumn("valid", valid_manifest())


def safe_segment(c: Column) -> Column:
    """A snapshot's name: letters, digits, underscores, dots, colons and hyphens, but not one or two dots alone."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.:-]+\z") & ~c.isin(".", ".."), F.lit(False))


def relative_path(c: Column) -> Column:
    """A path below the store: not empty or a dot, not absolute, no drive or share (also by backslashes), no part of two dots."""
    absolute = c.startswith("/") | c.rlike("^.:") | c.rlike(r"^[/\\]{2}")
    return F.coalesce((c != "") & (c != ".") & ~absolute & F.forall(F.split(c, r"[/\\]"), lambda p: p != ".."), F.lit(False))


def valid_manifest() -> Column:
    """Whether a manifest's names, version, row count, digest and data files hold by the rules; null fields break theirs."""
    ok = safe_segment(F.col("snapshot_id")) & F.col("dataset").rlike(r"^[a-z][a-z0-9_]*\z") & (F.length("source") >= 1) & (F.col("schema_version") >= 1) & (F.col("row_count") >= 0) & F.col("content_sha256").rlike(r"^[0-9a-f]{64}\z")
    return F.coalesce(ok & F.forall("data_files", relative_path), F.lit(False))
