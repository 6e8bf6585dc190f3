"""Operator 3: canonical exact digests of documents, in SQL functions only.

The canonical text is Unicode normalised (NFC), case-folded, normalised again, with
runs of white space as one space and none at the ends. Its fingerprint is 128 bits
wide: two xxhash64 values. Equal fingerprints are groups only after a comparison of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import settled

_OTHER = r"\t-\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: White space that is not a single space between words: only that is replaced.
_SPACE = f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"
#: Rows of one range of ids, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 4_000, 1 << 14
#: Range borders that a row is compared with at a time.
STRIDE = 128


def _nfc(text: Column) -> Column:
    return F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def canonical(text: Column) -> Column:
    """The canonical form; that of null is empty."""
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_nfc(folded), _SPACE, " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits of a canonical text."""
    word = lambda *c: F.lower(F.lpad(F.hex(F.xxhash64(*c)), 16, "0"))
    return F.concat(word(canon), word(F.lit("wide"), canon))


def printed(df: DataFrame, text: str = "text", name: str = "fingerprint", keep_canon: bool = False) -> DataFrame:
    """``df`` with the fingerprint ``name`` of a text column. The canonical text is a column of its own on the way (``canon``, kept if asked for): Spark takes its functions as ones that may
    not give the same twice, and would run them for every use."""
    out = df.withColumn("canon", canonical(F.col(text))).withColumn(name, digest(F.col("canon")))
    return out if keep_canon else out.drop("canon")


def group_ids(prints: DataFrame, df: DataFrame, text_col: str) -> tuple[DataFrame, bool]:
    """(fingerprint, group_id) of (id, fingerprint) rows, and whether texts of one fingerprint differ somewhere.

    Ids are pre-aggregated before they meet by fingerprint. Only of fingerprints that come several times are the texts compared, by the least and greatest
    canonical text of each, pre-aggregated too.
    """
    buckets = settled(prints.groupBy("fingerprint").agg(F.min("id").alias("group_id"), F.count("*").alias("n")), "buckets")
    canon = printed(df.select(F.col(text_col).alias("text")), keep_canon=True).select("canon", "fingerprint")
    bytes_of = canon.join(buckets.where("n > 1").select("fingerprint"), "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    return buckets.select("fingerprint", "group_id"), bool(bytes_of.where("lo <> hi").head(1))


def _groups_by_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint, group_id) of every row by the whole canonical text: for tables in which fingerprints collide."""
    rows = printed(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keep_canon=True).select("id", "canon", "fingerprint")
    least = rows.groupBy("fingerprint", "canon").agg(F.min("id").alias("group_id"))
    return rows.join(least, ["fingerprint", "canon"]).select("id", "fingerprint", "group_id")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, group_id) of every row; group_id is the smallest id with the same canonical text.

    Texts of equal fingerprints are compared byte by byte; where some differ, the groups are formed by the text itself. Null and
    empty texts are one group. Repeated rows stay; null ids are passed over by the minimum.
    Columns other than the two named are not read. An empty table gives none.
    """
    prints = settled(printed(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "fingerprint"), "prints")
    groups, clash = group_ids(prints, df, text_col)
    out = _groups_by_text(df, id_col, text_col) if clash else prints.join(groups, "fingerprint")
    return out.select(F.col("id").alias(id_col), "fingerprint", "group_id")


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, fingerprint, next_text, next_fingerprint): each row and the row with the next smaller id; after the smallest comes the largest.

    Ids are dealt into ranges by approximate quantiles; the first row of each range is
    copied to the end of the range before it, so no row needs another task's. Equal ids are
    ordered by a hash of their texts; null ids come last. Only range borders reach the driver, 16,384 at most.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = df.select(F.col(id_col).cast("double").alias("id"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = sorted(set(ids.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or [])) if ranges > 1 else []
    x = F.col("id").cast("double")
    passed = lambda array: F.size(F.filter(array, lambda c: c <= x))
    every = F.lit(cuts).cast("array<double>")
    coarse = passed(F.lit(cuts[STRIDE - 1 :: STRIDE]).cast("array<double>")) * STRIDE
    own = coarse + passed(F.slice(every, coarse + 1, STRIDE))
    own = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(own)
    dealt = rows.withColumn("range", own)
    order = (F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text"))
    # The first row of each range, by id and then text: the border rows.
    best = dealt.groupBy("range").agg(F.max("id").alias("id")).collect()
    best = sorted((r["range"], r["id"]) for r in best)
    if not best:
        return rows.withColumns({"fingerprint": F.lit(""), "next_text": F.lit(""), "next_fingerprint": F.lit("")})
    # A range's border row goes to the next higher range (ids fall), the highest one's to the lowest.
    goes = {best[k][0]: best[(k + 1) % len(best)][0] for k in range(len(best))}
    copies = dealt.withColumn("to", _tree(best, goes)).where("to is not null")
    if copies.groupBy("range").count().where("count > 1").head(1):  # several rows share a range's largest id
        first = Window.partitionBy("range").orderBy(*order)
        copies = copies.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    # Only what is left of the copies gets a fingerprint.
    both = printed(dealt).withColumn("copy", F.lit(False)).unionByName(printed(copies).select("id", "text", "fingerprint", F.col("to").alias("range"), F.lit(True).alias("copy")))
    # As many partitions as ranges, so that a task's share does not grow with the table.
    both = both.repartition(max(len(best), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "range")
    after = F.lead(F.struct("text", "fingerprint")).over(Window.partitionBy("range").orderBy("copy", *order))
    return both.withColumn("after", after).where("not copy").select("id", "text", "fingerprint", F.col("after.text").alias("next_text"), F.col("after.fingerprint").alias("next_fingerprint"))


def _tree(best: list[tuple[int, object]], goes: dict[int, int]) -> Column:
    """Where a border row is copied to; null for other rows."""
    tops = F.lit([float(i) if i is not None else float("nan") for _, i in best]).cast("array<double>")
    to = F.lit([goes[r] for r, _ in best]).cast("array<int>")
    at = F.array_position(tops, F.coalesce(F.col("id").cast("double"), F.lit(float("nan")))).cast("int")
    return F.when(at > 0, F.element_at(to, F.greatest(at, F.lit(1))))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text (see ``with_next``): the last half replaced by the start of the next document.

    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id), group_id as in ``fingerprints``.
    Likeness of exact digests is 1 for equal canonical texts and 0 otherwise; texts of equal fingerprints are compared by bytes.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(df, id_col, text_col).select("*", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = printed(rows, "edited", "edited_fingerprint")
    # Canonical texts are made again only where fingerprints are equal.
    near = lambda f, t: F.when(F.col("fingerprint") == F.col(f), canonical(F.col("text")) == canonical(F.col(t))).otherwise(False).cast("double")
    out = settled(rows.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint", "edited").alias("near_edited"), near("next_fingerprint", "next_text").alias("near_next")), "edited")
    groups, clash = group_ids(out, df, text_col)
    if clash:
        groups = _groups_by_text(df, id_col, text_col).distinct().select(F.col("id").alias("i"), F.col("fingerprint").alias("f"), "group_id")
        out = out.join(groups.groupBy("i", "f").agg(F.min("group_id").alias("group_id")), F.col("id").eqNullSafe(F.col("i")) & (F.col("fingerprint") == F.col("f")), "left").drop("i", "f")
    else:
        out = out.join(groups, "fingerprint", "left")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")
