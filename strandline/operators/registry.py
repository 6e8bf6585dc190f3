"""Experiment runs: identities, objectives, comparison and ranking."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bound(value: Column, use) -> Column:
    """``use`` of a value that it names several times, computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(c: Column) -> Column:
    """(sign, digits, n, point) of a number's text: its digits without zeros at either end, and how many stand before the point."""
    t = c.cast("string")
    part = F.regexp_extract(t, "[.]([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(t, "E([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    read = F.struct(F.regexp_extract(t, "^-?", 0).alias("sign"), part.alias("part"), power.alias("power"), F.regexp_replace(F.concat(F.regexp_extract(t, "^-?([0-9]+)", 1), part), "^0+", "").alias("long"))

    def split(x: Column) -> Column:
        digits = F.regexp_replace(x["long"], "0+$", "")
        return F.struct(x["sign"].alias("sign"), digits.alias("digits"), F.length(digits).alias("n"), (x["power"] - F.length(x["part"]) + F.length(x["long"])).alias("point"))

    return _bound(read, split)


def _fixed(x: Column, end: str) -> Column:
    """Plain notation; ``end`` follows a whole number."""
    digits, n, point = x["digits"], x["n"], x["point"]
    return (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= n, F.concat(F.rpad(digits, point, F.lit("0")), F.lit(end)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    )


def _power(x: Column, width: int) -> Column:
    """Notation with an exponent of at least ``width`` digits."""
    tail = F.when(x["n"] > 1, F.concat(F.lit("."), F.substring(x["digits"], F.lit(2), x["n"]))).otherwise("")
    size = F.abs(x["point"] - 1).cast("string")
    return F.concat(F.substring(x["digits"], 1, 1), tail, F.when(x["point"] > 0, "e+").otherwise("e-"), F.lpad(size, F.greatest(F.lit(width), F.length(size)), F.lit("0")))


def canonical_number(c: Column) -> Column:
    """All digits of a number without trailing zeros: plain from 1e-6 up to below 1e21, else as d.ddde+x; -0 is 0. Non-finite numbers are null."""

    def shown(x: Column) -> Column:
        return F.when(x["n"] == 0, "0").otherwise(F.concat(x["sign"], F.when(x["point"].between(-5, 21), _fixed(x, "")).otherwise(_power(x, 1))))

    return F.when(c.cast("string").rlike("^-?[0-9]"), _bound(_digits(c), shown))


def json_float(c: Column) -> Column:
    """A finite double as canonical JSON writes it: 0.0 for either zero, plain from 1e-4 up to below 1e16, else as d.ddde+xx. Others fail. The digits are those that the JVM writes."""

    def shown(x: Column) -> Column:
        return F.when(x["n"] == 0, "0.0").otherwise(F.concat(x["sign"], F.when(x["point"].between(-3, 16), _fixed(x, ".0")).otherwise(_power(x, 2))))

    bad = F.raise_error(F.lit("canonical JSON does not support non-finite float")).cast("string")
    return F.when(c.isNull(), None).when(F.isnan(c) | (F.abs(c) == float("inf")), bad).otherwise(_bound(_digits(c), shown))


def json_string(c: Column) -> Column:
    """A string in JSON's quotes, ASCII alone: other characters as \\uXXXX, those beyond the basic plane as two."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}

    def escaped(ch: Column) -> Column:
        def of(n: Column) -> Column:
            out = F.when((n >= 32) & (n < 127) & (n != 34) & (n != 92), ch)
            for code, text in short.items():
                out = out.when(n == code, F.lit(text))
            over = n - 0x10000
            return out.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(F.floor(over / 1024) + 0xD800), unit(over % 1024 + 0xDC00)))

        return _bound(F.ascii(ch), of)

    plain = ~c.rlike(r'[^\x20-\x7e]|["\\]')
    return F.concat(F.lit('"'), F.when(plain | (c == ""), c).otherwise(F.array_join(F.transform(F.split(c, ""), escaped), "")), F.lit('"'))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """A value of any nesting as canonical JSON: keys of structs and maps in order, no spaces, decimals as text without trailing zeros, null as null.

    Map keys are text; dates and times are text in ISO form. A double that is not finite fails.
    """

    def text(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            parts = [F.concat(json_string(F.lit(f.name)), F.lit(":"), whole(c[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
            return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        if isinstance(kind, T.ArrayType):
            return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: whole(x, kind.elementType)), ","), F.lit("]"))
        if isinstance(kind, T.MapType):
            entry = lambda k: F.concat(json_string(k.cast("string")), F.lit(":"), whole(c[k], kind.valueType))
            return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c)), entry), ","), F.lit("}"))
        if isinstance(kind, T.DecimalType):
            return F.concat(F.lit('"'), canonical_number(c), F.lit('"'))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return json_float(c)
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            return c.cast("string")
        return json_string(c.cast("string"))

    def whole(c: Column, kind: T.DataType) -> Column:
        return F.coalesce(F.when(c.isNotNull(), text(c, kind)), F.lit("null"))

    return whole(c, kind)


def spec_hash(c: Column, kind: T.DataType) -> Column:
    """SHA-256 of a spec's canonical JSON and a line feed."""
    return F.sha2(F.concat(canonical_json(c, kind), F.lit("\n")).cast("binary"), 256)


def digest(*columns: str) -> Column:
    """SHA-256 of a JSON object with sorted keys and nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def run_ids(runs: DataFrame, identity: tuple[str, ...], method: tuple[str, ...]) -> DataFrame:
    return runs.withColumn("run_id", F.concat(F.lit("run-"), F.substring(digest(*identity), 1, 20))).withColumn("compatibility_key", digest(*method))


def robust_sharpe(costs: DataFrame, windows: DataFrame) -> DataFrame:
    """min(Sharpe at 5 bps, at 10 bps) less the population deviation of window Sharpes; a missing cost is the headline (2 bps)."""
    p = costs.groupBy("run_id").pivot("cost_bps", [2.0, 5.0, 10.0]).agg(F.first("sharpe")).toDF("run_id", "s2", "s5", "s10")
    w = windows.groupBy("run_id").agg(F.stddev_pop("sharpe").alias("sd"))
    return p.join(w, "run_id", "left").select("run_id", (F.least(F.coalesce("s5", "s2"), F.coalesce("s10", "s2")) - F.coalesce("sd", F.lit(0.0))).alias("robust_sharpe"))


def objective_status(runs: DataFrame, floor: float, cap: float) -> DataFrame:
    """failed for non-finite metrics, blocked with joined reasons, else complete."""
    ms = ("robust_sharpe", "sharpe", "max_drawdown", "turnover")
    bad = F.array_contains(F.array(*[F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")) | F.col(m).isNull(), F.lit(True)) for m in ms]), True)
    why = F.concat_ws("; ", F.when(F.col("max_drawdown") < floor, F.lit("drawdown below floor")), F.when(F.col("turnover") > cap, F.lit("turnover above cap")))
    return runs.withColumn("reason", why).withColumn("status", F.when(bad, "failed").when(F.col("reason") != "", "blocked").otherwise("complete"))


def differences(runs: DataFrame, fields: tuple[str, ...], by: str) -> DataFrame:
    """(by, field, values) of fields with several values; sets hold one value each."""
    x = runs.select(by, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])))
    return x.groupBy(by, "field").agg(F.sort_array(F.collect_set("value")).alias("values")).where("size(values) > 1").select(by, "field", F.array_join("values", ",").alias("values"))


ORDER = (("robust_sharpe", False), ("sharpe", False), ("max_drawdown", False), ("turnover", True), ("run_id", True))


def ranking(runs: DataFrame, by: str, allow_dirty: bool = False) -> DataFrame:
    """Ranks of eligible runs within ``by``; groups of several compatibility keys have none. Only the eligible rows are sorted."""
    ok = (F.col("status") == "complete") & F.col("robust_sharpe").isNotNull() & (F.col("tracking_status") != "degraded") & (F.lit(allow_dirty) | ~F.col("git_dirty"))
    keys = runs.groupBy(by).agg(F.count_distinct("compatibility_key").alias("kinds"))
    x = runs.where(ok).join(keys.where("kinds = 1").select(by), by, "left_semi")
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in ORDER]
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def leaderboard(runs: DataFrame, ranked: DataFrame, by: str) -> DataFrame:
    """Ranked runs, then the excluded ones with a dash."""
    out = ranked.select(by, "run_id", F.col("rank").cast("string").alias("place"), "rank")
    rest = runs.join(ranked, "run_id", "left_anti").select(by, "run_id", F.lit("—").alias("place"), F.lit(None).cast("int").alias("rank"))
    return out.unionByName(rest).orderBy(by, F.col("rank").asc_nulls_last(), "run_id").drop("rank")


def search_grid(low: float, high: float, steps: int, minimums: DataFrame, cadences: DataFrame) -> DataFrame:
    """Penalties on a log grid, by minimum training and cadence: parameters' size, not the data's."""
    grid = minimums.sparkSession.range(steps).select((F.lit(low) * F.pow(F.lit(high / low), F.col("id") / (steps - 1))).alias("alpha"))
    return grid.crossJoin(minimums).crossJoin(cadences)


def trial_seed(seed: Column, trial: Column) -> Column:
    """SHA-256 of "seed:trial", modulo 2^32."""
    return F.conv(F.right(F.sha2(F.concat_ws(":", seed.cast("string"), trial.cast("string")).cast("binary"), 256), F.lit(8)), 16, 10).cast("long")


def study_summary(trials: DataFrame) -> DataFrame:
    return trials.groupBy("study").agg(F.count("*").alias("trials"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.max(F.when(F.col("status") == "complete", F.col("value"))).alias("best_value"), F.max_by(F.when(F.col("status") == "complete", F.col("run_id")), F.when(F.col("status") == "complete", F.struct("value", "run_id"))).alias("best_run"))


def merge_plan(stored: DataFrame, new: DataFrame) -> DataFrame:
    """new, same or conflict of each offered run, by its content's hash."""
    x = new.withColumnRenamed("content", "n").join(stored.withColumnRenamed("content", "s"), "run_id", "left")
    return x.select("run_id", F.when(F.col("s").isNull(), "new").when(F.col("s") == F.col("n"), "same").otherwise("conflict").alias("action"))


def context_hash(context: str) -> Column:
    return F.sha2(F.col(context).cast("binary"), 256)


def context_mismatches(runs: DataFrame, stored: DataFrame, by: str, context: str) -> DataFrame:
    """Runs that must be rejected: those of which the context's hash is not the one stored for their ``by`` (reason changed), or for which none is stored (unknown)."""
    x = runs.join(stored.select(by, "context_hash"), by, "left").withColumn("reason", F.when(F.col("context_hash").isNull(), "unknown").when(~F.col("context_hash").eqNullSafe(context_hash(context)), "changed"))
    return x.where("reason is not null").drop("context_hash")


def tracking_update(runs: DataFrame, updates: DataFrame) -> DataFrame:
    u = updates.select("run_id", F.col("tracking_status").alias("ts"), F.col("tracking_id").alias("ti"))
    return runs.join(u, "run_id", "left").select("run_id", F.coalesce("ts", "tracking_status").alias("tracking_status"), F.coalesce("ti", "tracking_id").alias("tracking_id"))


def flat_params(df: DataFrame, params: str, longest: int = 250) -> DataFrame:
    """Parameter maps as text; longer values than ``longest`` become a hash."""
    return df.withColumn(params, F.transform_values(params, lambda k, v: F.when(F.length(v) > longest, F.concat(F.lit("sha256:"), F.sha2(v.cast("binary"), 256))).otherwise(v)))


# Media types by suffix; any other file is bytes.
MEDIA = {"parquet": "application/vnd.apache.parquet", "json": "application/json", "md": "text/markdown", "csv": "text/csv", "txt": "text/plain", "toml": "application/toml"}
#: Bytes that a task holds of a file, and schemes of stores that tasks can stream from themselves.
PIECE, STREAMED = 4 << 20, ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def artifact_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(relative_path, sha256, size, media_type) of every file below ``folder``, whatever its size; hidden and empty files are passed over, as by all of Spark's readers.

    Spark lists the files, without their contents, and deals them out by size; each is hashed by one task in pieces of ``PIECE`` bytes. From
    stores that tasks cannot stream from (other schemes than ``STREAMED``) files are read whole, 2 GB each at most.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            hashes = []
            for path in batch.column("path").to_pylist():
                uri = quote(path.replace("s3a://", "s3://", 1), safe=":/@")
                store, at = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith("file:") else fs.FileSystem.from_uri(uri)
                h = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while piece := stream.read(PIECE):
                        h.update(piece)
                hashes.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())], ["path", "length", "sha256"])

    if (root.getScheme() or "file") in STREAMED:
        listed = found.select("path", "length")
        # By ranges of size and name: a task gets files of like size.
        rows = listed.repartitionByRange(max(1, min(listed.count(), 2 * spark.sparkContext.defaultParallelism)), "length", "path").mapInArrow(run, "path string, length long, sha256 string")
    else:
        rows = found.select("path", "length", F.sha2("content", 256).alias("sha256"))
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "^/+", "/")
    name = F.expr(f"substring(__p, {len(root.getPath().rstrip('/')) + 2})")
    kinds = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    suffix = F.lower(F.regexp_extract("relative_path", "[.]([A-Za-z0-9]+)$", 1))
    out = rows.withColumn("__p", inside).withColumn("relative_path", name)
    return out.select("relative_path", "sha256", F.col("length").alias("size"), F.coalesce(F.try_element_at(kinds, suffix), F.lit("application/octet-stream")).alias("media_type"))


# What marks a key as secret.
MARKERS = ("secret", "password", "token", "api_key", "access_key", "database_url", "dsn")
HIDDEN = "[REDACTED]"


def _secret(name: str) -> bool:
    return any(m in name.lower() for m in MARKERS)


def redacted(c: Column, kind: T.DataType) -> Column:
    """A column of type ``kind`` in which every field or map key with a marker is "[REDACTED]", in structs, maps and arrays of any depth. Secret values that are no text become null."""
    if isinstance(kind, T.StructType):
        fields = [(F.lit(HIDDEN) if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType)) if _secret(f.name) else redacted(c[f.name], f.dataType) for f in kind]
        return F.when(c.isNotNull(), F.struct(*[x.alias(f.name) for x, f in zip(fields, kind)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redacted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        mask = F.lit(HIDDEN) if isinstance(kind.valueType, T.StringType) else F.lit(None).cast(kind.valueType)
        return F.transform_values(c, lambda k, v: F.when(F.lower(k.cast("string")).rlike("|".join(MARKERS)), mask).otherwise(redacted(v, kind.valueType)))
    return c


def redact(df: DataFrame, props: str) -> DataFrame:
    """``df`` with its typed column ``props`` redacted (see ``redacted``)."""
    return df.withColumn(props, redacted(F.col(props), df.schema[props].dataType))


def _masked(x: object) -> object:
    if isinstance(x, dict):
        return {k: HIDDEN if _secret(k) else _masked(v) for k, v in x.items()}
    return [_masked(v) for v in x] if isinstance(x, list) else x


def redact_json(df: DataFrame, payload: str) -> DataFrame:
    """JSON text in which the values of secret keys are "[REDACTED]", at any depth; order and spacing are those of plain compact JSON. What is not JSON is not shown at all."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return json.dumps(_masked(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
            except (ValueError, RecursionError):
                return HIDDEN

        for batch in batches:
            yield batch.map(one, na_action=None).where(batch.notna(), None)

    return df.withColumn(payload, F.pandas_udf(run, "string")(F.col(payload)))
