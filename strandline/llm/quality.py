"""Operator 9: quality classification by hierarchical empirical Bayes.

A document classifier (averaged hashed n-grams, and words repeated at once, under a
calibrated softmax) gives each document's evidence. It learns from every labelled document:
groups of them, dealt by a hash of the id, are fitted side by side, and the mean of the fits is
the model (a fit is a linear function of its features, so the mean is one, too). Texts without a label
are passed over where they lie, by a map of fixed size; neighbouring groups are fitted in one task,
so that a rare label's texts, which several groups share, are sent there once. Host and path posteriors
come from grouped sums of that evidence: a host's mean is shrunk toward the global
mean and a path's toward its host's, by beta prior strengths that the method of
moments takes from the spread of all hosts' means, so sparse sites stay near
their prior. A document does not count in its own site's sums. Log-odds add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from . import _ngrams as ng
from ._work import settled
from ._words import text_slices

#: Labelled documents that one fit learns from, about, and how many of each label it has, about, at the least.
GROUP, LEAST = 1500, 400
#: Groups that one task fits, one after the other.
TOGETHER = 2
#: Bits of the map of labelled ids, and of one row of it.
MAP, MAP_ROW = 1 << 26, 1 << 15
#: Labels of this many documents or more lend every fifth to the calibration.
CALIBRATES = 10
BUCKETS = 1 << 14
#: What one word that equals the word before counts, in n-grams: about as many as have most of their bytes in a word.
REPEAT = 8
#: Share of good calibration documents that may be rejected by their final score, and the score above which none is.
REJECT_RATE, REJECT_BELOW = 0.002, 0.5


def _again(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return REPEAT * ng.repeats(data, offsets)


@dataclass
class QualityModel:
    """The classifier, and a table (id) of the good documents that it was not fitted on: their final scores set the limit of rejection. Without them nothing is rejected."""

    model: ng.Averaged | None
    calibration: DataFrame | None = None


#: Fractions of a weight are kept in steps of 2 to the power of minus this, so that their sums do not follow the order of the groups.
_FIXED = 36


def _fit_group(rows: pa.Table) -> np.ndarray | None:
    """The weights of one group's fit, in fixed point; the bias comes last. Without both labels there are none."""
    rows = rows.sort_by([("draw", "ascending"), ("text", "ascending")])
    labels, features = rows.column("y").to_pylist(), []
    if len(set(labels)) < 2:
        return None
    for _, _, data, offsets in text_slices(rows.column("text")):
        for (ix, c), again in zip(ng.counts(data, offsets, BUCKETS), _again(data, offsets).tolist()):
            features.append((np.append(ix, BUCKETS).astype(np.int16), np.append(c, again).astype(np.int32)) if again else (ix.astype(np.int16), c.astype(np.int32)))
    m = ng.fit(features, labels, BUCKETS + 1)
    value = np.append(m.table[:, 1].astype(float) - m.table[:, 0], m.bias[1] - m.bias[0])
    return np.round(value * (1 << _FIXED)).astype(np.int64)


def _fit_groups(rows: pa.Table, groups: int, together: int, times: dict[int, int]) -> pa.Table:
    """(place, value, fits): the sums of the weights of ``together`` neighbouring groups' fits, and their number.

    A row belongs to its ``base`` and to the groups after it (the first ones after the last), ``times`` of its label in all.
    """
    base, y = rows.column("base").to_numpy(), rows.column("y").to_numpy()
    turns, first = np.where(y == 1, times[1], times[0]), rows.column("piece")[0].as_py() * together
    found = [_fit_group(rows.filter(pa.array((g - base) % groups < turns))) for g in range(first, min(groups, first + together))]
    found = [x for x in found if x is not None]
    value = sum(found) if found else np.zeros(0, np.int64)
    return pa.table({"place": pa.array(np.arange(len(value)), pa.int32()), "value": pa.array(value), "fits": pa.array(np.full(len(value), len(found)), pa.int64())})


def _perhaps_labelled(texts: DataFrame, marked: DataFrame) -> DataFrame:
    """All rows of ``texts`` whose id is in ``marked``, and of the others those whose hash is that of such an id.

    The map has MAP bits at most, however many ids there are: where it is full, it spares nothing, and the join that follows decides as before.
    """
    if texts.schema["id"].dataType != marked.schema["id"].dataType:  # their hashes would differ
        return texts
    bit = F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(MAP))
    row, place = F.shiftright(bit, 15).alias("row"), F.pmod(bit, F.lit(MAP_ROW))
    bits = marked.groupBy(row).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return texts.select("*", row).join(F.broadcast(bits), "row").where(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*texts.columns)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", group: int = GROUP) -> QualityModel:
    """Fit on all labelled documents (label 1 good, 0 poor; others and nulls are passed over), in groups of about ``group``.

    A rare label's documents go into several groups, so that each group tells both apart. What reaches the
    driver are the sums of the fits' weights, whose number is fixed. The texts are joined by a merge whatever the size of
    the labels, as a plan that changes with it says nothing about larger tables.
    """
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    marked = settled(marked, "labelled")
    n = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    if len(n) < 2:
        return QualityModel(None)
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = _perhaps_labelled(texts, marked)
    groups, together = max(1, round(sum(n.values()) / group)), TOGETHER
    by_label = lambda of: F.when(F.col("y") == 1, of(n[1])).otherwise(of(n[0]))
    fifth = F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(5)) == 0
    calibrates = by_label(lambda k: F.lit(k >= CALIBRATES))
    times = {y: min(groups, -(-groups * LEAST // k)) for y, k in n.items()}
    rows = texts.join(marked.hint("merge"), "id").where(~(fifth & calibrates)).withColumn("draw", F.xxhash64(F.lit(11), "id")).withColumn("base", F.pmod("draw", F.lit(groups)))
    turns = F.sequence(F.lit(0), F.when(F.col("y") == 1, times[1]).otherwise(times[0]) - 1)
    pieces = F.array_distinct(F.transform(turns, lambda turn: F.floor(F.pmod(F.col("base") + turn, F.lit(groups)) / together)))
    dealt = rows.select("y", "draw", "base", "text", F.explode(pieces).alias("piece"))
    sums = dealt.groupBy("piece").applyInArrow(lambda t: _fit_groups(t, groups, together, times), "place int, value long, fits long")
    sums = sums.groupBy("place").agg((F.sum("value") / F.sum("fits")).alias("value")).toPandas().sort_values("place")  # as many rows as the model has weights
    if not len(sums):
        return QualityModel(None)
    value = sums["value"].to_numpy(float) / (1 << _FIXED)
    both = np.zeros((len(value), 2))
    both[:, 1] = value
    model = ng.Averaged([0, 1], both[:-1].astype(np.float32), both[-1])
    margins = texts.where(fifth).select("id", _scores(model, lambda p: np.log(p[:, 1]) - np.log(p[:, 0]))("text").alias("margin"))
    apart = settled(margins.join(marked.hint("merge"), "id").where(calibrates).select("id", "y", "margin"), "calibration")
    steps = np.geomspace(0.2, 8, 30)
    wrong = F.when(F.col("y") == 1, -F.col("margin")).otherwise(F.col("margin"))
    loss = [F.round(F.avg(F.when(F.col("y") == k, F.least(F.log1p(F.exp(F.least(wrong / float(t), F.lit(700.0)))), F.lit(20.7)))), 9) for t in steps for k in (0, 1)]
    found = [x or 0.0 for x in apart.agg(*loss).first()]
    model.temperature = float(steps[int(np.argmin(np.array(found).reshape(-1, 2).sum(axis=1)))]) if any(found) else 1.0
    return QualityModel(model, apart.where("y = 1").select("id").distinct())


def _scores(model: ng.Averaged, of: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column | str], Column]:
    """A function of a text column: ``of`` of the model's probabilities of (poor, good), 0.5 each for an empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            out = [np.zeros(0)]
            for _, _, data, offsets in text_slices(pa.Array.from_pandas(text, type=pa.string())):
                total, number = ng.sums(data, offsets, model.table[:-1])
                again = _again(data, offsets)
                p = model.probabilities(total + again[:, None] * model.table[-1], number + again)
                out.append(of(np.where((np.diff(offsets) == 0)[:, None], 0.5, np.maximum(p, 1e-300))))
            yield pd.Series(np.concatenate(out))

    return F.pandas_udf(run, "double")


def evidence(fitted: QualityModel, text_col: str = "text") -> Column:
    """The classifier's probability that a whole text is good; 0.5 for null and empty texts, or without a model."""
    model = fitted.model
    if model is None:
        return F.lit(0.5)
    return _scores(model, lambda p: p[:, 1])(F.coalesce(F.col(text_col), F.lit("")))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _strength(groups: DataFrame, n: str, k: str) -> float:
    """Prior strength m of beta-distributed group means, by moments: var(means) = mu (1 - mu) / (m + 1), noise taken off."""
    r = groups.where(F.col(n) >= 2).agg(
        F.count("*").alias("g"), F.sum(k).alias("k"), F.sum(n).alias("n"), F.avg(F.col(k) / F.col(n)).alias("m1"), F.avg(F.pow(F.col(k) / F.col(n), 2)).alias("m2"), F.avg(1 / F.col(n)).alias("inv")
    ).first()
    if not r["g"] or r["g"] < 2:
        return 100.0
    mu = min(max(r["k"] / r["n"], 1e-6), 1 - 1e-6)
    spread = max(r["m2"] - r["m1"] ** 2 - mu * (1 - mu) * r["inv"], 1e-9)
    return float(min(max(mu * (1 - mu) / spread - 1, 1.0), 1e4))


def hierarchical_quality(df: DataFrame, fitted: QualityModel, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """(id_col, evidence, host_posterior, path_posterior, score, rejected) of every row.

    ``host`` and ``path`` are column names (path: within its host); nulls form a site of their own. An empty or
    null text has no evidence of its own (0.5), so its site decides. Repeated rows each count. Only the named columns are read.
    The limit of rejection is the score that ``REJECT_RATE`` of the calibration documents fall below, ``REJECT_BELOW`` at most.
    """
    rows = settled(df.select(F.col(id_col).alias("id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), evidence(fitted, text_col).alias("p")), "evidence")
    paths = settled(rows.groupBy("host", "path").agg(F.count("*").alias("np"), F.sum("p").alias("kp")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("np").alias("nh"), F.sum("kp").alias("kh"))
    whole = paths.agg(F.sum("np"), F.sum("kp")).first()
    mu = float(whole[1] / whole[0]) if whole[0] else 0.5
    m_host, m_path = _strength(hosts, "nh", "kh"), _strength(paths, "np", "kp")
    sites = paths.withColumnRenamed("host", "h1").join(hosts.withColumnRenamed("host", "h2"), F.col("h1").eqNullSafe(F.col("h2"))).select("h1", F.col("path").alias("p1"), "np", "kp", "nh", "kh")
    all_ = rows.join(sites, F.col("host").eqNullSafe(F.col("h1")) & F.col("path").eqNullSafe(F.col("p1")))
    at_host = (F.col("kh") - F.col("p") + m_host * mu) / (F.col("nh") - 1 + m_host)
    at_path = (F.col("kp") - F.col("p") + m_path * F.col("host_posterior")) / (F.col("np") - 1 + m_path)
    score = 1 / (1 + F.exp(-(_logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.lit(mu)))))
    scored = all_.withColumn("host_posterior", at_host).withColumn("path_posterior", at_path).withColumn("score", score).select("id", "p", "host_posterior", "path_posterior", "score")
    limit = 0.0
    if fitted.model is not None and fitted.calibration is not None:
        scored = settled(scored, "scores")
        own = scored.join(fitted.calibration, "id", "left_semi").select(F.lit("good").alias("of"), "score")
        found = quantiles(own, "of", "score", {"q": REJECT_RATE}).first()
        limit = min(REJECT_BELOW, found["q"]) if found else 0.0
    return scored.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") < limit).alias("rejected"))


def keep_good(df: DataFrame, fitted: QualityModel, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` whose id is not rejected (an id with several rows stays if one of them does)."""
    kept = hierarchical_quality(df, fitted, id_col, **options).where("not rejected").select(F.col(id_col).alias("__kept")).distinct()
    return df.join(kept.hint("merge"), F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")
