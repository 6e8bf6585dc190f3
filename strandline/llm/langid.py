"""Operator 7: language identification.

Averaged hashed subword embeddings (byte 2- to 4-grams of the folded text) with a
linear softmax, trained by stochastic gradient descent in numpy on every row with a
language: groups of rows, dealt by a hash, are fitted side by side, and the mean of the
fits is the model (a fit is a linear function of its features, so the mean is one, too). A
temperature fitted on all rows kept outside the training calibrates the scores, and a text
is rejected when its calibrated score is too low or it has no letter at all. A whole text is
scored by sums over one small table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from . import _ngrams as ng
from ._work import settled
from ._words import text_slices

#: Labelled rows that one fit learns from, about, and its steps; few rows are gone over so many times at most.
GROUP, STEPS, EPOCHS = 3000, 12_000, 8
#: Rows of each label in a group, about: so large a share of its even part of the group, and so many at the least. Rarer labels' rows go into several groups.
RARE_SHARE, LEAST = 5, 5
#: Labels of so many rows or more lend every fifth to the calibration.
CALIBRATES = 10
BUCKETS = 1 << 14
#: Share of rightly labelled calibration rows that may be rejected, and the score above which none is.
REJECT_RATE, REJECT_BELOW = 0.001, 0.5
UNKNOWN = "und"


def held(rows: list[tuple]) -> list[bool]:
    """Which rows calibrate: every fifth of a label, so that one of few rows is learnt all the same."""
    seen: dict[object, int] = {}
    out = []
    for y, *_ in rows:
        seen[y] = seen.get(y, 0) + 1
        out.append(seen[y] % 5 == 0)
    return out


@dataclass
class LanguageModel:
    model: ng.Averaged | None
    reject_below: float


#: Fractions of a weight are kept in steps of 2 to the power of minus this, so that their sums do not follow the order of the groups.
_FIXED = 36


def _fit_group(rows: pa.Table) -> pa.Table:
    """(y, place, value, fits): the weights of one group's fit in fixed point, of each label around the mean of all; the bias comes last."""
    rows = rows.sort_by([("draw", "ascending"), ("text", "ascending")])
    features = [(ix.astype(np.int16), c.astype(np.int32)) for _, _, data, offsets in text_slices(rows.column("text")) for ix, c in ng.counts(data, offsets, BUCKETS)]
    m = ng.fit(features, rows.column("y").to_pylist(), BUCKETS, epochs=min(EPOCHS, max(1, round(STEPS / len(features)))))
    value = np.vstack([m.table.astype(float), m.bias])
    value = np.round((value - value.mean(axis=1, keepdims=True)) * (1 << _FIXED)).astype(np.int64)
    places, kinds = value.shape
    return pa.table({"y": pa.array(np.repeat(np.array(m.classes, np.int32), places)), "place": pa.array(np.tile(np.arange(places, dtype=np.int32), kinds)), "value": pa.array(value.T.ravel()), "fits": pa.array(np.ones(places * kinds, np.int64))})


def _weights_of(rows: pa.Table) -> pa.Table:
    """(y, weights) of one label: its mean weights by place, packed doubles."""
    rows = rows.sort_by("place")
    return pa.table({"y": rows.column("y").slice(0, 1), "weights": pa.array([rows.column("value").to_numpy().astype("<f8").tobytes()], pa.binary())})


def _calibrated(model: ng.Averaged, rows: DataFrame) -> float:
    """Set the temperature that makes rows (y, text) outside the training set likeliest, each label weighing the same; return the limit of rejection."""
    steps = np.geomspace(0.2, 8, 30)
    most = 1 << 20

    def logits(batches):
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                z = model.logits(*ng.sums(data, offsets, model.table))
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(first, last - first), pa.array(list(z), pa.list_(pa.float64()))], ["y", "z"])

    def pieces(batches):
        """(labels, logits) of about a million values at a time."""
        for batch in batches:
            for at in range(0, len(batch), size := max(1, most // len(model.classes))):
                x = batch.slice(at, size)
                yield x.column("y").to_numpy(), x.column("z").flatten().to_numpy().reshape(len(x), -1)

    def losses(batches):
        for y, z in pieces(batches):
            kinds, which = np.unique(y, return_inverse=True)
            for k, t in enumerate(steps.tolist()):
                s = z / t - (z / t).max(axis=1, keepdims=True)
                loss = np.minimum(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y], 20.7)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.full(len(kinds), k, np.int32)), pa.array(np.bincount(which, loss)), pa.array(np.bincount(which))], ["y", "step", "loss", "n"])

    def scores(batches):
        for y, z in pieces(batches):
            s = z[z.argmax(axis=1) == y] / model.temperature
            yield pa.RecordBatch.from_arrays([pa.array(1 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) if len(s) else pa.array([], pa.float64())], ["score"])

    apart = settled(rows.select("y", "text").mapInArrow(logits, "y int, z array<double>"), "calibration")
    by_label = apart.mapInArrow(losses, "y int, step int, loss double, n long").groupBy("step", "y").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    found = by_label.groupBy("step").agg(F.round(F.avg("loss"), 9).alias("loss")).orderBy("loss", "step").first()
    if found is None:
        return REJECT_BELOW
    model.temperature = float(steps[found["step"]])
    limit = quantiles(apart.mapInArrow(scores, "score double").select(F.lit("right").alias("of"), "score"), "of", "score", {"q": REJECT_RATE}).first()
    return min(REJECT_BELOW, limit["q"]) if limit else REJECT_BELOW


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", group: int = GROUP) -> LanguageModel:
    """Learn from all rows that have text with a letter and a language, in groups of about ``group``; without any, the model knows none.

    All labels are learnt; a rare one's rows go into several groups, so that each group tells it from the others. Rows are dealt by a
    hash of text and, where ``df`` has ``id_col``, id, so that copies of one text do not meet in one group. What reaches the driver is the
    table of weights, whose size is fixed for each label.
    """
    draw = lambda seed: F.xxhash64(F.lit(seed), F.col(text_col), *[F.col(c) for c in (id_col,) if c in df.columns])
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw(11).alias("draw"), (F.pmod(draw(12), F.lit(5)) == 0).alias("fifth"))
    kinds = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", (F.row_number().over(Window.orderBy("lang")) - 1).alias("y"))
    kinds = settled(kinds, "languages")
    labels = kinds.orderBy("y").collect()
    if not labels:
        return LanguageModel(None, 0.0)
    groups, least = max(1, round(sum(r["n"] for r in labels) / group)), max(LEAST, group // (RARE_SHARE * len(labels)))
    rows = known.join(F.broadcast(kinds), "lang").withColumn("held", F.col("fifth") & (F.col("n") >= CALIBRATES)).withColumn("base", F.pmod("draw", F.lit(groups)))
    turns = F.sequence(F.lit(0), F.least(F.lit(groups), F.ceil(F.lit(groups * least) / F.col("n"))).cast("int") - 1)
    dealt = rows.where("not held").select("y", "draw", "text", F.explode(F.transform(turns, lambda turn: F.pmod(F.col("base") + turn, F.lit(groups)))).alias("piece"))
    sums = dealt.groupBy("piece").applyInArrow(_fit_group, "y int, place int, value long, fits long")
    sums = sums.groupBy("y", "place").agg((F.sum("value") / F.sum("fits")).alias("value"))
    table, bias = np.zeros((BUCKETS, len(labels)), np.float32), np.full(len(labels), -np.inf)  # a label that was not fitted is never predicted
    for r in sums.groupBy("y").applyInArrow(_weights_of, "y int, weights binary").toLocalIterator():
        value = np.frombuffer(r["weights"], "<f8") / (1 << _FIXED)
        table[:, r["y"]], bias[r["y"]] = value[:-1], value[-1]
    model = ng.Averaged([r["lang"] for r in labels], table, bias)
    return LanguageModel(model, _calibrated(model, rows.where("held")))


def predict(df: DataFrame, fitted: LanguageModel, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add lang_pred, score and rejected (names after ``prefix``) to every row.

    A null text, or one without a letter, is ``und`` with score 0 and rejected, as is every
    text when the model knows no language. Repeated rows stay; columns of ``df`` stay, but for
    ones of these three names, which are replaced.
    """
    model, limit = fitted.model, fitted.reject_below
    names = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    kept = [c for c in df.columns if c not in names]

    lettered: Column = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    if model is None:
        found = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    else:
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for text, lettered in batches:
                langs, scores = [], []
                for _, _, data, offsets in text_slices(pa.Array.from_pandas(text, type=pa.string())):
                    p = model.probabilities(*ng.sums(data, offsets, model.table))
                    best = p.argmax(axis=1)
                    langs += [model.classes[i] for i in best.tolist()]
                    scores += p[np.arange(len(best)), best].tolist()
                out = pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})
                out.loc[~lettered.to_numpy(bool), ["lang", "score"]] = [UNKNOWN, 0.0]
                yield out

        found = F.pandas_udf(run, "lang string, score double")(F.col(text_col), lettered)
    out = df.select(*kept, found.alias("__found"))
    return out.select(*kept, F.col("__found.lang").alias(names[0]), F.col("__found.score").alias(names[1]), ((F.col("__found.lang") == UNKNOWN) | (F.col("__found.score") < limit)).alias(names[2]))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the row belongs to the quarter that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_known(df: DataFrame, fitted: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the model does not reject, with the columns of ``df``."""
    return predict(df, fitted, text_col, "__").where("not __rejected").select(*df.columns)
