"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated scores.

The score is the winning probability after temperature scaling on documents kept back from
training. A prediction is to be rejected when the text has no letter or the score falls below the
calibrated threshold (set for one right prediction in 500, see ``rejection_threshold``). With a single
learnt language every score is 1, and only letterless texts are rejected.

Edge cases. Null, empty or letterless text: ``und`` with score 0, rejected. Null doc_id: predicted
like any row, never learnt from. Repeated rows come back each. If nothing can be learnt (empty
table, no labels) every row is ``und``. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .subword import SubwordModel, SubwordOptions, fit, labelled_sample, scored

UNKNOWN = "und"
OPTIONS = SubwordOptions(grams=(2, 3, 4), fold=True)


def train(docs: DataFrame, learn_from: Column, opt: SubwordOptions = OPTIONS) -> SubwordModel:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang) rows for which ``learn_from`` holds."""
    labels = docs.where(learn_from).select("doc_id", F.col("lang").alias("label"))
    return fit(labelled_sample(docs, labels, opt), opt)


def predict(docs: DataFrame, model: SubwordModel, keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred, score and rejected. Only the text is read for a prediction."""
    has_letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    names = np.array([*model.labels, UNKNOWN], dtype=object)

    def finish(p: np.ndarray) -> list[pa.Array]:
        if p.shape[1] == 0:
            return [pa.array([UNKNOWN] * len(p), pa.string()), pa.array(np.zeros(len(p)))]
        return [pa.array(names[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))]

    flagged = docs.withColumn("_letters", has_letter)
    raw = scored(flagged, model, [*keep, "_letters"], finish, "lang_pred string, score double")
    out = raw.withColumn("lang_pred", F.when(F.col("_letters"), F.col("lang_pred")).otherwise(UNKNOWN))
    out = out.withColumn("score", F.when(F.col("lang_pred") == UNKNOWN, F.lit(0.0)).otherwise(F.col("score")))
    return out.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | (F.col("score") < model.threshold)).drop("_letters")
