"""Quality classifier: learned hashed word and character n-gram vectors averaged per document,
softmax output, trained by stochastic gradient descent in numpy.

Case, punctuation and repetition carry quality: letters are not folded, and every word has one
more feature that says whether it repeats the word before it.

Edge cases. Null or empty text: the score of an empty average (what the bias gives). Without
labelled rows every score is 0.5; with a single label every score leans to it. Null doc_id: scored,
never learnt from. Several labels for one doc_id: the smallest counts. Repeated rows come back each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .subword import SubwordModel, SubwordOptions, fit, labelled_sample, scored

OPTIONS = SubwordOptions(grams=(2, 3, 4), fold=False, repeats=True)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, opt: SubwordOptions = OPTIONS) -> SubwordModel:
    """Fit on a bounded sample: ``labels`` (doc_id, quality) where ``learn_from`` holds, ``docs`` (doc_id, text)."""
    rows = labels.where(learn_from).select("doc_id", F.col("quality").alias("label"))
    return fit(labelled_sample(docs, rows, opt), opt)


def score(docs: DataFrame, model: SubwordModel, keep: list[str], good: str = "1", cut: float = 0.3) -> DataFrame:
    """``keep`` columns plus score (probability of label ``good``) and predicted (1 from ``cut`` on)."""

    def finish(p: np.ndarray) -> list[pa.Array]:
        if p.shape[1] == 0:
            s = np.full(len(p), 0.5)
        elif good in model.labels:
            s = p[:, model.labels.index(good)]
        else:
            s = np.zeros(len(p))
        return [pa.array(s), pa.array((s >= cut).astype(np.int32))]

    return scored(docs, model, keep, finish, "score double, predicted int")
