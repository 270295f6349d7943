"""Quality score by compression: zstandard dictionaries of good and of bad text.

From labelled rows a bounded sample is drawn: the ``per_label`` rows of each label whose ids hash
lowest.  One half trains a dictionary for each label; the other half calibrates.  A text is compressed
with both dictionaries; the difference of the sizes by their sum is the main feature, beside it
stand how far the text compresses and its length.  A logistic model with a small ridge turns them into the
probability of label 1.

Training is one task on the bounded sample; its result, two dictionaries and a few numbers (under
``2 * dictionary + 1 KB`` bytes), goes with the scoring tasks, which read each whole text once and
shuffle nothing.

Null counts as empty; an empty text has its own defined score, the calibrated share of label 1.  Repeated rows are
scored alike and count once in the sample; so do ids with several texts.  An empty table gives no rows.
Without labelled rows of both kinds every score is that share (0.5 if there are none).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import per_document, texts, utf8
from ridgeline.staging import stage

LEVEL = 3


class Compressors:
    """Sizes of a text under the dictionary of each label and under none."""

    def __init__(self, dictionaries: dict[int, bytes]):
        plain = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
        self.by = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else zstandard.ZstdCompressor(**plain) for k, d in dictionaries.items()}

    def features(self, text: bytes) -> list[float]:
        good, bad = (len(self.by[k].compress(text)) for k in (1, 0))
        size = max(1, len(text))
        gap, ratio = (bad - good) / (bad + good), good / size
        return [1.0, gap, ratio, gap * ratio, ratio * ratio, np.log1p(size) / 10, np.log1p(size) * ratio / 10]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps for the ridge-penalised log likelihood, both labels weighing alike per row."""
    w = np.zeros(x.shape[1])
    pull = ridge * len(y) * np.eye(x.shape[1]) * np.r_[0.0, np.ones(x.shape[1] - 1)] / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _train(rows: list[tuple[bytes, int]], dictionary: int) -> dict:
    """Dictionaries from the first half of each label's rows, calibration on the second."""
    by = {k: [t for t, y in rows if y == k and t] for k in (0, 1)}
    share = float((len(by[1]) + 1) / (len(by[0]) + len(by[1]) + 2))
    if min(map(len, by.values())) < 20:
        return {"share": share, "weights": None, "dictionaries": {}}
    dictionaries = {}
    for k, own in by.items():
        first = own[: len(own) // 2]
        try:
            dictionaries[k] = zstandard.train_dictionary(dictionary, first, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little to train on: raw text serves as a dictionary
            dictionaries[k] = b"".join(first)[-dictionary:]
    test = Compressors(dictionaries)
    data = [(test.features(t), k) for k, own in by.items() for t in own[len(own) // 2 :]]
    x, y = np.array([f for f, _ in data]), np.array([k for _, k in data], float)
    return {"share": share, "weights": _logistic(x, y).tolist(), "dictionaries": dictionaries}


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = 1500, dictionary: int = 65_536, sample_bytes: int = 64_000_000) -> dict:
    """The model from the labelled rows of ``docs``: ``labels`` has ``doc_id`` and ``quality``.

    At most ``per_label`` whole texts of each label with at most ``sample_bytes / 2`` bytes together are used, one for each
    id (the first in order of its rows' texts); that is the bound of the one task.
    """
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    picked = [marks.where(F.col("quality") == k).orderBy(order, "doc_id").limit(per_label) for k in (0, 1)]
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # copies collapse before the shuffle
    rows = stage(rows.select("doc_id", "text", order.alias("rank"), F.length("text").alias("size"), F.col("quality").cast("int").alias("quality")), "quality-sample")
    run = Window.partitionBy("quality").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    few = rows.select("doc_id", (F.sum("size").over(run) <= sample_bytes // 2).alias("fits")).where("fits")  # per_label rows of each label
    sample = rows.join(F.broadcast(few), "doc_id", "left_semi")

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "text"])
        model = _train(list(zip(group["text"], group["quality"])), dictionary)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    sample = sample.select(F.lit(0).alias("all"), "rank", "text", "quality")
    found = sample.groupBy("all").applyInPandas(train, "model binary").collect()  # one small row
    return pickle.loads(bytes(found[0][0])) if found else {"share": 0.5, "weights": None, "dictionaries": {}}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score``: probability of label 1 for every row, from the text alone."""

    def make():
        weights = model["weights"]
        test = Compressors(model["dictionaries"]) if weights else None

        def work(text: bytes) -> tuple[float]:
            if not weights or not text:
                return (model["share"],)
            z = float(np.dot(test.features(text), weights))
            return (1 / (1 + float(np.exp(-min(max(z, -30.0), 30.0)))),)

        return work

    return per_document(texts(docs), "score double", make)
