"""A quality classifier by compression: which of two dictionaries, of good and of bad text, makes a text smaller."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import keep_rows, map_texts

#: Characters of a block. Blocks are compressed for themselves, so a long text cannot become its own dictionary.
BLOCK = 200
#: Labelled documents of each class that a model is fitted on, and blocks of text of each class, at most.
FIT_DOCUMENTS, FIT_BLOCKS = 3000, 4000
DICTIONARY = 112_640
LEVEL = 3
#: Of the fitting documents, this share calibrates the score; the dictionaries are built from the others.
CALIBRATE = 0.4
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and a logistic curve over the size difference, or a constant score where there is no choice."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    constant: float | None = None


class Sizes:
    """Compressed sizes of a text's blocks under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.pair = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False,
                write_dict_id=False,
            )
            for d in (good, bad)
        ]
        for c in self.pair:
            c.compress(b"")

    def difference(self, text: str) -> float:
        """How much smaller the good dictionary makes a text than the bad one does, by the sum of both: -1 to 1."""
        good = bad = 0
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK].encode("utf-8", "replace")
            good += len(self.pair[0].compress(block))
            bad += len(self.pair[1].compress(block))
        return (bad - good) / (bad + good) if good + bad else 0.0


def score_of(model: QualityModel, difference: float) -> float:
    if model.constant is not None:
        return model.constant
    return float(1 / (1 + np.exp(-np.clip(model.slope * difference + model.offset, -50, 50))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for one feature, with a little weight decay; classes count alike, then the odds are put right."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    share = y.mean()
    w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - 1e-4 * beta
        hess = (a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1] + np.log(share / (1 - share)))


def fit_quality(
    docs: DataFrame, doc_id: Column, text: Column, labels: DataFrame, documents: int = FIT_DOCUMENTS, blocks: int = FIT_BLOCKS
) -> QualityModel:
    """Fit on a bounded sample of ``labels(doc_id, quality)``, the same one for the same labels.

    Of each class the ``documents`` labels with the least hash of their id are looked up, and of their text at most
    ``blocks`` blocks of lines for the dictionaries, and one difference a document for the curve, are used: a bound for
    the driver, which builds the dictionaries. Blocks that both classes hold say nothing and are left out. Labels that are null, or neither 0 nor 1, are passed over, repeated ones count
    once, and an id labelled both ways counts as bad. Where one class has no text to learn from, every score is 1, or 0 if
    all labels are bad.
    """
    order = F.xxhash64(F.lit("quality"), "doc_id")
    clean = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    picked = None
    for q in (0, 1):
        part = clean.where(F.col("quality") == q).orderBy(order, "doc_id").limit(documents)
        picked = part if picked is None else picked.union(part)
    picked = picked.select(F.col("doc_id").alias("hw_id"), "quality").toPandas()  # at most 2 * documents small rows
    spark = docs.sparkSession
    chosen = spark.createDataFrame(picked.astype({"hw_id": "int64", "quality": "int32"}), "hw_id bigint, quality int")
    held = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    # The side's size is bounded by ``documents``.
    held = held.join(F.broadcast(chosen), F.col("doc_id") == F.col("hw_id")).select("hw_id", "quality", "text")
    part = F.pmod(F.xxhash64(F.lit("part"), "hw_id"), F.lit(1000)) < int(CALIBRATE * 1000)
    cut = f"transform(sequence(0, length(x) div {BLOCK}), i -> substring(x, {BLOCK} * i + 1, {BLOCK}))"
    cut = f"flatten(transform(split(text, '\\n', -1), x -> {cut}))"
    pieces = held.where(~part).select("quality", F.posexplode(F.expr(cut)).alias("at", "block"), "hw_id")
    pieces = pieces.where("block <> ''")
    samples = []
    for q in (1, 0):
        top = pieces.where(F.col("quality") == q).orderBy(F.xxhash64("hw_id", "at"), "hw_id", "at", "block").limit(blocks)
        samples.append([r[0].encode("utf-8", "replace") for r in top.select("block").collect()])
    both = set(samples[0]) & set(samples[1])
    samples = [[b for b in s if b not in both] for s in samples]
    if not all(samples):
        return QualityModel(b"", b"", 0.0, 0.0, 0.0 if set(picked["quality"]) == {0} else 1.0)
    good, bad = (_dictionary(s) for s in samples)

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        sizes = Sizes(good, bad)
        for b in batches:
            yield {"quality": b["quality"], "hw_id": b["hw_id"], "d": [sizes.difference(t) for t in b["text"]]}

    rest = held.where(part)
    measured = map_texts(
        rest, {"quality": rest["quality"], "hw_id": rest["hw_id"], "text": rest["text"]}, rows, "quality int, hw_id bigint, d double"
    )
    table = measured.orderBy("hw_id", "d").limit(2 * documents).toPandas()
    x, y = table["d"].to_numpy(), table["quality"].to_numpy()
    if len(set(y.tolist())) < 2:
        x, y = np.array([0.01, -0.01]), np.array([1, 0])  # nothing to calibrate on: the sign decides
    slope, offset = _logistic(x, y)
    return QualityModel(good, bad, max(slope, 0.0), offset)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or where there is too little to train on, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def score_documents(
    docs: DataFrame, doc_id: Column, text: Column, model: QualityModel, threshold: float = THRESHOLD
) -> DataFrame:
    """``(doc_id, score, predicted)`` per row, from the whole text alone: 1 from ``threshold`` on.

    An empty or null text has no size difference and the score of the curve there. Repeated rows and null ids each get
    their row.
    """

    def rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        sizes = Sizes(model.good, model.bad) if model.constant is None else None
        for b in batches:
            scores = [score_of(model, sizes.difference(t or "") if sizes else 0.0) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_texts(docs, {"doc_id": doc_id, "text": text}, rows, "doc_id bigint, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores ``threshold`` or more."""

    def decide():
        sizes = Sizes(model.good, model.bad) if model.constant is None else None
        return lambda texts: [score_of(model, sizes.difference(t) if sizes else 0.0) >= threshold for t in texts]

    return keep_rows(docs, text, decide)
