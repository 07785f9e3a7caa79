"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled texts, one on each class. A text is compressed whole with either, in pieces
of PIECE bytes so that what a dictionary knows counts throughout a long text; the difference of the two sizes over
their sum is the evidence. A logistic curve, fitted on labelled texts that no dictionary has seen, turns it into a
probability; besides the difference the curve takes the size under the good dictionary over the raw size (text that
repeats itself is small under either) and the logarithm of the raw size (short texts say less).

Fitted on at most `sample` labelled rows of each class, those with the smallest hash of doc_id, whose text has at
most FIT_CHARS characters; every text is scored whole. Of the rows with an even hash a dictionary learns at most PIECES
pieces each, evenly spaced over the text, which are cut out where the text lies; the rest calibrate, by numbers that are
computed where the text lies. So the driver gets at most `sample` times PIECES times PIECE bytes of text of a class.

A document without text is scored like any other, by its size 0. Null, unknown or contradicting labels are not learnt
from; of rows that repeat a labelled doc_id the least text is taken. Where a class has too few rows for a dictionary all
scores are the share of good rows (0.5 without any label). Repeated rows are scored alike, rows in as rows out; other
columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch, text_bytes

SAMPLE, FIT_CHARS = 2500, 100_000
PIECE, PIECES, DICTIONARY_BYTES, LEVEL = 2048, 16, 65_536, 3
LEAST_ROWS = 20


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 4: rows with 2 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality, text of at most `sample` rows of each class that are not held out, one for each id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 2)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("quality") == q).orderBy(*by_hash).limit(sample) for q in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample ids
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text").between(1, FIT_CHARS)).join(chosen, "doc_id")
    rows = texts.groupBy("doc_id").agg(F.first("quality").cast("int").alias("quality"), F.min("text").alias("text"))
    return Scratch(docs.sparkSession, "classifier").write(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "sample")


def _pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


class Model:
    """Two dictionaries and the calibration curve; small enough to travel with a task."""

    def __init__(self, dictionaries: list[bytes], weights: list[float], share: float):
        self.dictionaries, self.weights, self.share = dictionaries, weights, share

    @property
    def fitted(self) -> bool:
        return bool(self.dictionaries)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in self.dictionaries:
            (d := zstandard.ZstdCompressionDict(data)).precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if not self.dictionaries else 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, ...]:
    pieces = _pieces(text)
    a, b = (sum(len(c.compress(x)) for x in pieces) for c in (good, bad))
    difference, size = (b - a) / (a + b), a / (len(text) + 16)
    longer = np.log1p(len(text))
    return 1.0, difference, size, size * size, longer, difference * longer


def _spread(text: bytes) -> list[bytes]:
    """At most PIECES of the pieces of a text, evenly spaced."""
    all_of = _pieces(text)
    return all_of if len(all_of) <= PIECES else [all_of[i * len(all_of) // PIECES] for i in range(PIECES)]


def fit(sampled: DataFrame) -> Model:
    """The model of the rows (doc_id, quality, text), one for each id."""
    counts = dict(sampled.groupBy("quality").count().collect())
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if min(counts.get(q, 0) for q in (0, 1)) < LEAST_ROWS:
        return Model([], [], share)
    order, learns = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit("part")) % 2 == 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [_spread(t.encode()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pieces, pa.list_(pa.binary()))], ["h", "doc_id", "quality", "pieces"])

    rows = sampled.where(learns).select(order.alias("h"), "doc_id", "quality", "text").mapInArrow(cut, "h long, doc_id long, quality int, pieces array<binary>").collect()
    rows.sort(key=lambda r: (r.h, r.doc_id))
    try:
        dictionaries = [zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(p) for r in rows if r.quality == label for p in r.pieces], level=LEVEL).as_bytes() for label in (1, 0)]
    except zstandard.ZstdError:  # too little text to draw a dictionary from
        return Model([], [], share)
    model = Model(dictionaries, [], share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors()
        for batch in batches:
            x = [list(features(t.encode(), good, bad)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = sampled.where(~learns).select("doc_id", "quality", "text").mapInArrow(measure, "doc_id long, quality int, x array<double>").collect()
    if len({r.quality for r in found}) < 2:
        return Model([], [], share)
    found.sort(key=lambda r: r.doc_id)
    x, y = np.array([r.x for r in found]), np.array([float(r.quality) for r in found])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w.tolist()
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with a column (double), by default score: the probability of label 1."""
    at = [c.lower() for c in docs.columns].index("text")
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = model.compressors() if model.dictionaries else (None, None)
        for batch in batches:
            data, starts = text_bytes(batch.column(at))
            view = data.tobytes()
            x = np.array([features(view[a:b], good, bad) for a, b in zip(starts[:-1], starts[1:], strict=True)]) if good else np.zeros((len(batch), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, held_out, score and predicted of every row of `docs`."""
    model = fit(sample_rows(docs, labels, sample))
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.withColumn("held_out", F.coalesce(fold("doc_id") == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
