"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text. A window of a document is compressed
with the ordinary one alone and with the toxic one in front of it; the bytes saved by the toxic one are the window's
distance. As both share the ordinary part, ordinary text saves next to nothing. Training goes in rounds: ordinary
windows that the toxic dictionary still helps are trained into the ordinary one, and the toxic one is trained anew on
the windows of toxic documents that it helps. A word repeated within a window refers to itself and counts once.

Toxic documents in which these find nothing train a second, larger pair: a window's length with a dictionary of such documents is
compared with its length with one of ordinary ones. This finds what is only more frequent in toxic text.

The dictionaries are trained on one part of a bounded sample of labelled documents, on all windows of each; shares of
windows above fixed savings become a score by logistic regression on another part, and the scale is set so that the
cut-off separates the classes of that part best. Held-out labels are never read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.common import keyed_texts, per_worker, table, whole_text

WINDOW, STEP = 64, 48
CUTS = (2, 3, 4, 5, 7)
FAINT_CUTS = (1, 3)
FEATURES = len(CUTS) + 2 + len(FAINT_CUTS) + 1
THRESHOLD = 0.7
# The cut-off: a toxic document found counts so much more than a clean one lost, of which there may be at most this share.
FOUND_WEIGHT, MOST_LOST = 1.5, 0.08


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample and of the dictionaries."""

    documents: int = 1000  # per class and part
    rounds: int = 5
    # The toxic dictionary has room for all forms of many words; of few documents a large one would hold ordinary text.
    toxic_bytes: int = 8000
    least_toxic_bytes: int = 1500
    toxic_bytes_a_document: int = 20
    ordinary_bytes: int = 32000
    segment: int = 16
    match: int = 6
    level: int = 6
    faint_toxic_bytes: int = 32000
    faint_ordinary_bytes: int = 64000
    faint_segment: int = 12
    faint_match: int = 8


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    level: int = 6
    faint_ordinary: bytes = b""
    faint_toxic: bytes = b""
    mean: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    scale: list[float] = field(default_factory=lambda: [1.0] * FEATURES)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = -4.0


def windows_of(text: str) -> list[bytes]:
    """Overlapping byte windows of the lower-cased text; the whole text is covered."""
    raw = text.lower().encode("utf-8")
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - (WINDOW - STEP)), STEP)] if raw else []


def _compressor(content: bytes, level: int, size: int):
    params = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=WINDOW, dict_size=size, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=params).compress
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


class Savings:
    """Bytes that the toxic dictionary saves on each window, and those that the second one saves against its ordinary one."""

    def __init__(self, model: Model):
        size = len(model.ordinary) + len(model.toxic)
        self.plain = _compressor(model.ordinary, model.level, size)
        self.both = _compressor(model.toxic + model.ordinary, model.level, size)
        self.pair = None
        if model.faint_toxic and model.faint_ordinary:
            self.pair = [_compressor(c, model.level, len(c)) for c in (model.faint_ordinary, model.faint_toxic)]

    def __call__(self, windows: list[bytes]) -> np.ndarray:
        plain, both = self.plain, self.both
        return np.array([len(plain(w)) - len(both(w)) for w in windows], dtype=np.int64)

    def faint(self, windows: list[bytes]) -> np.ndarray:
        if self.pair is None:
            return np.zeros(len(windows), dtype=np.int64)
        ordinary, toxic = self.pair
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], dtype=np.int64)

    def features(self, windows: list[bytes]) -> list[float]:
        return features(self(windows), self.faint(windows))


def features(saved: np.ndarray, faint: np.ndarray) -> list[float]:
    """Shares of the windows that save so many bytes, the largest saving, and how many save much; shares and mean of the second pair."""
    if not len(saved):
        return [0.0] * FEATURES
    first = [*(float((saved >= c).mean()) for c in CUTS), float(min(saved.max(), 12)), float(np.log1p((saved >= 4).sum()))]
    return first + [*(float((faint >= c).mean()) for c in FAINT_CUTS), float(np.clip(faint, -8, 8).mean())]


def _trained(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """Content of a zstandard dictionary; where there is too little text to train one, the text itself."""
    total = sum(map(len, samples))
    if not total:
        return b""
    if total > 2 * size:
        try:
            repeated = samples * max(1, -(-20 * size // total))
            return zstandard.train_dictionary(size, repeated, k=segment, d=match).as_bytes()[-(size - 200) :]
        except zstandard.ZstdError:
            pass
    return b" ".join(samples)[:size]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], t: Training) -> list[Model]:
    """A model (not yet calibrated) after each round."""
    toxic_bytes = min(t.toxic_bytes, max(t.least_toxic_bytes, t.toxic_bytes_a_document * len(toxic)))

    def learn(samples: list[bytes], size: int) -> bytes:
        return _trained(samples, size, t.segment, t.match)

    now = Model(learn([b" ".join(w) for w in ordinary], t.ordinary_bytes), learn([b" ".join(w) for w in toxic], toxic_bytes), t.level)
    models = [now]
    for _ in range(t.rounds):

        def helped(docs: list[list[bytes]], model: Model) -> list[bytes]:
            saved = Savings(model)
            kept = ([w for w, s in zip(ws, saved(ws), strict=True) if s >= 3] for ws in docs)
            return [b" ".join(k) for k in kept if k]

        against = helped(ordinary, now)
        size = min(t.ordinary_bytes, max(1024, sum(map(len, against)) // 8))
        more = learn(against, size) if against else b""
        # Later content is nearer to the window and costs less to refer to; the oldest goes first.
        now = Model((more + now.ordinary)[-4 * t.ordinary_bytes :], now.toxic, t.level)
        wanted = helped(toxic, now)
        if len(wanted) >= 3:
            now = Model(now.ordinary, learn(wanted, toxic_bytes), t.level)
        models.append(now)
    # The windows of toxic documents without any clear saving, against those of all ordinary ones.
    saved = Savings(now)
    unclear = [w for ws in toxic if not (saved(ws) >= 4).any() for w in ws]
    if unclear:
        faint = [
            _trained(samples, size, t.faint_segment, t.faint_match)
            for samples, size in (([w for ws in ordinary for w in ws], t.faint_ordinary_bytes), (unclear, t.faint_toxic_bytes))
        ]
        models = [replace(m, faint_ordinary=faint[0], faint_toxic=faint[1]) for m in models]
    return models


def _logistic(x: np.ndarray, labels: np.ndarray, sample_weights: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge; the last column is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2 * max(1.0, sample_weights.sum() / 100))
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (sample_weights * (p - labels)) + ridge * w
        hessian = (x * (sample_weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(model: Model, rows: np.ndarray, labels: np.ndarray, sample_weights: np.ndarray) -> tuple[Model, float]:
    """Logistic regression of the labels on the features, and its weighted log loss. More savings never lower a score:
    features whose weight would be negative are left out, the most negative first."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    x = np.hstack([(rows - mean) / scale, np.ones((len(rows), 1))])
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        w = np.zeros(x.shape[1])
        w[used] = _logistic(x[:, used], labels, sample_weights)
        wrong = used & (w < 0)
        wrong[-1] = False
        if not wrong.any():
            break
        used[np.argmin(np.where(wrong, w, np.inf))] = False
    z = x @ w
    p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
    loss = -float((sample_weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / sample_weights.sum())
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(z, labels, sample_weights))
    fitted = replace(model, mean=mean.tolist(), scale=scale.tolist(), weights=w[:-1].tolist(), bias=float(w[-1]) + shift)
    return fitted, loss


def best_cut(z: np.ndarray, labels: np.ndarray, sample_weights: np.ndarray) -> float:
    """The cut between two neighbouring values of ``z`` that finds most and loses least (``FOUND_WEIGHT``, ``MOST_LOST``)."""
    order = np.argsort(-z, kind="stable")
    z, y, n = z[order], labels[order], sample_weights[order]
    found, lost = np.cumsum(n * y) / (n * y).sum(), np.cumsum(n * (1 - y)) / (n * (1 - y)).sum()
    gain = FOUND_WEIGHT * found - lost
    # Equal values are on one side; a cut below all of them would call every document toxic.
    gain[:-1][z[:-1] == z[1:]] = -np.inf
    gain[(lost > MOST_LOST) | (np.arange(len(z)) == len(z) - 1)] = -np.inf
    best = int(np.argmax(gain))
    return float(z[0] + 1) if gain[best] == -np.inf else float((z[best] + z[best + 1]) / 2)


def score_texts(model: Model, texts) -> np.ndarray:
    saved = Savings(model)
    rows = np.array([saved.features(windows_of(t)) for t in texts], dtype=float).reshape(-1, FEATURES)
    z = ((rows - model.mean) / model.scale) @ np.array(model.weights) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def fit_toxicity(documents: DataFrame, labels: DataFrame, t: Training = Training()) -> Model:
    """Fit on labelled documents that are not held out. Read are at most ``4 * t.documents`` whole texts, chosen by a
    hash of the id (equal texts once); half of them, with all their windows, reach the driver for training, the others are
    measured by the tasks for calibration. A document with several labels is toxic if one says so; null labels are left out. If
    a class is missing, every score is low."""
    spark = documents.sparkSession
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("part", held_out())
        .where("part <> 1")
    )
    counts = {(r["part"], r["toxic"]): r["count"] for r in known.groupBy("part", "toxic").count().collect()}
    chosen = None
    for part in (0, 2):
        for kind in (0, 1):
            some = known.where((F.col("part") == part) & (F.col("toxic") == kind)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.documents)
            chosen = some if chosen is None else chosen.unionByName(some)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    # At most 4 * t.documents ids.
    sample = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text"]).select("doc_id", "text", "toxic", "part")

    for fit_part, test_part in ((0, 2), (2, 0)):
        got = sample.where(F.col("part") == fit_part).toPandas().sort_values("doc_id")
        toxic, ordinary = ([windows_of(text) for text in got[got.toxic == kind].text] for kind in (1, 0))
        if toxic and ordinary:
            break
    else:
        return Model()
    models = train_dictionaries(toxic, ordinary, t)
    if len({r["toxic"] for r in sample.where(F.col("part") == test_part).select("toxic").distinct().collect()}) < 2:
        test_part = fit_part
    held = spark.sparkContext.broadcast({"models": [asdict(m) for m in models]})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        savings = [Savings(Model(**m)) for m in held.value["models"]]
        for batch in batches:
            cuts = [windows_of(text) for text in batch["text"]]
            yield batch[["doc_id", "toxic"]].assign(rows=[[s.features(ws) for s in savings] for ws in cuts])

    measured = sample.where(F.col("part") == test_part).mapInPandas(measure, "doc_id bigint, toxic int, rows array<array<double>>")
    got = measured.toPandas().sort_values("doc_id")
    y = got.toxic.to_numpy().astype(float)
    share = {k: counts.get((test_part, k), 1) / max(1, int((y == k).sum())) for k in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    rows = np.array([[list(m) for m in r] for r in got.rows], dtype=float)
    return min((calibrate(m, rows[:, i], y, w) for i, m in enumerate(models)), key=lambda x: x[1])[0]


def score_toxicity(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): held_out, score (0 to 1), predicted (score >= threshold).

    Null and empty texts get the score of a text without any toxic window. Every window of a text counts. Only the
    text enters the score. A null id is not held out. Repeated rows are scored each; other columns are ignored."""
    held = documents.sparkSession.sparkContext.broadcast({"model": asdict(model)})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(**held.value["model"])
        saved = per_worker(held, "saved", lambda: Savings(m))
        for batch in batches:
            rows = np.array([saved.features(windows_of(x)) for x in batch["text"]], dtype=float).reshape(-1, FEATURES)
            z = ((rows - m.mean) / m.scale) @ np.array(m.weights) + m.bias
            yield batch[["doc_id"]].assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    scored = keyed_texts(documents).mapInPandas(score, "doc_id bigint, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, with all their columns, whose text scores below the threshold."""
    held = documents.sparkSession.sparkContext.broadcast({"model": asdict(model)})
    text = documents.columns.index("text")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(Model(**held.value["model"]), [t or "" for t in batch.column(text).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return documents.mapInArrow(below, documents.schema)


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return score_toxicity(documents, fit_toxicity(documents, table(spark, folder, "labels")))
