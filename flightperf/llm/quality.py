"""Quality by co-training: a text view and a page-metadata view teach each other.

The text classifier sees character, word and line statistics of the content; the metadata
classifier sees language, source and stated length. Both start from the labelled rows. In each
of ``ROUNDS`` rounds each view labels the rows of an unlabelled pool that its calibrated
probability puts above ``CONFIDENT`` (or below 1 - ``CONFIDENT``), and the other view is fitted
again with them (an agreed label stays, a contested one is dropped). A third of the labelled rows
is held back to calibrate each view and to weigh the two calibrated logits into the score.

The fits read bounded samples chosen by a hash of doc_id: about ``MAX_LABELLED`` labelled rows
and a pool of about ``MAX_POOL`` unlabelled ones (co-training's own bounded pool). Features are
computed in the tasks, so the driver sees those feature rows alone; every document is scored.

Defined cases: null text counts as empty, null metadata as its own value; several labels of one
doc_id count as their mean, half or more being good; null labels are ignored; repeated rows are
scored each. Without labels of both classes nothing can be told apart and every score is 0.5.
Rows are kept at 0.5 or more. Extra columns are ignored by ``scores``, kept by ``keep_good``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import fresh, small_batches, text_bytes
from flightperf.llm.linear import Logistic, sigmoid

MAX_LABELLED = 12_000
MAX_POOL = 12_000
ROUNDS = 4
CONFIDENT = 0.97
KEEP_FROM = 0.5
SOURCE_BUCKETS = 32
LANG_BUCKETS = 8

_CLASS = np.zeros(256, dtype=np.int64)                  # 0 other, see text_features
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (1 if _c in "abcdefghijklmnopqrstuvwxyz" else 2 if _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else
                  3 if _c in "0123456789" else 4 if _c in " \t" else 5 if _c == "\n" else 6 if _c in ".," else
                  7 if _c in ";:'\"()-" else 8 if _c in "!?" else 9 if _c in "#$%&*+/<=>@\\^_`{|}~[]" else
                  10 if _i >= 128 else 0)


def text_features(raw: bytes) -> list[float]:
    """Content statistics of a text."""
    n = max(1, len(raw))
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) / n if raw else np.zeros(11)
    words = raw.split()
    lines = raw.split(b"\n")
    k = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:])) / k
    distinct = len(set(words)) / k
    letters = sum(map(len, words)) / k
    upper = float(counts[2]) / max(1e-9, float(counts[1] + counts[2]))
    symbols = float(counts[9] + counts[8])
    sizes = np.log1p([len(raw), len(words), len(lines)])
    return [*np.sqrt(counts).tolist(), *sizes.tolist(), same, same ** 0.5, distinct, distinct / (1 + float(sizes[1])),
            min(letters, 40.0), upper, upper > 0.5, symbols > 0.04, symbols ** 0.25, 1 - len(set(lines)) / len(lines),
            float(not words)]


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Language and source by hashed buckets, stated length in bands; nulls are values of their own."""
    out = [0.0] * (LANG_BUCKETS + SOURCE_BUCKETS + 2)
    out[zlib.crc32(("=" + lang if lang is not None else "").encode()) % LANG_BUCKETS] = 1.0
    out[LANG_BUCKETS + zlib.crc32(("=" + source if source is not None else "").encode()) % SOURCE_BUCKETS] = 1.0
    size = np.log1p(max(0, n_chars)) if n_chars is not None else 0.0
    return out + [float(size), float(size) ** 2, float(n_chars is None)]


def _features(batch, at: dict) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(x.as_py()) for x in batch.column(at["bytes"])], dtype=np.float64)
    meta = np.array([meta_features(*r) for r in zip(batch.column(at["lang"]).to_pylist(),
                                                    batch.column(at["source"]).to_pylist(),
                                                    batch.column(at["n_chars"]).to_pylist())], dtype=np.float64)
    return text, meta


def _views(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("bytes"), F.col("lang").cast("string"),
                       F.col("source").cast("string"), F.col("n_chars").cast("long"))


def _sampled(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, by a hash of doc_id; all of them when they are no more."""
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))


def _feature_rows(rows: DataFrame) -> np.ndarray:
    """Feature rows of a bounded sample (doc_id, bytes, lang, source, n_chars, label), sorted: the last
    column is the label, the ``LANG_BUCKETS + SOURCE_BUCKETS + 5`` before it the metadata view."""
    def run(batches):
        for b in small_batches(batches):
            text, meta = _features(b, {c: i for i, c in enumerate(b.schema.names)})
            label = np.array([-1.0 if v is None else v for v in b.column(5).to_pylist()])
            table = np.column_stack([text, meta, label])
            yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.list_(pa.float64()))], names=["row"])

    rows = rows.mapInArrow(run, "row array<double>").orderBy("row").collect()   # at most the sample's rows
    return np.array([r["row"] for r in rows])


class CoTrained:
    """The two fitted views, their calibration and the weights that join them."""

    def __init__(self, labelled: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT):
        self.usable = len(labelled) > 0 and len(np.unique(labelled[:, -1])) == 2
        self.added: list[tuple[int, int]] = []
        if not self.usable:
            return
        held = np.arange(len(labelled)) % 3 == 2
        if len(np.unique(labelled[held, -1])) < 2 or len(np.unique(labelled[~held, -1])) < 2:
            held = np.zeros(len(labelled), dtype=bool)  # too few rows to hold any back
        fit, check = labelled[~held], labelled[held] if held.any() else labelled
        xs, y = self._split(fit), fit[:, -1]
        cx, cy = self._split(check), check[:, -1]
        px = self._split(pool) if len(pool) else None
        given = [np.full(len(pool), np.nan) for _ in range(2)]   # labels that a view gets from the other
        for r in range(rounds + 1):
            self.views = []
            for v in range(2):
                own = ~np.isnan(given[v])
                x = np.concatenate([xs[v], px[v][own]]) if own.any() else xs[v]
                t = np.concatenate([y, given[v][own]]) if own.any() else y
                self.views.append(Logistic().fit(x, t))
            self.scale = [Logistic(0.1).fit(self.views[v].logit(cx[v])[:, None], cy) for v in range(2)]
            if r == rounds or px is None:
                break
            p = [sigmoid(self._logit(v, px[v])) for v in range(2)]
            sure = [np.where(q >= confident, 1.0, np.where(q <= 1 - confident, 0.0, np.nan)) for q in p]
            clash = ~np.isnan(sure[0]) & ~np.isnan(sure[1]) & (sure[0] != sure[1])
            given = [np.where(clash, np.nan, sure[1 - v]) for v in range(2)]
            self.added.append(tuple(int((~np.isnan(g)).sum()) for g in given))
        both = np.column_stack([self._logit(v, cx[v]) for v in range(2)])
        self.join = Logistic(0.1).fit(both, cy)

    @staticmethod
    def _split(rows):
        n_meta = LANG_BUCKETS + SOURCE_BUCKETS + 5
        return rows[:, :-1 - n_meta], rows[:, -1 - n_meta:-1]

    def _logit(self, v, x):
        return self.scale[v].logit(self.views[v].logit(x)[:, None])

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both together."""
        if not self.usable:
            half = np.full(len(text), 0.5)
            return half, half, half
        a, b = self._logit(0, text), self._logit(1, meta)
        return sigmoid(a), sigmoid(b), sigmoid(self.join.logit(np.column_stack([a, b])))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL,
          rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """Fit on ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id, quality)."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.avg("quality") >= 0.5).cast("double").alias("label")))
    some = _sampled(known, known.count(), max_labelled, 1)
    rows = _views(docs)
    labelled = rows.join(F.broadcast(some), "doc_id")   # about max_labelled rows of two numbers
    pool = _sampled(rows, rows.select("doc_id").count(), max_pool, 2).join(known.select("doc_id"), "doc_id", "left_anti")
    return CoTrained(_feature_rows(labelled),
                     _feature_rows(pool.select("*", F.lit(None).cast("double").alias("label"))), rounds, confident)


def scores(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, meta_score, score, keep (1 or 0) of every row."""
    def run(batches):
        for b in small_batches(batches):
            text, meta = _features(b, {c: i for i, c in enumerate(b.schema.names)})
            t, m, s = model.score(text, meta)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(t), pa.array(m), pa.array(s), pa.array((s >= KEEP_FROM).astype(np.int32))],
                names=["doc_id", "text_score", "meta_score", "score", "keep"])

    return _views(docs).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep int")


def keep_good(docs: DataFrame, model: CoTrained) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they were."""
    width = len(docs.columns)
    views = [c.alias(fresh(docs, f"view_{i}")) for i, c in enumerate((
        text_bytes(), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")))]
    at = {"bytes": width, "lang": width + 1, "source": width + 2, "n_chars": width + 3}

    def run(batches):
        for b in small_batches(batches):
            keep = model.score(*_features(b, at))[2] >= KEEP_FROM
            yield pa.RecordBatch.from_arrays(b.columns[:width], schema=pa.schema(list(b.schema)[:width])).filter(pa.array(keep))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], *views).mapInArrow(run, docs.schema)
