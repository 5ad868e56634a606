"""Quality classifier by co-training: one view is the text, the other the page's metadata.

Each view has a logistic classifier of its own. They are fitted on labelled documents; then, for ROUNDS rounds, each one names the unlabelled
documents it is surest of, good and bad in the proportion of the labels, and the other one learns from those too. Labelled
documents that no classifier has seen calibrate each view's log-odds and weigh the two against each other; the weighted sum is
the score of every document.

Fitting uses bounded samples, each of the documents whose id has the smallest hashes: of either kind of labelled documents SAMPLE / 2, or all
where there are fewer, however many documents have no label; and about SAMPLE unlabelled ones. Only their features reach the driver (4 * SAMPLE
rows of TEXT_FEATURES + META_FEATURES numbers at most). Scoring reads every document and its whole text, in one pass without a shuffle.

Defined cases: null or empty text has the features of a text without words; null metadata count as a value of their own, and
missing metadata columns as null; documents without id are scored but not learned from; repeated rows get equal scores. With labels of
one kind only, or none, every document has score 0.5 and is kept. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleevenotes.llm.language_crf import in_runs
from sleevenotes.llm.text import drawn
from sleevenotes.sources.work import written

SAMPLE = 8_000
ROUNDS = 4
#: Share of the unlabelled sample that a view passes on in each round.
PASSED_ON = 0.05
#: Log-odds that a view must have for a label it passes on. A view that knows little passes on nothing.
CONFIDENT = 2.0
PAIRS = 512
TEXT_FEATURES = PAIRS + 4
META_SLOTS = 64
META_FEATURES = 2 * META_SLOTS + 24
#: Low, as a clean document lost costs more than an untidy one kept; see the README for the measured errors.
KEEP_FROM = 0.1
STEPS, RATE, RIDGE = 400, 0.5, 1e-3


# -- features ------------------------------------------------------------------------------------------------------


def text_features(texts: pa.Array) -> np.ndarray:
    """Hashed pairs of neighbouring bytes, by share, and how much of the text repeats itself."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros((len(texts), TEXT_FEATURES), np.float32)
    words = pc.split_pattern_regex(texts, r"[\s\x0b]+")
    bounds = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten().dictionary_encode()
    codes = flat.indices.to_numpy()
    bounds = bounds - bounds[0]
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = codes[bounds[k] : bounds[k + 1]]
        if b - a > 1:
            pairs = (raw[a : b - 1].astype(np.uint32) * 40_503 + raw[a + 1 : b] * np.uint32(2_654_435)) >> 7
            out[k, :PAIRS] = np.bincount(pairs % PAIRS, minlength=PAIRS)[:PAIRS] * (20.0 / (b - a - 1))
        n = max(1, len(own))
        out[k, PAIRS] = len(np.unique(own)) / n
        out[k, PAIRS + 1] = (own[1:] == own[:-1]).sum() / n
        out[k, PAIRS + 2] = np.log1p(n) / 5
        out[k, PAIRS + 3] = (b - a) / n / 10
    return out


def meta_features(sources: list, langs: list, chars: list) -> np.ndarray:
    """Hashed source and language, and the size by powers of two."""
    out = np.zeros((len(sources), META_FEATURES), np.float32)
    rows = np.arange(len(sources))
    for at, values in ((0, sources), (META_SLOTS, langs)):
        slots = {v: zlib.crc32(str(v).encode()) % META_SLOTS for v in set(values)}
        out[rows, [at + slots[v] for v in values]] = 1
    size = [0 if c is None else 1 + min(22, max(0, int(c)).bit_length()) for c in chars]
    out[rows, [2 * META_SLOTS + s for s in size]] = 1
    return out


# -- the model -----------------------------------------------------------------------------------------------------


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray) -> Logistic:
    """Both kinds of label weigh the same. Accelerated gradient descent with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    z = (x - mean) / scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    lipschitz = 0.25 * float((weight[:, None] * z * z).sum()) + RIDGE
    w, v, b, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(STEPS):
        ahead, ahead_b = w + 0.9 * v, b + 0.9 * vb
        miss = weight * (y - 1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -30, 30))))
        v = 0.9 * v + (z.T @ miss - RIDGE * ahead) * min(RATE, 4 / lipschitz)
        vb = 0.9 * vb + RATE * miss.sum()
        w, b = w + v, b + vb
    return Logistic(mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32), float(b))


@dataclass
class Model:
    text: Logistic | None
    meta: Logistic | None
    calibrated: Logistic | None

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, and the share that each view alone would give."""
        if self.text is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        views = np.stack([self.text.odds(text), self.meta.odds(meta)], axis=1)
        sure = lambda odds: 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return sure(self.calibrated.odds(np.clip(views, -30, 30))), sure(views[:, 0]), sure(views[:, 1])


def co_train(text: np.ndarray, meta: np.ndarray, labels: np.ndarray, spare: np.ndarray, good_share: float | None = None) -> Model:
    """labels: 1, 0, or -1 for none. spare: labelled rows that only calibrate. good_share: of all labels, if the rows are a sample by kind."""
    known, pool = (labels >= 0) & ~spare, np.flatnonzero(labels < 0)
    if len(set(labels[known])) < 2 or len(set(labels[spare & (labels >= 0)])) < 2:
        return Model(None, None, None)
    good_share = labels[known].mean() if good_share is None else good_share
    views = (text, meta)
    taught = [labels.copy(), labels.copy()]
    for view in taught:
        view[spare] = -1
    for round_no in range(ROUNDS + 1):
        fitted = [fit_logistic(x[y >= 0], y[y >= 0]) for x, y in zip(views, taught, strict=True)]
        if round_no == ROUNDS or not len(pool):
            break
        for k in (0, 1):  # what view k is surest of, the other learns
            odds = fitted[k].odds(views[k][pool])
            order = np.argsort(odds, kind="stable")
            n = int(len(pool) * PASSED_ON)
            bad = order[: int(n * (1 - good_share))]
            good = order[len(order) - int(n * good_share) :]
            taught[1 - k][pool[bad[odds[bad] < -CONFIDENT]]] = 0
            taught[1 - k][pool[good[odds[good] > CONFIDENT]]] = 1
    rows = spare & (labels >= 0)
    odds = np.clip(np.stack([f.odds(x[rows]) for f, x in zip(fitted, views, strict=True)], axis=1), -30, 30)
    return Model(*fitted, fit_logistic(odds, labels[rows]))


# -- documents -----------------------------------------------------------------------------------------------------


def _views(docs: DataFrame, extra: list[str]) -> DataFrame:
    meta = [F.col(c) if c in docs.columns else F.lit(None).alias(c) for c in ("source", "lang", "n_chars")]
    return docs.select(*extra, "text", *(m.cast(t).alias(n) for m, t, n in zip(meta, ("string", "string", "long"), ("source", "lang", "n_chars"), strict=True)))


def _both(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = 0
    for texts, *meta in in_runs(*(batch.column(c) for c in ("text", "source", "lang", "n_chars"))):
        yield at, text_features(texts), meta_features(*(m.to_pylist() for m in meta))
        at += len(texts)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` labelled documents, and about as many without a label."""
    n = docs.count()
    if not n:
        return Model(None, None, None)
    with_id = docs.filter(F.col("doc_id").isNotNull())
    labelled = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = written(labelled.join(with_id.select("doc_id").distinct(), "doc_id", "left_semi"))
    times = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(times) < 2:
        return Model(None, None, None)
    of_kind = [(F.col("quality") == q) & drawn(F.col("doc_id"), sample // 2, times[q]) for q in (0, 1)]
    chosen = known.filter(of_kind[0] | of_kind[1])
    pool = with_id.filter(drawn(F.col("doc_id"), sample, n - sum(times.values())))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text, meta in _both(batch):
                ids = batch.column("doc_id").slice(at, len(text))
                packed = [r.tobytes() for r in np.concatenate([text, meta], axis=1)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "features": pa.array(packed, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, features binary"
    taught = _views(with_id.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"), ["doc_id"]).mapInArrow(features, schema)  # SAMPLE rows, about
    spare = F.pmod(F.xxhash64("doc_id", F.lit("spare")), F.lit(4)) == 0
    found = []
    for rows in (
        taught.join(chosen, "doc_id"),
        _views(pool, ["doc_id"]).mapInArrow(features, schema).join(known, "doc_id", "left_anti").withColumn("quality", F.lit(-1)),
    ):
        # a repeated id is one row, so that no document can take the place of others
        once = rows.groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
        found += once.select("features", "quality", spare.alias("spare")).orderBy("features").limit(2 * sample).collect()
    if not found:
        return Model(None, None, None)
    x = np.stack([np.frombuffer(r.features, np.float32) for r in found])
    y, s = np.array([r.quality for r in found]), np.array([r.spare for r in found])
    return co_train(x[:, :TEXT_FEATURES], x[:, TEXT_FEATURES:], y, s, times[1] / (times[0] + times[1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, text_score, meta_score and kept of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text, meta in _both(batch):
                total, by_text, by_meta = model.score(text, meta)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(at, len(total)), "score": pa.array(total, pa.float64()),
                     "text_score": pa.array(by_text, pa.float64()), "meta_score": pa.array(by_meta, pa.float64()),
                     "kept": pa.array(total >= KEEP_FROM)}
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, text_score double, meta_score double, kept boolean"
    return _views(docs, ["doc_id"]).mapInArrow(score, schema)
