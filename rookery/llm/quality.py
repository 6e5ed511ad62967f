"""Quality classifier by co-training.

Two classifiers see separate views of a document: one its text (hashed words, kinds
of characters, repetition), the other its metadata (source, language, length and
layout). Over some rounds each labels the unlabelled documents that it is most
certain of for the other one. Both are then calibrated on labelled documents kept
aside, and their log-odds are added.

Training uses a bounded sample in hash order: ``LABELLED`` labelled and ``POOL``
unlabelled documents. Scoring covers all documents; each is handled alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import free_name
from rookery.llm.shingles import slices, word_hashes

#: Bounds of the training sample, rows.
LABELLED = 8000
POOL = 8000
ROUNDS = 4
#: Pseudo-labels that a view gives in a round, as a share of the pool, and the precision
#: that it must reach for them on documents kept aside.
GIVEN = 0.05
CERTAIN = 0.99
#: Every so-manieth labelled document is kept aside for calibration.
ASIDE = 4
ACCEPT = 0.5
WORD_CELLS = 256
NAME_CELLS = 64
# Added to counts before shares are taken, so that a short text says little.
_FEW_BYTES, _FEW_WORDS = 120, 40
_PENALTY = 2e-4
_FARTHEST = 12.0  # standard deviations that a feature counts at most
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_kinds() -> np.ndarray:
    """Kind of each byte: other, capital, digit, white space, line feed, and each ASCII sign."""
    kinds = np.zeros(256, np.int64)
    kinds[65:91], kinds[48:58], kinds[[9, 11, 12, 13, 32]], kinds[10] = 1, 2, 3, 4
    for k, sign in enumerate(_SIGNS):
        kinds[sign] = 5 + k
    return kinds


_KINDS = _byte_kinds()
_KIND_COUNT = 5 + len(_SIGNS)


def features(text: pa.Array, source: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the text view and of the metadata view."""
    parts = [
        _part_features(part, source[k : k + len(part)], lang[k : k + len(part)])
        for k, part in slices(text)
    ] or [_part_features(text, source, lang)]
    return tuple(np.vstack(view) for view in zip(*parts, strict=True))


def _part_features(text: pa.Array, source: list, lang: list) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: n + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    sizes = np.diff(offsets).astype(np.int64)
    row = np.repeat(np.arange(n) * _KIND_COUNT, sizes)
    kinds = np.bincount(row + _KINDS[raw], minlength=n * _KIND_COUNT).reshape(n, -1).astype(float)
    words, borders = word_hashes(text)
    counts = np.diff(borders)
    cells = np.repeat(np.arange(n) * WORD_CELLS, counts) + (words % np.uint64(WORD_CELLS)).astype(np.int64)
    hashed = np.bincount(cells, minlength=n * WORD_CELLS).reshape(n, -1).astype(float)
    some = counts + 1
    same = np.zeros(len(words) + 1)
    if len(words) > 1:
        same[1:-1] = words[1:] == words[:-1]
    running = np.concatenate([[0.0], np.cumsum(same)])
    repeated = (running[np.maximum(borders[1:], borders[:-1] + 1)] - running[borders[:-1] + 1]) / some
    distinct = np.array(
        [len(np.unique(words[a:b])) for a, b in zip(borders, borders[1:], strict=False)]
    ) / some
    shares = np.sqrt(kinds / (sizes + _FEW_BYTES)[:, None])
    text_view = np.hstack(
        [
            shares,
            np.sqrt(hashed / (counts + _FEW_WORDS)[:, None]),
            repeated[:, None],
            distinct[:, None],
            np.log((sizes + _FEW_BYTES) / (counts + _FEW_WORDS / 2))[:, None],
        ]
    )
    lines = kinds[:, 4] + 1
    named = np.zeros((n, NAME_CELLS))
    for k, names in enumerate(zip(source, lang, strict=True)):
        for which, name in enumerate(names):
            named[k, zlib.crc32(f"{which}:{name}".encode()) % NAME_CELLS] = 1.0
    layout = np.log1p(np.stack([sizes, lines, sizes / lines, np.abs(counts / lines)], axis=1))
    return text_view.astype(np.float32), np.hstack([named, layout]).astype(np.float32)


@dataclass
class View:
    """Logistic regression on standardised columns, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -_FARTHEST, _FARTHEST)
        return z @ self.weights[:-1] + self.weights[-1]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    text: View
    metadata: View
    shares: np.ndarray  # of the two views' log-odds in the result, and a constant

    def log_odds(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, ...]:
        one, two = self.text.log_odds(text), self.metadata.log_odds(metadata)
        return one, two, self.shares[0] * one + self.shares[1] * two + self.shares[2]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _newton(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression (last: constant, not penalised), damped Newton steps."""
    z = np.hstack([z, np.ones((len(z), 1))]).astype(float)
    weights = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty * len(z))
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(z @ weights)
        slope = z.T @ (p - y) + ridge * weights
        curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    weights = _newton(np.clip((x - mean) / scale, -_FARTHEST, _FARTHEST), y, _PENALTY)
    return View(mean, scale, weights)


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Slope and shift of the log-odds on documents the view was not trained on."""
    raw = view.raw(x)
    size = max(np.abs(raw).mean(), 1e-6)
    found = _newton((raw / size)[:, None], y, 1e-3)
    view.slope, view.shift = float(max(found[0] / size, 0.0)), float(found[1])


def _sure_from(raw: np.ndarray, right: np.ndarray) -> float:
    """Least log-odds from which on a view is right about ``CERTAIN`` of the documents
    kept aside; infinite if there is none, so an unsure view teaches nothing."""
    order = np.argsort(-raw, kind="stable")
    precision = (np.cumsum(right[order]) + 1) / (np.arange(len(raw)) + 2)
    good = np.flatnonzero(precision >= CERTAIN)
    return float(raw[order][good[-1]]) if len(good) else np.inf


def co_train(
    text: np.ndarray, metadata: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_metadata: np.ndarray
) -> Model | None:
    """Model from labelled rows (``y`` 0 or 1) and unlabelled ones; None if the labels
    to train on or those kept aside lack a class."""
    aside = np.arange(len(y)) % ASIDE == 0
    if min(len(set(y[aside])), len(set(y[~aside]))) < 2:
        return None
    views = [text[~aside], metadata[~aside]]
    labels = [y[~aside].astype(float)] * 2
    pool, kept = [pool_text, pool_metadata], [text[aside], metadata[aside]]
    free = [np.ones(len(pool_text), bool) for _ in pool]  # not yet given to this view
    share = float(y[~aside].mean())
    for _ in range(ROUNDS):
        fitted = [fit_view(x, t) for x, t in zip(views, labels, strict=True)]
        for teacher, pupil in ((0, 1), (1, 0)):
            raw, held = (fitted[teacher].raw(x) for x in (pool[teacher], kept[teacher]))
            for target, part in ((1.0, share), (0.0, 1 - share)):
                sign = 2 * target - 1
                chance = sign * raw
                sure = np.flatnonzero(free[pupil] & (chance >= _sure_from(sign * held, y[aside] == target)))
                most = int(np.ceil(GIVEN * part * len(raw)))
                chosen = sure[np.argsort(-chance[sure], kind="stable")[:most]]
                free[pupil][chosen] = False
                views[pupil] = np.vstack([views[pupil], pool[pupil][chosen]])
                labels[pupil] = np.concatenate([labels[pupil], np.full(len(chosen), target)])
    one, two = (fit_view(x, t) for x, t in zip(views, labels, strict=True))
    calibrate(one, text[aside], y[aside])
    calibrate(two, metadata[aside], y[aside])
    both = np.stack([one.log_odds(text[aside]), two.log_odds(metadata[aside])], axis=1)
    return Model(one, two, np.maximum(_newton(both, y[aside], 1e-3), [0.0, 0.0, -np.inf]))


# --- DataFrames -----------------------------------------------------------------


def _inputs(docs: DataFrame) -> list:
    """Columns that the views are made from; a column that is missing counts as null."""
    name = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return [
        F.coalesce("text", F.lit("")).alias("text"),
        name("source").alias("source"),
        name("lang").alias("lang"),
    ]


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from the labelled documents among ``docs`` and a pool of the others.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad; null says nothing); ids
    labelled both ways are left out. Only the sample's features reach the driver.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    )
    agreed = known.filter("quality = most").select("doc_id", F.col("quality").cast("int"))
    ids = docs.select("doc_id").filter("doc_id is not null")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    labelled = agreed.join(ids.distinct(), "doc_id", "left_semi").orderBy(*order).limit(LABELLED)
    pool = ids.join(known, "doc_id", "left_anti").distinct().orderBy(*order).limit(POOL)
    # At most LABELLED + POOL ids: bounded, so the texts stay where they are.
    sample = F.broadcast(labelled.unionByName(pool.withColumn("quality", F.lit(None).cast("int"))))
    rows = docs.select("doc_id", *_inputs(docs)).join(sample, "doc_id")

    def describe(batches):
        for batch in batches:
            views = features(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            lists = [pa.array(list(v), pa.list_(pa.float32())) for v in views]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *lists], ["doc_id", "quality", "text", "metadata"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = (
        rows.select("doc_id", "quality", "text", "source", "lang")
        .mapInArrow(
            describe, f"doc_id {kind}, quality int, text array<float>, metadata array<float>"
        )
        .dropDuplicates(["doc_id"])
        .toArrow()
        .sort_by("doc_id")
    )
    y = found.column("quality").to_pandas().to_numpy(float)
    matrix = lambda c: (
        np.stack(found.column(c).to_pandas()) if len(found) else np.zeros((0, 1), np.float32)
    )
    text, metadata = matrix("text"), matrix("metadata")
    has = ~np.isnan(y)
    return co_train(text[has], metadata[has], y[has], text[~has], metadata[~has])


def _scores(model: Model | None, batch_columns: list) -> list[np.ndarray]:
    if model is None:
        return [np.full(len(batch_columns[0]), np.nan)] * 3
    text, source, lang = batch_columns
    views = features(text, source.to_pylist(), lang.to_pylist())
    return [sigmoid(x) for x in model.log_odds(*views)]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, text_score, metadata_score, quality_score, accepted`` of each row.

    Scores are chances of good quality; rows with a ``quality_score`` of ``ACCEPT`` and
    more are accepted. A null text counts as empty, a null source or language is a
    value of its own. Without a model (labels that lack a class) scores are null and
    all rows accepted. Repeated rows stay repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            found = _scores(shared.value, batch.columns[1:])
            arrays = [pa.array(x, pa.float64(), from_pandas=True) for x in found]
            good = pa.array(~(found[2] < ACCEPT))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, good], _SCORED)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_score double, metadata_score double, quality_score double, accepted boolean"
    return docs.select("doc_id", *_inputs(docs)).mapInArrow(score, schema)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are accepted, with all their columns."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, count = docs.schema, len(docs.columns)

    def keep(batches):
        for batch in batches:
            good = _scores(shared.value, batch.columns[count:])[2] >= ACCEPT
            columns = [c.filter(pa.array(good)) for c in batch.columns[:count]]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    own = [F.col(f"`{c}`") for c in docs.columns]
    inputs = [c.alias(free_name(docs.columns, f"_input{k}")) for k, c in enumerate(_inputs(docs))]
    return docs.select(*own, *inputs).mapInArrow(keep, schema)


_SCORED = ["doc_id", "text_score", "metadata_score", "quality_score", "accepted"]
