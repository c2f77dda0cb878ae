"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe the line and its two neighbours; transition weights tie neighbouring
labels. Training labels of lines come from document labels: all lines of good documents are good, and of bad documents
those that a first, line-wise model finds worst. Forward-backward marginals, weighted by line length, give a document's
share of good text, and a logistic curve fitted on the training documents turns that into a score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import fold, keyed, labelled, table

#: Labelled documents that the model is fitted on at most.
LABELLED = 5_000

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_COMMON = b" .,;:'-\t\r\n"
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _COMMON)
_HIGH = bytes(range(128, 256))
_TWICE = re.compile(rb"([^\w\s\x80-\xff])\1")
#: Features of a line; also taken from the line before and the line after.
FEATURES = ("chars", "words", "word length", "upper", "digits", "symbols", "bars", "doubled symbols", "distinct words", "repeats in a row", "upper words", "ends a sentence", "seen before", "short", "long word")


def line_features(lines: list[bytes]) -> np.ndarray:
    seen: set[bytes] = set()
    rows = np.zeros((len(lines), len(FEATURES)), np.float32)
    for k, line in enumerate(lines):
        words = line.split()
        n, size = len(words), max(1, len(line))
        text = line.rstrip()
        rows[k] = (
            math.log1p(len(line)) / 5,
            math.log1p(n) / 4,
            min(20.0, size / max(1, n)) / 10,
            (size - len(line.translate(None, _UPPER))) / size,
            (size - len(line.translate(None, _DIGIT))) / size,
            min(1.0, 5 * (size - len(line.translate(None, _SYMBOL))) / size),
            min(1.0, 10 * line.count(b"|") / size),
            min(1.0, len(_TWICE.findall(line)) / max(1, n)),
            len(set(words)) / max(1, n),
            sum(map(bytes.__eq__, words, words[1:])) / max(1, n),
            sum(w.isupper() and len(w) > 1 for w in words) / max(1, n),
            text.endswith((b".", b"!", b"?", b":", b'"')),
            line in seen,
            n < 4,
            max(map(len, words), default=0) > 30,
        )
        seen.add(line)
    return rows


def lines_of(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.strip()]


def with_neighbours(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Appends the features of the line before and after (zeros and a mark at a document's ends) and a constant."""
    first = np.zeros(len(rows), bool)
    last = np.zeros(len(rows), bool)
    ends = np.cumsum(sizes[sizes > 0])
    first[np.concatenate([[0], ends[:-1]]).astype(int)] = len(rows) > 0
    last[ends - 1] = True
    before, after = np.roll(rows, 1, axis=0), np.roll(rows, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([rows, before, after, first[:, None], last[:, None], np.ones((len(rows), 1), np.float32)])


def marginals(unary: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance that each line is good, expected number of each transition, and the summed log-partition. ``unary`` is the
    log-odds weight of good; all documents go forward and backward together, the longest first."""
    sizes = sizes[sizes > 0]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    ahead, behind = score.copy(), np.zeros_like(score)
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents with more than t lines
    for t in range(1, longest):
        at = starts[: alive[t]] + t
        ahead[at] += np.logaddexp(ahead[at - 1, :1] + move[0], ahead[at - 1, 1:] + move[1])
    for t in range(longest - 1, 0, -1):
        at = starts[: alive[t]] + t
        later = score[at] + behind[at]
        behind[at - 1] = np.logaddexp(later[:, :1] + move[:, 0], later[:, 1:] + move[:, 1])
    ends = starts + sizes - 1
    total = np.zeros(len(unary))
    whole = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    for s, n, z in zip(starts.tolist(), sizes.tolist(), whole.tolist(), strict=True):
        total[s : s + n] = z
    good = np.exp(ahead[:, 1] + behind[:, 1] - total)
    inner = np.ones(len(unary), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(ahead[at - 1][:, :, None] + move + (score[at] + behind[at])[:, None, :] - total[at][:, None, None]).sum(axis=0) if len(at) else np.zeros((2, 2))
    return good, pairs, float(whole.sum())


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    slope: float
    bias: float
    empty: float

    def score(self, docs: list[bytes]) -> np.ndarray:
        parts = [lines_of(d) for d in docs]
        sizes = np.array([len(p) for p in parts])
        if not sizes.sum():
            return np.full(len(docs), self.empty)
        share = self.share(with_neighbours(np.vstack([line_features(p) for p in parts if p]), sizes), sizes, np.array([len(line) for p in parts for line in p]))
        return np.where(np.isnan(share), self.empty, _curve(share, self.slope, self.bias))

    def share(self, rows: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of each document; NaN without lines."""
        good = marginals(rows @ self.weights, self.move, sizes)[0]
        of = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.bincount(of, lengths, len(sizes))
        with np.errstate(invalid="ignore"):
            return np.bincount(of, good * lengths, len(sizes)) / weight


def _curve(share: np.ndarray, slope: float, bias: float) -> np.ndarray:
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return 1 / (1 + np.exp(-np.clip(slope * np.log(share / (1 - share)) + bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, penalty: float = 1e-3) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w


def fit_lines(rows: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 150) -> Model:
    """The field's weights by gradient ascent on the conditional likelihood of the derived line labels."""
    rows = rows.astype(np.float64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    weight = lengths / np.maximum(1, np.bincount(of, lengths, len(sizes))[of])  # each document counts alike
    balance = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    first = _logistic(rows, labels[of].astype(float), weight * balance[of])
    chance = 1 / (1 + np.exp(-np.clip(rows @ first, -30, 30)))
    worst = np.full(len(sizes), np.inf)
    np.minimum.at(worst, of, chance)
    good = (labels[of] == 1) | (chance > 0.5) & (chance > worst[of])
    w, move = first.copy(), np.zeros((2, 2))
    inner = np.concatenate([[False], of[1:] == of[:-1]])
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[at - 1].astype(int), good[at].astype(int)), 1)
    rate, squares = 0.05, [np.zeros_like(w), np.zeros((2, 2))]
    for _ in range(rounds):
        p, pairs, _ = marginals(rows @ w, move, sizes)
        for value, slope, square in ((w, rows.T @ (good - p) / len(rows) - 1e-5 * w, squares[0]), (move, (seen - pairs) / len(rows) - 1e-5 * move, squares[1])):
            square += slope**2
            value += rate * slope / (np.sqrt(square) + 1e-8)
    model = Model(w, move, 1.0, 0.0, float(labels.mean()))
    share = model.share(rows, sizes, lengths)
    some = ~np.isnan(share)
    clipped = np.clip(share[some], 1e-3, 1 - 1e-3)
    x = np.stack([np.log(clipped / (1 - clipped)), np.ones(some.sum())], axis=1)
    model.slope, model.bias = _logistic(x, labels[some].astype(float), np.ones(some.sum()), penalty=1e-2)
    none = labels[~some]
    model.empty = float((none.sum() + labels.mean()) / (len(none) + 1))
    return model


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, most: int = LABELLED) -> Model:
    """Fits on a sample of at most ``most`` labelled documents for which ``use`` (of ``labels``) holds. Only features of
    their lines come to the driver. Without labels, everything scores one half."""

    def describe(batches):
        for batch in batches:
            parts = [lines_of(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([line_features(p).tobytes() for p in parts], pa.binary()), pa.array([[len(x) for x in p] for p in parts], pa.list_(pa.int32()))], ["y", "features", "lengths"])

    sample = labelled(docs, labels, "quality", F.lit(True) if use is None else use, most)
    got = sample.select("text", "y").mapInArrow(describe, "y int, features binary, lengths array<int>").collect()
    got.sort(key=lambda r: (r.y, bytes(r.features)))  # so that the fit doesn't depend on the order of rows
    sizes = np.array([len(r.lengths) for r in got], np.int64)
    width = len(FEATURES)
    if not sizes.sum() or len({r.y for r in got}) < 2:
        share = float(np.mean([r.y for r in got])) if got else 0.5
        return Model(np.zeros(3 * width + 3), np.zeros((2, 2)), 0.0, math.log((share + 0.01) / (1.01 - share)), share)
    rows = np.frombuffer(b"".join(bytes(r.features) for r in got), np.float32).reshape(-1, width)
    lengths = np.concatenate([np.array(r.lengths, np.int64) for r in got])
    return fit_lines(with_neighbours(rows, sizes), sizes, lengths, np.array([r.y for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, t, score`` of each row's whole text. Texts without lines (null, empty, blank) get the rate of such texts
    among the training rows. Repeated rows score alike, an empty table stays empty, other columns are not read."""

    def rate(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.score(part.column(2).cast(pa.binary()).to_pylist()))], ["doc_id", "t", "score"])

    return keyed(docs).mapInArrow(rate, "doc_id long, t long, score double")


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
