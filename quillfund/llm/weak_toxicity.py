"""Toxicity by weak supervision.

Voters are words (lexicon) and word beginnings (patterns): those of a fixed lexicon, and those that labelled training rows
show far more often in toxic texts than chance would (a lexicon alone would miss whole languages). Each votes "toxic" where
it occurs and abstains elsewhere; one more votes "clean" where all others abstain. A generative label model then estimates,
without labels, how often each voter fires on toxic and on other texts: correlated voters (which fire together beyond what
the class explains) are tied into blocks that vote once, and expectation-maximisation fits the rates of the blocks and the
share of toxic texts. Its posteriors train a linear classifier on the voters, which scores whole texts with one automaton pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import drop_rows, fold, keyed, labelled, table, written

#: Labelled documents that the model is fitted on at most.
LABELLED = 20_000
#: Voters at most, by significance; and lengths of word beginnings.
VOTERS = 400
BEGINNINGS = range(3, 9)
#: Texts whose candidate voters are held in memory at once.
SLICE = 500
#: A voter is right more often than this.
PRECISION = 0.9
# A lexicon of insults that vote wherever they occur in the sample, unless labels contradict them.
LEXICON = (
    "idiot moron imbecile stupid dumb fool loser scum trash garbage clown jerk bastard pathetic worthless disgusting "
    "vermin filth pig bitch whore asshole dumbass retard scumbag idioten trottel arschloch abschaum wichser dreckskerl "
    "schlampe hurensohn connard connasse salope salaud ordure imbécile crétin idiota imbécil estúpido gilipollas cabrón "
    "puta basura escoria"
).split()
# End of fixed values.
#: Highest chance of a voter's record, multiplied by the number of candidates.
CHANCE = 0.05
#: Voters whose votes correlate beyond this within a class are tied into one block.
CORRELATED = 0.8

_SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def spelled(text: str) -> bytes:
    """Lower-cased words in UTF-8 with a space on both sides of each."""
    return b" " + text.lower().encode("utf-8", "replace").translate(_SEPARATORS) + b" "


def signs(text: str) -> set[bytes]:
    """Candidate voters of a text: ``b" word "`` and ``b" begin"``, for beginnings shorter than the word."""
    words = set(spelled(text).split())
    found = {b" " + w + b" " for w in words}
    for size in BEGINNINGS:
        found |= {b" " + w[:size] for w in words if len(w) > size}
    return found


@dataclass
class Model:
    voters: list[bytes] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    accuracy: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    blocks: list[list[int]] = field(default_factory=list)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for k, sign in enumerate(self.voters):
            found.add_word(sign.decode("latin-1"), k)
        found.make_automaton()
        return found

    def score(self, text: str, automaton: ahocorasick.Automaton) -> float:
        fired = {k for _, k in automaton.iter(spelled(text).decode("latin-1"))} if len(automaton) else ()
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(self.weights[k] for k in fired)))))


def one_of_each(sample: DataFrame, words: int = 5) -> DataFrame:
    """``text, y`` without copies: of rows whose shingles of five words have the same smallest hash (as near copies nearly
    always do), that with the smallest text hash. Else the words of one copied text would look like evidence."""

    def smallest(text: str) -> int:
        parts = spelled(text).split()
        return min((xxhash.xxh64_intdigest(b" ".join(parts[k : k + words])) >> 1 for k in range(max(1, len(parts) - words + 1))), default=0)

    def least(batches):
        for batch in batches:
            near = [smallest(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], ["text", "y", "near"])

    rows = sample.select("text", "y").mapInArrow(least, "text string, y int, near long")
    return rows.groupBy("near").agg(F.min_by(F.struct("text", "y"), F.struct(F.xxhash64("text"), "y")).alias("row")).select("row.text", "row.y")


def induce(sample: DataFrame, voters: int = VOTERS) -> list[bytes]:
    """The most significant voters: their documents' share of toxic ones is far above that of the sample."""

    def count(batches):
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                seen: dict[bytes, list[int]] = {}
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for sign in signs(text):
                        seen.setdefault(sign, [0, 0])[y] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["sign", "clean", "toxic"])

    totals = dict(sample.groupBy("y").count().collect())
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not toxic or not clean:
        return []
    rate = toxic / (toxic + clean)
    counts = sample.select("text", "y").mapInArrow(count, "sign binary, clean long, toxic long").groupBy("sign").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = F.col("clean") + F.col("toxic")
    share = F.col("toxic") / n
    # Chernoff's bound on a share this high or higher by chance.
    divergence = share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    counts = written(counts.where("toxic > 0").withColumn("evidence", n * divergence), "signs")
    candidates = max(1, counts.count())
    known = F.col("sign").isin([bytearray(f" {word} ".encode()) for word in LEXICON])
    best = counts.where(share > max(PRECISION, rate)).where(known | (F.col("evidence") > math.log(candidates / CHANCE))).orderBy(F.desc("evidence"), "sign").limit(voters)
    return [bytes(r.sign) for r in best.collect()]


def votes(sample: DataFrame, model: Model) -> np.ndarray:
    """The vote matrix of the sample (at most ``LABELLED`` rows of ``VOTERS`` bits)."""
    signs_, size = model, len(model.voters)

    def fire(batches):
        automaton = signs_.automaton()
        for batch in batches:
            fired = [sorted({k for _, k in automaton.iter(spelled(t).decode("latin-1"))}) if size else [] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32()))], ["fired"])

    rows = sample.select("text").mapInArrow(fire, "fired array<int>").collect()
    matrix = np.zeros((len(rows), size), bool)
    for r, row in enumerate(rows):
        matrix[r, row.fired] = True
    return matrix


def label_model(matrix: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Posterior of each row, rates of each block among toxic and other rows, and the blocks. No labels are used.

    A voter that is silent abstains (most are bound to a language). Rows on which all are silent have the vote of one more
    voter, which says "clean" and whose rates are estimated like those of the others, as is the share of toxic rows."""
    y = matrix.any(axis=1).astype(float)
    blocks = _blocks(matrix, y)
    joint = np.stack([matrix[:, b].any(axis=1) for b in blocks] + [y == 0], axis=1).astype(float)
    for _ in range(rounds):
        prior = float(np.clip(y.mean(), 1e-3, 0.5))
        toxic = (joint.T @ y + 1) / (y.sum() + 2)
        other = (joint.T @ (1 - y) + 0.05) / ((1 - y).sum() + 2)
        toxic[-1], other[-1] = (joint[:, -1] @ y + 0.05) / (y.sum() + 2), (joint[:, -1] @ (1 - y) + 1) / ((1 - y).sum() + 2)
        other[:-1] = np.minimum(other[:-1], toxic[:-1] * 0.9)  # a voter votes "toxic"
        toxic[-1] = min(toxic[-1], other[-1] * 0.9)
        y = posterior(joint, toxic, other, prior)
    return y, toxic[:-1], other[:-1], blocks


def posterior(joint: np.ndarray, toxic: np.ndarray, other: np.ndarray, prior: float) -> np.ndarray:
    """The chance that each row is toxic, given who voted; abstentions say nothing."""
    logit = math.log(prior / (1 - prior)) + joint @ np.log(toxic / other)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _blocks(matrix: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """Voters tied by their correlation among the rows that seem toxic (where others don't vote at all)."""
    rows = matrix[y > 0.5].astype(float)
    spread = rows - rows.mean(axis=0)
    scale = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    related = (spread.T @ spread) / np.outer(scale, scale) > CORRELATED
    block = np.arange(matrix.shape[1])
    while (block != (lower := np.where(related, block[None, :], matrix.shape[1]).min(axis=1).clip(max=block))).any():
        block = lower
    return [np.flatnonzero(block == b).tolist() for b in np.unique(block)]


def train(matrix: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    x = np.hstack([matrix, np.ones((len(matrix), 1))])
    w = np.zeros(x.shape[1])
    step = 4 / max(1.0, np.linalg.norm(x, 2) ** 2 + penalty)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = x.T @ (p - y) + penalty * np.append(ahead[:-1], 0)
        fresh, grown = ahead - step * slope, (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = fresh + (t - 1) / grown * (fresh - w), fresh, grown
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, most: int = LABELLED) -> Model:
    """Fits on a sample of at most ``most`` labelled rows for which ``use`` (of ``labels``) holds.

    Without toxic or clean rows, or without significant voters, the model finds nothing toxic."""
    sample = written(labelled(docs, labels, "toxic", F.lit(True) if use is None else use, most), "labelled")
    sample = written(one_of_each(sample), "distinct-labelled")
    model = Model(voters=induce(sample))
    if not model.voters:
        return model
    matrix = votes(sample, model)
    y, toxic, other, blocks = label_model(matrix)
    model.weights, model.bias = train(matrix, y)
    model.blocks = blocks
    model.accuracy = {model.voters[k]: (float(toxic[b]), float(other[b])) for b, block in enumerate(blocks) for k in block}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, t, score`` of each row's whole text; null and empty texts get the score of a text without votes."""

    def rate(batches):
        automaton = model.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([model.score(t, automaton) for t in batch.column(2).to_pylist()], pa.float64())], ["doc_id", "t", "score"])

    return keyed(docs).mapInArrow(rate, "doc_id long, t long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more."""
    return drop_rows(docs, score(docs, fit(docs, labels, use)).where("score >= 0.5").select("doc_id", "t").distinct())


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
