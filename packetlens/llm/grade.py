"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's score is the sum of the weights of its distinct hashed features
(words, punctuation patterns, and buckets of simple rates); the chance of grade
k or better is ``sigmoid(score - threshold k)`` with rising thresholds, so all
grades share one set of weights. From it come the expected grade and the tail
probability that decides the selection.

The model is fitted in one task on at most ``max_rated`` rated documents, those
with the least hash of their id (a bounded sample by contract; a document gives
at most ``FEATURES`` numbers), by accelerated proximal gradient with an L1 term,
which leaves weights of chance words at zero. Scoring reads every document;
only the weights (``FEATURES`` floats) are broadcast.

Defined results: null text has no words; ratings of absent documents and
ratings with nulls are left out; with no ratings all weights are zero and the
thresholds are even; repeated rows are scored alike; texts of any length are read
whole; an empty table gives an empty result; other columns aren't read, so none
can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import let, prepare, words

FEATURES = 1 << 18
MAX_RATED = 20_000


def features(text: Column) -> Column:
    """Distinct feature numbers of a text."""
    body = F.coalesce(text, F.lit(""))
    number = lambda x: F.pmod(F.xxhash64(x), F.lit(FEATURES)).cast("int")
    hashed = lambda xs, kind: F.transform(xs, lambda x: number(F.concat(F.lit(kind), x)))
    letters = hashed(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), "w:")
    signs = hashed(F.array_distinct(F.regexp_extract_all(body, F.lit(r"[^\p{L}\p{N}\s]+"), F.lit(0))), "p:")

    def rates(ws: Column) -> Column:
        n = F.greatest(F.size(ws), F.lit(1))
        again = F.size(F.filter(ws, lambda w, i: w == F.get(ws, i - 1)))
        distinct = F.size(F.array_distinct(ws))
        rate = lambda name, x, steps: number(F.concat(F.lit(name), F.floor(x * steps / n).cast("string")))
        return F.array(
            rate("same:", again, 5), rate("distinct:", distinct, 10),
            rate("upper:", F.regexp_count(body, F.lit(r"\p{Lu}")), 2), rate("sign:", F.regexp_count(body, F.lit(r"[^\p{L}\p{N}\s]")), 4),
            number(F.concat(F.lit("length:"), F.floor(F.log2(F.size(ws) + 1)).cast("string"))))

    return F.array_distinct(F.concat(letters, signs, let(words(text), rates)))


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: two judgements (good text, not toxic) make the grades 0, 1, 2."""
    grade = F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grade: np.ndarray, top: int, steps: int = 200, l1: float = 6e-4,
                least_docs: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model for grades 0..top."""
    weights, cuts = np.zeros(FEATURES), np.linspace(-1.0, 1.0, top) if top > 1 else np.zeros(top)
    if not len(rows):
        return weights, cuts
    n = len(rows)
    flat = np.concatenate(rows)
    count = np.bincount(flat, minlength=FEATURES)
    used = np.flatnonzero(count >= least_docs)  # words of a few documents say nothing about others
    place = np.full(FEATURES, -1)
    place[used] = np.arange(len(used))
    size = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(n), size)
    owner, flat = owner[place[flat] >= 0], place[flat[place[flat] >= 0]]
    width = np.bincount(owner, minlength=n) + 1
    # a step per weight: the curvature of a row is at most 1/2 times its width
    step = 1 / (np.bincount(flat, weights=width[owner] * 0.5, minlength=len(used)) / n + 1e-9)
    w = np.zeros(len(used))
    reach = np.clip(np.array([(grade >= k).mean() for k in range(1, top + 1)]), 1e-4, 1 - 1e-4)
    cuts = -np.log(reach / (1 - reach))
    cuts = np.maximum.accumulate(cuts + np.arange(top) * 1e-3)
    cut_step = 1 / (0.5 * np.average(width))
    at_w, at_c, t = w.copy(), cuts.copy(), 1.0
    ks = np.arange(1, top + 1)
    for _ in range(steps):
        s = np.bincount(owner, weights=at_w[flat], minlength=n)
        p = _sigmoid(s[:, None] - at_c[None, :])  # P(grade >= k)
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        here, above = full[np.arange(n), grade], full[np.arange(n), grade + 1]
        up = np.where(grade > 0, here * (1 - here), 0.0)
        down = np.where(grade < top, above * (1 - above), 0.0)
        chance = np.maximum(here - above, 1e-9)
        by_score = -(up - down) / chance
        by_cut = np.array([np.sum(np.where(grade == k, up / chance, 0.0) - np.where(grade == k - 1, down / chance, 0.0)) for k in ks]) / n
        new = at_w - step * np.bincount(flat, weights=by_score[owner], minlength=len(used)) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_cuts = np.maximum.accumulate(at_c - cut_step * by_cut + np.arange(top) * 1e-9)
        turn = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w, at_c = new + (t - 1) / turn * (new - w), new_cuts + (t - 1) / turn * (new_cuts - cuts)
        at_c = np.maximum.accumulate(at_c)
        w, cuts, t = new, new_cuts, turn
    weights[used] = w
    return weights, cuts


def fit(docs: DataFrame, rated: DataFrame, top: int = 2, max_rated: int = MAX_RATED, **options) -> tuple[np.ndarray, np.ndarray]:
    """Fit on ``rated`` rows of ``doc_id, grade``."""
    chosen = rated.dropDuplicates(["doc_id", "grade"]).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_rated)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rated short rows
    numbers = sample.select(features(F.col("text")).alias("x"), F.col("grade").cast("int").alias("grade"), F.xxhash64("doc_id", "text").alias("o"))

    def run(batches):
        rows, grade = [], []
        for b in batches:
            x = b.column(0)
            ends = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])
            flat = x.flatten().to_numpy(zero_copy_only=False)
            rows += [flat[a:z].copy() for a, z in zip(ends[:-1], ends[1:])]
            grade += b.column(1).to_pylist()
        weights, cuts = fit_ordinal(rows, np.array(grade, int), top, **options)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary()), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    ordered = numbers.repartition(1).sortWithinPartitions("o").select("x", "grade")
    model = ordered.mapInArrow(run, "weights binary, cuts binary").first()
    if model is None:  # no rated document at all
        return fit_ordinal([], np.array([], int), top)
    return np.frombuffer(model["weights"]), np.frombuffer(model["cuts"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], select_grade: int = 2, least: float = 0.5,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail_probability`` (of ``select_grade`` or better) and ``kept`` per document."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    cuts = model[1]
    src = docs.select(F.col(key).alias("doc_id"), features(F.col(text)).alias("x"))

    def run(batches):
        for b in batches:
            x = b.column(1)
            ends = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])
            # each row is summed by itself, so its score doesn't depend on the rows around it
            s, some = np.zeros(b.num_rows), np.flatnonzero(np.diff(ends))
            if len(some):
                s[some] = np.add.reduceat(weights.value[x.flatten().to_numpy(zero_copy_only=False)], ends[some])
            s = np.round(s, 9)
            p = _sigmoid(s[:, None] - cuts[None, :])
            tail = p[:, select_grade - 1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(tail), pa.array(tail >= least)],
                                             names=["doc_id", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def graded_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    prepare(docs.sparkSession)
    return score(docs, fit(docs, grades(labels)), **options)
