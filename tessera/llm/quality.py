"""Quality grades by ordinal cumulative-link regression on hashed text.

All grades share one weight vector over hashed features; ordered thresholds
turn its score s into P(grade >= k) = sigmoid(s - theta_k). A document gets its
expected grade and those tail probabilities, and is kept if the tail
probability of a chosen grade is at least one half.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import chunks, map_chunks
from tessera.llm.ngram_join import EACH_BYTE, FOLDED_BYTE, hash_words, mix, words_of
from tessera.llm.toxicity import training_rows

BITS = 15
#: Signs of a word's shape that count: runs of capitals, other letters, digits and equal signs are one each.
SHAPE_SIGNS = 12
#: Kind of each byte: 1 letters and what is not ASCII, 2 capitals, 3 digits, else the sign itself.
_KIND = np.array([2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 1 if 97 <= b <= 122 or b >= 128 or b == 95 else b for b in range(256)], dtype=np.uint8)
#: A random value of each kind at each place of a shape.
_SIGNS = mix(np.arange(1, 256 * SHAPE_SIGNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(256, SHAPE_SIGNS)


def _ids(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _named(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    kind = _KIND[data]
    first = np.append(True, kind[1:] != kind[:-1])
    first[starts] = True
    at = np.cumsum(first)
    inside = np.repeat(np.arange(len(starts)), ends - starts)
    where = np.repeat(starts, ends - starts) + np.arange(len(inside)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    place = at[where] - at[starts][inside]
    kept = first[where] & (place < SHAPE_SIGNS)
    total = np.append(np.uint64(0), np.cumsum(_SIGNS[kind[where[kept]], place[kept]], dtype=np.uint64))
    stops = np.cumsum(np.bincount(inside[kept], minlength=len(starts)))
    return mix(total[stops] - total[np.append(0, stops[:-1])]) if len(starts) else np.zeros(0, dtype=np.uint64)


def _share(part: np.ndarray, whole: np.ndarray, steps: int = 10) -> np.ndarray:
    return np.minimum(steps - 1, (part / whole * steps).astype(np.int64))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its hashed feature ids, ascending, and their values. A text without words has the feature of emptiness alone.

    Features are words (lower-cased in A-Z, as parts of a vector of length 1),
    shapes of words (as shares), and buckets of the shares of repeats, distinct
    words, the most frequent word, capitals and repeated lines, of the words'
    mean length and their number.
    """
    data, starts, ends, n = words_of([t.encode("utf-8", "surrogatepass") for t in texts])
    doc = np.repeat(np.arange(len(texts)), n)
    exact = hash_words(data, starts, ends, EACH_BYTE)
    words, shapes = _ids(hash_words(data, starts, ends, FOLDED_BYTE)), _ids(_shapes(data, starts, ends))
    full = np.maximum(1, n)

    def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, c = np.unique(doc << BITS | ids, return_counts=True)
        return pairs >> BITS, pairs & ((1 << BITS) - 1), c.astype(np.float64)

    in_doc, word, c = counted(words)
    norm = np.sqrt(np.bincount(in_doc, c * c, minlength=len(texts)))
    parts = [(in_doc, word, c / norm[in_doc])]
    in_doc, form, c = counted(shapes)
    parts.append((in_doc, form, c / full[in_doc]))

    order = np.lexsort((exact, doc))
    new = np.append(True, (exact[order][1:] != exact[order][:-1]) | (doc[order][1:] != doc[order][:-1]))[: len(order)]
    firsts = np.flatnonzero(new)
    distinct = np.bincount(doc[order][firsts], minlength=len(texts))
    most = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, doc[order][firsts], np.diff(np.append(firsts, len(order))))
    repeats = np.bincount(doc[1:][(exact[1:] == exact[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
    heads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    length = np.bincount(doc, heads[ends] - heads[starts], minlength=len(texts))
    upper, lower = (np.append(0, np.cumsum((data >= a) & (data <= a + 25))) for a in (65, 97))
    capitals = np.bincount(doc[(upper[ends] > upper[starts]) & (lower[ends] == lower[starts])], minlength=len(texts))
    lines = [t.split("\n") for t in texts]
    buckets = {
        "r": _share(repeats, full), "d": _share(distinct, full), "t": _share(most, full), "l": _share(length / 20, full), "u": _share(capitals, full),
        "n": np.minimum(12, np.frexp(n.astype(np.float64))[1]), "m": _share(np.array([len(x) - len(set(x)) for x in lines], dtype=np.float64), np.array([max(1, len(x)) for x in lines])),
    }
    there = np.flatnonzero(n > 0)
    for name, bucket in buckets.items():
        ids = np.array([_named(f"{name}{k}") for k in range(13)])
        parts.append((there, ids[bucket[there]], np.ones(len(there))))
    none = np.flatnonzero(n == 0)
    parts.append((none, np.full(len(none), _named("empty")), np.ones(len(none))))

    pairs, where = np.unique(np.concatenate([d << BITS | i for d, i, _ in parts]), return_inverse=True)
    values = np.bincount(where, np.concatenate([v for _, _, v in parts]), minlength=len(pairs)).astype(np.float32)
    cuts = np.searchsorted(pairs >> BITS, np.arange(len(texts) + 1))
    ids = (pairs & ((1 << BITS) - 1)).astype(np.int32)
    return [(ids[a:b], values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than the grades

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text, one row each."""
        s = np.array([(self.weights[ids] * values).sum(dtype=np.float64) for ids, values in features(texts)], dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, rounds: int = 250, ridge: float = 2e-5, step: float = 0.08) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam over the whole sample; the classes weigh alike up to a square root."""
    theta = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(max(1, grades - 1))
    if not rows:
        return OrdinalModel(np.zeros(1 << BITS, dtype=np.float64), theta - 3.0)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    ids, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    y = np.array([r[2] for r in rows])
    share = np.bincount(y, minlength=grades) / len(y)
    weight = 1 / np.sqrt(np.maximum(share[y], 1e-9))
    weight /= weight.sum()
    params = np.concatenate([np.zeros(1 << BITS), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    dim = 1 << BITS
    for t in range(1, rounds + 1):
        gaps = np.exp(params[dim + 1 :])
        theta = params[dim] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(at, params[ids] * values, minlength=len(rows))
        cum = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -30, 30)))
        full = np.concatenate([np.ones((len(y), 1)), cum, np.zeros((len(y), 1))], axis=1)
        p = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-12)
        slope = cum * (1 - cum)
        # d log p / d eta_k for eta_k = s - theta_k: + at the grade's own threshold, - at the next
        own, nxt = np.zeros_like(cum), np.zeros_like(cum)
        rows_up, rows_dn = np.flatnonzero(y > 0), np.flatnonzero(y < grades - 1)
        own[rows_up, y[rows_up] - 1] = 1.0
        nxt[rows_dn, y[rows_dn]] = 1.0
        d = (own - nxt) * slope * (weight / p)[:, None]
        grad = np.zeros_like(params)
        grad[:dim] = -np.bincount(ids, (d.sum(1))[at] * values, minlength=dim) + ridge * params[:dim]
        to_theta = d.sum(0)
        grad[dim] = to_theta.sum()
        for j in range(len(gaps)):
            grad[dim + 1 + j] = to_theta[j + 1 :].sum() * gaps[j]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params = params - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = params[dim] + np.concatenate([[0.0], np.cumsum(np.exp(params[dim + 1 :]))])
    return OrdinalModel(params[:dim], theta)


def learn(rows: DataFrame, grades: int) -> OrdinalModel:
    """Fit on rows (text, y): a sample whose size the caller bounds. Grades outside 0 .. grades - 1 are left out."""

    def extract(batches):
        import pyarrow.compute  # noqa: F401

        for b in chunks(batches):
            found = features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"y": b.column("y"), "ids": pa.array([f[0].tobytes() for f in found], pa.binary()), "vals": pa.array([f[1].tobytes() for f in found], pa.binary())})

    got = rows.filter(F.col("y").between(0, grades - 1)).mapInArrow(extract, "y int, ids binary, vals binary").collect()
    got = sorted(got, key=lambda r: (r["y"], bytes(r["ids"]), bytes(r["vals"])))  # the fit doesn't depend on the order of partitions
    return fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32), r["y"]) for r in got], grades)


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 poor, 1 sound but toxic, 2 sound."""
    good, toxic = F.coalesce(F.col("quality"), F.lit(0)), F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", F.when(good == 0, 0).when(toxic == 1, 1).otherwise(2).alias("grade"))


def grade_documents(documents: DataFrame, ratings: DataFrame, grades: int = 3, select_at: int = 1, fit_rows: int = 6_000, keep=None) -> DataFrame:
    """(doc_id, expected_grade, p_at_least_1 .., accepted) of every document.

    ratings: (doc_id, grade 0 .. grades - 1), of which about fit_rows, chosen by
    a hash of the id, fit the model. accepted: P(grade >= select_at) >= 0.5.
    Null texts count as empty; null ids and repeated rows are kept; an empty
    table gives no rows; without ratings every document is accepted.
    """
    keep = F.lit(True) if keep is None else keep
    model = learn(training_rows(documents, ratings, "grade", keep, fit_rows, "doc_id", "text"), grades)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        tails = model.tails(part.column("text").to_pylist())
        columns = [part.column("doc_id"), pa.array(tails.sum(axis=1), pa.float64()), *(pa.array(tails[:, k], pa.float64()) for k in range(grades - 1))]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "expected_grade", *(f"p_at_least_{k}" for k in range(1, grades))]
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names[1:])
    return map_chunks(rows, run, schema).withColumn("accepted", F.col(f"p_at_least_{select_at}") >= 0.5)


def keep_accepted(documents: DataFrame, ratings: DataFrame, grades: int = 3, select_at: int = 1, fit_rows: int = 6_000) -> DataFrame:
    """The accepted documents with all their columns, judged in place: no join on ids.

    Null texts count as empty; null ids and repeated rows stay or go like any;
    an empty table gives no rows; without ratings every document is accepted.
    """
    model = learn(training_rows(documents, ratings, "grade", F.lit(True), fit_rows, "doc_id", "text"), grades)
    schema = documents.schema

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        good = model.tails([t or "" for t in part.column("text").to_pylist()])[:, select_at - 1] >= 0.5
        return part.filter(pa.array(good, pa.bool_()))

    return map_chunks(documents, run, schema)
