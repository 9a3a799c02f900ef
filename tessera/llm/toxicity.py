"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, accents, homoglyphs, invisible characters and
digit or sign substitutions inside words. The lexicon holds folded word heads
(" los") and whole words (" loser ") with log-odds weights learned from
labelled documents; hits inside exception phrases don't count. The summed
weight, normalised by length, goes through a fitted logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import map_chunks
from tessera.operators.components import checkpointed

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгеёзіїјкмнорстухѕԁһӏɡαβεικνορτυχγωаᴏ", "abbreezlijkmhopctyxsdhlgabeikvoptuxywao", strict=True))
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
#: Harmless phrases around words that can insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "pond scum", "soap scum", "sore loser")
MIN_HEAD, MAX_HEAD = 3, 8
#: Least weights of patterns among which the fit chooses.
LEAST_WEIGHTS = (2.0, 3.0, 4.0)

_SUBSTITUTED = re.compile(r"[0134578@$!|+](?=[^\W\d_])|(?<=[^\W\d_])[0134578@]")
_APART = re.compile(r"[\W_]+")
_MARKS = re.compile(r"[̀-ͯ­​-‏⁠﻿]+")
_LOOK = str.maketrans(HOMOGLYPHS | {"l": "i"})
_LOOK_ASCII = str.maketrans({"l": "i"})


def fold(text: str) -> str:
    """Folded words, one space before, between and after them. l, i and what stands for them become one letter."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
        t = t.translate(_LOOK)
    for _ in range(2):
        if not _SUBSTITUTED.search(t):
            break
        t = _SUBSTITUTED.sub(lambda m: SUBSTITUTES[m[0]], t)
    return " " + _APART.sub(" ", t).strip().translate(_LOOK_ASCII) + " "


def patterns(folded: str) -> set[str]:
    """The word heads and whole words of a folded text."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= MIN_HEAD:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(MIN_HEAD, min(len(w), MAX_HEAD + 1)))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = -3.0

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for e in self.exceptions:
            found.add_word(p := fold(e), (len(p), None))
        found.make_automaton()
        return found

    def measure(self, matcher, folded: str) -> float:
        """Summed weight of the patterns hit, the heaviest at each word, by length. A pattern counts once, as it was weighed by documents."""
        hits: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in matcher.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif folded[end] == " " or folded[end + 1] != " ":  # a head needs more of the word
                hits[start] = max((weight, size), hits.get(start, (0.0, 0)))
        once = {folded[at : at + size]: w for at, (w, size) in hits.items() if not any(a <= at < b for a, b in spared)}
        total = math.fsum(once.values())
        return total / math.log(math.e + folded.count(" ") / 200) if total else 0.0

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, min_toxic: int = 3, min_weight: float = 3.0, sure: float = 8.0) -> dict[str, float]:
    """Weights of the patterns that tell: log-odds of toxic to clean documents, less for those that chance may have made.

    The weight is full where chance would put so many toxic documents under the
    pattern with a probability of 10 ** -sure or less. A head gives way to a longer pattern that is in nearly the same documents;
    a longer pattern goes if a head kept weighs about as much.
    """
    kept = {}
    for p, t, c in counts:
        w = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
        # Chernoff bound of the chance of t toxic documents of t + c
        base = toxic / (toxic + clean)
        chance = -t * math.log10(base) - (c * math.log10(1 - base) if c else 0.0) - (math.lgamma(t + c + 1) - math.lgamma(t + 1) - math.lgamma(c + 1)) / math.log(10)
        if t >= min_toxic and w >= min_weight and chance > 0:
            kept[p] = (t, c, w * min(1.0, chance / sure))
    heads = {p: [p[:k] for k in range(MIN_HEAD + 1, len(p)) if p[:k] in kept] for p in kept}
    loose = {h for p, hs in heads.items() for h in hs if kept[p][0] >= 0.98 * kept[h][0] and kept[p][1] <= kept[h][1]}
    return {p: w for p, (_, _, w) in kept.items() if p not in loose and not any(h not in loose and w <= kept[h][2] + 0.3 for h in heads[p])}


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps."""
    a = np.column_stack([x, np.ones_like(x)])
    beta = np.array([0.5, -3.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.05, float(beta[0])), float(beta[1])


def training_rows(documents: DataFrame, labels: DataFrame, label: str, keep, fit_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of about fit_rows labelled documents, chosen by a hash of the id; the ids joined are a bounded broadcast."""
    rows = labels.filter(keep & F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    share = max(1, rows.count())
    rows = rows.filter(F.pmod(F.xxhash64("_id", F.lit("fit")), F.lit(share)) < fit_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.col(id_col).alias("_id"), text.alias("text")).join(F.broadcast(rows), "_id").select("text", F.col("_y").alias("y"))


def learn_lexicon(rows: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from rows (text, y) with y 1 for toxic; empty if a class is missing. All patterns that tell are in it; the caller's bound on the rows bounds them.

    The patterns come from three quarters of the rows; the rest give the curve
    and choose the least weight of a pattern.
    """
    quarter = F.pmod(F.xxhash64("text", F.lit("curve")), F.lit(4))
    rows, rest = rows.filter(quarter != 0), rows.filter(quarter == 0)

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen.update((p, int(y == 1)) for p in patterns(fold(text)))
                seen["", int(y == 1)] += 1
        names = sorted({p for p, _ in seen})
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(names, pa.string()), "t": pa.array([seen[p, 1] for p in names], pa.int64()), "c": pa.array([seen[p, 0] for p in names], pa.int64())})

    counts = rows.mapInArrow(count, "pattern string, t long, c long").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = checkpointed(counts)
    totals = counts.filter("pattern = ''").first()
    if totals is None or not totals["t"] or not totals["c"]:
        return Lexicon({}, exceptions)
    toxic, clean = totals["t"], totals["c"]
    # as `choose` weighs them: no pattern below the least weight is worth the way to the driver
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    found = sorted(tuple(r) for r in counts.filter((F.col("pattern") != "") & (F.col("t") >= 3) & (weight >= min(LEAST_WEIGHTS) - 1e-6)).collect())
    tried = [Lexicon(choose(found, toxic, clean, min_weight=w), exceptions) for w in LEAST_WEIGHTS]

    def measure(batches):
        matchers = [x.matcher() for x in tried]
        for b in batches:
            folded = [fold(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[x.measure(m, f) for x, m in zip(tried, matchers, strict=True)] for f in folded], pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    points = [(r["x"], r["y"]) for r in rest.mapInArrow(measure, "x array<double>, y int").collect()]
    y = np.array([p[1] == 1 for p in points], dtype=float)
    if len(set(y)) < 2:
        return tried[1]
    best = None
    for k, lexicon in enumerate(tried):
        x = np.array([p[0][k] for p in points])
        slope, offset = calibrate(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30))), 1e-9, 1 - 1e-9)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        if best is None or loss < best[0]:
            best = loss, Lexicon(lexicon.weights, exceptions, slope, offset)
    return best[1]


def score_toxicity(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document; null and empty texts score as texts without a hit."""
    made: list = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(lexicon.matcher())
        x = [lexicon.score(lexicon.measure(made[0], fold(t))) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.float64())], ["doc_id", "score"])

    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_chunks(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    """True for rows that no fit sees: crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, fit_rows: int = 12_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    The lexicon is learned from about fit_rows labelled documents that aren't
    held out (a documented bound); labels repeated for a document count as toxic if one is. Null
    ids, repeated rows and null texts (as empty) are kept; an empty table gives
    no rows; without labels of both classes every score is the same low value.
    """
    lexicon = learn_lexicon(training_rows(documents, labels, "toxic", ~held_out(), fit_rows, "doc_id", "text"), exceptions)
    out = score_toxicity(documents, lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
