"""Order MinHash fingerprints.

Every k-mer of a text is numbered by its occurrence, so that the numbered
k-mers of a text are distinct. Each of `rows` hash functions selects the `size`
numbered k-mers with the least hashes; these are put back into text order and
hashed as a tuple, one signature entry. Two texts share an entry if the same
k-mers are selected in the same order, so the share of equal entries falls with
edits and with moved passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.arrow import small_batches

K, ROWS, SIZE = 8, 32, 2
RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _N
    return x ^ (x >> np.uint64(29))


def multipliers(rows: int) -> np.ndarray:
    """Odd multipliers of the hash functions."""
    return (_mix(np.arange(1, rows + 1, dtype=np.uint64) * _M) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def numbered_kmers(text: str, k: int) -> np.ndarray:
    """A 32-bit hash of each (k-mer, occurrence number), in text order; a shorter text is one k-mer, an empty one none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    k = min(k, n)
    h = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ points[j : n - k + 1 + j]) * _M
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    index = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.append(True, ranked[1:] != ranked[:-1]), index, 0))
    occurrence = np.empty(len(h), dtype=np.uint64)
    occurrence[order] = (index - first).astype(np.uint64)
    return (_mix(h + occurrence * _N) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str, k: int = K, rows: int = ROWS, size: int = SIZE) -> np.ndarray:
    """`rows` signature entries of 32 bits; an empty text has zeros."""
    base = numbered_kmers(text, k)
    out = np.zeros(rows, dtype=np.uint32)
    if not len(base):
        return out
    take = min(size, len(base))
    picked = np.empty((rows, take), dtype=np.int64)
    for j, odd in enumerate(multipliers(rows)):
        h = base * odd
        for t in range(take):
            picked[j, t] = at = h.argmin()
            h[at] = 0xFFFFFFFF
    chosen = base[np.sort(picked, axis=1)].astype(np.uint64)
    value = np.arange(1, rows + 1, dtype=np.uint64) * _M
    for t in range(take):
        value = _mix((value ^ chosen[:, t]) * _M)
    return ((value >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _text(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def walk(batches: Iterator[pa.RecordBatch], k: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, ghost, doc_id, text), sorted: each row that isn't a ghost is compared with the row after it in its part."""
    held = None
    out: list[tuple] = []
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, ids) for i, c in enumerate(zip(*out, strict=True))], names)
        out.clear()
        return batch

    ids = None
    last: dict = {}
    for batch in batches:
        ids = batch.schema.field("doc_id").type
        for part, ghost, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")), strict=True):
            prints = last["prints"] if last.get("text") == text else fingerprint(text, k, rows, size)
            last = {"text": text, "prints": prints}
            if held is not None and held[0] == part:
                _, id_, before, old = held
                changed = edited(before, text)
                new = old if changed == before else fingerprint(changed, k, rows, size)
                out.append((id_, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), _text(old), _text(new), likeness(old, new), likeness(old, prints)))
                if len(out) >= 2000:
                    yield flush()
            held = None if ghost else (part, doc, text, prints)
    if out:
        yield flush()


def _splits(rows: DataFrame, parts: int, whole: bool) -> list:
    """At most parts - 1 keys that cut the order into ranges of about equal numbers of rows."""
    if whole:
        return rows.agg(F.percentile_approx(F.col("key").cast("double"), [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    # other ids: those of least hash, at most 100 for each range, stand for all; they set nothing but the ranges
    some = sorted(r["key"].encode("utf-8", "surrogatepass") for r in rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(100 * parts).collect())
    return [some[len(some) * i // parts].decode("utf-8", "surrogatepass") for i in range(1, parts)] if some else []


def fingerprint_documents(documents: DataFrame, parts: int | None = None, k: int = K, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    Documents stand in descending doc_id: whole numbers by value, other ids as
    text by code point (equal ids by text, descending; null ids last); the
    document after the last is the first, a single one follows itself. Null
    texts are empty: n_chars 0, a fingerprint of zeros. Repeated rows stay; an
    empty table gives no rows; other columns are ignored.

    The order is dealt into ranges of ids by a bounded list of split points.
    The first row of each range is also sent to the end of the range before it
    (a ghost), so that every row finds its successor without a global window.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows_ = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows_.schema["doc_id"].dataType
    whole = isinstance(kind, IntegralType)
    id_type = kind.simpleString()
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # null ids come after all others: "n" before "s" + id
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) if whole else F.coalesce(F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("n"))
    placed = rows_.withColumn("key", key)
    splits = sorted(set(_splits(placed, parts, whole)))
    if splits and whole:
        bounds = [float("-inf"), *splits, float("inf")]
        placed = Bucketizer(splits=bounds, inputCol="at", outputCol="bucket").transform(placed.withColumn("at", F.col("key").cast("double")))
        placed = placed.withColumn("part", (F.lit(len(bounds)) - F.col("bucket")).cast("int")).drop("at", "bucket")
    elif splits:
        table = F.array(*[F.lit(x) for x in splits])
        placed = placed.withColumn("part", F.size(F.filter(table, lambda x: x > F.col("key"))))
    else:
        placed = placed.withColumn("part", F.lit(0))
    heads = placed.groupBy("part").agg(F.max("key").alias("head")).orderBy("part").collect()  # at most `parts` rows
    if not heads:
        return spark.createDataFrame([], f"doc_id {id_type}, {RESULT}")
    before = spark.createDataFrame([(h["head"], heads[i - 1]["part"]) for i, h in enumerate(heads)], f"key {placed.schema['key'].dataType.simpleString()}, part int")
    real = placed.withColumn("ghost", F.lit(0))
    ghosts = placed.drop("part").join(F.broadcast(before), "key").groupBy("key", "part").agg(F.max("text").alias("text"), F.first("doc_id").alias("doc_id")).withColumn("ghost", F.lit(1))
    dealt = real.unionByName(ghosts).repartition(parts, "part")
    ordered = dealt.sortWithinPartitions(F.asc("part"), F.asc("ghost"), F.desc("key"), F.desc("text")).select("part", "ghost", "doc_id", "text")
    return ordered.mapInArrow(lambda b: walk(b, k, rows, size), f"doc_id {id_type}, {RESULT}")
