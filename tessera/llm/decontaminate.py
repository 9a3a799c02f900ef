"""Benchmark decontamination by q-gram lemma filtering.

A document region within e edits of a benchmark item of m characters shares at
least m + 1 - q * (e + 1) character q-grams with it, on diagonals (document
position minus item position) at most e apart. Shared q-grams are counted in
diagonal bands of width 2 (e + 1) that overlap by half, so every such region
lies whole in one band; bands that reach the count are verified by banded
alignment. q depends on the item's length, so that the count is above 0 for the
whole edit share at every length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import map_chunks
from tessera.operators.components import checkpointed

#: Edits allowed, as a share of an item's characters.
EDIT_SHARE = 0.08
#: q of items from so many characters on; shorter ones are one q-gram as a whole, and count where they stand as whole words.
Q_FROM = ((600, 12), (64, 10), (26, 8), (12, 5))
#: Characters of benchmark items in one index; more items are searched in further passes.
BLOCK_CHARS = 2_000_000
#: Shared q-grams that are laid out at a time.
HITS = 2_000_000
#: Texts with a passage up to which their list is broadcast to the documents, if the benchmark takes several passes.
BROADCAST_ROWS = 200_000
_A = np.uint64(0x9E3779B97F4A7C15)
_B = {1 << k: np.uint64(pow(0xD1342543DE82EF95, 1 << k, 2**64)) for k in range(8)}
_GAP = np.uint32(0xFFFFFFFF)
_TABLE_BITS = 22


def points(text: str) -> np.ndarray:
    """Code points, one for each of the text's, in lower case and with every white space as a space."""
    t = text.lower()
    if len(t) != len(text):
        t = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    p[((p >= 9) & (p <= 13)) | (p == 0xA0) | (p == 0x3000)] = 32
    return p


#: q-grams that are hashed at a time, so that the arrays stay in cache.
_SLICE = 1 << 16


def grams(p: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams of code points: of runs of 1, 2, 4 ... points, put together to q."""
    out = np.zeros(max(0, len(p) - q + 1), dtype=np.uint64)
    for a in range(0, len(out), _SLICE):
        run = (p[a : a + _SLICE + q - 1].astype(np.uint64) + np.uint64(1)) * _A
        run ^= run >> np.uint64(32)
        n = len(run) - q + 1
        total, size, at = np.zeros(n, dtype=np.uint64), 1, 0
        while True:
            if q & size:
                total = total * _B[size] + run[at : at + n]
                at += size
            size *= 2
            if size > q:
                break
            run = run[: -size // 2] * _B[size // 2] + run[size // 2 :]
        total ^= total >> np.uint64(31)
        out[a : a + n] = total * _A
    return out


def q_of(size: int, edit_share: float) -> int:
    """The longest q of Q_FROM, or a shorter one, with which the lemma tells `edit_share` edits from none."""
    edits = int(size * edit_share)
    for least, q in Q_FROM:
        if size >= least:
            return min(q, max(1, size // (edits + 1)))
    return size


@dataclass
class Index:
    """The q-grams of items of one q."""

    ids: list[int]
    texts: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    q: int
    hashes: np.ndarray  # ascending
    item: np.ndarray
    pos: np.ndarray
    table: np.ndarray  # whether some hash has these first bits
    words: bool  # whether an item counts as whole words only

    @classmethod
    def build(cls, items: list[tuple[int, np.ndarray]], q: int, edit_share: float) -> Index:
        sizes = np.array([len(p) for _, p in items], dtype=np.int64)
        words = q < Q_FROM[-1][0] and bool((sizes == q).all())
        edits = np.zeros(len(items), dtype=np.int64) if words else (sizes * edit_share).astype(np.int64)
        h = [grams(p, q) for _, p in items]
        hashes = np.concatenate(h)
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(x) for x in h])
        pos = np.concatenate([np.arange(len(x), dtype=np.int32) for x in h])
        order = np.argsort(hashes, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[hashes >> np.uint64(64 - _TABLE_BITS)] = True
        return cls([i for i, _ in items], [p for _, p in items], edits, np.maximum(1, sizes + 1 - q * (edits + 1)), q, hashes[order], item[order], pos[order], table, words)


def build_indexes(items: list[tuple[int, str]], edit_share: float) -> list[Index]:
    """One index for each q that the items ask for; empty items are left out."""
    by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, t in items:
        if len(p := points((t or "").strip())):
            by_q.setdefault(q_of(len(p), edit_share), []).append((i, p))
    return [Index.build(some, q, edit_share) for q, some in sorted(by_q.items())]


def _word(p: np.ndarray, at: int) -> bool:
    return 0 <= at < len(p) and (chr(p[at]).isalnum() or p[at] == 95)


def whole_words(p: np.ndarray, start: int, end: int) -> bool:
    """Whether no word goes on over either end of the passage."""
    return not (_word(p, start - 1) and _word(p, start) or _word(p, end - 1) and _word(p, end))


def verbatim(item: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(0, start, end) if the item itself stands on one of the diagonals."""
    for d in range(max(0, low), min(high, len(doc) - len(item)) + 1):
        if doc[d] == item[0] and (doc[d : d + len(item)] == item).all():
            return 0, d, d + len(item)
    return None


def align(item: np.ndarray, doc: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the item in the document on diagonals low .. high, None beyond `edits`.

    Cell d of a row is the diagonal low + d; a value is cost << 32 | start. A
    step down a diagonal costs a mismatch, a skipped item character comes from
    the diagonal above, a skipped document character from the one below.
    """
    one, far = np.int64(1 << 32), np.int64(1 << 50)
    d = np.arange(low, high + 1, dtype=np.int64)
    slide = np.arange(len(d), dtype=np.int64) * one
    row = np.where((d >= 0) & (d <= len(doc)), np.clip(d, 0, None), far)
    for i, c in enumerate(item):
        at = d + i
        inside = (at >= 0) & (at < len(doc))
        same = doc[np.clip(at, 0, len(doc) - 1)] == c
        down = np.where(inside, row + np.where(same, 0, one), far)
        skip = np.append(row[1:] + one, far)
        skip[(at + 1 < 0) | (at + 1 > len(doc))] = far
        row = np.minimum(down, skip)
        # a start before the document's first character doesn't exist
        fresh = (at + 1 >= 0) & (at + 1 <= len(doc))
        row = np.where(fresh, np.minimum.accumulate(row - slide) + slide, far)
        if (row >> 32).min() > edits:
            return None
    best = int(row.argmin())
    return int(row[best] >> 32), int(row[best] & 0xFFFFFFFF), int(low + best + len(item))


def spans(index: Index, docs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
    """For each document its (item id, start, end, edits), the best for each item and place."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
    if not len(index.hashes) or not docs:
        return out
    gap = np.full(index.q, _GAP, dtype=np.uint32)
    starts = np.cumsum([0] + [len(p) + index.q for p in docs])
    h = grams(np.concatenate([x for p in docs for x in (p, gap)]), index.q)
    at = np.flatnonzero(index.table[h >> np.uint64(64 - _TABLE_BITS)])
    first = np.searchsorted(index.hashes, h[at], side="left")
    times = np.searchsorted(index.hashes, h[at], side="right") - first
    at, first, times = at[times > 0], first[times > 0], times[times > 0]
    counted: dict[tuple[int, int, int], int] = {}
    ends = np.cumsum(times)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, side="right")))
        where = np.repeat(at[a:b], times[a:b])
        row = np.repeat(first[a:b], times[a:b]) + np.arange(len(where)) - np.repeat(np.append(0, np.cumsum(times[a:b])[:-1]), times[a:b])
        item, doc = index.item[row], np.searchsorted(starts, where, side="right") - 1
        diagonal = where - starts[doc] - index.pos[row].astype(np.int64)
        if index.words:  # a q-gram is a whole item here
            for d, i, at_ in zip(doc.tolist(), item.tolist(), diagonal.tolist(), strict=True):
                end = at_ + index.q
                if (docs[d][at_:end] == index.texts[i]).all() and whole_words(docs[d], at_, end):
                    out[d].append((index.ids[i], at_, end, 0))
            a = b
            continue
        stride = index.edits[item] + 1
        band = np.floor_divide(diagonal, stride)
        cells = np.stack([np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
        order = np.lexsort(cells[::-1])
        cells = cells[:, order]
        new = np.flatnonzero(np.append(True, (cells[:, 1:] != cells[:, :-1]).any(axis=0)))
        n = np.diff(np.append(new, cells.shape[1]))
        whole = a == 0 and b == len(at)
        enough = n >= (index.needed[cells[1, new]] if whole else 1)
        for d, i, k, c in zip(*cells[:, new[enough]].tolist(), n[enough].tolist(), strict=True):
            counted[d, i, k] = counted.get((d, i, k), 0) + c
        a = b
    for (d, i, k), c in sorted(counted.items()):
        if c < index.needed[i]:
            continue
        edits, item = int(index.edits[i]), index.texts[i]
        low = k * (edits + 1)
        found = verbatim(item, docs[d], low, low + 2 * (edits + 1)) or align(item, docs[d], low - edits, low + 2 * (edits + 1) + edits, edits)
        if found and not any(s[0] == index.ids[i] and s[1] < found[2] and found[1] < s[2] and s[3] <= found[0] for s in out[d]):
            out[d] = [s for s in out[d] if not (s[0] == index.ids[i] and s[1] < found[2] and found[1] < s[2])]
            out[d].append((index.ids[i], found[1], found[2], found[0]))
    return out


def blocks(benchmark: DataFrame, edit_share: float, block_chars: int | None = None) -> Iterator[list[Index]]:
    """Indexes of blocks of items, each of about block_chars characters; made one block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).filter("t is not null").distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // (block_chars or BLOCK_CHARS)))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    for k in range(n):
        rows = (items if n == 1 else items.filter(part == k)).collect()
        yield build_indexes(sorted((r["i"] if r["i"] is not None else -1, r["t"]) for r in rows), edit_share)


SPAN = "struct<item_id: bigint, start: bigint, end: bigint, edits: bigint>"
_SPANS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def _found(indexes: list[Index], texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    docs = [points(t or "") for t in texts]
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
    for index in indexes:
        for all_, some in zip(out, spans(index, docs), strict=True):
            all_ += some
    return out


def _as_column(found: list[list[tuple[int, int, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("item_id", "start", "end", "edits"), s, strict=True)) for s in sorted(f)] for f in found], _SPANS)


def _hits(rows: DataFrame, indexes: list[Index]) -> DataFrame:
    """(mark, spans) of the texts in which a block of items is found, written to the shared folder."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found = _found(indexes, part.column("text").to_pylist())
        batch = pa.RecordBatch.from_arrays([part.column("mark"), _as_column(found)], ["mark", "spans"])
        return batch.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return checkpointed(map_chunks(rows.select("mark", "text"), run, f"mark binary, spans array<{SPAN}>").dropDuplicates(["mark"]))


def _in_passes(rows: DataFrame, first: list[Index], rest: Iterator[list[Index]]) -> DataFrame:
    """(mark, spans) of the texts with a passage. Each pass over the documents holds one block of the benchmark, whatever its size; equal texts are one row."""
    hits = _hits(rows, first)
    for indexes in rest:
        both = hits.unionByName(_hits(rows, indexes))
        hits = checkpointed(both.groupBy("mark").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    return F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits


def _marked(documents: DataFrame) -> DataFrame:
    return documents.withColumn("mark", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _first_two(items: Iterator[list[Index]]) -> tuple[list[Index], Iterator[list[Index]] | None]:
    first, second = next(items), next(items, None)
    return first, None if second is None else chain([second], items)


def find_passages(documents: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """(doc_id, contaminated, items, spans) of every document.

    spans: the passages within the edit budget of a benchmark item, in code
    points of the text; items: their distinct item ids, ascending. Case and the
    kind of white space don't count as edits. Items of fewer than 12 characters
    count without edits, where they stand as whole words. Null and empty items
    are in no document; null texts are empty and clean; null ids and repeated
    rows are kept; an empty table gives no rows, an empty benchmark no passage.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first, rest = _first_two(blocks(benchmark, edit_share))
    if rest is None:

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column("doc_id"), _as_column(_found(first, part.column("text").to_pylist()))], ["doc_id", "spans"])

        out = map_chunks(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")
    else:
        rows = _marked(rows)
        out = rows.select("doc_id", "mark").join(_in_passes(rows, first, rest), "mark", "left").select("doc_id", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return out.select("doc_id", (F.size("spans") > 0).alias("contaminated"), items.alias("items"), "spans")


def keep_clean(documents: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """The documents without a benchmark passage, with all their columns.

    Null and empty texts are clean; null ids and repeated rows stay; an empty
    table gives no rows; with an empty benchmark all documents stay.
    """
    first, rest = _first_two(blocks(benchmark, edit_share))
    if rest is None:

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            found = _found(first, part.column("text").to_pylist())
            return part.filter(pa.array([not f for f in found], pa.bool_()))

        return map_chunks(documents, run, documents.schema)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = _in_passes(_marked(documents.select(text.alias("text"))), first, rest).select("mark")
    full = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("mark"))
    return full.join(hits, "mark", "left_anti").select("row.*")
