"""Exact Jaccard self-join of word n-gram sets.

Two documents link when 100 * |A n B| >= percent * |A u B| over their distinct
shingles. Equal sets are one class from the start. Between classes:

1. Sizes are cut into bands such that a pair that can link lies in one band or
   two neighbours. In a band, linked sets differ in at most k elements, so of
   p = k + 1 + spare hash partitions of the shingles at least spare + 1 hold
   the same in both. Each class emits a key for every partition that it fills;
   sets with more than `spare` partitions empty emit keys for these as well.
   Classes with a key in common form a tile; no linking pair shares no tile.
2. In a tile, parity bitmaps (a hashed bit is flipped by every shingle) bound
   the overlap from above: popcount(a ^ b) shingles at least are not shared.
   Pairs that the bound lets pass are kept as a spanning forest only.
3. The components of these forests are cut into size-banded tiles of about
   BLOCK classes a side, each class with its sorted shingle hashes, and pairs
   that pass the bound again are intersected exactly.

Rows between steps number at most one per class and tile: pairs live inside a
task's arrays. Large tiles are split into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import chunks, small_batches
from tessera.operators.components import checkpointed
from tessera.operators.components import connected_components

#: Classes on one side of a tile, at most or, after the first bound, about.
BLOCK = 1024
#: Keys that a task holds before it hands them on.
HELD_KEYS = 500_000
#: Class ids in the lists that a task holds before it hands them on.
HELD_IDS = 500_000
#: Copies of a class from which its rows are joined apart from those of the others.
HOT_COPIES = 10_000
#: Classes up to which the list of candidates is broadcast to the documents.
BROADCAST_ROWS = 1_000_000

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: A random odd 64-bit value of each byte, and the same with A-Z as a-z.
EACH_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _A) | np.uint64(1)
FOLDED_BYTE = EACH_BYTE.copy()
FOLDED_BYTE[65:91] = FOLDED_BYTE[97:123]


_POWERS: list = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, a new line after each; where their words start and end; the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    stops = np.cumsum(np.array([len(t) + 1 for t in texts]))
    return data, starts, ends, np.diff(np.searchsorted(starts, stops), prepend=0)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; the table has a value for each byte."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(table[data] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _A)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, lower-cased in A-Z, and the number of words of each text."""
    data, starts, ends, counts = words_of(texts)
    return hash_words(data, starts, ends, FOLDED_BYTE), counts


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; the whole sequence of fewer words is one; none without words."""
    h, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    rolled = h[: max(0, len(h) - n + 1)].copy()
    for j in range(1, n):
        rolled = mix(rolled * _A + h[j : len(h) - n + 1 + j])
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(rolled[at : at + c - n + 1]))
        elif c:
            x = np.uint64(c)
            for w in h[at : at + c]:
                x = mix(np.array([x], dtype=np.uint64) * _A + w)[0]
            out.append(np.array([x ^ _C], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = mix(s ^ _C).sum(dtype=np.uint64, keepdims=True) + np.array([len(s)], dtype=np.uint64) * _A
    return int(mix(total).astype(np.int64)[0])


def can_link(small: int | np.ndarray, large: int | np.ndarray, percent: int):
    return 100 * small >= percent * large


def bands(percent: int, upto: int) -> list[int]:
    """Lower edges of the size bands from 1 on; a set links only within its band and the next."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent + 1))
    return out


def most_apart(top: int, percent: int) -> int:
    """The most elements in which two linked sets differ, if the smaller has `top` at most: (1 - t) * |union|, |union| <= top / t."""
    return (100 - percent) * top // percent


def tile_keys(s: np.ndarray, percent: int, edges: list[int]) -> np.ndarray:
    """Keys of a set: one for each filled partition, in its band and in the band below as the larger set."""
    n = len(s)
    band = int(np.searchsorted(edges, n, side="right")) - 1
    out = []
    for b in (band, band - 1):
        if b < 0:
            continue
        k = most_apart(edges[b + 1] - 1, percent)
        if k == 0:
            continue  # only equal sets link
        spare = 2 + k // 50
        p = k + 1 + spare
        salt = mix(np.array([b + 1], dtype=np.uint64) * _A)[0]
        h = mix(s ^ salt)
        part = (((h >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)).astype(np.int64)
        held = np.zeros(p, dtype=np.uint64)
        np.add.at(held, part, mix(h))
        filled = np.bincount(part, minlength=p) > 0
        names = mix((np.arange(1, p + 1, dtype=np.uint64) + salt) * _B)
        keys = mix(held[filled] ^ names[filled])
        if p - len(keys) > spare:
            keys = np.concatenate([keys, mix(names[~filled] ^ _C)])
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def bitmap(s: np.ndarray, percent: int) -> np.ndarray:
    """Parity bitmap in words of 64 bits; its width, a power of two, is at least 4 times what linked sets differ in."""
    words = 1 << max(0, (4 * most_apart(len(s), percent) // 64)).bit_length()
    bit = mix(s + _A)
    out = np.zeros(words, dtype=np.uint64)
    np.bitwise_xor.at(out, ((bit >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap cut to fewer words; parity folds by exclusive or."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def bound_matrix(maps: list[np.ndarray]) -> np.ndarray:
    words = min(len(m) for m in maps)
    return np.stack([fold(m, words) for m in maps])


class Forest:
    """Union-find over 0 .. n - 1; the root of a set is its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def passing(i: int, js: np.ndarray, sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Those of js, no smaller than i, that size and bitmap allow to link with i."""
    js = js[100 * sizes[i] >= percent * sizes[js]]
    if len(js):
        apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
        overlap = (sizes[i] + sizes[js] - apart) // 2
        js = js[100 * overlap >= percent * (sizes[i] + sizes[js] - overlap)]
    return js


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _measure(n: int, percent: int):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        for part in chunks(batches):
            sets = shingle_sets(part.column("text").to_pylist(), n)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if f else None for s, f in zip(sets, full, strict=True)], pa.int64()),
                    pa.array([bitmap(s, percent).tobytes() if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                    part.column("mark"),
                ],
                ["doc_id", "n_shingles", "sid", "bits", "mark"],
            )

    return run


#: One key of one class, as it is packed into the rows of a bucket.
_ENTRY = np.dtype([("key", "<u8"), ("sid", "<i8"), ("n", "<i4")])


def _emit(n: int, percent: int, bits: int):
    def run(batches):
        import pyarrow.compute  # noqa: F401

        seen: set[int] = set()
        held: list[np.ndarray] = []
        edges = bands(percent, 1 << 31)

        def pack():
            all_ = np.concatenate(held)
            held.clear()
            bucket = (all_["key"] >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            all_, bucket = all_[order], bucket[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a in range(0, len(starts), 512):
                some = starts[a : a + 512]
                stops = np.append(starts, len(all_))[a + 1 : a + 1 + len(some)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[some], pa.int32()), pa.array([all_[i:j].tobytes() for i, j in zip(some, stops, strict=True)], pa.binary())], ["bucket", "entries"])

        total = 0
        for part in chunks(batches):
            for s in shingle_sets(part.column("text").to_pylist(), n):
                if not len(s) or (name := set_id(s)) in seen:
                    continue
                seen.add(name)
                keys = tile_keys(s, percent, edges)
                e = np.empty(len(keys), dtype=_ENTRY)
                e["key"], e["sid"], e["n"] = keys, name, len(s)
                held.append(e)
                total += len(e)
            if total > HELD_KEYS:
                yield from pack()
                total = 0
        if total:
            yield from pack()

    return run


def _tiles(percent: int):
    """The classes of each key of a bucket, as tiles (tile, sids): lists of at most 2 * BLOCK classes, handed on as they are made; equal lists have equal names."""

    def run(batches):
        for table in groups(batches, ["bucket"]):
            e = np.frombuffer(b"".join(table.column("entries").to_pylist()), dtype=_ENTRY)
            e = e[np.lexsort((e["sid"], e["key"]))]
            fresh = np.append(True, (e["key"][1:] != e["key"][:-1]) | (e["sid"][1:] != e["sid"][:-1]))
            e = e[fresh]
            starts = np.flatnonzero(np.append(True, e["key"][1:] != e["key"][:-1]))
            sizes = np.diff(np.append(starts, len(e)))
            out: dict[int, np.ndarray] = {}

            def flush():
                batch = pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.int64()))], ["tile", "sids"])
                out.clear()
                return batch

            held = 0
            for a, g in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                m = e[a : a + g]
                m = m[np.argsort(m["n"], kind="stable")]
                blocks = [m[i : i + BLOCK] for i in range(0, g, BLOCK)]
                for i, x in enumerate(blocks):
                    for y in blocks[i:]:
                        if not can_link(int(x["n"][-1]), int(y["n"][0]), percent):
                            break
                        sids = np.sort(x["sid"] if x is y else np.concatenate([x["sid"], y["sid"]]))
                        if len(sids) > 1:
                            out[set_id(sids.astype(np.uint64))] = sids
                            held += len(sids)
                            if held > HELD_IDS:
                                held = 0
                                yield flush()
            if out:
                yield flush()

    return run


def _bounded(percent: int):
    """Spanning edges (u, v) of the pairs in each tile that the bitmaps let pass."""

    def run(batches):
        us: list[int] = []
        vs: list[int] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
            us.clear()
            vs.clear()
            return batch

        for t in groups(batches, ["tile"]):
            sizes = t.column("n_shingles").to_numpy()
            order = np.argsort(sizes, kind="stable")
            sizes = sizes[order]
            sids = t.column("sid").to_numpy()[order].tolist()
            raw = t.column("bits").to_pylist()
            maps = bound_matrix([np.frombuffer(raw[i], dtype=np.uint64) for i in order])
            forest = Forest(len(sids))
            for i in range(len(sids) - 1):
                for j in passing(i, np.arange(i + 1, len(sids)), sizes, maps, percent).tolist():
                    forest.join(i, j)
            for i in range(len(sids)):
                if (r := forest.root(i)) != i:
                    us.append(sids[i])
                    vs.append(sids[r])
            if len(us) > 50_000:
                yield flush()
        yield flush()

    return run


def _arrays(n: int):
    """Sorted shingle hashes of the candidate classes, from the texts."""

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for part in chunks(batches):
            sets = shingle_sets(part.column("text").to_pylist(), n)
            same = [len(s) > 0 and set_id(s) == sid for s, sid in zip(sets, part.column("sid").to_pylist(), strict=True)]
            part = part.append_column("shingles", pa.array([s.tobytes() for s in sets], pa.binary())).drop_columns(["text"])
            yield part.filter(pa.array(same, pa.bool_()))

    return run


def _exact(percent: int):
    """(sid, root, links) of every class of a tile: a spanning star of its linked sets and the documents it links with.

    A tile (i, i) compares all its classes; a tile (i, j) those of block i with
    those of block j.
    """

    def run(batches):
        out: list[tuple[int, int, int]] = []
        for t in groups(batches, ["cluster", "low", "high"]):
            low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
            raw = t.column("shingles").to_pylist()
            sizes = np.array([len(r) // 8 for r in raw])
            order = np.argsort(sizes, kind="stable")
            sizes = sizes[order]
            sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in order]
            sids = t.column("sid").to_numpy()[order].tolist()
            block, copies = t.column("block").to_numpy()[order], t.column("copies").to_numpy()[order]
            maps = bound_matrix([bitmap(s, percent) for s in sets])
            forest, links = Forest(len(sids)), np.zeros(len(sids), dtype=np.int64)
            for i in range(len(sids) - 1):
                js = np.arange(i + 1, len(sids))
                js = passing(i, js if low == high else js[block[js] != block[i]], sizes, maps, percent)
                if not len(js):
                    continue
                a, others = sets[i], np.concatenate([sets[j] for j in js])
                hit = a[np.minimum(np.searchsorted(a, others), len(a) - 1)] == others
                shared = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(sizes[js])[:-1]))
                js = js[100 * shared >= percent * (sizes[i] + sizes[js] - shared)]
                links[i] += copies[js].sum()
                links[js] += copies[i]
                for j in js.tolist():
                    forest.join(i, j)
            out += [(sids[i], sids[forest.root(i)], int(links[i])) for i in range(len(sids)) if links[i]]
            if len(out) > 50_000:
                yield _star(out)
                out = []
        yield _star(out)

    return run


def _star(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["sid", "root", "links"])


def jaccard_components(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    component_id is the least doc_id reachable by links, n_links the number of
    rows that the document links with directly. Null and empty texts have no
    shingles and no links; rows without an id take part, and give the id of
    their component if another row has one. Rows that are repeated link with
    each other; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.withColumn("mark", F.xxhash64("text"))
    measured = checkpointed(marked.mapInArrow(_measure(n, percent), f"doc_id {id_type}, n_shingles long, sid long, bits binary, mark long"))
    # a class is fetched again by the id and text of its least row
    of_class = [F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bits").alias("bits"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("at")]
    classes = checkpointed(measured.filter("sid is not null").groupBy("sid").agg(*of_class))

    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(6, (4 * parts).bit_length())
    packed = rows.mapInArrow(_emit(n, percent, bits), "bucket int, entries binary")
    tiles = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_tiles(percent), "tile long, sids array<long>")
    tiles = checkpointed(tiles.groupBy("tile").agg(F.first("sids").alias("sids")))
    members = tiles.select("tile", F.explode("sids").alias("sid")).join(classes.select("sid", "n_shingles", "bits"), "sid")
    edges = members.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_bounded(percent), "u long, v long")
    clusters = connected_components(edges).select(F.col("id").alias("sid"), F.col("component").alias("cluster"))

    ranked = clusters.join(classes.select("sid", "n_shingles", "at", "copies"), "sid")
    # blocks: by size, and by a hash where many classes of a cluster are of about one size; no window holds a cluster
    ranked = checkpointed(ranked.withColumn("size", F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent))).cast("long")))
    large = ranked.groupBy("cluster", "size").agg(F.count("*").alias("of")).filter(F.col("of") > BLOCK)
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    spread = F.pmod(F.xxhash64("sid"), F.coalesce(F.ceil(F.col("of") * 4 / (3 * BLOCK)), F.lit(1)))
    blocked = checkpointed(ranked.join(large, ["cluster", "size"], "left").withColumn("block", F.col("size") * (1 << 32) + spread).drop("size", "of"))
    extent = blocked.groupBy("cluster", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    a, b = extent.alias("a"), extent.alias("b")
    reach = (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block")) & (100 * F.col("a.most") >= percent * F.col("b.least"))
    pairs = a.join(b, reach).select(F.col("a.cluster").alias("cluster"), F.col("a.block").alias("low"), F.col("b.block").alias("high"))
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    placed = blocked.join(sides, ["cluster", "block"])

    wanted = blocked.select(F.col("at.doc_id").alias("_id"), F.col("at.mark").alias("_mark"), "sid")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = marked.join(wanted, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("sid", "text")
    arrays = texts.mapInArrow(_arrays(n), "sid long, shingles binary").groupBy("sid").agg(F.first("shingles").alias("shingles"))
    tiled = placed.join(arrays, "sid").select("cluster", "low", "high", "block", "sid", "copies", "shingles")
    order = ["cluster", "low", "high"]
    stars = checkpointed(tiled.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_exact(percent), "sid long, root long, links long"))

    linked = connected_components(stars.select(F.col("sid").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("sid"), "component")
    links = stars.groupBy("sid").agg(F.sum("links").alias("links"))
    named = linked.join(classes.select("sid", "rep"), "sid")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(least, "component").join(links, "sid").select("sid", "component_id", "links")
    # a class of one row without links needs no row here: its row says all
    several = classes.filter("copies > 1").select("sid", "rep", "copies").join(found, "sid", "full_outer")
    several = checkpointed(several.select("sid", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links")))
    out = _with_class(measured.select("doc_id", "n_shingles", "sid"), several)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"))


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with the columns of their class, null without one. Classes of many rows are broadcast (at most one for each HOT_COPIES rows), so that no task gets all their rows; so are all if they are few."""
    if classes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), "sid", "left")
    hot = classes.filter(F.col("copies") >= HOT_COPIES)
    marked = rows.join(F.broadcast(hot), "sid", "left")
    cold = marked.filter("copies is null").select(rows.columns).join(classes.filter(F.col("copies") < HOT_COPIES), "sid", "left")
    return marked.filter("copies is not null").unionByName(cold)


def keep_one_of_each(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """The documents, all columns kept, that stand for their group: those whose doc_id is their component_id.

    Documents without shingles stay. Rows that repeat a doc_id, or have none,
    count as one document for each distinct text.
    """
    found = checkpointed(jaccard_components(documents, n, percent).select("doc_id", "component_id"))
    spare = found.filter("doc_id is not null and component_id < doc_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    spare = F.broadcast(spare) if spare.count() <= BROADCAST_ROWS else spare
    kept = documents.join(spare, documents["doc_id"] == spare["__kept_id"], "left_anti")
    unclear = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("component_id").alias("component_id")).filter("n > 1 or doc_id is null and component_id is null")
    unclear = checkpointed(unclear.select(F.col("doc_id").alias("__kept_id"), F.lit(True).alias("__kept_often")))
    if not unclear.head(1):
        # a row without an id whose component has one is that component's
        return kept.filter("doc_id is not null or text is null or text = ''") if found.filter("doc_id is null").head(1) else kept
    often = unclear.count()
    unclear = F.broadcast(unclear) if often <= BROADCAST_ROWS else unclear
    marked = kept.join(unclear, kept["doc_id"].eqNullSafe(unclear["__kept_id"]), "left").drop("__kept_id")
    return marked.filter("__kept_often is null").unionByName(marked.filter("__kept_often").dropDuplicates(["doc_id", "text"])).drop("__kept_often")
