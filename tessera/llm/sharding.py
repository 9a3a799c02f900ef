"""Shards by a hierarchical weighted hash tree.

Every node of a tree of regions, racks and shards has an exponential draw of its
own, -ln(u) / weight with u hashed from the document id and the node's name; a
node's weight is the sum of its shards'. A document goes down by the least draw
at each level, so it looks at the children of the nodes on its path only and
comes to each shard in proportion to its weight. Where a weight changes, the
draws of that shard and of the nodes above it change and no others: documents
move into or out of subtrees whose weights changed, and within a node only
between a child whose weight changed and the rest.

A region or rack can be planned wider than it is filled: its shards that aren't
installed weigh as the others do, but take no document. For such a node the
draws of its children follow from its own, as the least of exponential draws is
known to part from the others: the child that wins has the node's draw, another
child the node's draw plus a further draw of its own. Installed shards then
compete as if each had drawn by itself, and a shard that is installed later
takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of hash values in which each shard's slots are numbered, so that no window holds a whole shard.
SLOT_BUCKETS = 512


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0
    installed: bool = True


def tree(shards: int) -> list[Shard]:
    """Equal shards 0 .. shards - 1, and those planned to fill the last region.

    Regions are planned for 4, 4, 8, 16, 32 ... shards, in racks of 2, 2, 2, 4,
    4, 8 ...; the plan doesn't depend on the number of shards, so each further
    shard is installed in a place that was planned, or opens a region.
    """
    if shards < 1:
        raise ValueError("a tree needs a shard")
    out: list[Shard] = []
    region = 0
    while len(out) < shards:
        size = 4 << max(0, region - 1)
        per_rack = 1 << size.bit_length() // 2
        out += [Shard(len(out) + i, f"region{region}", f"rack{i // per_rack}", 1.0, len(out) + i < shards) for i in range(size)]
        region += 1
    return out


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), lambda x: fn(x)), 1)


def _exponential(key: Column, name: Column, weight: Column) -> Column:
    u = (F.pmod(F.xxhash64(key, name), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _least(key: Column, nodes: list[tuple[str, float, int]]) -> Column:
    """struct(draw, at) of the node of least draw. nodes: (name, weight, at)."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(k).alias("at")) for n, w, k in nodes])
    return F.array_min(F.transform(table, lambda x: F.struct(_exponential(key, x["name"], x["weight"]).alias("draw"), x["at"].alias("at"))))


def _chosen(key: Column, tables: list[list[tuple[str, float, int]]], which: Column) -> Column:
    """`at` of the node of least draw in the table that `which` numbers."""
    literal = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(k).alias("at")) for n, w, k in t]) for t in tables])
    draws = F.transform(F.element_at(literal, which + 1), lambda x: F.struct(_exponential(key, x["name"], x["weight"]).alias("draw"), x["at"].alias("at")))
    return F.array_min(draws)["at"]


def _apart(key: Column, above: Column, won: Column, nodes: list[tuple[str, float, int]]) -> Column:
    """struct(draw, at) of the least among children of a node whose draw is `above`, of which `won` (by its at) has that draw and the others more."""
    table = F.array(*[F.struct(F.lit(f"{n}+").alias("name"), F.lit(float(w)).alias("weight"), F.lit(k).alias("at")) for n, w, k in nodes])
    more = lambda x: F.when(x["at"] == won, F.lit(0.0)).otherwise(_exponential(key, x["name"], x["weight"]))
    return F.array_min(F.transform(table, lambda x: F.struct((above + more(x)).alias("draw"), x["at"].alias("at"))))


class Node:
    """A region or rack, or a shard if it has no children. Children stand in the order of the shards."""

    def __init__(self, name: str, weight: float, number: int | None = None, installed: bool = True):
        self.name, self.weight, self.number, self.children = name, weight, number, []
        self.full = self.some = installed

    @classmethod
    def above(cls, name: str, children: list[Node]) -> Node:
        node = cls(name, sum(c.weight for c in children))
        node.children = children
        node.full, node.some = all(c.full for c in children), any(c.some for c in children)
        return node


def _nodes(shards: list[Shard]) -> list[Node]:
    if not any(s.installed for s in shards) or any(s.weight <= 0 for s in shards):
        raise ValueError("a tree needs shards, each of positive weight")
    regions: dict[str, dict[str, list[Node]]] = {}
    for s in shards:
        racks = regions.setdefault(s.region, {})
        racks.setdefault(s.rack, []).append(Node(f"shard{s.number}", s.weight, s.number, s.installed))
    return [Node.above(r, [Node.above(f"{r}/{k}", leaves) for k, leaves in racks.items()]) for r, racks in regions.items()]


def descend(key: Column, shards: list[Shard]) -> Column:
    """The shard that a key comes to: region, then rack, then shard, by the least draw at each level."""
    regions = _nodes(shards)
    racks = [k for r in regions for k in r.children]
    place = {id(k): i for i, k in enumerate(racks)}
    rack_tables = [[(k.name, k.weight, place[id(k)]) for k in r.children] for r in regions]
    shard_tables = [[(s.name, s.weight, s.number) for s in k.children] for k in racks]

    def shard_of(rack: Column) -> Column:
        return _chosen(key, shard_tables, rack)

    def best_of(options: list[Column]) -> Column:
        return options[0] if len(options) == 1 else F.array_min(F.array(*options))

    # an entry is struct(draw, at, rack): the place of a full region, a full rack or a shard, the other two -1
    def entry(draw: Column, region: Column | int = -1, rack: Column | int = -1, shard: Column | int = -1) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(draw.alias("draw"), as_column(region).alias("region"), as_column(rack).alias("rack"), as_column(shard).alias("shard"))

    def in_rack(rack: Node, draw: Column) -> Column:
        won = _least(key, [(s.name, s.weight, s.number) for s in rack.children])["at"]
        there = [(s.name, s.weight, s.number) for s in rack.children if s.some]
        return let(_apart(key, draw, won, there), lambda x: entry(x["draw"], shard=x["at"]))

    def in_region(region: Node, draw: Column) -> Column:
        won = _least(key, [(k.name, k.weight, place[id(k)]) for k in region.children])["at"]

        def options(w: Column) -> Column:
            out = []
            if full := [(k.name, k.weight, place[id(k)]) for k in region.children if k.full]:
                out.append(let(_apart(key, draw, w, full), lambda x: entry(x["draw"], rack=x["at"])))
            for k in region.children:
                if k.some and not k.full:
                    out.append(let(_apart(key, draw, w, [(k.name, k.weight, place[id(k)])])["draw"], lambda d, k=k: in_rack(k, d)))
            return best_of(out)

        return let(won, options)

    options = []
    if full := [(r.name, r.weight, i) for i, r in enumerate(regions) if r.full]:
        options.append(let(_least(key, full), lambda x: entry(x["draw"], region=x["at"])))
    for r in regions:
        if r.some and not r.full:
            options.append(let(_exponential(key, F.lit(r.name), F.lit(float(r.weight))), lambda d, r=r: in_region(r, d)))

    def follow(x: Column) -> Column:
        rack = F.when(x["region"] >= 0, _chosen(key, rack_tables, x["region"])).otherwise(x["rack"])
        return F.when(x["shard"] >= 0, x["shard"]).otherwise(let(rack, shard_of))

    return let(best_of(options), follow).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def add_slots(rows: DataFrame, order: list[Column], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Adds `slot`, gapless from 0 in each `shard`.

    Rows are dealt to (shard, bucket) by a hash of `_key` and the text's
    checksum, so that rows that repeat an id are spread; the counts of the at
    most shards * buckets cells give each cell its first slot, and a row's rank
    in its cell the rest.
    """
    rows = rows.withColumn("_cell", F.pmod(F.xxhash64("_key", "text_crc32", F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy(*order))
    return rows.withColumn("_rank", rank).join(F.broadcast(firsts), ["shard", "_cell"]).withColumn("slot", (F.col("_first") + F.col("_rank") - 1).cast("long")).drop("_cell", "_rank", "_first")


def _grown(shards: list[Shard] | int) -> list[Shard]:
    """One shard more than `shards`, which are a number of equal ones or a list whose last place is then a region of its own."""
    if isinstance(shards, int):
        return tree(shards + 1)
    number = max(s.number for s in shards) + 1
    return [*shards, Shard(number, f"region of shard {number}", "rack0")]


def shard_documents(documents: DataFrame, shards: list[Shard] | int = 8, grown: list[Shard] | int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    law is `key`: the document id and the tree alone decide the shard.
    grown_shard is the shard under `grown` (by default one shard more). Null ids
    share one key; null texts are empty (size 1, crc32 0); repeated ids go to
    the same shard with slots of their own; an empty table gives no rows; other
    columns are not read.
    """
    grown = _grown(shards) if grown is None else tree(grown) if isinstance(grown, int) else grown
    shards = tree(shards) if isinstance(shards, int) else shards
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = documents.select(
        "doc_id",
        text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, shards).alias("shard"),
        descend(key, grown).alias("grown_shard"),
        key.alias("_key"),
    )
    out = add_slots(rows, [F.col("_key"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def with_shards(documents: DataFrame, shards: list[Shard] | int = 8) -> DataFrame:
    """The documents with size, text_crc32, law and shard; nothing is shuffled.

    All their columns are kept as they are: where one of the new names is taken
    (in any case), the new column gets underscores at its end. Null ids share
    one key, null texts are empty, repeated rows stay, an empty table gives no
    rows.
    """
    shards = tree(shards) if isinstance(shards, int) else shards
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    taken = {c.lower() for c in documents.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    return documents.select(
        "*",
        text_size(F.col("text")).alias(free("size")),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias(free("text_crc32")),
        F.lit("key").alias(free("law")),
        descend(key, shards).alias(free("shard")),
    )
