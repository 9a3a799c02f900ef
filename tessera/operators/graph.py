"""Match graphs from predictions: edges (u < v, weight) and vertices."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed, connected_components
from tessera.operators.ranks import with_position


def match_graph(predictions: DataFrame, keep_threshold: float = 0.7, score: str = "prob_match") -> DataFrame:
    """(u, v, weight): predictions (src_id, cand_id, score) at the threshold and over, without self loops, the greatest score of each pair."""
    kept = predictions.filter(F.col(score) >= keep_threshold).select(F.col("src_id").cast("long").alias("a"), F.col("cand_id").cast("long").alias("b"), F.col(score).alias("p"))
    return kept.filter("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("p").alias("weight"))


def ends(edges: DataFrame) -> DataFrame:
    """(id, other) both ways."""
    return edges.select(F.col("u").alias("id"), F.col("v").alias("other")).unionAll(edges.select("v", "u"))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component); with vertices (id), those without an edge are components of their own."""
    found = connected_components(edges)
    if vertices is None:
        return found
    return vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def louvain_of(edges: list[tuple[int, int, float]], passes: int = 20) -> dict[int, int]:
    """Communities of one component by modularity moves and merging, in order of id; a community is named by its least vertex."""
    names = sorted({x for u, v, _ in edges for x in (u, v)})
    home = {x: x for x in names}
    graph: dict[int, dict[int, float]] = {x: {} for x in names}
    for u, v, w in edges:
        graph[u][v] = graph[u].get(v, 0.0) + w
        graph[v][u] = graph[v].get(u, 0.0) + w
    total = sum(sum(n.values()) for n in graph.values())
    if not total:
        return home
    for _ in range(passes):
        weight = {x: sum(n.values()) for x, n in graph.items()}
        of, mass = {x: x for x in graph}, dict(weight)
        moved_any = True
        rounds = 0
        merged = False
        while moved_any and rounds < 50:
            moved_any, rounds = False, rounds + 1
            for x in sorted(graph):
                near: dict[int, float] = {}
                for y, w in graph[x].items():
                    if y != x:
                        near[of[y]] = near.get(of[y], 0.0) + w
                own = of[x]
                mass[own] -= weight[x]
                gain = lambda c: near.get(c, 0.0) - weight[x] * mass.get(c, 0.0) / total  # noqa: B023, E731
                best = min(near, key=lambda c: (-gain(c), c), default=own)
                if gain(best) <= gain(own) + 1e-12:
                    best = own
                mass[best] = mass.get(best, 0.0) + weight[x]
                if best != own:
                    of[x], moved_any, merged = best, True, True
        if not merged:
            break
        least: dict[int, int] = {}
        for x in sorted(graph):
            least.setdefault(of[x], x)
        home = {v: least[of[h]] for v, h in home.items()}
        after: dict[int, dict[int, float]] = {}
        for x, near in graph.items():
            a = after.setdefault(least[of[x]], {})
            for y, w in near.items():
                b = least[of[y]]
                a[b] = a.get(b, 0.0) + w
        graph = after
    first: dict[int, int] = {}
    for v in names:
        first.setdefault(home[v], v)
    return {v: first[home[v]] for v in names}


def _moves(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, node): each vertex with the least vertex of its community, after rounds of modularity moves by all vertices at once.

    edges: (component, u, v, weight), self loops allowed. In a round half of the
    vertices, by a hash, may move to the best community beside them; of two
    lone vertices only the greater one moves, so that they can't change places.
    """
    both = edges.select("component", F.col("u").alias("id"), F.col("v").alias("other"), "weight").unionAll(edges.select("component", "v", "u", "weight"))
    total = both.groupBy("component").agg(F.sum("weight").alias("total"))
    state = both.groupBy("component", "id").agg(F.sum("weight").alias("k")).join(total, "component").select("id", "k", "total", F.col("id").alias("comm"))
    state, still = checkpointed(state), 0
    for t in range(rounds):
        mass = state.groupBy("comm").agg(F.sum("k").alias("mass"), F.count("*").alias("n"))
        beside = state.select(F.col("id").alias("other"), F.col("comm").alias("c"))
        pull = both.filter("id <> other").join(beside, "other").groupBy("id", "c").agg(F.sum("weight").alias("near"))
        there = mass.select(F.col("comm").alias("c"), F.col("mass").alias("c_mass"), F.col("n").alias("c_n"))
        own = F.col("c") == F.col("comm")
        gain = F.round(F.col("near") - F.col("k") * (F.col("c_mass") - F.when(own, F.col("k")).otherwise(0.0)) / F.col("total"), 12)
        choice = pull.join(state, "id").join(there, "c").withColumn("gain", gain).groupBy("id")
        choice = choice.agg(F.max(F.when(~own, F.struct("gain", (-F.col("c")).alias("neg"), "c_n"))).alias("best"), F.max(F.when(own, F.col("gain"))).alias("stay"))
        stay = F.coalesce("stay", -F.col("k") * (F.col("mass") - F.col("k")) / F.col("total"))
        to = -F.col("best.neg")
        swap = (F.col("n") == 1) & (F.col("best.c_n") == 1) & (to > F.col("comm"))
        move = (F.col("best.gain") > stay + 1e-9) & (F.pmod(F.xxhash64("id", F.lit(t)), F.lit(2)) == 0) & ~swap
        after = state.join(mass, "comm").join(choice, "id", "left").select("id", "k", "total", F.when(move, to).otherwise(F.col("comm")).alias("comm"), F.coalesce(move, F.lit(False)).alias("moved"))
        after = checkpointed(after)
        still = still + 1 if after.filter("moved").isEmpty() else 0
        state = after.drop("moved")
        if still == 2:
            break
    least = state.groupBy("comm").agg(F.min("id").alias("node"))
    return checkpointed(state.join(least, "comm").select("id", "node"))


def louvain(edges: DataFrame, task_edges: int = 1_000_000) -> DataFrame:
    """(id, community): communities inside each connected component, named by their least vertex.

    A component of up to task_edges edges is one task. Greater ones are first
    merged by moves of all vertices at once, as DataFrame joins, until they are
    no greater than that; those that no move makes smaller stay as merged.
    """
    within = checkpointed(edges.join(connected_components(edges).withColumnRenamed("id", "u"), "u").select("component", "u", "v", "weight"))

    def great(rows: DataFrame) -> DataFrame:
        return rows.groupBy("component").count().filter(F.col("count") > task_edges).select("component")

    home = None
    while not (big := checkpointed(great(within))).isEmpty():
        rows = within.join(big, "component", "left_semi")
        to = _moves(rows)
        if to.filter("id <> node").isEmpty():
            break
        if home is None:
            home = ends(within).select("id").distinct().withColumn("node", F.col("id"))
        home = checkpointed(home.join(to.select(F.col("id").alias("node"), F.col("node").alias("_to")), "node", "left").select("id", F.coalesce("_to", "node").alias("node")))
        named = rows.join(to.select(F.col("id").alias("u"), F.col("node").alias("a")), "u").join(to.select(F.col("id").alias("v"), F.col("node").alias("b")), "v")
        merged = named.groupBy("component", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("weight").alias("weight"))
        within = checkpointed(within.join(big, "component", "left_anti").unionByName(merged))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(group.u, group.v, group.weight, strict=True))
        found = louvain_of([(int(u), int(v), float(w)) for u, v, w in rows])
        return pd.DataFrame({"id": list(found), "community": list(found.values())})

    found = within.join(big, "component", "left_anti").groupBy("component").applyInPandas(run, "id long, community long")
    left = ends(within.join(big, "component", "left_semi")).select("id", F.col("id").alias("community")).distinct()
    found = found.unionByName(left)
    if home is None:
        return found
    return home.join(found.withColumnRenamed("id", "node"), "node").select("id", "community")


def communities(edges: DataFrame, use_louvain: bool = True) -> DataFrame:
    """(id, community) by Louvain, or by connected components."""
    return louvain(edges) if use_louvain else components(edges).withColumnRenamed("component", "community")


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community)."""
    a, b = parts.select(F.col("id").alias("u"), F.col("community").alias("cu")), parts.select(F.col("id").alias("v"), F.col("community").alias("cv"))
    e = edges.join(a, "u").join(b, "v")
    inside = e.agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("m"))
    sides = e.select(F.col("cu").alias("c"), "weight").unionAll(e.select("cv", "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    squares = sides.agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inside.join(F.broadcast(squares)).select((F.col("inside") / F.col("m") - F.col("k2") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def sample_nodes(edges: DataFrame, max_nodes: int = 400, seeds: int = 100) -> DataFrame:
    """(id): up to max_nodes vertices in the two-step neighbourhoods of the vertices of greatest degree.

    The sample is a report: the limit is its purpose. Seeds come by degree and
    id; each brings its neighbourhood in the order of a hash, itself first. Each
    step keeps the best seed of a vertex alone, so it makes at most a row per
    end of an edge, however great the hubs are. The seeds are broadcast: their
    number is the bound.
    """
    w = Window.orderBy(F.desc("degree"), F.asc("id"))
    top = degrees(edges).orderBy(F.desc("degree"), F.asc("id")).limit(seeds).withColumn("seed_rank", F.row_number().over(w)).select("id", "seed_rank")
    near = ends(edges)
    reached = top
    for _ in range(2):
        step = near.join(reached, "id").select(F.col("other").alias("id"), "seed_rank")
        reached = reached.unionAll(step).groupBy("id").agg(F.min("seed_rank").alias("seed_rank"))
    own = F.broadcast(top.select("id", F.col("seed_rank").alias("own")))
    far = ~F.col("own").eqNullSafe(F.col("seed_rank"))
    ranked = reached.join(own, "id", "left").select("id", "seed_rank", far.alias("far"), F.md5(F.col("id").cast("string")).alias("draw"))
    return ranked.orderBy("seed_rank", "far", "draw", "id").limit(max_nodes).select("id")


def sample_subgraph(edges: DataFrame, max_nodes: int = 400) -> DataFrame:
    """The edges among the sampled vertices; all edges if the vertices are no more than max_nodes."""
    if degrees(edges).count() <= max_nodes:
        return edges
    return induced(edges, sample_nodes(edges, max_nodes))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes (id)."""
    return edges.join(nodes.withColumnRenamed("id", "u"), "u", "left_semi").join(nodes.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", "weight")


def draw_nodes(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, degree, size, color): plot-ready vertices; color counts the communities in their order."""
    colors = with_position(parts.select("community").distinct(), "community", name="color")
    joined = degrees(edges).join(parts, "id").join(colors, "community")
    return joined.select("id", "degree", (200 * (1 + F.log1p("degree"))).alias("size"), F.col("color").cast("int").alias("color"))


def draw_edges(edges: DataFrame) -> DataFrame:
    """(u, v, weight, width): plot-ready edges, widths from 0.5 to 3.5 by weight."""
    span = edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    width = 0.5 + 3 * (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9)
    return edges.join(F.broadcast(span)).select("u", "v", "weight", width.alias("width"))
