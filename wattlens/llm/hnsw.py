"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt to shards by hash; each shard builds one graph and stores it. Every vector then queries every shard: a cell
holds two shards' graphs and searches each with the vectors of the other. A search descends the layers through lists (a node is
listed by the nearest node of the layer above) and then walks along the links of the base. How wide a cell's beams begin is
settled on an audited sample that is compared with all vectors of the shard: vectors of the cell, and ones made to lie near
stored ones, so that a recall can be told however rare matches are. Then all vectors search once. Found pairs are verified in
double precision. A cell returns one row per linked vector (its links and a neighbour that stands for its component), so no
list of pairs leaves a task.

The graphs are built and searched for many vectors at once with NumPy; positions in a shard are ordered by level, so every
layer is a prefix of the layer below.
"""
from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wattlens.llm.arrow_text import U64, mix, ship
from wattlens.llm.components import components
from wattlens.plans.staging import stage

FAN = 144  # nodes of a layer for each node of the layer above
LINKS = 24
BUILD_BEAM, BEAM = 8, 8
TOP = 64  # a base layer of at most so many nodes is searched whole
UPPER_TOP = 1024  # a layer above the base, which only gives start nodes, likewise
ENTRIES = 8  # start nodes of a beam
EXPANDED = 4  # nodes of a beam that are expanded at once
BATCH, ROUTED = 256, 8192  # queries that walk along links together, and that go through the lists of the layer above
BACK = 1 << 17  # nodes whose links get their other direction together
FLAG_BYTES = 32_000_000  # visited flags, or similarities, of a batch of queries
MIN_SHARDS, SHARD_BYTES = 6, 64_000_000
SPARE_TASKS = 43
PIECE = 1_000_000  # bytes of a stored graph in one row
AUDITED, PLANTED, RECALL = 512, 256, 0.99
FEW = 16  # matches of a query whose recall is also judged apart from those of large groups


def _top(ids: np.ndarray, sims: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    if ids.shape[1] > count:
        at = np.argpartition(-sims, count - 1, axis=1)[:, :count]
        return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    return ids, sims


def _dots(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Similarities of each query with its row of positions."""
    return np.matmul(vectors[ids], queries[:, :, None])[:, :, 0]


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int,
                filled: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (-1: none) and similarities of the best `beam` nodes found for each query; `entry` has start nodes."""
    rows = len(queries)
    seen = np.zeros((rows, filled + 1), bool)  # the last column stands for missing links
    seen[:, filled] = True
    every = np.arange(rows)[:, None]
    entry = np.where(entry >= 0, entry, filled)
    entry = np.sort(entry, axis=1)
    entry[:, 1:][entry[:, 1:] == entry[:, :-1]] = filled
    seen[every, entry] = True
    ids = np.full((rows, beam), filled, np.int64)
    sims = np.full((rows, beam), -np.inf, np.float32)
    width = min(beam, entry.shape[1])
    start = _dots(vectors, np.minimum(entry, filled - 1), queries)
    start[entry == filled] = -np.inf
    ids[:, :width], sims[:, :width] = _top(entry, start.astype(np.float32), width)
    expanded = np.zeros((rows, beam), bool)
    active, some = np.arange(rows), min(EXPANDED, beam)
    while len(active):
        open_ = np.where(expanded[active] | ~np.isfinite(sims[active]), -np.inf, sims[active])
        best = np.argpartition(-open_, some - 1, axis=1)[:, :some]
        go = np.isfinite(np.take_along_axis(open_, best, 1))
        left = go.any(axis=1)
        active, best, go = active[left], best[left], go[left]
        if not len(active):
            break
        own = active[:, None]
        expanded[own, best] |= go
        near = np.where(go[:, :, None], links[np.where(go, ids[own, best], 0)], -1).reshape(len(active), -1)
        near = np.sort(np.where((near < 0) | (near >= filled), filled, near), axis=1)
        new = ~seen[own, near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[own, near] = True
        near = np.where(new, near, filled)
        value = _dots(vectors, np.minimum(near, filled - 1), queries[active])
        value[~new] = -np.inf
        joined = np.concatenate([sims[active], value], axis=1)
        at = np.argpartition(-joined, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(joined, at, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), at, 1)
        flags = np.concatenate([expanded[active], np.zeros(near.shape, bool)], axis=1)
        expanded[active] = np.take_along_axis(flags, at, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def choose_links(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, count: int,
                 columns: int = LINKS) -> np.ndarray:
    """Of each row's candidates the nearest, skipping those nearer to one already taken; the rest fill up free places.
    `count` at most, in `columns` columns (-1: none)."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    valid = np.isfinite(sims) & (ids >= 0) & (ids != own[:, None])
    gathered = vectors[np.maximum(ids, 0)]
    between = np.matmul(gathered, gathered.transpose(0, 2, 1))
    rows, width = ids.shape
    taken = np.zeros((rows, width), bool)
    nearest_taken = np.full((rows, width), -np.inf, np.float32)
    number = np.zeros(rows, np.int64)
    for k in range(width):
        take = valid[:, k] & (number < count) & (nearest_taken[:, k] < sims[:, k])
        taken[:, k] = take
        number += take
        nearest_taken = np.where(take[:, None], np.maximum(nearest_taken, between[:, :, k]), nearest_taken)
    rank = np.where(taken, 0, np.where(valid, 1, 2)) * width + np.arange(width)
    at = np.argsort(rank, axis=1)[:, :count]
    out = np.where(np.take_along_axis(valid, at, 1), np.take_along_axis(ids, at, 1), -1)
    return np.pad(out, ((0, 0), (0, columns - out.shape[1])), constant_values=-1)


class Graph:
    """The graphs of all layers of one shard over unit vectors in level order.

    Besides its links to near nodes of its own layer, a node is listed by the nearest node of the layer above. A search descends
    through these lists: it takes the nodes of the layer above that are nearest to a query and compares their lists, all queries
    of a node in one product, and then walks along the links from the best nodes found.
    """

    def __init__(self, vectors: np.ndarray, sizes: list[int], links: list[np.ndarray] | None = None,
                 homes: list[np.ndarray] | None = None):
        self.vectors, self.sizes = vectors, sizes  # sizes: nodes of each layer, the base first
        self.links = links or [np.zeros((0, 0), np.int32)] * len(sizes)
        self.homes = homes or [np.zeros(0, np.int32)] * len(sizes)  # by layer, the node above that lists a node
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if not links:
            for layer in range(len(sizes) - 2, -1, -1):
                if sizes[layer] > (UPPER_TOP if layer else TOP):
                    self._build(layer)

    def nearest(self, queries: np.ndarray, layer: int, count: int) -> np.ndarray:
        """Nodes of a layer above the base that are near to each query."""
        size = self.sizes[layer]
        if size > UPPER_TOP and layer + 1 < len(self.sizes):
            found = [self._walk(part, layer, *self._descend(part, layer, count)[:2], count)[0]
                     for part in (queries[low:low + ROUTED] for low in range(0, len(queries), ROUTED))]
            return np.concatenate(found)
        found = [_top(np.broadcast_to(np.arange(size), sims.shape), sims, min(count, size))[0]
                 for sims in (queries[low:low + 1024] @ self.vectors[:size].T for low in range(0, len(queries), 1024))]
        return np.concatenate(found)

    def lists(self, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of a layer by the node that lists them, and where each list begins."""
        if layer not in self._lists:
            home = self.homes[layer]
            self._lists[layer] = np.argsort(home, kind="stable"), np.searchsorted(
                np.sort(home), np.arange(self.sizes[layer + 1] + 1))
        return self._lists[layer]

    def compared(self, queries: np.ndarray, layer: int, above: np.ndarray):
        """Queries (as places in `above`), the nodes of one list and their similarities, for every node in `above`."""
        members, starts = self.lists(layer)
        flat = above.ravel()
        order = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[order], np.arange(self.sizes[layer + 1] + 1))
        for node in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(starts) > 0)):
            listed = members[starts[node]:starts[node + 1]]
            place, vectors = order[bounds[node]:bounds[node + 1]], self.vectors[listed].T
            step = max(16, FLAG_BYTES // (4 * len(listed)))
            for low in range(0, len(place), step):
                some = place[low:low + step]
                yield some, listed, queries[some // above.shape[1]] @ vectors

    def _descend(self, queries: np.ndarray, layer: int, beam: int, least: float = np.inf):
        """The best node, and its similarity, of each list of the `beam` nearest nodes above; also (query, node) pairs of at
        least `least`."""
        above = self.nearest(queries, layer + 1, beam)
        width = above.shape[1]
        entry, value = np.full(above.size, -1), np.full(above.size, -np.inf, np.float32)
        rows, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, listed, sims in self.compared(queries, layer, above):
            best = sims.argmax(axis=1)
            entry[place], value[place] = listed[best], sims[np.arange(len(best)), best]
            row, col = np.nonzero(sims >= least)
            rows.append(place[row] // width)
            nodes.append(listed[col])
        return entry.reshape(above.shape), value.reshape(above.shape), np.concatenate(rows), np.concatenate(nodes)

    def _walk(self, queries: np.ndarray, layer: int, entry: np.ndarray, value: np.ndarray, beam: int):
        entry, _ = _top(entry, value, ENTRIES)
        step = max(16, min(BATCH, FLAG_BYTES // (self.sizes[layer] + 1)))
        found = [beam_search(self.vectors, self.links[layer], queries[low:low + step], entry[low:low + step],
                             min(beam, self.sizes[layer]), self.sizes[layer]) for low in range(0, len(queries), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _build(self, layer: int) -> None:
        """Links to near nodes among those that the lists of near nodes above hold, and back."""
        size, vectors = self.sizes[layer], self.vectors
        batches = [np.arange(low, min(size, low + ROUTED)) for low in range(0, size, ROUTED)]
        home = np.zeros(size, np.int32)
        for batch in batches:
            above = self.nearest(vectors[batch], layer + 1, BUILD_BEAM)
            near = np.where(above < 0, -np.inf, _dots(vectors, np.maximum(above, 0), vectors[batch]))
            home[batch] = np.maximum(above[np.arange(len(batch)), near.argmax(axis=1)], 0)
        self.homes[layer] = home
        links = np.full((size, LINKS), -1, np.int32)
        for batch in batches:
            above = self.nearest(vectors[batch], layer + 1, BUILD_BEAM)
            ids = np.full((above.size, BUILD_BEAM), -1)
            sims = np.full(ids.shape, -np.inf, np.float32)
            for place, listed, near in self.compared(vectors[batch], layer, above):
                best, value = _top(np.broadcast_to(listed, near.shape), near, BUILD_BEAM)
                ids[place, :best.shape[1]], sims[place, :best.shape[1]] = best, value
            ids, sims = ids.reshape(len(batch), -1), sims.reshape(len(batch), -1)
            sims[ids == batch[:, None]] = -np.inf
            for low in range(0, len(batch), 1024):
                part = slice(low, low + 1024)
                links[batch[part]] = choose_links(vectors, batch[part], *_top(ids[part], sims[part], LINKS), LINKS // 2)
        chosen = links.copy()
        for low in range(0, size, BACK):
            target = chosen[low:low + BACK].ravel().astype(np.int64)
            source = low + np.arange(len(target)) // LINKS
            self._add_back(links, source[target >= 0], target[target >= 0])
        self.links[layer] = links

    def _add_back(self, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
        """Links in the other direction; a full node keeps its best ones. The nearest of many newcomers are looked at."""
        count = links.shape[1]
        value = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        order = np.lexsort((-value, target))
        source, target, value = source[order], target[order], value[order]
        nodes, first = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        near = place < count
        fresh = np.full((len(nodes), count), -1, np.int64)
        fresh[np.searchsorted(nodes, target[near]), place[near]] = source[near]
        for low in range(0, len(nodes), 1024):
            own = nodes[low:low + 1024]
            ids = np.concatenate([links[own].astype(np.int64), fresh[low:low + 1024]], axis=1)
            ids = np.sort(ids, axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = _dots(self.vectors, np.maximum(ids, 0), self.vectors[own])
            sims[ids < 0] = -np.inf
            links[own] = choose_links(self.vectors, own, ids, sims, count)

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position) pairs with a similarity of at least `least`: all such nodes of the lists of the `beam` nearest
        nodes above, and those that a walk meets. Where each of these lists has one, twice as many are compared."""
        if self.sizes[0] <= TOP:
            return np.nonzero(queries @ self.vectors.T >= least)
        size, codes = self.sizes[0], []
        for low in range(0, len(queries), ROUTED):
            part = queries[low:low + ROUTED]
            todo, width, start = np.arange(len(part)), beam, None
            while len(todo):
                entry, value, row, node = self._descend(part[todo], 0, width, least)
                start = start or (entry, value)
                codes.append((low + todo[row]) * size + node)
                full = ((value >= least) | (entry < 0)).all(axis=1) & (value >= least).any(axis=1)
                todo, width = todo[full & (width < self.sizes[1])], width * 2
            ids, sims = self._walk(part, 0, *start, beam)
            row, col = np.nonzero(sims >= least)
            codes.append((low + row) * size + ids[row, col])
        found = np.unique(np.concatenate(codes))
        return found // size, found % size


def planted(vectors: np.ndarray, least: float) -> np.ndarray:
    """Up to PLANTED unit vectors, each with a cosine between `least` and 1 to a stored one."""
    rng = np.random.default_rng(len(vectors))
    near = vectors[rng.permutation(len(vectors))[:PLANTED]].astype(float)
    aside = rng.normal(size=near.shape)
    aside -= np.einsum("nd,nd->n", aside, near)[:, None] * near
    aside /= np.maximum(np.sqrt(np.einsum("nd,nd->n", aside, aside))[:, None], 1e-9)
    cosine = rng.uniform(least, 1, (len(near), 1))
    return (cosine * near + np.sqrt(1 - cosine ** 2) * aside).astype(np.float32)


def matches(graph: Graph, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, position) pairs with a similarity of at least `least`, by comparison with every vector."""
    step = max(16, FLAG_BYTES // (4 * len(graph.vectors)))
    parts = [np.nonzero(queries[low:low + step] @ graph.vectors.T >= least) for low in range(0, len(queries), step)]
    return np.concatenate([row + i * step for i, (row, _) in enumerate(parts)]), np.concatenate([col for _, col in parts])


def recalls(row: np.ndarray, hit: np.ndarray) -> float:
    """The lower of the mean recall of all audited queries and of those with few matches, so that no large group hides them."""
    if not len(row):
        return 1.0
    number, found = np.bincount(row), np.bincount(row, hit)
    share = found[number > 0] / number[number > 0]
    few = share[number[number > 0] <= FEW]
    return min(share.mean(), few.mean() if len(few) else 1.0)


def audited_search(graph: Graph, queries: np.ndarray, least: float) -> np.ndarray:
    """Pairs as query * nodes + position. Beams widen until the recall of an audited sample reaches the target, of AUDITED
    queries (a match with itself is none) as of the planted ones; its size is fixed, so an audit costs no more than a search."""
    size, beam = graph.sizes[0], BEAM
    at = np.random.default_rng(len(queries)).permutation(len(queries))[:AUDITED]
    truths = []
    for sample in (queries[at], planted(graph.vectors, least)):
        row, col = matches(graph, sample, least)
        if not truths and queries is graph.vectors:
            other = at[row] != col
            row, col = row[other], col[other]
        truths.append((sample, row, col))

    def reached() -> bool:
        return all(recalls(row, np.isin(row * size + col, q * size + x)) >= RECALL
                   for sample, row, col in truths for q, x in [graph.within(sample, least, beam)])

    while beam < size and not reached():
        beam *= 2
    q, x = graph.within(queries, least, beam)
    _, row, col = truths[0]
    return np.union1d(q * size + x, at[row] * size + col)


def _pack(**arrays: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """One stored graph from the vectors of a shard, in pieces that Spark can sort and spill."""
    node = frame["node"].to_numpy(np.int64)
    uniform = (mix(node.astype(U64)) >> U64(11)).astype(float) / 2 ** 53
    level = np.floor(-np.log(np.maximum(uniform, 1e-18)) / np.log(FAN)).astype(np.int64)
    level[uniform.argmin()] = max(1, level.max())  # so that the base has a layer above it
    order = np.lexsort((node, -level))
    node, level = node[order], level[order]
    raw = np.stack(frame["vector"].to_list()).astype(float)[order]
    scale = np.abs(raw).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    unit = raw / scale
    unit /= np.sqrt(np.einsum("nd,nd->n", unit, unit))[:, None]
    sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
    graph = Graph(unit.astype(np.float32), sizes)
    layers = {f"{name}{k}": value for name, values in (("links", graph.links), ("homes", graph.homes))
              for k, value in enumerate(values)}
    blob = _pack(node=node, copies=frame["copies"].to_numpy(np.int64)[order], unit=unit, sizes=np.array(sizes), **layers)
    pieces = [blob[low:low + PIECE] for low in range(0, len(blob), PIECE)]
    return pd.DataFrame({"dim": frame["dim"].iloc[0], "shard": frame["shard"].iloc[0], "piece": np.arange(len(pieces)),
                         "graph": pieces})


def _labels(left: np.ndarray, right: np.ndarray, count: int) -> np.ndarray:
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def search_cell(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between two shards (or inside one): per linked node the number of vectors linked and a node of its component."""
    sides = []
    for _, pieces in frame.groupby("shard"):
        stored = np.load(io.BytesIO(b"".join(pieces.sort_values("piece")["graph"])))
        sizes = stored["sizes"].tolist()
        unit = stored["unit"]
        links, homes = ([stored[f"{name}{k}"] for k in range(len(sizes))] for name in ("links", "homes"))
        sides.append((stored["node"], stored["copies"], unit, Graph(unit.astype(np.float32), sizes, links, homes)))
    (node_a, copies_a, unit_a, graph_a), (node_b, copies_b, unit_b, graph_b) = sides[0], sides[-1]
    loose = np.float32(least - 1e-4)
    size_a, size_b = len(node_a), len(node_b)
    codes = audited_search(graph_a, graph_b.vectors, loose)
    pairs = [(codes % size_a, codes // size_a)]
    if len(sides) == 2:
        codes = audited_search(graph_b, graph_a.vectors, loose)
        pairs.append((codes // size_b, codes % size_b))
    code = np.unique(np.concatenate([a * size_b + b for a, b in pairs]))
    a, b = code // size_b, code % size_b
    if len(sides) == 1:
        code = np.unique(np.minimum(a, b) * size_b + np.maximum(a, b))
        a, b = code // size_b, code % size_b
        a, b = a[a != b], b[a != b]
    true = np.concatenate([np.einsum("nd,nd->n", unit_a[a[i:i + 50_000]], unit_b[b[i:i + 50_000]]) >= least
                           for i in range(0, len(a), 50_000)] or [np.zeros(0, bool)])
    a, b = a[true], b[true]
    if len(sides) == 1:
        node, links = node_a, np.bincount(a, copies_a[b], size_a) + np.bincount(b, copies_a[a], size_a)
        label = _labels(a, b, size_a)
    else:
        node = np.concatenate([node_a, node_b])
        links = np.concatenate([np.bincount(a, copies_b[b], size_a), np.bincount(b, copies_a[a], size_b)])
        label = _labels(a, b + size_a, size_a + size_b)
    at = links > 0
    return pd.DataFrame({"node": node[at], "links": links[at].astype(np.int64), "near": node[label[at]]})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 least: float = 0.9) -> DataFrame:
    """Per row: the id, n_links (other vectors with a cosine of at least `least`, in double precision), component_id (the
    smallest id that links reach) and kept (the row's id is its component's).

    A vector that is null, empty, zero, or has a null or non-finite component links with nothing. Vectors of different
    lengths never link. Equal vectors are one node however many they are, and link with each other. Rows that
    repeat an id count as vectors of their own and are kept alike; a null id is never kept. Other columns are left out. Empty
    table: no rows. Links that the graphs miss are missed (audits keep recall at RECALL); none below `least` is
    ever linked. Memory of a cell grows with the links between its two shards.
    """
    value = F.col("vector")
    usable = (value.isNotNull() & (F.size("vector") > 0)
              & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists(value, lambda x: x != 0))
    rows = stage(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
                 .withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    nodes = stage(rows.filter("usable").groupBy("vector").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
                  .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vector-nodes")
    shards = F.greatest(F.lit(MIN_SHARDS), F.ceil(F.count("*") * F.max("dim") * 8 / SHARD_BYTES)).cast("int")
    count = nodes.agg(shards).first()[0] or MIN_SHARDS
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(count)).cast("int"))
    graphs = stage(ship(dealt.select("dim", "shard", "node", "copies", "vector")).groupBy("dim", "shard")
                   .applyInPandas(build_shard, "dim int, shard int, piece int, graph binary"), "graphs")
    other = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_other")
    cells = graphs.select("*", other).select("dim", F.least("shard", "_other").alias("_i"),
                                             F.greatest("shard", "_other").alias("_j"), "shard", "piece", "graph")
    # more partitions than cells, so that few tasks have two
    cells = cells.repartition(count * (count + 1) // 2 + SPARE_TASKS, "dim", "_i", "_j")
    # a cell of two shards of which one is empty has one graph that is not its own, and no links
    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[1] != key[2] and frame["shard"].nunique() < 2:
            return pd.DataFrame({"node": [], "links": [], "near": []}, dtype="int64")
        return search_cell(frame, least)

    found = stage(cells.groupBy("dim", "_i", "_j").applyInPandas(search, "node bigint, links bigint, near bigint"),
                  "vector-links")
    linked = components(found.filter("node <> near").select(F.col("node").alias("src"), F.col("near").alias("dst")))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.join(totals, "node", "left").join(linked, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "component").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.filter("usable").join(named, "vector", "left").unionByName(
        rows.filter("not usable").withColumn("n_links", F.lit(0).cast("bigint")).withColumn("component_id", F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_hnsw_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
