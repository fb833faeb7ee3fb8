"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. A first graph links nodes that lie together in a few orders along
random hyperplanes. Then the graph is improved by joins of neighbours of neighbours: every node
is a meeting place of the nodes it points to and of those that point to it, each pair that has
not met there before is compared, and every node keeps the K nearest it has been shown, until
few lists change. Meeting places are dealt to cells of bounded size; a node's vector, a byte per
component, travels once to each cell where it meets others, and a cell proposes to a node only
the nearest of those it found. A place that very many nodes point to is dealt as several, and
one place is worked through in blocks, so no group grows with the table.

A query walks the graph: all nodes of its list of the nearest ones found that it has not yet
visited are joined with their neighbours, distances are taken, and the nearest of both stay,
until a step shows nothing new. The last list is ranked again by the original vectors in double
precision, and nodes become the rows they stand for.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without a vec_id or whose vector has another length than most (of equally frequent lengths the
greatest counts). Repeated rows count once; one vec_id with several vectors is several rows.
Columns other than vec_id and embedding are ignored. An empty table gives no rows. The graph takes
greatest components from about 1e-36 to 1e38, as float32 holds them; scores take any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.storage import forget, materialised

#: Neighbours of a node, and orders along random hyperplanes that the first graph comes from.
NEIGHBOURS, ORDERS = 48, 2
#: Hyperplanes whose sides make the first part of an order.
PLANES = 8
#: Nodes compared with each other in the first graph, and at a meeting place at once.
TOGETHER, BLOCK = 96, 144
#: Most meeting places of a cell (every core has two cells or more), and nodes that point to one
#: place before it is dealt as several.
CELL, HUB = 8192, 4096
#: Nodes that a cell proposes to one node.
PROPOSED = 12
#: The graph is done when a smaller share of its links is new, or after so many rounds.
CHANGING, ROUNDS = 0.12, 16
#: Nodes in a query's list while it searches.
BEAM = 96
#: Smaller tables are compared as a whole.
WHOLE = 1024

_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float32())])


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def packed(vectors: np.ndarray) -> list[bytes]:
    """Each vector as its greatest component over 127 (float32) and one byte per component."""
    scale = np.abs(vectors).max(1, keepdims=True) / 127
    small = np.rint(vectors / scale).astype(np.int8)
    return [s + v for s, v in zip(map(bytes, scale.astype("<f4")), map(bytes, small))]


class _Codes:
    """Packed vectors for comparing. Products of bytes are exact, so a pair always has one distance."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        rows = column.to_pylist()
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        dims = raw.shape[1] - 4
        self.scale = np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0].astype(np.float64)
        # Sums of products of bytes fit a float32 up to a thousand components.
        self.codes = raw[:, 4:].view(np.int8).astype(np.float32 if dims <= 1000 else np.float64)
        self.norm = self.scale**2 * (self.codes.astype(np.float64) ** 2).sum(1)

    def among(self, at: np.ndarray) -> np.ndarray:
        """Squared distances between all nodes of each row of ``at``."""
        x = self.codes[at]
        dots = (x @ x.transpose(0, 2, 1)).astype(np.float64)
        scale, norm = self.scale[at], self.norm[at]
        far = (norm[:, :, None] + norm[:, None, :]) - 2 * (scale[:, :, None] * scale[:, None, :]) * dots
        return np.maximum(far, 0).astype(np.float32)

    def between(self, other: _Codes) -> np.ndarray:
        """Squared distance of each vector to its counterpart."""
        dots = (self.codes * other.codes).astype(np.float64).sum(1)
        return np.maximum((self.norm + other.norm) - 2 * (self.scale * other.scale) * dots, 0).astype(np.float32)


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each ``a`` the ``most`` nearest ``b``, each once."""
    order = np.argsort(a.astype(np.uint64) << np.uint64(32) | d.view(np.uint32), kind="stable")
    a, b, d = a[order], b[order], d[order]
    once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    a, b, d = a[once], b[once], d[once]
    lead = np.r_[True, a[1:] != a[:-1]][: len(a)]
    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(lead, np.arange(len(a)), 0))
    return a[rank < most], b[rank < most], d[rank < most]


def _meet(codes: _Codes, bound: np.ndarray, blocks: list[np.ndarray], fresh: list[np.ndarray], most: int) -> tuple:
    """(a, b, distance) of nodes that meet in a block over a fresh link and are nearer than a's bound."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    waiting = 0
    order = sorted(range(len(blocks)), key=lambda i: len(blocks[i]))
    start = 0
    while start < len(order):
        wide = len(blocks[order[min(len(order), start + 64) - 1]])
        take = order[start : start + max(1, min(64, (1 << 20) // max(1, wide) ** 2))]
        start += len(take)
        wide = len(blocks[take[-1]])
        at, there, new = np.zeros((len(take), wide), np.int64), np.zeros((len(take), wide), bool), np.zeros((len(take), wide), bool)
        for row, i in enumerate(take):
            at[row, : len(blocks[i])], there[row, : len(blocks[i])], new[row, : len(blocks[i])] = blocks[i], True, fresh[i]
        d = codes.among(at)
        good = (d < bound[at][:, :, None]) & there[:, :, None] & there[:, None, :]
        good &= (new[:, :, None] | new[:, None, :]) & (at[:, :, None] != at[:, None, :])
        k, i, j = np.nonzero(good)
        found.append((at[k, i], at[k, j], d[k, i, j]))
        waiting += len(k)
        if waiting > 1 << 21:
            found = [_nearest(*map(np.concatenate, zip(*found)), most)]
            waiting = 0
    return _nearest(*map(np.concatenate, zip(*found)), most)


def _proposals(names: np.ndarray, found: tuple) -> pa.Table:
    return pa.table([pa.array(names[found[0]]), pa.array(names[found[1]]), pa.array(found[2], pa.float32())], schema=_PAIRS)


def _kept(pairs: DataFrame, most: int) -> DataFrame:
    """node, links (d, b, fresh; nearest first) from pairs (a, b, d, fresh): the ``most`` nearest of each."""
    near = pairs.withColumn("place", F.dense_rank().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("place") <= most)
    once = near.groupBy("a", "b", "d").agg(F.min("fresh").alias("fresh"))
    return once.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list(F.struct("d", "b", "fresh"))).alias("links"))


def _ordered(nodes: DataFrame, n: int, dims: int) -> DataFrame:
    """Pairs (a, b, d, fresh) of nodes that are near in an order along random hyperplanes."""
    rng = np.random.default_rng(42)
    planes = rng.standard_normal((ORDERS, dims, PLANES + 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(dims), 0
        for batch in batches:
            total += _matrix(batch.column(0)).sum(0)
            count += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total), pa.array([count] * dims)], ["dim", "total", "n"])

    added = nodes.select("embedding").mapInArrow(sums, "dim bigint, total double, n bigint")
    centre = np.zeros(dims)
    for row in added.groupBy("dim").agg((F.sum("total") / F.sum("n")).alias("mean")).collect():
        centre[row["dim"]] = row["mean"] or 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1)) - centre
            for k in range(ORDERS):
                along = vectors @ planes[k]
                side = (along[:, :PLANES] > 0) @ (1 << np.arange(PLANES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(batch), pa.int32()), pa.array(side), pa.array(along[:, PLANES]), batch.column(0), batch.column(2)],
                    ["kind", "side", "along", "node", "code"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = TOGETHER if n > WHOLE else WHOLE + 1

        def block(rows: pa.Table) -> pa.RecordBatch:
            every = np.arange(len(rows))
            inside = np.array_split(every, max(1, len(every) // together))
            found = _meet(_Codes(rows["code"]), np.full(len(rows), np.inf, np.float32), inside, [np.ones(len(x), bool) for x in inside], NEIGHBOURS)
            return _proposals(rows["node"].to_numpy(), found).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 64 * together:
                rows = pa.Table.from_batches(held)
                whole = len(rows) // together * together - together
                yield from block(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
        if held:
            yield from block(pa.Table.from_batches(held))

    rows = nodes.select("node", "embedding", "code").mapInArrow(place, "kind int, side bigint, along double, node bigint, code binary")
    if n <= WHOLE:
        rows = rows.where("kind = 0").select("node", "code").coalesce(1)
    else:
        order = ["kind", "side", "along", "node"]
        rows = rows.repartitionByRange(max(1, ORDERS * n // CELL), *order).sortWithinPartitions(*order).select("node", "code")
    return rows.mapInArrow(compare, "a bigint, b bigint, d float").withColumn("fresh", F.lit(True))


def _proposed(graph: DataFrame, cells: int, round_number: int) -> DataFrame:
    """Pairs (a, b, d, fresh) from all meeting places of a graph."""
    out = graph.select("node", F.explode("links").alias("l")).select("node", F.col("l.b").alias("b"), F.col("l.fresh").alias("fresh"))
    links = out.select(F.col("node").alias("place"), F.col("b").alias("m"), "fresh").unionByName(
        out.select(F.col("b").alias("place"), F.col("node").alias("m"), "fresh")
    )
    hubs, hub_path = materialised(links.groupBy("place").count().where(F.col("count") > HUB), "hubs")
    part = F.lit(0).cast("bigint")
    if not hubs.isEmpty():
        links = links.join(hubs, "place", "left")
        part = F.when(F.isnull("count"), 0).otherwise(F.pmod(F.xxhash64("m", F.lit(round_number)), F.ceil(F.col("count") / BLOCK)))
    links = links.withColumn("part", part).unionByName(
        graph.select(F.col("node").alias("place"), F.col("node").alias("m"), F.lit(False).alias("fresh"), F.lit(0).cast("bigint").alias("part")),
        allowMissingColumns=True,
    )
    links = links.select("place", "part", "m", "fresh", F.pmod(F.xxhash64("place", "part", F.lit(round_number)), F.lit(cells)).alias("cell"))
    last = F.when(F.size("links") < NEIGHBOURS, F.lit(float("inf"))).otherwise(F.element_at("links", -1)["d"]).cast("float")
    known = graph.select(F.col("node").alias("m"), "code", last.alias("bound"))
    guests = links.select(F.col("cell").alias("cell"), F.col("m").alias("m")).distinct().join(known, "m")

    def meet(places: pa.Table, guests: pa.Table) -> pa.Table:
        names = guests["m"].to_numpy()
        by_name = np.argsort(names)
        row = by_name[np.searchsorted(names[by_name], places["m"].to_numpy())]
        place, part, fresh = (places[c].to_numpy() for c in ("place", "part", "fresh"))
        # Hubs are cut at random, so other members share a block in the next round.
        shuffled = np.random.default_rng(round_number).permutation(len(row))
        order = shuffled[np.lexsort((~fresh[shuffled], row[shuffled], part[shuffled], place[shuffled]))]
        place, part, row, fresh = place[order], part[order], row[order], fresh[order]
        once = np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (row[1:] != row[:-1])]
        place, part, row, fresh = place[once], part[once], row[once], fresh[once]
        cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1]), True])
        blocks, news = [], []
        for low, high in zip(cuts[:-1], cuts[1:]):
            own = np.arange(low, high) if high - low <= BLOCK else low + np.random.default_rng([round_number, low]).permutation(high - low)
            for some in np.array_split(own, -(-len(own) // BLOCK)):
                if fresh[some].any():
                    blocks.append(row[some])
                    news.append(fresh[some])
        return _proposals(names, _meet(_Codes(guests["code"]), guests["bound"].to_numpy(), blocks, news, PROPOSED))

    met = links.groupBy("cell").cogroup(guests.groupBy("cell")).applyInArrow(meet, "a bigint, b bigint, d float")
    return met.withColumn("fresh", F.lit(True))


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """node, code, links (d: squared distance, b: node, fresh) of nodes (node, embedding)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array(packed(_matrix(batch.column(1))), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], ["node", "embedding", "code"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    coded, coded_path = materialised(nodes.mapInArrow(pack, f"node bigint, embedding {kind}, code binary"), "codes")
    size = coded.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    codes = coded.select("node", "code")

    def written(pairs: DataFrame) -> tuple[DataFrame, str]:
        return materialised(codes.join(_kept(pairs, NEIGHBOURS), "node", "left").withColumn("links", F.coalesce("links", F.array())), "graph")

    graph, path = written(_ordered(coded, size["n"], size["dims"] or 0))
    cells = max(2 * nodes.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // CELL))
    for round_number in range(ROUNDS if size["n"] > WHOLE else 0):
        pairs = graph.select(F.col("node").alias("a"), F.explode("links").alias("l")).select(
            "a", F.col("l.b").alias("b"), F.col("l.d").alias("d"), F.lit(False).alias("fresh")
        )
        proposed = _proposed(graph, cells, round_number)
        following, next_path = written(pairs.unionByName(proposed))
        forget(nodes.sparkSession, path)
        graph, path = following, next_path
        new = graph.agg(F.avg(F.size(F.filter("links", lambda l: l["fresh"])))).first()[0]
        if new < CHANGING * NEIGHBOURS:
            break
    return graph


def search(graph: DataFrame, starts: DataFrame, beam: int = BEAM) -> DataFrame:
    """query, node: the ``beam`` nodes nearest to each query that greedy search finds.

    ``starts``: query (unique), code (its packed vector) and node (where its walk begins).
    """
    links = graph.select("node", F.col("links.b").alias("next"))
    codes = graph.select("node", F.col("code").alias("other"))

    def measured(pairs: DataFrame) -> DataFrame:
        """(query, node, d) of (query, code, node)."""

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _Codes(batch["code"]).between(_Codes(batch["other"])) if len(batch) else np.empty(0, np.float32)
                yield pa.RecordBatch.from_arrays([batch["query"], batch["node"], pa.array(d)], ["query", "node", "d"])

        return pairs.join(codes, "node").select("query", "node", "code", "other").mapInArrow(measure, "query bigint, node bigint, d float")

    def stays(rows: DataFrame) -> DataFrame:
        first = Window.partitionBy("query").orderBy("d", "node")
        return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= beam).drop("place")

    walkers = starts.select("query", "code")
    found, path = materialised(measured(starts).withColumn("done", F.lit(False)), "beams")
    while True:
        ahead = found.where("not done").join(links, "node").select("query", F.explode("next").alias("node")).distinct()
        shown = measured(ahead.join(walkers, "query")).withColumn("done", F.lit(False))
        both = found.withColumn("done", F.lit(True)).unionByName(shown)
        following, next_path = materialised(stays(both.groupBy("query", "node", "d").agg(F.max("done").alias("done"))), "beams")
        forget(graph.sparkSession, path)
        found, path = following, next_path
        if found.where("not done").isEmpty():
            return found.select("query", "node")


def usable(table: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) that take part: finite, not zero, of the most frequent length."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where("vec_id is not null")
    kind = rows.schema["embedding"].dataType.elementType
    infinite = F.lit(float("inf")).cast(kind)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    # Adding zero makes equal components equal in their bits.
    alike = F.transform("embedding", lambda x: x + F.lit(0).cast(kind))
    return rows.where(F.size("embedding") == (sizes["size"] if sizes else 0)).select("vec_id", alike.alias("embedding")).distinct()


def _spread(found: DataFrame, members: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """Rows of the nodes found: query_id, rank, vec_id, score by the original vectors."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _matrix(batch["embedding"]) - _matrix(batch["other"]) if len(batch) else np.empty((0, 1))
            score = np.sqrt((apart**2).sum(1))
            yield pa.RecordBatch.from_arrays([batch["query"], batch["node"], pa.array(score)], ["query", "node", "score"])

    vectors = members.where("place = 1").select("node", "embedding")
    pairs = found.join(vectors, "node").join(vectors.select(F.col("node").alias("query"), F.col("embedding").alias("other")), "query")
    exact = pairs.select("query", "node", "embedding", "other").mapInArrow(measure, "query bigint, node bigint, score double")
    # No row has more than the ``most`` nearest nodes among its nearest rows, but itself.
    closest = Window.partitionBy("query").orderBy("score", "node")
    near = exact.withColumn("near", F.rank().over(Window.partitionBy("query").orderBy("score"))).where(F.col("near") <= most + 1).drop("near")
    rows = near.join(queries, "query").join(members.select("node", "vec_id"), "node")
    rows = rows.where((F.col("vec_id") != F.col("query_id")) | (F.col("node") != F.col("query")))
    first = Window.partitionBy("query_id", "query").orderBy("score", "vec_id", "node")
    ranked = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, is_query: Column | str, most: int = 10) -> DataFrame:
    """The ``most`` nearest rows found for each query, which are rows of ``table`` themselves.

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance of the original vectors),
    ties to the smaller vec_id; all other rows where there are no more than ``most``.
    """
    rows, _ = materialised(usable(table), "vectors")
    # Of equal vectors, the first few ids can be among anybody's nearest; combined before the shuffle.
    own = Window.partitionBy("embedding").orderBy("vec_id")
    first, _ = materialised(rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= most + 1), "first-rows")
    nodes, _ = materialised(first.where("place = 1").select(F.monotonically_increasing_id().alias("node"), "embedding"), "nodes")
    members, _ = materialised(first.join(nodes, "embedding"), "members")
    asked = rows.where(is_query).join(nodes, "embedding").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    queries, _ = materialised(asked, "queries")
    graph = neighbour_graph(nodes)
    starts = queries.select("query").distinct().join(graph.select(F.col("node").alias("query"), "code"), "query")
    found, _ = materialised(search(graph, starts.withColumn("node", F.col("query"))), "found")
    return _spread(found, members, queries, most)
