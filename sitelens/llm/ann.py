"""Approximate nearest neighbours: a graph by NN-descent in Spark joins, searched greedily by all queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import saved


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(id, vec_id, v): the vectors of length other than zero whose components are all finite, of the commonest dimension.

    ``id`` is the row's own, as several rows may have one vec_id. Rows without a vec_id are left out.
    """
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = typed.filter(finite & F.exists("v", lambda x: x != 0))
    size = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).select("d")
    return good.join(F.broadcast(size), F.size("v") == F.col("d"), "left_semi").select(F.monotonically_increasing_id().alias("id"), "vec_id", "v")


def _matrix(column, kind) -> np.ndarray:
    """The rows of a binary column as a matrix."""
    n = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(n, -1) if n else np.zeros((0, 1), kind)


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in 32 and 16 bits, and 48 random projections' signs as a number."""
    for batch in batches:
        rows = batch.column("v")
        n = len(rows)
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        planes = np.random.default_rng(7).standard_normal((x.shape[1], 48))
        code = ((x @ planes > 0) * (1 << np.arange(48, dtype=np.int64))).sum(axis=1)
        yield pa.record_batch([batch.column("id"), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary()), pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary()), pa.array(code, pa.int64())], ["id", "v", "h", "code"])


def _by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come in the order of ``key``; a table has as many groups as a batch ends."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None:
        yield held.combine_chunks()


def _best(node: np.ndarray, near: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different partners of each node, nodes in order."""
    order = np.lexsort((-sim, near, node))
    first = np.append(True, (np.diff(node[order]) != 0) | (np.diff(near[order]) != 0)) if len(order) else np.zeros(0, bool)
    order = order[first & (node[order] != near[order])]
    order = order[np.lexsort((near[order], -sim[order], node[order]))]
    start = np.append(True, np.diff(node[order]) != 0) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < k]


def _pairs_inside(x: np.ndarray, radius: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, partner, similarity) of each row's ``most`` best partners among the rows, those above its radius."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    top = np.argpartition(-s, min(most, len(s) - 1) - 1, axis=1)[:, :most] if len(s) > 1 else np.zeros((len(s), 0), np.int64)
    row = np.repeat(np.arange(len(s)), top.shape[1])
    value = np.take_along_axis(s, top, 1).ravel()
    keep = value > radius[row]
    return row[keep], top.ravel()[keep], value[keep]


_PROPOSALS = "id long, near array<long>, sim array<float>"


def _propose(ids: np.ndarray, row: np.ndarray, partner: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(row, kind="stable")
    row, partner, sim = row[order], partner[order], sim[order]
    at = np.flatnonzero(np.append(True, np.diff(row) != 0)) if len(row) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(at, len(row)))
    return pa.record_batch([pa.array(ids[row[at]], pa.int64()), _lists(partner, sizes, pa.int64()), _lists(sim.astype(np.float32), sizes, pa.float32())], ["id", "near", "sim"])


def neighbour_graph(points: DataFrame, *, k: int = 20, reverse: int = 24, rounds: int = 9, least: float = 0.005, leaf: int = 256, deals: int = 3, proposals: int = 8) -> DataFrame:
    """(id, near, sim): about the k nearest of every row of ``points`` (id, h binary of 16-bit floats, code).

    First neighbours: the best inside groups of equal signs on random planes, these dealt by hash into groups of about
    ``leaf``, in ``deals`` ways, so that paths lead from each group to others. Each round joins every node with its neighbours and a hashed choice of ``reverse`` nodes that have it as a neighbour,
    compares these among one another, and keeps each one's k best; a node proposes to each of these its ``proposals`` best others, what is
    left comes again in the next round. It ends when fewer than ``least`` of all entries change.
    """
    n = points.count()
    width = max(1, -(-n // leaf))
    bits = max(0, width.bit_length() - 2)
    sized = points.withColumn("deal", F.explode(F.array(*map(F.lit, range(deals))))).withColumn("cell", F.expr(f"shiftright(code, deal * {48 // deals})").bitwiseAND(F.lit((1 << min(bits, 48 // deals)) - 1)))
    parts = sized.groupBy("deal", "cell").agg(F.ceil(F.count("*") / leaf).alias("parts"))
    dealt = sized.join(parts, ["deal", "cell"]).withColumn("group", F.xxhash64("deal", "cell", F.pmod(F.xxhash64("id", "deal"), F.col("parts")))).select("group", "id", "h").repartition("group").sortWithinPartitions("group")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "group"):
            keys, ids, x = table["group"].to_numpy(), table["id"].to_numpy(), _matrix(table["h"], "<f2").astype(np.float32)
            at = np.flatnonzero(np.append(True, np.diff(keys) != 0))
            for a, b in zip(at, [*at[1:], len(keys)], strict=True):
                row, partner, sim = _pairs_inside(x[a:b], np.full(b - a, -2.0), k)
                yield _propose(ids[a:b], row, ids[a:b][partner], sim)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "id"):
            sizes = np.diff(table["near"].combine_chunks().offsets.to_numpy()) if isinstance(table["near"], pa.ChunkedArray) else np.diff(table["near"].offsets.to_numpy())
            node = np.repeat(table["id"].to_numpy(), sizes)
            near, sim = table["near"].combine_chunks().flatten().to_numpy(), table["sim"].combine_chunks().flatten().to_numpy()
            best = _best(node, near, sim, k)
            ids, at = np.unique(node[best], return_index=True)
            count = np.diff(np.append(at, len(best)))
            yield pa.record_batch([pa.array(ids), _lists(near[best], count, pa.int64()), _lists(sim[best], count, pa.float32())], ["id", "near", "sim"])

    def merged(frame: DataFrame) -> DataFrame:
        return frame.repartition("id").sortWithinPartitions("id").mapInArrow(merge, _PROPOSALS)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, "center"):
            keys, ids, radius, x = table["center"].to_numpy(), table["id"].to_numpy(), table["radius"].to_numpy(), _matrix(table["h"], "<f2").astype(np.float32)
            at = np.flatnonzero(np.append(True, np.diff(keys) != 0))
            found = []
            for a, b in zip(at, [*at[1:], len(keys)], strict=True):
                row, partner, sim = _pairs_inside(x[a:b], radius[a:b], proposals)
                found.append((row + a, partner + a, sim))
            row, partner, sim = (np.concatenate(c) for c in zip(*found, strict=True))
            best = _best(ids[row], ids[partner], sim, k)
            first = ids[row[best]]
            node, at = np.unique(first, return_index=True)
            count = np.diff(np.append(at, len(best)))
            yield pa.record_batch([pa.array(node), _lists(ids[partner[best]], count, pa.int64()), _lists(sim[best].astype(np.float32), count, pa.float32())], ["id", "near", "sim"])

    graph = saved(merged(dealt.mapInArrow(begin, _PROPOSALS)), "graph")
    chosen = F.row_number().over(Window.partitionBy("center").orderBy(F.xxhash64("center", "id"), "id"))
    for _ in range(rounds):
        # A node's radius is the similarity of its k-th neighbour: nothing below it can help.
        full = points.select("id", "h").join(graph.select("id", F.when(F.size("sim") >= k, F.array_min("sim")).otherwise(-2.0).cast("float").alias("radius")), "id", "left").withColumn("radius", F.coalesce("radius", F.lit(-2.0).cast("float")))
        edges = graph.select(F.col("id").alias("center"), F.explode("near").alias("id"))
        back = edges.select(F.col("id").alias("center"), F.col("center").alias("id")).withColumn("rank", chosen).filter(F.col("rank") <= reverse).select("center", "id")
        own = points.select(F.col("id").alias("center"), "id")
        members = edges.union(back).union(own).distinct()
        around = members.join(full, "id").repartition("center").sortWithinPartitions("center")
        new = saved(merged(around.mapInArrow(compare, _PROPOSALS).unionByName(graph)), "graph")
        moved = new.join(graph.select("id", F.col("near").alias("old")), "id").agg(F.sum(F.size(F.array_except("near", F.coalesce("old", F.array().cast("array<long>"))))), F.sum(F.size("near"))).first()
        graph = new
        if (moved[0] or 0) <= least * (moved[1] or 1):
            break
    return graph


def search_graph(points: DataFrame, graph: DataFrame, queries: DataFrame, *, beam: int = 160, width: int = 40, hops: int = 8, sample: int = 2048, least: int = 16, share: float = 0.04, reverse: int = 20, block: int = 16_384) -> DataFrame:
    """(query_id, id): for each row of ``queries`` (query_id, v) the ``beam`` best points that a greedy search has met.

    A query begins at the best of ``sample`` points, at most a ``share`` of all but for ``least``, and, hop by hop, looks at the neighbours (in either direction) of the
    ``width`` best points that it has not yet left from, keeping the ``beam`` best. Queries go in blocks of at most ``block``, whose vectors are sent
    to the tasks; the number of points does not bear on what is sent.
    """
    back = graph.select(F.explode("near").alias("id"), F.col("id").alias("near"))
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("id", "near"), "near"))).filter(F.col("rank") <= reverse).groupBy("id").agg(F.collect_list("near").alias("back"))
    adjacent = saved(graph.select("id", "near").join(back, "id", "full").select("id", F.array_union(F.coalesce("near", F.array().cast("array<long>")), F.coalesce("back", F.array().cast("array<long>"))).alias("near")), "adjacent")
    sample = min(sample, max(least, int(points.count() * share)))
    some = points.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").collect()
    entry_ids, entry = np.array([r["id"] for r in some], np.int64), np.array([np.frombuffer(r["v"], "<f4") for r in some])
    blocks = max(1, -(-queries.count() // block))
    results = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id")
        rows = own.collect()
        if not rows:
            continue
        ids, q = np.array([r["query_id"] for r in rows], np.int64), np.array([np.frombuffer(r["v"], "<f4") for r in rows])

        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = _matrix(batch.column("v"), "<f4") @ entry.T
                k = min(beam, s.shape[1])
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pa.record_batch([pa.array(np.repeat(batch.column("query_id").to_numpy(), k)), pa.array(entry_ids[top.ravel()]), pa.array(np.take_along_axis(s, top, 1).ravel()), pa.array(np.zeros(top.size, bool))], ["query_id", "id", "score", "left"])

        def score(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("v"), "<f4")
                at = np.searchsorted(ids, batch.column("query_id").to_numpy())
                s = np.einsum("ij,ij->i", q[at], x) if len(at) else np.zeros(0, np.float32)
                yield pa.record_batch([batch.column("query_id"), batch.column("id"), pa.array(s.astype(np.float32)), pa.array(np.zeros(len(at), bool))], ["query_id", "id", "score", "left"])

        kind = "query_id long, id long, score float, left boolean"
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        state = saved(own.mapInArrow(begin, kind).withColumn("rank", best).filter(F.col("rank") <= beam), "beam")
        for _ in range(hops):
            front = state.filter(~F.col("left")).withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("turn") <= width).select("query_id", "id")
            met = front.join(adjacent, "id").select("query_id", F.explode("near").alias("id")).distinct().join(state.select("query_id", "id"), ["query_id", "id"], "left_anti")
            scored = met.join(points.select("id", "v"), "id").select("query_id", "id", "v").mapInArrow(score, kind)
            turned = state.join(front.withColumn("now", F.lit(True)), ["query_id", "id"], "left").select("query_id", "id", "score", (F.col("left") | F.coalesce("now", F.lit(False))).alias("left"))
            state = saved(turned.unionByName(scored).withColumn("rank", best).filter(F.col("rank") <= beam), "beam")
            if state.filter(~F.col("left") & (F.col("rank") <= width)).isEmpty():
                break
        found = state.select("query_id", "id")
        results = found if results is None else results.unionByName(found)
    return results


def nearest_neighbours(vectors: DataFrame, is_query, *, k: int = 5, graph_k: int = 24, **search) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector with ``is_query``, by cosine.

    ``vectors``: (vec_id, embedding). Scores are exact cosines in double precision of the original vectors; ties go to
    the smaller vec_id; the query itself is no candidate. Null, zero and non-finite vectors, ones with null components and ones of a
    dimension other than the commonest take no part, nor do rows without a vec_id. Every row counts for itself, also of a repeated vec_id: as a query,
    and as a candidate of all other rows. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = saved(usable_vectors(vectors), "vectors")
    if usable.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = saved(usable.mapInArrow(_encode, "id long, v binary, h binary, code long"), "points")
    graph = neighbour_graph(points, k=graph_k)
    queries = points.join(usable.filter(is_query(F.col("vec_id"))).select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "v")
    found = search_graph(points, graph, queries, **search)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pairs = found.filter("query_id <> id").join(usable.select("id", "vec_id", "v"), "id").join(usable.select(F.col("id").alias("query_id"), F.col("vec_id").alias("query"), F.col("v").alias("q")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1)) for c in ("v", "q"))
            s = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.record_batch([*(batch.column(c) for c in ("query_id", "query", "id", "vec_id")), pa.array(s)], ["row", "query_id", "id", "vec_id", "score"])

    scored = pairs.select("query_id", "query", "id", "vec_id", "v", "q").mapInArrow(exact, "row long, query_id long, id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 5 nearest of every 50th vector among all others."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
