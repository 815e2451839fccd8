"""Near-duplicate embeddings by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import ranked
from .common import components, cut, table

#: Leading principal dimensions of the grid, vectors in an interval that is moved as one, and in one that is compared outright.
DIMS, INTERVAL, LEAF = 8, 1024, 64


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: Partial sums that are added up in one task, at most, before the last one.
FAN = 16


def _axes(classes: DataFrame, vector: str) -> dict[int, np.ndarray]:
    """By dimension of vectors: the leading principal axes of all unit vectors of that dimension (rows), from sums of products.

    Sums travel as one block of numbers for each task, are added up in two steps, and what comes back are the axes alone.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            col, size = b.column(0), b.column(1).to_numpy()
            for n in np.unique(size).tolist():
                x = _unit(_matrix(col.filter(pa.array(size == n))))
                x = np.hstack((x, np.ones((len(x), 1))))
                sums[n] = sums.get(n, 0) + x.T @ x
        fan = TaskContext.get().partitionId() % FAN
        for n, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([fan], pa.int32()), pa.array([s.tobytes()])], names=["n", "fan", "s"])

    def added(part: pa.Table) -> np.ndarray:
        n = part.column("n")[0].as_py() + 1
        total = np.zeros(n * n)
        for x in part.column("s"):
            total += np.frombuffer(x.as_buffer())
        return total.reshape(n, n)

    def summed(part: pa.Table) -> pa.Table:
        return pa.table({"n": part.column("n").slice(0, 1), "s": pa.array([added(part).tobytes()])})

    def principal(part: pa.Table) -> pa.Table:
        s = added(part)
        n = len(s) - 1
        mean = s[n, :n] / s[n, n]
        _, vectors = np.linalg.eigh(s[:n, :n] / s[n, n] - np.outer(mean, mean))
        return pa.table({"n": part.column("n").slice(0, 1), "axes": pa.array([np.ascontiguousarray(vectors[:, ::-1][:, :DIMS].T).tobytes()])})

    parts = classes.select(vector, F.size(vector).alias("n")).mapInArrow(products, "n int, fan int, s binary")
    sums = parts.groupBy("n", "fan").applyInArrow(summed, "n int, s binary").groupBy("n").applyInArrow(principal, "n int, axes binary")
    return {r.n: np.frombuffer(bytes(r.axes)).reshape(-1, r.n) for r in sums.collect()}


def _join(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, eps: float, least: float, same: bool, emit) -> None:
    """Recursive join of two intervals of the order (or one with itself): halves until short, skipping those whose boxes are too far apart."""

    def boxes(p: np.ndarray):
        return p.min(axis=0), p.max(axis=0)

    def walk(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and a0 > b0:
            return
        (al, ah), (bl, bh) = boxes(pa_[a0:a1]), boxes(pb[b0:b1])
        gap = np.maximum(0, np.maximum(bl - ah, al - bh))
        if (gap * gap).sum() > eps * eps:
            return
        if max(a1 - a0, b1 - b0) <= LEAF:
            cos = a[a0:a1] @ b[b0:b1].T
            if same and a0 == b0:
                cos = np.triu(cos, 1)
            i, j = np.nonzero(cos >= least)
            if len(i):
                emit(i + a0, j + b0)
            return
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        for x0, x1 in ((a0, am), (am, a1)) if a1 - a0 > LEAF else ((a0, a1),):
            for y0, y1 in ((b0, bm), (bm, b1)) if b1 - b0 > LEAF else ((b0, b1),):
                walk(x0, x1, y0, y1)

    if same and len(a) > 1 or not same and len(a) and len(b):
        walk(0, len(a), 0, len(b))


def _interval_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: intervals (block: long, in their order, label, n, low, high) of one label and dimension whose boxes are at most eps apart.

    The recursion over the order that _join() does within two intervals, across all of them: the order is halved again and again, a
    half's box being that of what is in it; from the whole with itself, pairs of halves go on down to intervals unless their
    boxes are too far apart. A step is a join on the halves' numbers, so no key gathers more than a half's partners.
    """
    sides = [f"{x}{k}" for x in ("l", "h") for k in range(DIMS)]
    spread = [F.get("low", k).alias(f"l{k}") for k in range(DIMS)] + [F.get("high", k).alias(f"h{k}") for k in range(DIMS)]
    placed = ranked(boxes, ["label", "n", "block"], "place").df
    level = cut(placed.select("label", "n", "block", (F.col("place") - 1).cast("long").alias("at"), *spread))
    leaves, levels, size = level, [level.drop("block")], level.count()
    while size > 1:
        both = levels[-1].groupBy("label", "n", F.shiftright("at", 1).alias("at"))
        levels.append(cut(both.agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in sides])))
        size = (size + 1) // 2
    top = levels.pop()
    pairs = top.select("label", "n", F.col("at").alias("a"), F.col("at").alias("b"))
    two = lambda c: F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1)).alias(c)
    while levels:
        level = levels.pop()
        side = lambda at: level.select("label", "n", F.col("at").alias(at), *[F.col(c).alias(f"{at}_{c}") for c in sides])  # noqa: E731,B023
        half = pairs.select("label", "n", two("a"), "b").select("label", "n", "a", two("b")).where("a <= b")
        gaps = [F.greatest(F.lit(0.0), F.col(f"b_l{k}") - F.col(f"a_h{k}"), F.col(f"a_l{k}") - F.col(f"b_h{k}")) for k in range(DIMS)]
        far = half.join(side("a"), ["label", "n", "a"]).join(side("b"), ["label", "n", "b"])
        pairs = cut(far.where(sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps).select("label", "n", "a", "b"))
    block = lambda c: leaves.select(F.col("at").alias(c), F.col("block").alias(f"{c}_block"))
    named = pairs.join(block("a"), "a").join(block("b"), "b")
    return named.select(F.col("a_block").alias("a"), F.col("b_block").alias("b"))


def near_links(classes: DataFrame, least: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """For distinct vectors (rep: long, label, vector, many: copies): links (u, v), and (rep, near): how many copies of others are near.

    The distance of unit vectors is at most eps iff their cosine is at least ``least``. All are projected on the leading principal
    axes, which never lengthens a distance, put in grid cells of side eps, and sorted by label, dimension and cells (epsilon grid order). The
    order is cut into intervals of up to INTERVAL vectors. Pairs of intervals of one label are joined unless the boxes of their
    projections, or of halves of the order that they are in, are more than eps apart; within a pair, halves are joined recursively in the same way, down to LEAF vectors,
    whose cosines are computed in double precision. Each pair of intervals returns its vectors' counts of near ones and a
    forest of links that connects the same vectors, so that dense clusters don't give links by the square.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    axes = _axes(classes, "vector")
    if not axes:
        none = classes.select(F.col("rep").alias("u"), F.col("rep").alias("v")).where("false")
        return none, classes.select("rep", F.lit(0).cast("long").alias("near")).where("false")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, sizes = b.column(b.schema.get_field_index("vector")), b.column(b.schema.get_field_index("n")).to_numpy()
            grid = np.zeros((len(sizes), DIMS), np.int32)
            spot = np.zeros((len(sizes), DIMS))
            for n in np.unique(sizes).tolist():
                p = _unit(_matrix(vectors.filter(pa.array(sizes == n)))) @ axes[n].T
                spot[np.flatnonzero(sizes == n)[:, None], np.arange(p.shape[1])] = p
            grid = np.floor(spot / eps).astype(np.int32)
            lists = lambda x, t: pa.ListArray.from_arrays(np.arange(0, x.size + 1, DIMS, dtype=np.int32), pa.array(x.ravel(), t))
            yield pa.RecordBatch.from_arrays([*b.columns, lists(grid, pa.int32()), lists(spot, pa.float64())], names=[*b.schema.names, "cell", "spot"])

    kept = classes.select("rep", "label", "many", "vector", F.size("vector").alias("n"))
    kind = kept.schema["vector"].dataType.simpleString()
    placed = cut(kept.mapInArrow(cells, f"rep long, label {kept.schema['label'].dataType.simpleString()}, many long, vector {kind}, n int, cell array<int>, spot array<double>"))
    order = ["label", "n", "cell", "rep"]
    number = kind.removeprefix("array<").removesuffix(">")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each run of up to INTERVAL vectors of one label and dimension in this range partition."""
        part, count, held = TaskContext.get().partitionId(), 0, None

        def row(t: pa.Table) -> pa.RecordBatch:
            nonlocal count
            count += 1
            whole = lambda name: t.column(name).combine_chunks()
            whole_of = {name: (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c) for name in t.column_names for c in (whole(name),)}
            spot = _matrix(whole_of["spot"])
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            one = [pa.array([(part << 32) + count]), whole_of["label"].slice(0, 1), whole_of["n"].slice(0, 1), listed(pa.array(spot.min(axis=0))), listed(pa.array(spot.max(axis=0)))]
            many = [listed(whole_of["rep"]), listed(whole_of["many"]), listed(whole_of["vector"].flatten()), listed(pa.array(spot.ravel()))]
            return pa.RecordBatch.from_arrays([*one, *many], names=["block", "label", "n", "low", "high", "reps", "many", "flat", "spots"])

        for b in batches:
            t = pa.Table.from_batches([b]).select(["label", "n", "rep", "many", "vector", "spot"])
            held = pa.concat_tables([held, t]) if held is not None else t
            while held.num_rows:
                label, n = held.column("label"), held.column("n").to_numpy()
                same = pc.equal(label, label[0]).to_numpy() & (n == n[0])
                run = len(same) if same.all() else int(np.argmin(same))
                if run == held.num_rows and run < INTERVAL:
                    break
                yield row(held.slice(0, min(run, INTERVAL)))
                held = held.slice(min(run, INTERVAL))
        if held is not None and held.num_rows:
            yield row(held)

    kind_of_label = kept.schema["label"].dataType.simpleString()
    content = cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(intervals, f"block long, label {kind_of_label}, n int, low array<double>, high array<double>, reps array<long>, many array<long>, flat array<{number}>, spots array<double>"))
    pairs = cut(_interval_pairs(content.select("block", "label", "n", "low", "high"), eps))
    half = lambda at: content.select(F.col("block").alias(at), F.struct("n", "reps", "many", "flat", "spots").alias(f"{at}_rows"))
    both = pairs.join(half("a"), "a").join(half("b"), "b").select("a_rows", "b_rows", (F.col("a") == F.col("b")).alias("same"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(rows: pa.StructArray, k: int):
            f = lambda name: rows.field(name)[k]
            n = f("n").as_py()
            flat = lambda name, size: f(name).values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            return f("reps").values.to_numpy(), f("many").values.to_numpy(), _unit(flat("flat", n)), flat("spots", DIMS)

        for batch in batches:
            x, y, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for k in range(len(batch)):
                (ra, ma, va, sa), (rb, mb, vb, sb) = side(x, k), side(y, k)
                na, parent = np.zeros(len(ra), np.int64), list(range(len(ra) + len(rb)))
                nb = na if same[k] else np.zeros(len(rb), np.int64)
                off = 0 if same[k] else len(ra)

                def root(i: int) -> int:
                    while parent[i] != i:
                        parent[i] = i = parent[parent[i]]
                    return i

                def emit(i: np.ndarray, j: np.ndarray) -> None:
                    np.add.at(na, i, mb[j])
                    np.add.at(nb, j, ma[i])
                    for p, q in zip(i.tolist(), (j + off).tolist(), strict=True):
                        p, q = root(p), root(q)
                        if p != q:
                            parent[max(p, q)] = min(p, q)

                _join(va, sa, vb, sb, eps, least, same[k], emit)
                ids = ra if same[k] else np.concatenate((ra, rb))
                near = na if same[k] else np.concatenate((na, nb))
                at = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(near[at]), pa.array(ids[[root(i) for i in at.tolist()]])], names=["rep", "near", "to"])

    found = cut(both.mapInArrow(joined, "rep long, near long, to long"))
    return found.where("rep != to").select(F.col("rep").alias("u"), F.col("to").alias("v")), found.groupBy("rep").agg(F.sum("near").alias("near"))


def near_groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """(``key``, n_links, component_id, kept) for every row of ``df``: vectors of one non-null label link at cosine >= ``least``.

    Null, empty or zero vectors, those with null or non-finite components, and rows with a null label or key link with nothing
    (component_id is their own key). Vectors of different dimension don't link. Equal vectors are one class and cost no pairs;
    each of them counts the others as links. A key repeated with several vectors is one node with the links of all of them.
    """
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("wide"), F.col(vector).alias("vector"))
    # x - x is NaN for what isn't finite.
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0) & F.coalesce(F.forall("wide", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.exists("wide", lambda x: x != 0)
    rows = cut(rows.withColumn("good", F.coalesce(good, F.lit(False))).drop("wide"))
    fit = rows.where("good")
    classes = cut(fit.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("many")))
    links, near = near_links(classes, least)
    roots = cut(components(links).withColumnRenamed("node", "rep"))
    named = cut(classes.join(cut(near), "rep", "left").join(roots, "rep", "left").select("label", "vector", (F.col("many") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")))
    out = fit.drop("good").join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_groups() of all embeddings."""
    return near_groups(table(spark, sf_dir, "embeddings"))


#: SQL for op7: all pairs of a label, and the least id reached over links.
OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(u, v) AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
n AS (SELECT u, count(*)::BIGINT AS n FROM p GROUP BY u), c AS (SELECT u, min(v) AS c FROM r GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""
