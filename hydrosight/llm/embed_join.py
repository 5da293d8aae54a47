"""Near-duplicate vectors by an epsilon grid order join.

Cosine >= t means that the unit vectors lie within epsilon = sqrt(2 - 2 t).

1. Equal vectors become one with a count. Sums of products, added up in Spark,
   give the principal dimensions (a dims x dims matrix on the driver).
2. Vectors are range-partitioned and sorted by their grid cells of width
   epsilon on the leading principal dimensions, then cut into blocks. A task writes
   its blocks to one file of the shared folder; the table of blocks holds file, place
   and the box of the unit vectors on the principal dimensions.
3. Intervals of the sequence are joined recursively: a pair of intervals whose
   boxes are further apart than epsilon is dropped with all below it, the
   others are replaced by the pairs of their parts, down to blocks. Each level is an
   equi-join on the parent interval.
4. A task reads the two blocks of a pair and multiplies them in double precision. It returns for
   each matched vector the count of its links and one link to its component
   in the pair, so a pair of blocks gives at most its own vectors, however many links it holds.

Only vectors of one length are compared with each other.

Defined cases
    null, empty or zero vectors, null or non-finite components   no links, a
                         component of their own (vec_id), kept
    null vec_id          takes part; a component takes its smallest id, null
                         if it has none
    repeated rows        equal vectors are linked with each other
    empty table          empty result
    clashing columns     only the id and vector columns are read
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrosight.llm.common import arrow_fs, cut, parallelism, scratch_files
from hydrosight.llm.components import components

GRID = 4  # leading dimensions whose cells order the vectors
BOX = 12  # principal dimensions of the boxes
BLOCK = 1024
FAN = 8  # parts of an interval


def _keyed(batches):
    """A key of each vector that can be compared, and its length."""
    for batch in batches:
        keys, dims = [], []
        for v in batch.column(1).to_pylist():
            a = None if v is None or None in v else np.array(v, np.float64)
            ok = a is not None and len(a) > 0 and np.isfinite(a).all() and a.any()
            keys.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest() if ok else None)
            dims.append(len(a) if ok else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), batch.column(1)],
            names=["vec_id", "key", "dim", "v"])


def _raw(column) -> np.ndarray:
    flat = column.flatten() if hasattr(column, "flatten") else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches):
    """Sums of products and of components, one row a cell."""
    total = None
    for batch in batches:
        if batch.num_rows:
            u = _unit(_raw(batch.column(0)))
            u = np.hstack([np.ones((len(u), 1)), u])
            total = u.T @ u if total is None else total + u.T @ u
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())],
                                         names=["cell", "x"])


def principal(moments: np.ndarray, count: int, rounds: int = 60) -> np.ndarray:
    """Leading orthonormal directions of the covariance, by subspace iteration."""
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    d = len(cov)
    axes = np.random.default_rng(1).normal(size=(d, min(count, d)))
    for _ in range(rounds):
        axes = np.einsum("ij,jk->ik", cov, axes) + 1e-9 * axes
        for k in range(axes.shape[1]):  # modified Gram-Schmidt, twice for accuracy
            for _ in range(2):
                for j in range(k):
                    axes[:, k] -= (axes[:, j] * axes[:, k]).sum() * axes[:, j]
            size = math.sqrt((axes[:, k] ** 2).sum())
            axes[:, k] = axes[:, k] / size if size > 1e-150 else np.eye(d)[:, k]
    return axes


def _placed(axes: np.ndarray, epsilon: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _unit(_raw(batch.column(2))) @ axes
            cells = np.floor(p[:, :GRID] / epsilon).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(cells), pa.list_(pa.int64())), pa.array(p[:, 0])],
                names=["key", "m", "v", "cells", "p"])
    return run


def _blocks(folder: str, axes: np.ndarray, size: int):
    """Writes a partition's blocks to one file; returns vectors (kind 0) and blocks (kind 1)."""
    def run(batches):
        from pyspark import TaskContext
        ctx = TaskContext.get()
        part = ctx.partitionId()
        fs, root = arrow_fs(folder)
        out, place, count, held, n = None, 0, 0, [], 0
        name = f"{folder}/part-{part:06d}-{ctx.taskAttemptId()}.blocks"

        def flush(table):
            nonlocal out, place, count
            x = _raw(table.column("v").combine_chunks())
            block = part * (1 << 20) + count
            uid = block * (1 << 12) + np.arange(len(x))
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name.rsplit('/', 1)[1]}", compression=None)
            m = table.column("m").to_numpy().astype("<i8")
            data = uid.astype("<i8").tobytes() + m.tobytes() + x.astype("<f8").tobytes()
            out.write(data)
            p = _unit(x) @ axes
            lo, hi = np.full(BOX, -1e-12), np.full(BOX, 1e-12)
            lo[:p.shape[1]], hi[:p.shape[1]] = p.min(axis=0) - 1e-12, p.max(axis=0) + 1e-12
            k = len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * k, pa.int32()), pa.array(uid, pa.int64()), table.column("key").combine_chunks(),
                 pa.array(m, pa.int64()), *(pa.nulls(k, t) for t in
                                            (pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))],
                names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([k], pa.int64()), pa.array([name]), pa.array([place], pa.int64()),
                 pa.array([lo.tolist()], pa.list_(pa.float64())), pa.array([hi.tolist()], pa.list_(pa.float64()))],
                names=names)
            place += len(data)
            count += 1
        names = ["kind", "id", "key", "n", "file", "place", "lo", "hi"]
        try:
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                while n >= size:
                    table = pa.Table.from_batches(held)
                    yield from flush(table.slice(0, size))
                    held = table.slice(size).to_batches()
                    n -= size
            if n:
                yield from flush(pa.Table.from_batches(held))
        finally:
            if out is not None:
                out.close()
    return run


BLOCKS = ("kind int, id bigint, key binary, n bigint, file string, place bigint, "
          "lo array<double>, hi array<double>")


def _groups(i: np.ndarray, j: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of a bipartite graph: the smallest row of each row's and column's component."""
    r, c = np.arange(rows), np.full(cols, rows)
    while True:
        np.minimum.at(c, j, r[i])
        before = r.copy()
        np.minimum.at(r, i, c[j])
        r = np.minimum(r, r[r])
        if (r == before).all():
            return r, c


def _joined(dim: int, threshold: float):
    """Links of block pairs: each matched vector, its component in the pair, its links."""
    def run(batches):
        sources, name = {}, None

        def load(file, place, n):
            nonlocal name
            if file not in sources:
                if len(sources) > 8:
                    sources.pop(next(iter(sources))).close()
                fs, path = arrow_fs(file)
                sources[file] = fs.open_input_file(path)
            data = bytes(sources[file].read_at(n * (16 + 8 * dim), place))
            uid, m = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n)
            x = np.frombuffer(data, "<f8", n * dim, 16 * n).reshape(n, dim)
            big = np.abs(x).max(axis=1, keepdims=True)
            x = x / big
            return uid, m, x, np.sqrt((x * x).sum(axis=1))
        last, left = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if last != r["a"]:
                    last, left = r["a"], load(r["a_file"], r["a_place"], r["a_n"])
                same = r["a"] == r["b"]
                ua, ma, xa, na = left
                ub, mb, xb, nb = left if same else load(r["b_file"], r["b_place"], r["b_n"])
                hit = (xa @ xb.T) / np.outer(na, nb) >= threshold
                if same:
                    np.fill_diagonal(hit, False)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                rows, cols = _groups(i, j, len(ua), len(ub))
                links = np.zeros(len(ua), np.int64)
                np.add.at(links, i, mb[j])
                got = np.flatnonzero(links)
                out = [(ua[got], ua[rows[got]], links[got])]
                links = np.zeros(len(ub), np.int64)
                np.add.at(links, j, ma[i])
                got = np.flatnonzero(links)
                # in a block with itself a vector is a row and a column: both join, one counts
                out.append((ub[got], ua[cols[got]], 0 * links[got] if same else links[got]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)],
                                                 names=["uid", "label", "links"])
    return run


def _distance(a: str, b: str):
    gap = F.greatest(F.lit(0.0), F.col(f"{a}_lo").getItem(0) - F.col(f"{b}_hi").getItem(0),
                     F.col(f"{b}_lo").getItem(0) - F.col(f"{a}_hi").getItem(0))
    total = gap * gap
    for k in range(1, BOX):
        gap = F.greatest(F.lit(0.0), F.col(f"{a}_lo").getItem(k) - F.col(f"{b}_hi").getItem(k),
                         F.col(f"{b}_lo").getItem(k) - F.col(f"{a}_hi").getItem(k))
        total = total + gap * gap
    return total


def block_pairs(blocks: DataFrame, parts: int, epsilon: float) -> DataFrame:
    """Pairs a <= b of block ids whose boxes lie within epsilon, by recursion from
    the whole sequence to its parts. Blocks of range partition p have ids from p << 20."""
    def boxes(df, node):
        return df.groupBy(node.alias("node")).agg(
            F.array(*(F.min(F.col("lo")[k]) for k in range(BOX))).alias("lo"),
            F.array(*(F.max(F.col("hi")[k]) for k in range(BOX))).alias("hi"))
    level0 = blocks.select(F.col("id").alias("node"), "lo", "hi", F.shiftright("id", 20).alias("up"))
    levels, nodes = [level0], boxes(blocks, F.shiftright("id", 20))
    while parts > 1:  # from range partitions up to one interval
        levels.append(cut(nodes.withColumn("up", F.floor(F.col("node") / FAN)), "intervals"))
        nodes = boxes(levels[-1], F.col("up"))
        parts = -(-parts // FAN)
    pairs = cut(boxes(nodes, F.lit(0).cast("bigint")).select(F.col("node").alias("a"), F.col("node").alias("b")),
                "interval-pairs")
    for level in reversed(levels):
        def side(s):
            return level.select(F.col("up").alias(f"{s}"), F.col("node").alias(f"{s}_node"),
                                F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"))
        pairs = cut(pairs.join(side("a"), "a").join(side("b"), "b")
                    .where((F.col("a_node") <= F.col("b_node"))
                           & (_distance("a", "b") <= epsilon * epsilon + 1e-9))
                    .select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "interval-pairs")
    return pairs


def _links(distinct: DataFrame, dim: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """For vectors (key, m, v) of one length: (uid, key) and (uid, label, links)."""
    spark = distinct.sparkSession
    cells = distinct.select("v").mapInArrow(_moments, "cell bigint, x double").groupBy("cell").agg(
        F.sum("x").alias("x")).collect()
    moments = np.zeros((dim + 1) ** 2)
    for r in cells:
        moments[r["cell"]] = r["x"]
    axes = principal(moments.reshape(dim + 1, dim + 1), BOX)
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    kind = distinct.schema["v"].dataType.simpleString()
    placed = cut(distinct.select("key", "m", "v").mapInArrow(
        _placed(axes, epsilon), f"key binary, m bigint, v {kind}, cells array<bigint>, p double"), "vector-cells")
    parts = parallelism(spark)
    # grid order; within a cell by the first principal dimension
    ordered = placed.repartitionByRange(parts, "cells", "p", "key").sortWithinPartitions("cells", "p", "key")
    written = cut(ordered.select("key", "m", "v").mapInArrow(
        _blocks(scratch_files(spark, "vector-blocks"), axes, block), BLOCKS), "vector-blocks", "kind")
    blocks = written.where("kind = 1")
    pairs = block_pairs(blocks.select("id", "lo", "hi"), parts, epsilon)
    place = blocks.select("id", "file", "place", "n")
    for s in ("a", "b"):
        pairs = pairs.join(place.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in
                                                                ("file", "place", "n"))), s)
    # a pair is little to shuffle and much to do: spread by block and stretch of partners
    tasks = max(parts, 4 * spark.sparkContext.defaultParallelism)
    pairs = pairs.repartition(tasks, "a", F.col("b") % 7).sortWithinPartitions("a", "b")
    joined = cut(pairs.mapInArrow(_joined(dim, threshold), "uid bigint, label bigint, links bigint"), "vector-links")
    return written.where("kind = 0").select(F.col("id").alias("uid"), "key"), joined


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    element = "double" if "double" in df.schema[vector_col].dataType.simpleString() else "float"
    vectors = df.select(F.col(id_col).cast("bigint").alias("vec_id"),
                        F.col(vector_col).cast(f"array<{element}>").alias("v"))
    keyed = cut(vectors.mapInArrow(_keyed, f"vec_id bigint, key binary, dim int, v array<{element}>"), "vector-keys")
    groups = cut(keyed.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"), F.first("dim").alias("dim"),
        F.first("v").alias("v")), "vector-groups")
    known, result = keyed.select("vec_id", "key"), None
    for dim in sorted(r["dim"] for r in groups.select("dim").distinct().collect()):
        uids, joined = _links(groups.where(F.col("dim") == dim), dim, threshold, block)
        links = joined.groupBy("uid").agg(F.sum("links").alias("links"))
        labels = components(joined.select(F.col("uid").alias("a"), F.col("label").alias("b")))
        one = (uids.join(labels.withColumnRenamed("id", "uid"), "uid", "left")
               .join(links, "uid", "left").join(groups.select("key", "least", "m"), "key")
               .select("key", "least", F.coalesce("label", "uid").alias("label"),
                       (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
        one = cut(one, "vector-labels")
        least = one.groupBy("label").agg(F.min("least").alias("component_id"))
        one = one.join(least, "label").select("key", "n_links", "component_id")
        result = one if result is None else result.union(one)
    if result is None:
        return known.select("vec_id", F.lit(0).cast("bigint").alias("n_links"),
                            F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = known.join(cut(result, "vector-result"), "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
