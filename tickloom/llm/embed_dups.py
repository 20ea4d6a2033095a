"""Exact cosine self-join of embeddings within labels by a subspace pigeonhole.

Unit vectors with cosine t or more are at squared distance 2 - 2t or less. All vectors are turned by one random
rotation, so that no direction is special, and cut into blocks of ``WIDTH`` dimensions. If every block of a pair
were farther apart than its share (in proportion to its dimensions) of that squared distance, so would be the
pair; so a linked pair is near in some block. Each block is joined by range on a grid over its leading
dimensions: a vector stays in its own cell, and goes as a probe to the later cells its ball meets; block
distances are checked in the join. The union of candidates is verified with the whole vectors in doubles.

Equal vectors of a label are one class with a count before anything is joined, so copies make no pairs. Rows:
a null label, a null, empty or zero vector, and null or non-finite components link with nothing; vectors of
different lengths do not link; null ids and repeated rows are kept; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.graph import components, with_roots
from tickloom.session import materialize

WIDTH = 8
GRID = 5  # leading dimensions of a block that the grid is over
CELL = 2.0  # edge of a cell, in units of the block's radius
SEED = 6
SLACK = 1e-6

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    if dims not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng([SEED, dims]).standard_normal((dims, dims)))
        _ROTATIONS[dims] = q * np.sign(np.diag(r))
    return _ROTATIONS[dims]


def usable(vector):
    """Whether a vector has a direction."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cells(home: bool, cosine: float):
    """Rows (label, dims, block, cell, node, c0..) of vectors in their own cells, or as probes in later ones."""
    offsets = np.array([o for o in itertools.product((-1, 0, 1), repeat=GRID) if o > (0,) * GRID])
    names = [f"c{j}" for j in range(WIDTH)]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                vectors = part.column("embedding").to_pylist()
                labels, nodes = np.asarray(part.column("label")), np.asarray(part.column("node"))
                lengths = np.array([len(v) for v in vectors])
                for dims in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == dims)
                    x = np.array([vectors[i] for i in at], dtype=np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    x = x @ rotation(dims)
                    for block, first in enumerate(range(0, dims, WIDTH)):
                        c = x[:, first : first + WIDTH]
                        radius = np.sqrt((2 - 2 * cosine) * c.shape[1] / dims + SLACK)
                        edge = CELL * radius
                        c = np.pad(c, ((0, 0), (0, WIDTH - c.shape[1])))
                        cell = np.floor(c[:, :GRID] / edge)
                        if home:
                            who, cells = np.arange(len(at)), cell
                        else:
                            low = c[:, :GRID] - cell * edge
                            gap = np.where(offsets[None] < 0, low[:, None], np.where(offsets[None] > 0, edge - low[:, None], 0.0))
                            who, off = np.nonzero((gap**2).sum(axis=2) <= radius**2 + SLACK)
                            # its own cell too: the join keeps one order of a pair there
                            who, cells = np.concatenate((np.arange(len(at)), who)), np.concatenate((cell, cell[who] + offsets[off]))
                        cells = cells.astype(np.int64)
                        key = np.zeros(len(who), dtype=np.int64)
                        for j in range(GRID):
                            key = key * 4096 + cells[:, j] + 2048
                        cols = [labels[at][who], np.full(len(who), dims), np.full(len(who), block), key, nodes[at][who], (np.zeros(len(who), bool) if home else np.arange(len(who)) < len(at)), *[c[who, j].astype(np.float32) for j in range(WIDTH)]]
                        yield pa.RecordBatch.from_arrays([pa.array(a, type=t) for a, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()] + [pa.float32()] * WIDTH)], names=["label", "dims", "block", "cell", "node", "own", *names])

    return run, "label long, dims int, block int, cell long, node long, own boolean, " + ", ".join(f"{n} float" for n in names)


def _verify(cosine: float):
    """The pairs (a, b) whose whole vectors u and v reach the cosine, in doubles; each vector is scaled by its
    largest component first, so that nothing overflows."""

    def unit(x):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def run(batches):
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            lengths = np.diff(np.asarray(u.offsets))  # both of a pair are of one length: the join was on it
            keep = np.zeros(batch.num_rows, dtype=bool)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                x, y = (np.asarray(c.take(pa.array(at)).flatten(), dtype=np.float64).reshape(-1, dims) for c in (u, v))
                keep[at] = (unit(x) * unit(y)).sum(axis=1) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def link(df: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id): other vectors linked directly, and the least id reachable."""
    single = dict(df.dtypes)[vector] == "array<float>"  # any other type is compared as doubles
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("embedding"), F.col(f"`{label}`").cast("long").alias("label"))
    good = rows.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    classes = good.groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "vectors")
    slim = classes.select("label", "embedding", "node")
    run, schema = _cells(True, cosine)
    home = slim.mapInArrow(run, schema)
    run, schema = _cells(False, cosine)
    probe = slim.mapInArrow(run, schema).select("label", "dims", "block", "cell", F.col("node").alias("other"), F.col("own").alias("same"), *[F.col(f"c{j}").alias(f"d{j}") for j in range(WIDTH)])
    apart = sum((F.col(f"c{j}") - F.col(f"d{j}")) * (F.col(f"c{j}") - F.col(f"d{j}")) for j in range(WIDTH))
    share = F.lit(2 - 2 * cosine) * F.least(F.lit(WIDTH), F.col("dims") - F.col("block") * WIDTH) / F.col("dims") + 4 * SLACK
    near = home.join(probe, ["label", "dims", "block", "cell"]).where((apart <= share) & (~F.col("same") | (F.col("node") < F.col("other"))))
    pairs = near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a <> b").distinct()
    left = slim.select(F.col("node").alias("a"), F.col("embedding").alias("u"))
    right = slim.select(F.col("node").alias("b"), F.col("embedding").alias("v"))
    links = materialize(pairs.join(left, "a").join(right, "b").mapInArrow(_verify(cosine), "a long, b long"), "vector-links")

    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    joined = with_roots(components(links, "vector-classes"))
    roots = joined.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("root"))
    found = classes.join(others, "node", "left").join(joined, "node", "left").join(roots, "component", "left")
    found = found.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "least").alias("component_id"))
    linked = good.join(found, ["label", "embedding"]).select("id", "n_links", "component_id")
    rest = rows.where(~(F.col("label").isNotNull() & usable(F.col("embedding")))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(rest)
