"""Batch scoring of feature vectors with the two network shapes.

Weights are a small table (one row per tensor). They are read once, checked for size, broadcast, and
applied to Arrow batches as matrix products; Spark decides how many batches run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Output names of the two models and the heads that pass a sigmoid.
PLE_OUTPUTS = ["ctrl_return_1h_out", "trmt_return_1h_out", "ctrl_sigma_1h_out", "trmt_sigma_1h_out", "t_ctrl_out", "t_trmt_out"]
DRAGON_OUTPUTS = ["ctrl_return_1h_out", "trmt_return_1h_out", "ctrl_sigma_1h_out", "trmt_sigma_1h_out", "t_out"]
SIGMOID_OUTPUTS = ("t_out", "t_ctrl_out", "t_trmt_out")
TOWER = (64, 32, 16, 1)
MAX_WEIGHT_BYTES = 256 * 1024 * 1024

Weights = dict[str, np.ndarray]


def dense(x: np.ndarray, w: Weights, name: str, last_relu: bool) -> np.ndarray:
    """Linear layers ``name.0``, ``name.1``, ... with ReLU between them and, if asked, after the last."""
    i = 0
    while f"{name}.{i}.weight" in w:
        if i:
            x = np.maximum(x, 0.0)
        x = x @ w[f"{name}.{i}.weight"].T + w[f"{name}.{i}.bias"]
        i += 1
    return np.maximum(x, 0.0) if last_relu else x


def mix(x: np.ndarray, w: Weights, name: str, experts: list[np.ndarray]) -> np.ndarray:
    """Softmax-weighted sum of expert outputs."""
    g = x @ w[f"{name}.weight"].T + w[f"{name}.bias"]
    g = np.exp(g - g.max(axis=1, keepdims=True))
    g = g / g.sum(axis=1, keepdims=True)
    return np.einsum("be,bed->bd", g, np.stack(experts, axis=1))


def ple(x: np.ndarray, w: Weights, levels: int = 2, experts: int = 2) -> list[np.ndarray]:
    """Progressive layered extraction: three groups of experts a level, task gates see their own and the
    shared experts, the shared gate sees all; then one tower per output."""
    inputs = {"shared": x, "ctrl": x, "trmt": x}
    for level in range(levels):
        outs = {
            g: [dense(inputs[g], w, f"{g}.{level}.{i}", True) for i in range(experts)] for g in ("shared", "ctrl", "trmt")
        }
        inputs = {
            "ctrl": mix(inputs["ctrl"], w, f"gate.ctrl.{level}", outs["ctrl"] + outs["shared"]),
            "trmt": mix(inputs["trmt"], w, f"gate.trmt.{level}", outs["trmt"] + outs["shared"]),
            "shared": mix(inputs["shared"], w, f"gate.shared.{level}", outs["shared"] + outs["ctrl"] + outs["trmt"]),
        }
    side = {o: "trmt" if "trmt" in o else "ctrl" for o in PLE_OUTPUTS}
    return [dense(inputs[side[o]], w, o, False)[:, 0] for o in PLE_OUTPUTS]


def dragonnet(x: np.ndarray, w: Weights) -> list[np.ndarray]:
    """One shared trunk and one tower per output."""
    trunk = dense(x, w, "trunk", True)
    return [dense(trunk, w, o, False)[:, 0] for o in DRAGON_OUTPUTS]


MODELS: dict[str, tuple[Callable, list[str]]] = {"ple": (ple, PLE_OUTPUTS), "dragonnet": (dragonnet, DRAGON_OUTPUTS)}


def layer_sizes(model: str, width: int = 111) -> dict[str, tuple[int, int]]:
    """Tensor name to (outputs, inputs) of every linear layer."""
    out: dict[str, tuple[int, int]] = {}

    def stack(name: str, n_in: int, sizes: tuple[int, ...]) -> None:
        for i, n in enumerate(sizes):
            out[f"{name}.{i}"] = (n, n_in)
            n_in = n

    if model == "dragonnet":
        stack("trunk", width, (128, 256, 512, 256, 128))
        for o in DRAGON_OUTPUTS:
            stack(o, 128, TOWER)
        return out
    for level in range(2):
        n_in = width if level == 0 else 128
        for g in ("shared", "ctrl", "trmt"):
            for i in range(2):
                stack(f"{g}.{level}.{i}", n_in, (256, 128))
            out[f"gate.{g}.{level}"] = (6 if g == "shared" else 4, n_in)
    for o in PLE_OUTPUTS:
        stack(o, 128, TOWER)
    return out


def seeded_weights(model: str, width: int = 111, seed: int = 7) -> Weights:
    """Reproducible stand-in weights (uniform Glorot, zero bias); trained ones come from a table."""
    rng = np.random.default_rng(seed)
    w: Weights = {}
    for name, (n_out, n_in) in layer_sizes(model, width).items():
        bound = np.sqrt(6.0 / (n_in + n_out))
        w[f"{name}.weight"] = rng.uniform(-bound, bound, (n_out, n_in))
        w[f"{name}.bias"] = np.zeros(n_out)
    return w


def save_weights(spark: SparkSession, w: Weights, path: str) -> None:
    rows = [(n, [int(s) for s in a.shape], [float(v) for v in a.ravel()]) for n, a in w.items()]
    spark.createDataFrame(rows, "tensor string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    """Read a weight table; refuses one too large to be a model of this kind."""
    table = spark.read.parquet(path)
    size = table.agg(F.coalesce(F.sum(F.size("data")), F.lit(0)).cast("bigint")).first()[0] * 8
    if size > MAX_WEIGHT_BYTES:
        raise ValueError(f"weight table holds {size} bytes, limit {MAX_WEIGHT_BYTES}")
    return {r["tensor"]: np.array(r["data"]).reshape(r["shape"]) for r in table.toLocalIterator()}


def score(df: DataFrame, model: str, weights: Weights, features: str = "features", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep`` columns plus the model's outputs, t heads through a sigmoid."""
    forward, outputs = MODELS[model]
    return apply_network(df, forward, outputs, weights, features, keep)


def apply_network(df: DataFrame, forward: Callable, outputs: list[str], weights: Weights, features: str, keep: tuple[str, ...], max_bytes: int = MAX_WEIGHT_BYTES) -> DataFrame:
    """The network over batches of rows; its weights go to every task, so their size is checked first."""
    size = sum(a.nbytes for a in weights.values())
    if size > max_bytes:
        raise ValueError(f"weights hold {size} bytes, limit {max_bytes}")
    shared = df.sparkSession.sparkContext.broadcast(weights)
    names, sigmoid = list(keep), SIGMOID_OUTPUTS

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = pdf[names].reset_index(drop=True)
            if len(pdf):
                heads = forward(np.stack(pdf[features].to_numpy()).astype("float64"), shared.value)
            else:
                heads = [np.empty(0)] * len(outputs)
            for name, v in zip(outputs, heads):
                out[name] = 1.0 / (1.0 + np.exp(-v)) if name in sigmoid else v
            yield out

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{o} double" for o in outputs])
    return df.select(*keep, features).mapInPandas(batches, schema)
