"""Per-key regimes: a Gaussian hidden Markov model whose passes are scans of matrix products over chunks.

A chunk is stored as one row of arrays. For a model, the product of its K x K matrices (transition times density) says
what the chunk does to the state before it, whatever that is; prefix and suffix products give the expected counts of the
chunk for every pair of states at its borders. One task a key then joins the borders: forward and backward vectors over
the chunks, the weight of every border pair, and the next model. A decoding is the same in max-plus products. So an
iteration is one pass over the chunks and one small row a chunk, and no task holds a key's series.

Missing and infinite features count as 0. Keys with fewer than max(50, 20 K) train rows get no model and no state. The
first model comes from the sizes of the volatility feature, not from random starts, so results can be repeated.
"""
from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..core.ordered import BLOCK_ROWS, int_div
from ..core.session import checkpointed

c = F.col
COLUMNS = ("spread_z", "spread_diff_1", "spread_vol_24")


@dataclass(frozen=True)
class RegimeConfig:
    states: int = 2
    iterations: int = 50
    tolerance: float = 1e-2
    floor: float = 1e-6
    columns: tuple[str, ...] = COLUMNS
    #: The columns that split the first model, that pick the calm state, and that settle its ties.
    volatility: str = "spread_vol_24"
    difference: str = "spread_diff_1"
    level: str = "spread_z"

    def at(self, name: str) -> int:
        return self.columns.index(name)


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.start)))
        for k, (m, v) in enumerate(zip(self.means, self.covs)):
            root = np.linalg.cholesky(v)
            d = np.linalg.solve(root, (x - m).T)
            out[:, k] = -0.5 * ((d * d).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out

    def steps(self, x: np.ndarray, opens: bool) -> tuple[np.ndarray, np.ndarray]:
        """A matrix a row, the log of its scale; before a key's first row every state leads to the start shares."""
        log_b = self.log_density(x)
        top = log_b.max(axis=1, initial=-np.inf)
        out = self.moves[None] * np.exp(log_b - top[:, None])[:, None, :]
        if opens:
            out[0] = self.start * np.exp(log_b[0] - top[0])
        return out, top


# ---- scans -----------------------------------------------------------------------------------------------------

def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = m.max(axis=(1, 2))
    s = np.where(s > 0, s, 1.0)
    return m / s[:, None, None], np.log(s)


def prefix_products(steps: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product of the first t + 1 matrices for every t, scaled, and the logs of the scales."""
    (out, more), reach = _scaled(steps), 1
    logs = logs + more
    while reach < len(out):
        joined, more = _scaled(out[:-reach] @ out[reach:])
        logs = np.concatenate([logs[:reach], logs[reach:] + logs[:-reach] + more])
        out, reach = np.concatenate([out[:reach], joined]), 2 * reach
    return out, logs


def suffix_products(steps: np.ndarray) -> np.ndarray:
    """The product of the matrices after t for every t, scaled; the last is the unit matrix."""
    unit = np.eye(steps.shape[1])[None]
    if len(steps) == 1:
        return unit
    back = prefix_products(steps[:0:-1].transpose(0, 2, 1), np.zeros(len(steps) - 1))[0]
    return np.concatenate([back[::-1].transpose(0, 2, 1), unit])


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def best_prefixes(steps: np.ndarray) -> np.ndarray:
    """The same in max-plus: the log-probability of the best path from a state before the chunk to a state at t."""
    out, reach = steps, 1
    while reach < len(out):
        out, reach = np.concatenate([out[:reach], _best(out[:-reach], out[reach:])]), 2 * reach
    return out


def best_suffixes(steps: np.ndarray) -> np.ndarray:
    k = steps.shape[1]
    unit = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None]
    if len(steps) == 1:
        return unit
    return np.concatenate([best_prefixes(steps[:0:-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1), unit])


# ---- a chunk and a key -------------------------------------------------------------------------------------------

@dataclass
class Counts:
    """What a chunk expects for every (state before it, state at its end): leading axes i, j."""

    product: np.ndarray
    log: float
    rows: int
    opening: np.ndarray
    weight: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    moves: np.ndarray


def expected(model: Model, x: np.ndarray, opens: bool) -> Counts:
    steps, logs = model.steps(x, opens)
    ahead, total = prefix_products(steps, logs)
    behind, whole = suffix_products(steps), ahead[-1]
    safe = np.where(whole > 0, whole, 1.0)
    # scales differ by row: the share of state k at row t among all paths from i to j sums to 1 over k
    share = ahead[:, :, :, None] * behind[:, None, :, :]  # t, i, k, j
    share = share / np.maximum(share.sum(axis=2, keepdims=True), 1e-300)
    before = np.concatenate([np.eye(len(whole))[None], ahead[:-1]])
    pair = before[:, :, :, None, None] * steps[:, None, :, :, None] * behind[:, None, None, :, :]  # t, i, k, l, j
    pair = pair / np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
    if opens:
        pair = pair[1:]
    return Counts(whole, float(total[-1]), len(x), share[0].transpose(0, 2, 1), share.sum(axis=0).transpose(0, 2, 1) * (safe > 0)[:, :, None],
                  np.einsum("tikj,td->ijkd", share, x), np.einsum("tikj,td,te->ijkde", share, x, x), pair.sum(axis=0).transpose(0, 3, 1, 2))


def assigned(x: np.ndarray, of: np.ndarray, states: int) -> Counts:
    """The counts of a chunk whose states are given; transitions are left even."""
    share = np.eye(states)[of]
    ones, lead = np.ones((states, states)), lambda v: np.broadcast_to(v, (states, states, *v.shape))
    return Counts(ones, 0.0, len(x), lead(np.full(states, 1.0)), lead(share.sum(axis=0)), lead(share.T @ x), lead(np.einsum("tk,td,te->kde", share, x, x)), lead(np.ones((states, states))))


def joined(chunks: list[Counts], floor: float) -> tuple[Model, float]:
    """The next model of a key and the log-likelihood of this one."""
    k = len(chunks[0].product)
    forward, logs = [np.full(k, 1.0 / k)], 0.0  # the first chunk's rows are alike, so any share of states before it will do
    for ch in chunks:
        v = forward[-1] @ ch.product
        logs += ch.log + np.log(v.sum())
        forward.append(v / v.sum())
    backward = [np.ones(k)]
    for ch in reversed(chunks):
        v = ch.product @ backward[-1]
        backward.append(v / v.max())
    backward.reverse()
    total = None
    for n, ch in enumerate(chunks):
        w = forward[n][:, None] * ch.product * backward[n + 1][None]
        w = w / w.sum()
        add = [np.einsum("ij,ij...->...", w, v) for v in (ch.weight, ch.sums, ch.squares, ch.moves)]
        opening = np.einsum("ij,ijk->k", w, ch.opening) if n == 0 else opening
        total = add if total is None else [a + b for a, b in zip(total, add)]
    weight, sums, squares, moves = total
    heavy = np.maximum(weight, 1e-12)
    means = sums / heavy[:, None]
    covs = squares / heavy[:, None, None] - means[:, :, None] * means[:, None, :] + floor * np.eye(means.shape[1])
    every = sums.sum(axis=0) / weight.sum()
    wide = squares.sum(axis=0) / weight.sum() - np.outer(every, every) + floor * np.eye(len(every))
    few = weight < means.shape[1]  # too few rows for a covariance of their own
    means, covs = np.where(few[:, None] & (weight[:, None] < 1e-9), every, means), np.where(few[:, None, None], wide, covs)
    return Model(opening / opening.sum(), moves / np.maximum(moves.sum(axis=1, keepdims=True), 1e-300), means, covs), float(logs)


# ---- on Spark ------------------------------------------------------------------------------------------------------

def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def blocks_of(rows: DataFrame, keys: Sequence[str], train: str, cfg: RegimeConfig, idx: str, chunk_rows: int) -> DataFrame:
    """One row a chunk: bars, features and the number of its train rows (which come first), stored."""
    keys = list(keys)
    d = rows.select(*keys, c(idx).cast("bigint").alias("_i"), c(train).alias("_train"), *[c(n).cast("double").alias(f"_f{k}") for k, n in enumerate(cfg.columns)])
    d = d.withColumn("_chunk", int_div(c("_i"), chunk_rows))
    width = len(cfg.columns)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        x = np.column_stack([t.column(f"_f{k}").to_numpy() for k in range(width)]).astype(float)
        x = np.where(np.isfinite(x), x, 0.0)
        own = {k: t.column(k)[:1] for k in [*keys, "_chunk"]}
        return pa.table({**own, "bars": pa.array([t.column("_i").to_numpy()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary()),
                         "n_train": pa.array([int(np.count_nonzero(t.column("_train").to_numpy(zero_copy_only=False)))], pa.int64())})

    packed = checkpointed(d.groupBy(*keys, "_chunk").applyInArrow(pack, f"{_ddl(d, keys)}, _chunk bigint, bars array<bigint>, x binary, n_train bigint"))
    size = packed.groupBy(*keys).agg(F.min("_chunk").alias("_first"), F.sum("n_train").alias("_n"))
    return packed.join(size, keys).where(c("_n") >= max(50, 20 * cfg.states)).withColumn("opens", c("_chunk") == c("_first")).drop("_first", "_n")


def _by_chunk(df: DataFrame, keys: Sequence[str], made: str, of: Callable[[dict, np.ndarray], dict], width: int, train_only: bool) -> DataFrame:
    """``of(row, features)`` for every chunk; a chunk without rows gives none."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.slice(i, 1)
                row = {n: own.column(n)[0].as_py() for n in own.schema.names if n not in (*keys, "bars")}
                x = np.frombuffer(row["x"]).reshape(-1, width)
                x = x[:row["n_train"]] if train_only else x
                if len(x):
                    out = of(row, x)
                    n = len(next(iter(out.values())))
                    heads = {k: own.column(k).take(pa.array(np.zeros(n, dtype=np.int64))) for k in [*keys, "_chunk"]}
                    bars = {"i": own.column("bars")[0].values.slice(0, n)} if "state" in out else {}
                    yield pa.RecordBatch.from_pydict({**heads, **bars, **out})

    return df.mapInArrow(run, f"{_ddl(df, keys)}, _chunk bigint, {made}")


def _fold(df: DataFrame, keys: Sequence[str], made: str, of: Callable[[pa.Table], dict]) -> DataFrame:
    keys = list(keys)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_chunk")
        out = of(t)
        n = len(next(iter(out.values())))
        return pa.table({**{k: pa.repeat(t.column(k)[0], n) for k in keys}, **out})

    return df.groupBy(*keys).applyInArrow(run, f"{_ddl(df, keys)}, {made}")


MODEL = "model binary, log_likelihood double, previous double, iteration int"


def fit_regimes(blocks: DataFrame, keys: Sequence[str], cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Per key: model, log_likelihood of the model that it was made from, iteration; keys that have converged rest."""
    keys, width, floor, k = list(keys), len(cfg.columns), cfg.floor, cfg.states
    vol = cfg.at(cfg.volatility)
    cuts = np.array([NormalDist().inv_cdf(n / k) for n in range(1, k)])
    binary = lambda v: pa.array([pickle.dumps(v)], pa.binary())
    size = _by_chunk(blocks, keys, "n double, s double, q double", lambda row, x: {"n": pa.array([float(len(x))]), "s": pa.array([x[:, vol].sum()]), "q": pa.array([(x[:, vol] ** 2).sum()])}, width, True)
    size = size.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("_m"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2))).alias("_sd"))

    def first(row: dict, x: np.ndarray) -> dict:
        return {"counts": binary(assigned(x, np.searchsorted(row["_m"] + row["_sd"] * cuts, x[:, vol]), k))}

    def again(row: dict, x: np.ndarray) -> dict:
        return {"counts": binary(expected(pickle.loads(row["model"]), x, row["opens"]))}

    def step(n: int):
        def of(t: pa.Table) -> dict:
            model, logs = joined([pickle.loads(v) for v in t.column("counts").to_pylist()], floor)
            before = t.column("before")[0].as_py()
            return {"model": binary(model), "log_likelihood": pa.array([logs if n else None], pa.float64()), "previous": pa.array([before], pa.float64()), "iteration": pa.array([n], pa.int32())}
        return of

    none = F.lit(None).cast("double").alias("before")
    counts = _by_chunk(blocks.join(size, keys), keys, "counts binary", first, width, True).select("*", none)
    now, done = checkpointed(_fold(counts, keys, MODEL, step(0))), None
    for n in range(1, cfg.iterations + 1):
        counts = _by_chunk(blocks.join(now.select(*keys, "model"), keys), keys, "counts binary", again, width, True)
        new = checkpointed(_fold(counts.join(now.select(*keys, c("log_likelihood").alias("before")), keys), keys, MODEL, step(n)))
        rests = (F.lit(n == cfg.iterations) | F.coalesce(c("log_likelihood") - c("previous") < cfg.tolerance, F.lit(False)))
        rest, now = new.where(rests), new.where(~rests)
        done = rest if done is None else done.unionByName(rest)
        if n < cfg.iterations and now.isEmpty():
            break
    out = done if done is not None else now
    return checkpointed(out.select(*keys, "model", "log_likelihood", "iteration"))


def decode_regimes(blocks: DataFrame, models: DataFrame, keys: Sequence[str], cfg: RegimeConfig = RegimeConfig(), train_only: bool = False) -> DataFrame:
    """keys, i, state of the most likely path over a key's rows, or over its train rows alone."""
    keys, width, k = list(keys), len(cfg.columns), cfg.states
    d = blocks.join(models.select(*keys, "model"), keys)

    def logs(row: dict, x: np.ndarray) -> np.ndarray:
        model = pickle.loads(row["model"])
        with np.errstate(divide="ignore"):
            steps = np.log(model.moves)[None] + model.log_density(x)[:, None, :]
            if row["opens"]:
                steps[0] = np.log(model.start) + model.log_density(x[:1])[0]
        return steps

    def borders(t: pa.Table) -> dict:
        chunks = [pickle.loads(v) for v in t.column("best").to_pylist()]
        scores = [np.zeros(k)]
        for w in chunks:
            v = (scores[-1][:, None] + w).max(axis=0)
            scores.append(v - v.max())
        ends = [int(np.argmax(scores[-1]))]
        for n in range(len(chunks) - 1, -1, -1):
            ends.append(int(np.argmax(scores[n] + chunks[n][:, ends[-1]])))
        ends.reverse()
        return {"_chunk": t.column("_chunk"), "enters": pa.array(ends[:-1], pa.int32()), "leaves": pa.array(ends[1:], pa.int32())}

    def states(row: dict, x: np.ndarray) -> dict:
        steps = logs(row, x)
        path = best_prefixes(steps)[:, row["enters"], :] + best_suffixes(steps)[:, :, row["leaves"]]
        return {"state": pa.array(np.argmax(path, axis=1).astype(np.int32))}

    best = _by_chunk(d, keys, "best binary", lambda row, x: {"best": pa.array([pickle.dumps(best_prefixes(logs(row, x))[-1])], pa.binary())}, width, train_only)
    ends = _fold(best, keys, "_chunk bigint, enters int, leaves int", borders)
    return _by_chunk(d.join(ends, [*keys, "_chunk"]), keys, "i bigint, state int", states, width, train_only).drop("_chunk")


def calm_state(train: DataFrame, decoded: DataFrame, keys: Sequence[str], cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """Per key the state whose train rows have the smallest deviation of the difference; ties go to the smaller mean |level|."""
    keys = list(keys)
    clean = lambda n: F.when(F.abs(n) < float("inf"), F.nanvl(c(n), F.lit(0.0))).otherwise(0.0)
    d = decoded.join(train.select(*keys, c("i").cast("bigint").alias("i"), clean(cfg.difference).alias("_d"), clean(cfg.level).alias("_z")), [*keys, "i"])
    g = d.groupBy(*keys, "state").agg(F.stddev_pop("_d").alias("deviation"), F.avg(F.abs("_z")).alias("level"), F.count(F.lit(1)).alias("rows"))
    return g.groupBy(*keys).agg(F.min(F.struct("deviation", "level", "state")).alias("_s")).select(*keys, c("_s.state").alias("calm"))


def regimes(rows: DataFrame, train: str, keys: Sequence[str] = ("pair",), cfg: RegimeConfig = RegimeConfig(), chunk_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(keys, i, state, mean_reverting_state of every row of a key with a model; models with their calm state).

    ``train`` is a boolean column that is true for a key's first rows."""
    keys = list(keys)
    rows = rows.withColumn("_is_train", c(train))
    blocks = checkpointed(blocks_of(rows, keys, "_is_train", cfg, "i", chunk_rows))
    models = fit_regimes(blocks, keys, cfg)
    calm = calm_state(rows.where("_is_train"), decode_regimes(blocks, models, keys, cfg, train_only=True), keys, cfg)
    models = checkpointed(models.join(calm, keys))
    states = decode_regimes(blocks, models, keys, cfg).join(models.select(*keys, "calm"), keys)
    return states.select(*keys, "i", "state", (c("state") == c("calm")).alias("mean_reverting_state")), models


def model_table(models: DataFrame, keys: Sequence[str], cfg: RegimeConfig = RegimeConfig()) -> DataFrame:
    """One row a state: start share, transitions, means and deviations."""
    keys = list(keys)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own = b.slice(i, 1)
                m = pickle.loads(own.column("model")[0].as_py())
                n = len(m.start)
                heads = {k: own.column(k).take(pa.array(np.zeros(n, dtype=np.int64))) for k in [*keys, "calm", "log_likelihood", "iteration"]}
                yield pa.RecordBatch.from_pydict({**heads, "state": pa.array(np.arange(n, dtype=np.int32)), "start": pa.array(m.start), "moves": pa.array(list(m.moves)),
                                                  "means": pa.array(list(m.means)), "deviations": pa.array([np.sqrt(np.diag(v)) for v in m.covs])})

    return models.mapInArrow(rows, f"{_ddl(models, keys)}, calm int, log_likelihood double, iteration int, state int, start double, moves array<double>, means array<double>, deviations array<double>")
