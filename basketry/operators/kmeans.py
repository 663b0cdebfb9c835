"""K-means with many restarts at once: a round reads the rows one time for all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import stage


#: Rows whose distances are held at a time.
_SLICE = 2048


def _uniform(ids: np.ndarray, restart: int, step: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on a row's hash, the restart and the step alone."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + restart * 10_007 + step + 1) & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _distances2(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2.0 * x @ centres.T + (centres**2).sum(axis=1)[None], 0.0)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _next_centres(centres: list[np.ndarray], seed: int):
    """Per restart the task's row that a draw weighted by squared distance picks: the least of -ln(u) / weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _rows(batch), batch.column("h").to_numpy()
            for restart, chosen in enumerate(centres):
                weight = _distances2(x, chosen).min(axis=1) if len(chosen) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    key = np.where(weight > 0, -np.log(_uniform(ids, restart, len(chosen), seed)) / weight, np.inf)
                at = int(np.lexsort((ids, key))[0])
                own = (float(key[at]), int(ids[at]))
                if restart not in best or own < best[restart][:2]:
                    best[restart] = (*own, x[at])
        names = ["restart", "place", "h", "x"]
        columns = [list(best), *[[b[k] for b in best.values()] for k in range(3)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64())), strict=True)], names)

    return run


def _sums(centres: np.ndarray):
    """One row a task: for all restarts the costs, and the counts and sums of the rows of each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restarts, k, width = centres.shape
        costs, counts, sums = np.zeros(restarts), np.zeros((restarts, k)), np.zeros((restarts, k, width))
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                x = _rows(batch.slice(at, _SLICE))
                # one product for the distances to all centres of all restarts, one for the sums of their rows
                far = _distances2(x, centres.reshape(-1, width)).reshape(len(x), restarts, k)
                own = far.argmin(axis=2)
                costs += np.take_along_axis(far, own[:, :, None], axis=2).sum(axis=(0, 2))
                belongs = (own[:, :, None] == np.arange(k)).astype(np.float64)
                counts += belongs.sum(axis=0)
                sums += (belongs.reshape(len(x), -1).T @ x).reshape(restarts, k, width)
        flat = np.concatenate((costs, counts.ravel(), sums.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["sums"])

    return run


def _summed(data: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    restarts, k, width = centres.shape
    rows = data.mapInArrow(_sums(centres), "sums array<double>").select(F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(restarts * (1 + k + k * width))
    for r in rows:
        flat[r.place] = r.v
    costs, counts, sums = np.split(flat, [restarts, restarts * (1 + k)])
    return costs, counts.reshape(restarts, k), sums.reshape(restarts, k, width)


@dataclass(frozen=True)
class Clusters:
    """The centres of the restart with the least sum of squared distances, and that sum for every restart."""

    centres: np.ndarray
    costs: list[float]
    rounds: int

    def predict(self, data: DataFrame) -> DataFrame:
        """(key columns, cluster) of rows with their vector in ``x``."""
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = _distances2(_rows(batch), centres).argmin(axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("user_id"), pa.array(own)], ["user_id", "cluster"])

        return data.select("user_id", "x").mapInArrow(run, f"user_id {dict(data.dtypes)['user_id']}, cluster int")


def fit_restarts(data: DataFrame, k: int = 5, restarts: int = 20, seed: int = 42, most_rounds: int = 100, tolerance: float = 1e-4) -> Clusters:
    """K-means of ``data`` (user_id, x array<double>), the best of ``restarts`` runs that go on side by side.

    Starts are drawn by squared distance to the centres so far. A run ends when no centre moves by more than ``tolerance``; a
    centre without rows stays where it is. Fewer different rows than ``k`` give as many centres. Draws depend on user ids and
    the seed alone. A round is one pass over the rows for all runs that have not ended; what reaches the driver are sums.
    """
    hashed = stage(data.select("x", F.xxhash64("user_id", "x").alias("h")), "points")
    centres: list[np.ndarray] = [np.zeros((0, 0))] * restarts
    for _ in range(k):
        found = hashed.mapInArrow(_next_centres(centres, seed), "restart int, place double, h long, x array<double>")
        picked = found.where("place < double('infinity')").groupBy("restart").agg(F.min_by("x", F.struct("place", "h")).alias("x")).collect()
        if not picked:
            break
        for r in picked:
            x = np.array(r.x)[None]
            centres[r.restart] = x if not len(centres[r.restart]) else np.concatenate((centres[r.restart], x))
    if not len(centres[0]):
        return Clusters(np.zeros((0, 0)), [], 0)
    now = np.stack(centres)
    moving, rounds = np.arange(restarts), 0
    while len(moving) and rounds < most_rounds:
        _, counts, sums = _summed(hashed, now[moving])
        means = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], now[moving])
        shift = np.sqrt(((means - now[moving]) ** 2).sum(axis=2)).max(axis=1)
        now[moving] = means
        moving, rounds = moving[shift > tolerance], rounds + 1
    costs = _summed(hashed, now)[0]
    return Clusters(now[int(costs.argmin())], costs.tolist(), rounds)
