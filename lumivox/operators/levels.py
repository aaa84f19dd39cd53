"""Intensity normalisation over tissues, for any number of scans at once.

Every scan has a state: balance factors, the field's coefficients, the bounds within which voxels weigh, and where it stands in
its rounds. A pass is one aggregation over all voxels: tasks sum what their voxels give under their scan's state, and what the
tasks give for a scan makes its next state. A scan's quartiles are exact: a state knows between which values they lie, as it knows by how much
values moved at most, so only values between, and voxels about the bounds that follow from them, leave the tasks one by one.
States, some hundred numbers a scan, are what comes to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumivox.functions import numeric as N
from lumivox.functions.storage import checkpointed
from lumivox.operators.voxel import is_finite

SUMMARY = 128  # values that a block of voxels tells of itself


@dataclass(frozen=True)
class NormaliseOptions:
    """target: what tissue sums are brought to, None for the upper median of the positive ones; balance: whether results carry the balance factors."""

    order: int = 3
    rounds: int = 15
    inner: int = 7
    target: float | None = None
    balance: bool = False


@dataclass
class Level:
    """coef: of the log field's polynomial of that order; balance: of the tissues; target: the sum that was aimed at; fitted: voxels with weight;
    residual: their mean absolute log difference from the target; scale: the field's geometric mean over them; rounds done.
    """

    order: int
    coef: np.ndarray
    balance: np.ndarray
    target: float
    fitted: int
    residual: float
    scale: float
    rounds: int


@dataclass
class State:
    """Where a scan stands, and what the next pass does for it by `phase`.

    target, middle: find the upper median of the plain sums, first between which values it lies. near, weigh: find the quartiles, and then
    who weighs. sums: of those who weigh, under a new field. done: nothing more, `level` or `error` says how it went.
    brackets: between which values each wanted order statistic lies. weights: balance, coefficients and bounds that voxels weigh by.
    factor: how far bounds lie beyond the quartiles, in their distance.
    """

    phase: str
    balance: np.ndarray
    coef: np.ndarray
    target: float | None = None
    round: int = 0
    inner: int = 0
    factor: float = 3.0
    brackets: tuple = ()
    weights: tuple | None = None
    level: Level | None = None
    error: str = ""


def solved(gram: np.ndarray, rhs: np.ndarray, what: str) -> np.ndarray:
    """Normal equations with a ridge that only matters where they are singular."""
    ridge = max(gram.diagonal().max(), 1.0) * 1e-12
    try:
        low = np.linalg.cholesky(gram + ridge * np.eye(len(gram)))
    except np.linalg.LinAlgError:
        raise ValueError(f"the equations of the {what} aren't positive definite") from None
    return np.linalg.solve(low.T, np.linalg.solve(low, rhs))


def basis(places: np.ndarray, order: int) -> np.ndarray:
    return np.stack([places[:, 0] ** i * places[:, 1] ** j * places[:, 2] ** k for i, j, k in N.polynomial_terms(order)], 1)


def summary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values at even ranks, first and last among them, and those ranks."""
    v = np.sort(values)
    at = np.unique(np.append(np.arange(0, len(v), max(1, -(-len(v) // SUMMARY))), len(v) - 1))
    return v[at], at


def bracket(summaries: list[tuple[np.ndarray, np.ndarray, int]], rank: int) -> tuple[float, float]:
    """Two values between which the element of that rank lies for sure, by the summaries (values, ranks, size) of all parts."""
    c = np.unique(np.concatenate([v for v, _, _ in summaries]))
    least, most = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)  # of elements below each
    for v, ranks, n in summaries:
        at = np.searchsorted(v, c)
        least += np.where(at > 0, ranks[np.maximum(at - 1, 0)] + 1, 0)
        most += np.where(at < len(v), ranks[np.minimum(at, len(v) - 1)], n)
    low, high = c[most <= rank], c[least > rank]
    return (float(low[-1]) if len(low) else float("-inf")), (float(high[0]) if len(high) else float("inf"))


def rank_of(share: float | None, n: int) -> int:
    """A quartile's rank, or the upper median's for None."""
    return n // 2 if share is None else min(int(np.floor(n * share + 0.5)), n - 1)


def zones(brackets: tuple, k: float) -> tuple[float, float, float, float]:
    """Least and largest lower bound, least and largest upper bound, k distances beyond quartiles that lie anywhere in their brackets."""
    (a, b), (c, d) = brackets
    with np.errstate(invalid="ignore"):
        found = (a - k * (d - a), b - k * max(c - b, 0.0), c + k * max(c - b, 0.0), d + k * (d - a))
    return tuple(float(s if np.isnan(v) else v) for v, s in zip(found, (-np.inf, np.inf, -np.inf, np.inf)))


def logs(x: np.ndarray, p: np.ndarray, balance: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Log of the balanced sum over the field, minus infinity without a positive sum."""
    s = x @ balance
    return np.where(s > 0, np.log(np.where(s > 0, s, 1)) - p @ coef, -np.inf)


def weighing(x: np.ndarray, p: np.ndarray, weights: tuple | None) -> np.ndarray:
    if weights is None:
        return np.zeros(len(x), bool)
    balance, coef, low, high = weights
    log = logs(x, p, balance, coef)
    return (log >= low) & (log <= high) & (log > -np.inf)


def sums(x: np.ndarray, p: np.ndarray, s: State) -> np.ndarray:
    """Of some voxels in one row: count, equations of the balance, equations of the log field, sum of that field's logs, distance from the target."""
    field, own = p @ s.coef, x @ s.balance
    flat = x / np.exp(field)[:, None]
    y = np.where(own > 0, np.log(np.where(own > 0, own, 1) / s.target), 0)
    return np.concatenate([[len(x)], (flat.T @ flat).ravel(), flat.sum(0), (p.T @ p).ravel(), p.T @ y, [field.sum(), np.abs(np.where(own > 0, y - field, 0)).sum()]])


def told(data: np.ndarray, tissues: int, s: State, order: int) -> dict:
    """What a block of a scan's voxels, tissues and then places, gives to the scan's phase."""
    x, p = data[:, :tissues], basis(data[:, tissues:], order)
    if s.phase in ("target", "near"):
        v = x.sum(1) if s.phase == "target" else logs(x, p, s.balance, s.coef)
        v = v[v > 0] if s.phase == "target" else v
        return {"n": len(v), "summaries": [(*summary(v), len(v))] if len(v) else []}
    if s.phase == "sums":
        return {"sums": sums(*(a[weighing(x, p, s.weights)] for a in (x, p)), s)}
    v = x.sum(1) if s.phase == "middle" else logs(x, p, s.balance, s.coef)
    v = v[v > 0] if s.phase == "middle" else v
    out = {"n": len(v), "below": np.array([(v < a).sum() for a, _ in s.brackets]), "between": [v[(v >= a) & (v <= b)] for a, b in s.brackets]}
    if s.phase == "middle":
        return out
    before = weighing(x, p, s.weights)
    far_low, near_low, near_high, far_high = zones(s.brackets, s.factor)
    some = v > -np.inf
    sure = some & (v >= near_low) & (v <= near_high)
    maybe = some & ~sure & (v >= far_low) & (v <= far_high)
    return out | {"sums": sums(x[sure], p[sure], s), "changed": int((before != sure)[~maybe].sum()), "maybe": [np.column_stack([data, v, before])[maybe]]}


def together(parts: list[dict]) -> dict:
    """What several blocks told, as one."""
    out = dict(parts[0])
    for part in parts[1:]:
        for k, v in part.items():
            out[k] = [np.concatenate(pair) for pair in zip(out[k], v)] if k == "between" else out[k] + v
    return out


def statistics(found: dict, shares: tuple) -> list[float]:
    """The exact elements at the wanted ranks, from the counts below the brackets and the values within."""
    return [float(np.partition(v, r)[r]) for r, v in ((rank_of(q, found["n"]) - below, v) for q, below, v in zip(shares, found["below"], found["between"]))]


def moved(s: State, found: dict, tissues: int, terms: int, o: NormaliseOptions) -> State:
    """The state after a pass, in which `found` was told."""
    n, quartiles = tissues, (0.25, 0.75)
    if s.phase in ("target", "middle") and not found["n"]:
        raise ValueError("no voxel of the mask has a positive sum")
    if s.phase == "target":
        return replace(s, phase="middle", brackets=(bracket(found["summaries"], rank_of(None, found["n"])),))
    if s.phase == "middle":
        return replace(s, phase="near", target=statistics(found, (None,))[0])
    if s.phase == "near":
        return replace(s, phase="weigh", brackets=tuple(bracket(found["summaries"], rank_of(q, found["n"])) for q in quartiles))
    total, changed = found["sums"], True
    if s.phase == "weigh":
        q1, q3 = statistics(found, quartiles)
        with np.errstate(invalid="ignore"):
            low, high = (float(v) if not np.isnan(v) else float("-inf") for v in (q1 - s.factor * (q3 - q1), q3 + s.factor * (q3 - q1)))
        rows = np.concatenate(found["maybe"])
        inside, x, p = (rows[:, -2] >= low) & (rows[:, -2] <= high), rows[:, :n], basis(rows[:, n : n + 3], o.order)
        total = total + sums(x[inside], p[inside], s)
        changed = s.weights is None or found["changed"] + int((inside != (rows[:, -1] > 0)).sum()) > 0
        s = replace(s, weights=(s.balance, s.coef, low, high), brackets=((q1, q1), (q3, q3)))
    if not total[0]:
        raise ValueError("no voxel is left that weighs anything")
    gram, rhs = total[1 : 1 + n * n].reshape(n, n), total[1 + n * n : 1 + n * n + n]
    rest = total[1 + n * n + n :]
    if s.phase == "weigh" and s.factor < 3 and (not changed or s.inner >= o.inner):
        coef = solved(rest[: terms * terms].reshape(terms, terms), rest[terms * terms : terms * terms + terms], "field")
        return replace(s, phase="sums", coef=coef, round=s.round + 1, inner=0)
    if s.phase == "sums" and s.round >= o.rounds:
        level = Level(o.order, s.coef, s.balance, s.target, int(total[0]), float(rest[-1] / total[0]), float(np.exp(rest[-2] / total[0])), s.round)
        return replace(s, phase="done", level=level)
    new = solved(gram, rhs, "balance factors")
    if not (new > 0).all():
        raise ValueError(f"balance factors that aren't positive: {new}")
    balance = new / np.exp(np.log(new).mean())
    # a sum moves by its tissues' factors, a log field by no more than its coefficients do: places are within -1 and 1
    step, field = np.log(balance / s.balance), np.abs(s.coef - s.weights[1]).sum()
    low, high = step.min() - field - 1e-9, step.max() + field + 1e-9
    (q1, _), (q3, _) = s.brackets
    near = tuple((q + low, q + high) for q in (q1, q3))
    known = np.isfinite(q1) and high - low <= 0.1 * (q3 - q1)
    return replace(s, phase="weigh" if known else "near", balance=balance, brackets=near, factor=1.5, inner=s.inner + 1)


def blocks(tissue: DataFrame, columns: list[str], shape: tuple[int, int, int] | DataFrame) -> DataFrame:
    """scan_id and data: the tissues, 0 where not positive and finite, and the places in -1 to 1 of a batch's masked voxels of a scan."""
    n = len(columns)
    positive = lambda c: F.when(is_finite(F.col(c).cast("double")) & (F.col(c) > 0), F.col(c).cast("double")).otherwise(0.0)
    if isinstance(shape, DataFrame):
        sized = tissue.where("in_mask").join(shape.select("scan_id", *(F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz"))), "scan_id")
        sizes = [F.col(f"_{c}") for c in ("nx", "ny", "nz")]
    else:
        sized, sizes = tissue.where("in_mask"), [F.lit(int(k)) for k in shape]
    place = [(2 * F.col(a) / F.greatest(k - 1, F.lit(1)) - 1).alias(f"_{a}") for a, k in zip("xyz", sizes)]
    flat = sized.select("scan_id", *[positive(c).alias(f"_t{i}") for i, c in enumerate(columns)], *place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scan, rows in b.groupby("scan_id", dropna=False):
                yield pd.DataFrame({"scan_id": [scan], "data": [rows.iloc[:, 1:].to_numpy(np.float64).tobytes()], "width": [n + 3]})

    return checkpointed(flat.mapInPandas(run, "scan_id string, data binary, width int"))


def fit_levels(tissue: DataFrame, columns: list[str], shape: tuple[int, int, int] | DataFrame, o: NormaliseOptions = NormaliseOptions()) -> dict[str, Level]:
    """By scan the field and balance under which the tissue sum of its masked voxels is level.

    A voxel weighs 1 where its log sum is within the quartiles widened by 3, later by 1.5 of their distance, else 0. Each round takes
    balance factors and weights in turn till no weight changes or `inner` times, then the field's least squares. Scans go through
    their rounds side by side: there are as many passes as the slowest one needs. shape: of every scan, or a table of scan_id, nx, ny, nz.
    Scans that can't be fitted are an error that names them.
    """
    if o.rounds < 1 or o.inner < 1 or (o.target is not None and not o.target > 0):
        raise ValueError("normalisation: rounds, inner rounds and the target must be positive")
    n, terms = len(columns), len(N.polynomial_terms(o.order))
    parts = blocks(tissue, columns, shape).persist()
    start = State("target" if o.target is None else "near", np.ones(n), np.zeros(terms), o.target)
    states = {r.scan_id: start for r in parts.select("scan_id").distinct().collect()}
    if not states:
        raise ValueError("normalisation: no voxel of the mask has a positive sum")

    def one_pass(going: dict[str, State]) -> dict[str, State]:
        def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own: dict[str, dict] = {}
            for b in batches:
                for scan, data, width in zip(b["scan_id"], b["data"], b["width"]):
                    if scan in going:
                        new = told(np.frombuffer(data).reshape(-1, width), n, going[scan], o.order)
                        own[scan] = together([own[scan], new]) if scan in own else new
            yield pd.DataFrame({"scan_id": list(own), "told": [pickle.dumps(v) for v in own.values()]}, dtype=object)

        def move(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            now = going[key[0]]
            try:
                now = moved(now, together([pickle.loads(v) for v in rows["told"]]), n, terms, o)
            except ValueError as e:
                now = replace(now, phase="done", error=str(e))
            return pd.DataFrame({"scan_id": [key[0]], "state": [pickle.dumps(now)]})

        found = parts.mapInPandas(tell, "scan_id string, told binary").groupBy("scan_id").applyInPandas(move, "scan_id string, state binary")  # a row a task of each scan
        return {r.scan_id: pickle.loads(r.state) for r in found.collect()}

    try:
        while going := {k: s for k, s in states.items() if s.phase != "done"}:
            states |= one_pass(going)
    finally:
        parts.unpersist()
    if failed := {k: s.error for k, s in states.items() if s.error}:
        raise ValueError("normalisation: " + "; ".join(f"{k}: {e}" for k, e in sorted(failed.items())))
    return {k: s.level for k, s in states.items()}


def fit_level(tissue: DataFrame, columns: list[str], shape: tuple[int, int, int], o: NormaliseOptions = NormaliseOptions()) -> Level:
    """The same for one scan."""
    found = fit_levels(tissue, columns, shape, o)
    if len(found) != 1:
        raise ValueError(f"normalisation: one scan is asked for, there are {len(found)}")
    return next(iter(found.values()))


def _log_field(order: int, shape: tuple[int, int, int] | None, coef: Column) -> Column:
    sizes = [F.lit(int(k)) for k in shape] if shape else [F.col(f"_{c}") for c in ("nx", "ny", "nz")]
    at = [2 * F.col(a) / F.greatest(k - 1, F.lit(1)) - 1 for a, k in zip("xyz", sizes)]
    return sum((F.get(coef, F.lit(m)) * F.pow(at[0], F.lit(i)) * F.pow(at[1], F.lit(j)) * F.pow(at[2], F.lit(k)) for m, (i, j, k) in enumerate(N.polynomial_terms(order))), F.lit(0.0))


def normalise(tissue: DataFrame, columns: list[str], shape: tuple[int, int, int] | DataFrame, o: NormaliseOptions = NormaliseOptions(), level: Level | dict[str, Level] | None = None) -> DataFrame:
    """Adds `field` and divides the tissue columns by it, and `wm`, all coefficients of it, where that is there: rows outside the mask too.

    The field of each scan is fitted to `columns` where no level is given; one level counts for every row.
    """
    level = level or fit_levels(tissue, columns, shape, o)
    literal = lambda v: F.array(*[F.lit(float(x)) for x in v])
    rows = tissue
    if isinstance(shape, DataFrame):
        rows = rows.join(shape.select("scan_id", *(F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz"))), "scan_id")
    if isinstance(level, Level):
        order, rows = level.order, rows.withColumns({"_coef": literal(level.coef), "_balance": literal(level.balance)})
    else:
        order = next(iter(level.values())).order
        table = [(k, [float(x) for x in v.coef], [float(x) for x in v.balance]) for k, v in level.items()]
        rows = rows.join(tissue.sparkSession.createDataFrame(table, "scan_id string, _coef array<double>, _balance array<double>"), "scan_id")
    rows = rows.withColumn("field", F.exp(_log_field(order, None if isinstance(shape, DataFrame) else shape, F.col("_coef"))))
    factor = {c: (F.get("_balance", F.lit(i)) if o.balance else F.lit(1.0)) / F.col("field") for i, c in enumerate(columns)}
    out = {c: F.col(c) * f for c, f in factor.items()}
    if "wm" in tissue.columns:
        whole = next((f for c, f in factor.items() if c.startswith("wm")), 1.0 / F.col("field"))
        out["wm"] = F.transform("wm", lambda x: x * whole)
    return rows.withColumns(out).select(*tissue.columns, "field")
