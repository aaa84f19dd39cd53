"""Gradient tables and response files: text in, rows out."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lumivox.functions.numeric import affine_rotation, rotate_directions
from lumivox.sources.schemas import GRADIENT, RESPONSE


def _numbers(text: str) -> list[list[float]]:
    """Rows of numbers; # starts a comment, commas and white space separate."""
    rows = []
    for line in text.splitlines():
        if body := re.split(r"[,\s]+", line.split("#")[0].strip().strip(",")):
            if body != [""]:
                try:
                    rows.append([float(x) for x in body])
                except ValueError as e:
                    raise ValueError(f"not a number in: {line.strip()}") from e
    return rows


def parse_bvals(text: str) -> np.ndarray:
    return np.array([float(x) for x in text.split()])


def parse_bvecs(text: str) -> np.ndarray:
    """Rows of three from three long rows or from long columns."""
    rows = _numbers(text)
    if len({len(r) for r in rows}) != 1:
        raise ValueError("rows of different length")
    a = np.array(rows)
    if a.shape[0] == 3 and a.shape[1] != 3:
        return a.T
    if a.shape[1] == 3:
        return a.T if a.shape[0] == 3 else a
    raise ValueError("neither three rows nor three columns")


def parse_table(text: str) -> tuple[np.ndarray, np.ndarray]:
    """b-values and directions from lines of x, y, z and b."""
    rows = _numbers(text)
    if any(len(r) != 4 for r in rows) or not rows:
        raise ValueError("lines of four numbers are needed")
    a = np.array(rows)
    return a[:, 3], a[:, :3]


def parse_response(text: str) -> np.ndarray:
    """Rows of zonal coefficients, all of one length."""
    rows = _numbers(text)
    if not rows:
        raise ValueError("an empty response")
    if len({len(r) for r in rows}) != 1:
        raise ValueError("ragged response rows")
    return np.array(rows)


def format_response(rows: np.ndarray, comment: str = "") -> str:
    head = "".join(f"# {x}\n" for x in comment.splitlines())
    return head + "".join(" ".join(f"{v:.15e}" for v in r) + "\n" for r in rows)


def gradient_frame(spark: SparkSession, scan_id: str, bvals: np.ndarray, directions: np.ndarray, n_vol: int | None = None, affine: np.ndarray | None = None, world: bool = False, to_voxel: bool = False) -> DataFrame:
    """The gradient table of one scan as rows; world: directions turned by the affine's rotation, to_voxel: turned back by it."""
    if len(bvals) != len(directions) or (n_vol is not None and len(bvals) != n_vol):
        raise ValueError(f"{len(bvals)} b-values, {len(directions)} directions, {n_vol} volumes")
    if affine is not None and (world or to_voxel):
        r = affine_rotation(affine)
        directions = rotate_directions(directions, r if world else np.linalg.inv(r))
    return spark.createDataFrame([(scan_id, v, float(b), *map(float, g)) for v, (b, g) in enumerate(zip(bvals, directions))], GRADIENT)


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file from any store that Spark reads."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())


def response_frame(spark: SparkSession, scan_id: str, tissue: str, rows: np.ndarray, bvals: list[float]) -> DataFrame:
    return spark.createDataFrame([(scan_id, tissue, k, float(b), [float(x) for x in r]) for k, (r, b) in enumerate(zip(rows, bvals))], RESPONSE)
