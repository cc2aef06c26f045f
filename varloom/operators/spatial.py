"""Spatial clustering of a unit's variants by the distances between them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def distance_clusters(pos: np.ndarray, window: int, overlap: int, min_try: int = 5) -> np.ndarray:
    """Cluster of each of some sorted positions.

    Gaps between neighbours are looked at in windows, each ``overlap`` further. Where a window's mean gap is over its median
    / ln 2, what the mean of exponential gaps of that median is, its largest gaps split the variants until it no longer is.
    Fewer than ``min_try`` variants are one cluster.
    """
    if len(pos) < min_try:
        return np.zeros(len(pos), int)
    gaps = np.diff(pos).astype(float)
    size = min(window, len(gaps))
    cuts: set[int] = set()
    for start in range(0, len(gaps) - size + 1, max(1, overlap)):
        part = gaps[start : start + size]
        expected = np.median(part) / math.log(2)
        order = np.argsort(-part, kind="stable")
        left = 0
        while left < len(part) and part[order[left:]].mean() > expected:
            cuts.add(start + int(order[left]))
            left += 1
    return np.searchsorted(np.array(sorted(cuts), int), np.arange(len(pos)), side="left")


def spatial_clusters(sets: DataFrame, var: DataFrame, windows: list[tuple[int, int]], min_try: int = 5, pos: str = "POS") -> DataFrame:
    """Sets (unit, varSetName, VAR_id, w) split by distance: units unit_part, names set_window_overlap."""
    got = sets.join(var.select("VAR_id", F.col(pos).cast("double").alias("_pos")), "VAR_id")

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["_pos", "VAR_id"], ignore_index=True)
        out = []
        for window, overlap in windows:
            part = distance_clusters(f["_pos"].to_numpy(), window, overlap, min_try)
            out.append(pd.DataFrame({"unit": [f"{u}_{k}" for u, k in zip(f["unit"], part, strict=True)], "varSetName": [f"{n}_{window}_{overlap}" for n in f["varSetName"]], "VAR_id": f["VAR_id"], "w": f["w"]}))
        return pd.concat(out)

    return got.groupBy("unit", "varSetName").applyInPandas(split, "unit string, varSetName string, VAR_id long, w double")


def coding_position(hgvs: str = "HGVSc"):
    """The number in a coding description such as c.76A>T, as a column."""
    return F.regexp_extract(hgvs, r"c\.([0-9]+)", 1).try_cast("double")
