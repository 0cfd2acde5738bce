"""Searches in sorted arrays: nearest at or before, nearest at or after."""

from __future__ import annotations

import numpy as np


def less_equal(data: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Index of the last entry <= target, -1 where there is none."""
    return np.searchsorted(data, targets, side="right") - 1


def less(data: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Index of the last entry < target, -1 where there is none."""
    return np.searchsorted(data, targets, side="left") - 1


def greater_equal(data: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Index of the first entry >= target, -1 where there is none."""
    at = np.searchsorted(data, targets, side="left")
    return np.where(at < len(data), at, -1)


def greater(data: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Index of the first entry > target, -1 where there is none."""
    at = np.searchsorted(data, targets, side="right")
    return np.where(at < len(data), at, -1)


def search(data: np.ndarray, targets: np.ndarray, backward: bool, exact: bool) -> np.ndarray:
    return {(True, True): less_equal, (True, False): less, (False, True): greater_equal, (False, False): greater}[backward, exact](data, targets)
