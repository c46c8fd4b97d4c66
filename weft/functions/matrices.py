"""Small dense matrices on the driver."""

from __future__ import annotations

import numpy as np


def nearest_positive_definite(matrix: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """The symmetric part of a matrix, with eigenvalues of `least` at least."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, least)) @ vectors.T
