"""Hashed tokens of whole texts for the two classifiers; used inside Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

WORD = re.compile(r"[^\W\d_]+")


def text_of(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def hashed(strings: list[str], buckets: int, salt: int = 0) -> np.ndarray:
    """A bucket per string; ``buckets`` is a power of two.  The hash is fixed and the same on every machine."""
    if not strings:
        return np.zeros(0, np.int64)
    keys = pd.util.hash_array(np.array(strings, dtype=object), categorize=False)
    if salt:
        keys = (keys ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return (keys & np.uint64(buckets - 1)).astype(np.int64)
