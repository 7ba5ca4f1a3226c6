"""Signature similarity: difflib's ratio, with cheap exact bounds in front of it.

These helpers run inside tasks on the distinct signatures of one stretch of alerts.
"""

from __future__ import annotations

import difflib
import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_BINS = 64
# So few signatures are compared one by one, with what is known of the pair.
_FEW = 16


def ratio(a: str, b: str) -> float:
    """Similarity of two signatures, case ignored. Not symmetric: ``a`` is the group's."""
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


@F.pandas_udf(T.DoubleType())
def signature_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


@functools.lru_cache(maxsize=1 << 16)
def _accepts(a: str, b: str, threshold: float) -> bool:
    return difflib.SequenceMatcher(None, a, b).ratio() >= threshold


def _bins(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(codes % _BINS, minlength=_BINS).astype(np.int32)


class SignatureIndex:
    """Signatures seen so far, each with a number; tells which of them a new one matches.

    Both bounds only ever overestimate the ratio (shared characters cannot exceed the shorter
    length or the binned character overlap), so no match is lost.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []
        self._lower: list[str] = []
        self._lengths = np.zeros(64, dtype=np.int64)
        self._counts = np.zeros((64, _BINS), dtype=np.int32)

    def number(self, signature: str) -> int:
        n = self.numbers.get(signature)
        if n is None:
            n = self.numbers[signature] = len(self.texts)
            self.texts.append(signature)
            lowered = signature.lower()
            self._lower.append(lowered)
            if n == len(self._lengths):
                self._lengths = np.concatenate([self._lengths, np.zeros_like(self._lengths)])
                self._counts = np.concatenate([self._counts, np.zeros_like(self._counts)])
            self._lengths[n] = len(lowered)
            self._counts[n] = _bins(lowered)
        return n

    def matching(self, number: int, start: int = 0) -> list[int]:
        """Numbers from ``start`` on whose signature, as the group's, accepts this one."""
        n = len(self.texts)
        if n - start <= _FEW:
            own = self._lower[number]
            return [i for i in range(start, n) if i == number or _accepts(self._lower[i], own, self.threshold)]
        total = self._lengths[start:n] + self._lengths[number]
        safe_total = np.maximum(total, 1)
        shorter = np.minimum(self._lengths[start:n], self._lengths[number])
        near = np.flatnonzero(2.0 * shorter / safe_total >= self.threshold)
        if len(near):
            overlap = np.minimum(self._counts[start:n][near], self._counts[number]).sum(axis=1)
            near = near[2.0 * overlap / safe_total[near] >= self.threshold]
        found = []
        matcher = difflib.SequenceMatcher(None)
        matcher.set_seq2(self._lower[number])
        for i in near.tolist():
            i += start
            if i == number:
                continue
            matcher.set_seq1(self._lower[i])
            if matcher.ratio() >= self.threshold:
                found.append(i)
        # Equal signatures always match.
        if number >= start:
            found.append(number)
            found.sort()
        return found
