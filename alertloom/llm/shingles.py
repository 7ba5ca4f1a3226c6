"""Sets of word shingles and their minwise sketches, by batches of texts in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (between ASCII white space, A-Z in lower case), and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    names = pc.ascii_lower(coded.dictionary).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    hashes = table[coded.indices.to_numpy()] if len(flat) else np.empty(0, np.uint64)
    real = pc.binary_length(flat).to_numpy() > 0
    if not real.all():
        bounds = np.concatenate(([0], np.cumsum(real)))[bounds]
        hashes = hashes[real]
    return hashes, bounds


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """The shingle that begins with each word, as long as there are words."""
    out = hashes.copy()
    if len(hashes) >= size:
        out = hashes[: len(hashes) - size + 1].copy()
        for k in range(1, size):
            out = out * _ODD + hashes[k : len(hashes) - size + 1 + k]
    return mixed(out)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending; a shorter text is one shingle, a text without words has none."""
    shingles, out = rolled(hashes, size), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(shingles[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * _ODD + h
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def factors(n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def sketches(sets: list[np.ndarray], n: int) -> np.ndarray:
    """For each set that isn't empty, n minwise values, by their lower 32 bits (a minimum's upper bits are nearly always zero); empty sets get zeros."""
    out = np.zeros((len(sets), n), np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        starts = np.concatenate(([0], np.cumsum([len(sets[k]) for k in full])[:-1]))
        for j, a in enumerate(factors(n)):
            x = flat * a
            out[full, j] = np.minimum.reduceat(x ^ (x >> np.uint64(31)), starts) & np.uint64(0xFFFFFFFF)
    return out


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
