"""Code points and rolling hashes of text columns, vectorized over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 2**64)
#: Code points worked on at once; longer texts are cut into overlapping segments.
BLOCK = 1 << 19


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and where each text begins (one more entry for the end). Null counts as ''."""
    texts = pc.fill_null(texts, "")
    joined = "".join(texts.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(pc.utf8_length(texts).to_numpy())].astype(np.int64)


def segments(starts: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, begin, end), each list of about BLOCK code points at most. A text above BLOCK gives several
    segments that overlap by window - 1, so each window lies in exactly one of them; shorter texts than window are left out."""
    held, size = [], 0
    for row, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        for begin in range(a, b - window + 1, BLOCK):
            end = min(b, begin + BLOCK + window - 1)
            if size and size + end - begin > BLOCK:
                yield held
                held, size = [], 0
            held.append((row, begin, end))
            size += end - begin
    if held:
        yield held


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    p = np.full((2, n), np.array([[BASE], [_INVERSE]], np.uint64))
    p[:, 0] = 1
    return tuple(np.cumprod(p, axis=1, dtype=np.uint64))


def rolling_hash(codes: np.ndarray, width: int, p: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """64-bit hash of every stretch of width code points; equal stretches have equal hashes wherever they are."""
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[0][:n], out=total[1:])
    h = (total[width:] - total[:-width]) * p[1][: n - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, by prefix and suffix minima of blocks of that width."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])
