"""numpy kernels over the UTF-8 bytes of a batch of texts.

All of them take whole texts. A run of bytes is hashed through prefix sums: the sum of
table[byte] * BASE**position, shifted back by the inverse power, does not depend on where it
stands, so any word or window costs one subtraction and two products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled together until their bytes pass this; one longer text is handled alone.
CHUNK = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=U) * U(BASE))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            a = np.full(size, base, dtype=U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive texts; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + CHUNK, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which `run_hash` takes the hash of any run of bytes."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(TABLE[raw] * up[:-1], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw)


#: Word bytes of the shingles: all but space and \t to \r.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Word bytes of the decontamination: digits, letters and all bytes from 128.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin. Words do not cross texts."""
    inside = is_word[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return run_hash(prefix_hash(lower_ascii(raw)), start, end), np.searchsorted(start, off)


def grams(word: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles; a text of fewer words, but some, has one of them all."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    first = bounds[:-1][text] + np.arange(out_bounds[-1]) - out_bounds[:-1][text]
    size = np.minimum(n, k)[text]
    return gram_at(word, first, size), out_bounds


def gram_at(word: np.ndarray, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hash of the `size` words from `first`."""
    total = np.zeros(len(first), U)
    size = np.broadcast_to(np.asarray(size), first.shape)
    weights, _ = powers(2 + (int(size.max()) if len(first) else 0))
    for j in range(int(size.max()) if len(first) else 0):
        take = size > j
        if take.all():
            total += word[first + j] * weights[j + 1]
        else:
            total[take] += word[first[take] + j] * weights[j + 1]
    return mix(total + size.astype(U) * U(INVERSE))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        if not len(a) and (before == label).all():
            break
    return label
