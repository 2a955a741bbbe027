"""Fingerprints of all windows of a sequence, and its content-chosen anchors; numpy, for use inside tasks."""

import numpy as np
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
S29, S32 = np.uint64(29), np.uint64(32)
NONE = np.zeros(0, np.uint64)


class WordPrints(dict):
    """Word (bytes) -> its 64-bit fingerprint; starts anew when it has grown to `most` words."""

    def __init__(self, most=400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * M2
    h = (h ^ (h >> S29)) * M3
    return h ^ (h >> S32)


#: Fingerprints of the 256 bytes.
BYTE = mixed(np.arange(256, dtype=np.uint64))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Fingerprint of two neighbouring (or overlapping) windows from theirs: the pair of ranks of prefix doubling."""
    out = left * M1
    out += right
    out ^= out >> S29
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """Every 8 neighbouring bytes as one number, which is their rank; no copy."""
    data = np.ascontiguousarray(data)
    return np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))


def spread(ranks: np.ndarray) -> np.ndarray:
    """Ranks of 8 bytes spread over 64 bits, each to a number of its own."""
    out = ranks * M2
    out ^= out >> S32
    return out


def windows_at(data: np.ndarray, at: np.ndarray, length: int, block=1 << 14) -> np.ndarray:
    """windows(data, length) of bytes at some places only, block by block; the length is 8 or more."""
    ranks, size = eights(data), 1 << (length.bit_length() - 1)
    out = np.empty(len(at), np.uint64)

    def level(at, size):
        return spread(ranks[at]) if size == 8 else joined(level(at, size // 2), level(at + size // 2, size // 2))

    for i in range(0, len(at), block):
        some = at[i : i + block]
        out[i : i + block] = mixed(joined(level(some, size), level(some + length - size, size)) if length > size else level(some, size))
    return out


def windows(values: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length the fingerprint of every window of that many values (64-bit), by doubling."""
    if values.dtype == np.uint8 and min(lengths) >= 8:
        level, size, done = spread(eights(values)), 8, {}
    else:
        level, size, done = BYTE[values] if values.dtype == np.uint8 else mixed(values), 1, {}
    for length in sorted(lengths):
        while size * 2 <= length and len(level) > size:
            level, size = joined(level[:-size], level[size:]), size * 2
        rest, n = length - size, len(values) - length + 1
        done[length] = NONE if n <= 0 else mixed(joined(level[:n], level[rest : rest + n]) if rest else level[:n])
    return [done[n] for n in lengths]


def lowest(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Smallest value (or what `pick` picks) of every `width` neighbours."""
    out, size = values, 1
    while size * 2 <= width:
        out, size = pick(out[:-size], out[size:]), size * 2
    rest, n = width - size, len(values) - width + 1
    return out if not rest else pick(out[:n], out[rest : rest + n])


def anchors(values: np.ndarray, width: int) -> np.ndarray:
    """Which values are the smallest of some `width` neighbours: content alone decides, alike wherever a passage stands."""
    if len(values) < width:
        return np.zeros(len(values), bool)
    low = np.zeros(len(values) + width - 1, np.uint64)
    low[width - 1 : len(values)] = lowest(values, width)
    return lowest(low, width, np.maximum) == values


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Mask over `size` places of those within a window of `width` that begins at a place in `starts`."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, size), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
