"""Elias-Fano n-gram trie levels in files that are mapped into memory.

A monotone sequence is split into low bits, packed, and high bits, in unary; selects
over the unary part use a running count for every 64 bits, or the decoded part where
there are about as many questions as elements.  A level of the trie keeps

* its keys: word hashes at the root, and below it the context numbers and, relative to
  them, (context, word number) as one monotone number, so that a search for a successor
  stays inside its context;
* its pointers: where each context's successors begin, monotone too;
* its values: exact counts at the root, below it probabilities and backoff weights as
  logarithms in 4,095 steps, which differ from the exact ones by 0.0013 at most.

All searches take arrays and run in lockstep.  Sequences hold integers below 2**63;
larger ones raise.
"""

from __future__ import annotations

import json

import numpy as np

from tickloom.llm.warc import filesystem

#: Log probabilities are kept in steps of LOWEST / STEPS; the code after the last stands for none.
LOWEST, STEPS = -10.0, 4_094
ABSENT = STEPS + 1


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of packed words with the running counts ``before``."""
    at = np.searchsorted(before, k, "right") - 1
    rest, word = k - before[at], words[at]
    out = np.zeros(len(k), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.int64)
        up = rest >= ones
        rest = np.where(up, rest - ones, rest)
        out += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), low)
    return at * 64 + out


class EliasFano:
    """A monotone sequence of integers below 2**63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[dict, list[np.ndarray]]:
        """What a file keeps of a sequence."""
        if len(values) and (int(values[0]) < 0 or int(values[-1]) >= 1 << 63):
            raise OverflowError("a sequence holds integers from 0 to 2**63 - 1")
        n, v = len(values), values.astype(np.uint64)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = np.zeros((n + (top >> bits)) // 64 + 2, np.uint64)
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            bit = np.arange(n, dtype=np.int64) * bits
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (bit & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        zeros = np.arange(len(high), dtype=np.int64) * 64 - ones
        fit = np.uint32 if len(high) * 64 < 1 << 32 else np.int64
        return {"n": n, "low_bits": bits}, [low, high, ones.astype(fit), zeros.astype(fit)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        out = self.low[word] >> shift
        # a shift by 64 is split into two, as it is not defined
        out |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (_select(self.high, self.ones, i) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits) | self._low(i)).astype(np.int64)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value, -1 if it is not there."""
        out = np.full(len(value), -1, np.int64)
        if not self.n or not len(value):
            return out
        v = value.astype(np.uint64)
        bucket = (v >> np.uint64(self.low_bits)).astype(np.int64)
        ask = np.flatnonzero(bucket <= int(self.get(np.array([self.n - 1]))[0]) >> self.low_bits)
        bucket, part = bucket[ask], v[ask] & np.uint64((1 << self.low_bits) - 1)
        # elements before a bucket stand before the zero that opens it
        if len(ask) * 8 > self.n:
            zero = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == 0)
            begin = np.concatenate([[0], zero - np.arange(len(zero))])
            at, end = begin[bucket], begin[bucket + 1]
        else:
            at = np.where(bucket > 0, _select(~self.high, self.zeros, np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
            end = _select(~self.high, self.zeros, bucket) - bucket
        # the low parts of a bucket rise, and may be many where keys lie close together
        low, high, todo = at.copy(), end.copy(), np.flatnonzero(at < end)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = self._low(middle) < part[todo]
            low[todo[less]], high[todo[~less]] = middle[less] + 1, middle[~less]
            todo = todo[low[todo] < high[todo]]
        there = np.flatnonzero(low < end)
        there = there[self._low(low[there]) == part[there]]
        out[ask[there]] = low[there]
        return out


def write_level(path_folder: str, name: str, sequences: dict[str, np.ndarray], plain: dict[str, np.ndarray]) -> str:
    """Write sequences (monotone) and plain arrays to one file; returns its path."""
    head: dict = {"sequences": {}, "plain": {}}
    blobs, at = [], 0

    def put(a: np.ndarray) -> list:
        nonlocal at
        spot = [a.dtype.str, at, len(a)]
        raw = a.tobytes()
        raw += b"\0" * (-len(raw) % 8)
        blobs.append(raw)
        at += len(raw)
        return spot

    for k, v in sequences.items():
        meta, arrays = EliasFano.arrays(v)
        head["sequences"][k] = meta | {"arrays": [put(a) for a in arrays]}
    for k, v in plain.items():
        head["plain"][k] = put(v)
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 8) % 8)
    fs, root = filesystem(path_folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
        f.write(len(top).to_bytes(8, "little") + top)
        for b in blobs:
            f.write(b)
    return f"{path_folder.rstrip('/')}/{name}"


def read_level(path: str) -> tuple[dict[str, EliasFano], dict[str, np.ndarray]]:
    """A level mapped into memory; of a store that has no local path it is read into memory, never copied to a disk."""
    fs, local = filesystem(path)
    if fs.type_name == "local":
        raw = np.memmap(local, np.uint8, "r")
    else:
        with fs.open_input_file(local) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    base = 8 + size
    take = lambda kind, at, n: np.ndarray(n, np.dtype(kind), raw, base + at)
    return {k: EliasFano(m["n"], m["low_bits"], *(take(*a) for a in m["arrays"])) for k, m in head["sequences"].items()}, {k: take(*a) for k, a in head["plain"].items()}


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities."""
    return np.clip(np.rint(np.log10(np.maximum(p, 1e-300)) / LOWEST * STEPS), 0, STEPS).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    """Probabilities of codes, 0 of ABSENT."""
    return np.where(code == ABSENT, 0.0, 10.0 ** (code.astype(float) / STEPS * LOWEST))
