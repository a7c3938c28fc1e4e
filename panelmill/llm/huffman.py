"""Canonical length-limited Huffman codes over token ids, and their bits in blocks.

Code lengths are all that needs to be kept: codes of one length go up with the id. A block of bits starts a checkpoint every
STRIDE ids, so that its strides are decoded side by side, one table look-up per id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

LONGEST = 18  # bits of a code; 2**LONGEST entries of the decoding table
STRIDE = 128  # ids between checkpoints


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each id's code (0: the id does not occur), the least in sum among codes of at most ``longest`` bits.

    Package-merge: on each of ``longest`` levels the ids by weight are merged with pairs of the level before. Of the last
    level 2n - 2 items are taken, and what they are made of on each level before; the ids among them are the lightest
    ones, so a count per level says how long each code is.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} ids need codes of over {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    items, levels = weights, []
    for _ in range(longest):
        levels.append(items)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        items = np.sort(np.concatenate([weights, pairs]), kind="stable")
    take = 2 * n - 2
    for i in reversed(range(longest)):
        if i == 0:
            singles = take
        else:
            below = levels[i - 1]
            pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
            # in the merged order an id comes before a pair of the same weight
            place = np.searchsorted(pairs, weights, side="left") + np.arange(n)
            singles = int(np.searchsorted(place, take, side="left"))
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


@dataclass(frozen=True)
class Code:
    lengths: np.ndarray  # by id

    @cached_property
    def longest(self) -> int:
        return int(self.lengths.max(initial=1))

    @cached_property
    def _ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids in code order, and their codes aligned to ``longest`` bits."""
        used = np.flatnonzero(self.lengths)
        ids = used[np.argsort(self.lengths[used], kind="stable")]
        room = np.int64(1) << (self.longest - self.lengths[ids].astype(np.int64))
        return ids, np.cumsum(room) - room

    @cached_property
    def codes(self) -> np.ndarray:
        ids, aligned = self._ordered
        codes = np.zeros(len(self.lengths), np.uint64)
        codes[ids] = aligned >> (self.longest - self.lengths[ids].astype(np.int64))
        return codes

    @cached_property
    def table(self) -> np.ndarray:
        """For every ``longest`` bits: the id they start with, times 32, plus its bits. Bits that start no code move on by one."""
        ids, _ = self._ordered
        room = np.int64(1) << (self.longest - self.lengths[ids].astype(np.int64))
        table = np.ones(1 << self.longest, np.uint32)
        known = np.repeat((ids.astype(np.uint32) << np.uint32(5)) | self.lengths[ids], room)
        table[: len(known)] = known
        return table

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, bytes]:
        """The bits of some ids, and the bits from each checkpoint to the next as two bytes each."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        start = ends - size
        total = int(ends[-1]) if len(ids) else 0
        if len(ids) and not size.all():
            raise ValueError("an id without a code")
        words = np.zeros(total // 32 + 2, np.uint64)
        at, shift = start >> 5, (np.int64(64) - size - (start & 31)).astype(np.uint64)
        placed = self.codes[ids] << shift
        # every word of 32 bits has a code that starts in it, up to the last
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        if len(firsts):
            words[: len(firsts)] += np.add.reduceat(placed >> np.uint64(32), firsts)
            words[1 : len(firsts) + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), firsts)
        bits = words.astype(">u4").tobytes()[: -(-total // 8)]
        marks = np.append(start[::stride], total)
        return bits, np.diff(marks).astype("<u2").tobytes()

    def decode(self, bits: bytes, steps: bytes, n: int, stride: int = STRIDE) -> np.ndarray:
        """The n ids of a block."""
        size = np.frombuffer(steps, "<u2").astype(np.int64)
        at = np.cumsum(size) - size
        out = np.empty((len(at), stride), np.uint32)
        strip = 2048  # strides whose bytes are widened at a time
        for a in range(0, len(at), strip):
            part = at[a : a + strip].copy()
            low, high = int(part[0]) >> 3, (int(part[-1]) + stride * self.longest >> 3) + 8
            there = np.frombuffer(bits[low:high], np.uint8)
            data = np.zeros(high - low, np.uint8)  # a last, shorter stride reads on behind its end, which is cut off below
            data[: len(there)] = there
            wide = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
            part -= 8 * low
            down = 32 - self.longest
            for t in range(stride):
                entry = self.table[(wide[part >> 3] << (part & 7).astype(np.uint32)) >> np.uint32(down)]
                out[a : a + strip, t] = entry >> np.uint32(5)
                part += entry & np.uint32(31)
        return out.reshape(-1)[:n]
