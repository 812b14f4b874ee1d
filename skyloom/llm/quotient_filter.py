"""A counting quotient filter, laid out canonically: one run per quotient, remainders ascending."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class CountingQuotientFilter:
    """The top `quotient_bits` of a `width`-bit fingerprint pick a run, the other bits are the remainder kept in it with a count.

    Remainders are whole, so two filters of the same geometry merge without loss by merging their sorted runs.
    """

    def __init__(self, width: int, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.width, self.quotient_bits, self.runs, self.remainders, self.counts = width, quotient_bits, runs, remainders, counts

    @classmethod
    def of(cls, quotient_bits: int, fingerprints: np.ndarray, counts: np.ndarray | None = None, width: int = 64) -> CountingQuotientFilter:
        fingerprints = fingerprints.astype(np.uint64)
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")  # quotient first, then remainder
        fingerprints, counts = fingerprints[order], counts[order]
        first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]]) if len(fingerprints) else np.empty(0, np.int64)
        fingerprints = fingerprints[first]
        counts = np.add.reduceat(counts, first) if len(first) else counts
        shift = np.uint64(width - quotient_bits)
        runs = np.bincount((fingerprints >> shift).astype(np.int64), minlength=1 << quotient_bits).astype(np.uint32)
        return cls(width, quotient_bits, runs, fingerprints & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        return (quotients << np.uint64(self.width - self.quotient_bits)) | self.remainders

    @classmethod
    def merged(cls, parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        return cls.of(parts[0].quotient_bits, np.concatenate([p.fingerprints() for p in parts]), np.concatenate([p.counts for p in parts]), parts[0].width)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints counted more than once, and their counts."""
        many = self.counts > 1
        return self.fingerprints()[many], self.counts[many]

    def blocks(self, block_bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Each block of neighbouring quotients that holds anything, as a filter of the fingerprints' other bits."""
        per_block = self.runs.reshape(1 << block_bits, -1)
        sizes = per_block.sum(axis=1)
        ends = np.cumsum(sizes)
        for block in np.flatnonzero(sizes):
            own = slice(ends[block] - sizes[block], ends[block])
            yield int(block), CountingQuotientFilter(self.width - block_bits, self.quotient_bits - block_bits, per_block[block],
                self.remainders[own], self.counts[own])
