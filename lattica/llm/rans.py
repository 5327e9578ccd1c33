"""Range asymmetric numeral system over static tables, many lanes at a time.

A block of symbols is dealt to ``lanes`` coders in turn (symbol ``i`` to lane
``i % lanes``). Coder states lie in [2**31, 2**63); a coder that would leave
that range gives off, or takes in, one 32-bit word. The states at a block's
start are its checkpoint: with them and the block's words it is decoded apart
from all others.
"""

from __future__ import annotations

import numpy as np

LOW = np.uint64(1 << 31)
U32 = np.uint64(32)
#: Symbols of a full block, and of a lane of it.
BLOCK, STEPS = 1 << 21, 256


def table_bits(n_symbols: int) -> int:
    """Precision of a table: 16 slots a symbol on average, 12 bits at least."""
    return max(12, int(n_symbols - 1).bit_length() + 4) if n_symbols else 12


def normalised(counts: np.ndarray) -> np.ndarray:
    """Positive integer frequencies that add up to 2**table_bits."""
    total = 1 << table_bits(len(counts))
    freq = np.maximum(1, counts.astype(np.float64) / counts.sum() * total).astype(np.int64)
    freq[np.argmax(freq)] += max(0, total - int(freq.sum()))
    while (excess := int(freq.sum()) - total) > 0:
        top = np.argmax(freq)
        freq[top] -= min(excess, int(freq[top]) // 2)
    return freq.astype(np.uint32)


class Table:
    """Shared frequencies of a file: ``alphabet`` (sorted ids) and ``freq`` (one each)."""

    def __init__(self, alphabet: np.ndarray, freq: np.ndarray):
        self.alphabet, self.bits = alphabet.astype(np.uint32), table_bits(len(alphabet))
        self.freq = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot_symbol: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Table, np.ndarray]:
        """The table of these ids, and the ids as positions in its alphabet."""
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.uint32)
        place[alphabet] = np.arange(len(alphabet))
        return cls(alphabet, normalised(counts[alphabet]) if len(alphabet) else np.zeros(0, np.uint32)), place[ids]

    def encode(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states at the start, words) of one block."""
        n = len(symbols)
        lanes = -(-n // STEPS)
        freq, start = self.freq[symbols], self.start[symbols]
        limit = freq << np.uint64(63 - self.bits)
        bits, state, given = np.uint64(self.bits), np.full(lanes, LOW, np.uint64), []
        for at in range((n - 1) // lanes * lanes, -1, -lanes):
            f, x = freq[at : at + lanes], state[: min(lanes, n - at)]
            full = x >= limit[at : at + lanes]
            if full.any():
                given.append(x[full].astype(np.uint32))
                x = np.where(full, x >> U32, x)
            quotient = x // f
            state[: len(x)] = (quotient << bits) + (x - quotient * f) + start[at : at + lanes]
        return state, np.concatenate(given[::-1]) if given else np.zeros(0, np.uint32)

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The ``n`` ids of a block."""
        if self.slot_symbol is None:
            self.slot_symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        out, state, lanes, at_word = np.empty(n, np.uint32), states.astype(np.uint64), len(states), 0
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        words = words.astype(np.uint64)
        for at in range(0, n, lanes):
            x = state[: min(lanes, n - at)]
            slot = x & mask
            symbol = self.slot_symbol[slot]
            out[at : at + len(x)] = symbol
            x = self.freq[symbol] * (x >> bits) + slot - self.start[symbol]
            if n_short := np.count_nonzero(short := x < LOW):
                x[short] = (x[short] << U32) | words[at_word : at_word + n_short]
                at_word += n_short
            state[: len(x)] = x
        return self.alphabet[out]
