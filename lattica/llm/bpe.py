"""Byte-level BPE over a bounded table of chunks that recur in a worker.

A pre-token of this vocabulary never continues from a non-blank character to a
blank one, so a text can be cut before each blank run, and each distinct chunk
is encoded by the tokenizers library once for as long as the table holds it.
Texts with other white space, or with the vocabulary's special strings, are
encoded whole.

Chunks are cut and looked up as bytes, all of a call together: one of up to 16
bytes is two numbers, which are its whole key in a table of open addresses.
Longer ones, and those that hold a zero byte, are looked up in a dictionary.
"""

from __future__ import annotations

import re

import numpy as np

#: Chunks are cut before runs of these four; a text with any other white space goes whole.
BLANK = np.isin(np.arange(256), list(b" \n\t\r"))
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Bytes of a chunk that the table holds itself, and which of eight bytes are a chunk's own.
SHORT = 16
OWN = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def is_short(chunk: bytes) -> bool:
    return len(chunk) <= SHORT and b"\0" not in chunk


class ChunkTable:
    """Numbers of short chunks, by their two words of bytes; open addresses, at most half of them taken."""

    def __init__(self):
        self.first, self.second = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.entry = np.full(1 << 16, -1, np.int32)
        self.taken = 0

    def _place(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = first * MIX[0] ^ second * MIX[1]
        mixed = (mixed ^ mixed >> np.uint64(32)) * MIX[0]
        return (mixed >> np.uint64(65 - len(self.entry).bit_length())).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each, -1 where there is none."""
        place = self._place(first, second)
        out = self.entry[place].astype(np.int64)
        rest = np.flatnonzero(((self.first[place] != first) | (self.second[place] != second)) & (out >= 0))
        while len(rest):
            place[rest] = at = (place[rest] + 1) & (len(self.entry) - 1)
            out[rest] = self.entry[at]
            rest = rest[((self.first[at] != first[rest]) | (self.second[at] != second[rest])) & (out[rest] >= 0)]
        return out

    def add(self, first: np.ndarray, second: np.ndarray, entry: np.ndarray) -> None:
        """Distinct chunks that the table lacks."""
        if 2 * (self.taken + len(entry)) > len(self.entry):
            held = np.flatnonzero(self.entry >= 0)
            first, second = np.concatenate([self.first[held], first]), np.concatenate([self.second[held], second])
            entry = np.concatenate([self.entry[held], entry])
            size = 1 << (2 * len(entry)).bit_length()
            self.first, self.second, self.entry, self.taken = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
        self.taken += len(entry)
        place, rest = self._place(first, second), np.arange(len(entry))
        while len(rest):
            at = place[rest]
            free = rest[self.entry[at] < 0]
            self.entry[place[free]] = entry[free]  # one of those at a place stays
            won = free[self.entry[place[free]] == entry[free]]
            self.first[place[won]], self.second[place[won]] = first[won], second[won]
            lost = np.ones(len(entry), bool)
            lost[won] = False
            rest = rest[lost[rest]]
            place[rest] = (place[rest] + 1) & (len(self.entry) - 1)


def words_of(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two words of short chunks."""
    words = np.array(chunks, f"S{SHORT}").view("<u8").reshape(-1, 2)
    return words[:, 0].copy(), words[:, 1].copy()


class ChunkEncoder:
    """Encodes texts to flat arrays of ids. ``limit``: chunks that the table keeps.

    ``plain``: the vocabulary's special strings are ordinary text where a text has them.
    """

    def __init__(self, path: str, plain: bool = False, limit: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        special = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.has_special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))  # a character of its pieces is a byte
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.table, self.long = ChunkTable(), {}
        self.offset = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.count = self.used = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The new entries of chunks with these ids; they are not looked up before ``_store``."""
        n, first = len(counts), self.count
        while first + n > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * len(self.offset)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[first : first + n] = counts
        self.offset[first : first + n] = self.used + np.cumsum(counts) - counts
        self.used, self.count = self.used + len(ids), first + n
        return np.arange(first, first + n)

    def _store(self, chunks: list[bytes], entries: np.ndarray) -> None:
        short = np.fromiter(map(is_short, chunks), bool, len(chunks))
        self.table.add(*words_of([c for c, x in zip(chunks, short) if x]), entries[short])
        self.long.update((c, e) for c, e, x in zip(chunks, entries.tolist(), short) if not x)

    def _entries(self, chunks: list[bytes]) -> np.ndarray:
        """The entry of each chunk, -1 where there is none."""
        short = np.fromiter(map(is_short, chunks), bool, len(chunks))
        out = np.empty(len(chunks), np.int64)
        out[short] = self.table.find(*words_of([c for c, x in zip(chunks, short) if x]))
        out[~short] = [self.long.get(c, -1) for c, x in zip(chunks, short) if not x]
        return out

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """Encodes chunks that the table lacks, each apart from the others; their new entries."""
        entries = [np.zeros(0, np.int64)]
        for at in range(0, len(chunks), 20_000):
            part = chunks[at : at + 20_000]
            done = self.tokenizer.encode_batch_fast([[c.decode() for c in part]], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(done.ids, np.uint32)
            # an id stands for so many bytes of the text, so the chunks' bytes tell where each one's ids end
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(list(map(len, part))), "right")
            entries.append(self._add(ids, np.diff(ends, prepend=0)))
        return np.concatenate(entries)

    def _learn_missing(self, missing: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """New chunks, first ``missing``, and their entries.

        A letter before a last full stop or comma ends a pre-token: such chunks are put together from two.
        """
        ends = [c[-1:] in (b".", b",") and len(c) > 1 and c.decode()[-2].isalpha() for c in missing]
        joined, alone = [c for c, x in zip(missing, ends) if x], [c for c, x in zip(missing, ends) if not x]
        needed = list(dict.fromkeys([*(c[:-1] for c in joined), *([b".", b","] if joined else [])]))
        place = dict(zip(needed, self._entries(needed).tolist()))
        fresh = list(dict.fromkeys([*alone, *(c for c, e in place.items() if e < 0)]))
        learned = self._learn(fresh)
        place.update(zip(fresh, learned.tolist()))
        pairs = np.array([(place[c[:-1]], place[c[-1:]]) for c in joined], np.int64).reshape(-1, 2)
        place.update(zip(joined, self._add(self.gather(pairs.ravel()), self.length[pairs].sum(1)).tolist()))
        new = list(dict.fromkeys([*missing, *fresh]))
        return new, np.fromiter(map(place.__getitem__, new), np.int64, len(new))

    def gather(self, index: np.ndarray) -> np.ndarray:
        """The ids of these entries of the table, one after the other."""
        counts = self.length[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.offset[index] - (ends - counts), counts) + np.arange(total)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        raw, whole = [], {}
        for i, text in enumerate(texts):
            if OTHER_SPACE.search(text) or self.has_special(text):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                raw.append(b"")
            else:
                raw.append(text.encode())
        data = b"".join(raw)
        size = len(data)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        del raw
        # a chunk begins with a text, and where blanks follow what is not blank
        eights = np.frombuffer(data + bytes(32 - size % 8), "<u8")
        blank = BLANK[eights.view(np.uint8)[:size]]
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        firsts = np.concatenate([[0], ends])
        begins[firsts[firsts < size]] = True
        starts = np.flatnonzero(begins)
        lengths = np.diff(starts, append=size)
        bounds = np.searchsorted(starts, firsts)
        # sixteen bytes from each start, of three aligned words, cut to the chunk's own
        at, low = starts >> 3, (starts & 7).astype(np.uint64) << np.uint64(3)
        high, one = np.uint64(63) - low, np.uint64(1)
        middle = eights[at + 1]
        first = (eights[at] >> low | middle << one << high) & OWN[np.minimum(lengths, 8)]
        second = (middle >> low | eights[at + 2] << one << high) & OWN[np.clip(lengths - 8, 0, 8)]
        entry = self.table.find(first, second)
        odd = lengths > SHORT
        if b"\0" in data:
            odd[np.searchsorted(starts, np.flatnonzero(eights.view(np.uint8)[:size] == 0), "right") - 1] = True
        for i in np.flatnonzero(odd).tolist():
            entry[i] = self.long.get(data[starts[i] : starts[i] + lengths[i]], -1)
        before, used = self.count, self.used
        if len(absent := np.flatnonzero(entry < 0)):
            pieces = [data[a : a + n] for a, n in zip(starts[absent].tolist(), lengths[absent].tolist())]
            if before > self.limit and len(absent) > len(starts) // 5:  # another kind of text has begun
                self.clear()
                return self.encode(texts)
            missing = list(dict.fromkeys(pieces))
            new, entries = self._learn_missing(missing)
            place = dict(zip(missing, entries.tolist()))
            entry[absent] = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
            if before <= self.limit:
                self._store(new, entries)
        ids = self.gather(entry)
        bounds = np.concatenate([[0], np.cumsum(self.length[entry])])[bounds]
        if before > self.limit:  # the table is full: what this call added goes again
            self.count, self.used = before, used
        counts = np.diff(bounds)
        if not whole:
            return ids, counts
        parts = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, plain: bool = False) -> ChunkEncoder:
    """This process's encoder of the vocabulary at ``path``."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = ChunkEncoder(path, plain)
    return _ENCODERS[path, plain]
