"""Token ids of whole texts by a byte-level BPE file of the tokenizers library, fast and exact.

The library spends most of its time on splitting, not on merging, so pieces of texts are encoded once and kept.
The pre-tokenizer always cuts before a space or newline that stands alone between other characters. A text whose
white space is of that kind only is cut there into pieces, each with its leading separator; the ids of the text are
those of its pieces in turn. Any other text is encoded in one go. Strings of special tokens count as ordinary text.

Pieces are found, hashed and looked up with numpy over the bytes of a whole Arrow batch. A piece is known by 96
bits of two polynomial hashes of its bytes with different bases, and its length.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import held

_SPACE, _NEWLINE = 32, 10
#: Bytes of text handled at once.
CHUNK = 1 << 19
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _spaces_beyond(buf: np.ndarray) -> np.ndarray:
    """Positions of white space other than the space and the newline (its first byte, in UTF-8), and of \\x1c-\\x1f."""
    out = [np.flatnonzero(((buf >= 9) & (buf <= 13) & (buf != 10)) | ((buf >= 0x1C) & (buf <= 0x1F)))]
    at = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    if len(at):
        at = at[at + 2 < len(buf)] if at[-1] + 2 >= len(buf) else at
        a, b, c = buf[at], buf[at + 1], buf[at + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        three |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        out.append(at[two | three])
    return np.concatenate(out)


class Encoder:
    """Encodes batches of texts. bits: 2 ** bits slots for known pieces; at half of them, all are forgotten."""

    def __init__(self, path: str, bits: int = 21):
        if CHUNK // 2 > 1 << (bits - 1):
            raise ValueError("half of the slots must hold the pieces of a chunk")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: the vocabulary writes a byte as one character
        for token, i in vocab.items():
            self.lengths[i] = len(token)
        self.kind = np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32
        n = CHUNK + 8
        self.pows = [_powers(b, n) for b in _BASES]
        self.inverses = [_powers(np.uint64(pow(int(b), -1, 1 << 64)), n) for b in _BASES]
        self.bits = bits
        self._forget()

    def _forget(self) -> None:
        n = 1 << self.bits
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
        self.at, self.n = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.ids, self.used, self.known = np.zeros(1 << 20, self.kind), 0, 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each encoded in one go."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Slots of pieces, -1 for unknown ones."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = key >> np.uint64(64 - self.bits)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            s = slot[left]
            there = self.key[s]
            hit = (there == key[left]) & (self.check[s] == check[left])
            out[left[hit]] = s[hit]
            left = left[~hit & (there != 0)]
            slot[left] = (slot[left] + np.uint64(1)) & mask
        return out

    def _store(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        mask = np.uint64((1 << self.bits) - 1)
        slot = key >> np.uint64(64 - self.bits)
        left = np.arange(len(key))
        while len(left):
            s = slot[left]
            free = self.key[s] == 0
            self.key[s[free]] = key[left[free]]
            won = free & (self.key[s] == key[left])
            w, s = left[won], s[won]
            self.check[s], self.at[s], self.n[s] = check[w], at[w], n[w]
            left = left[~won]
            slot[left] = (slot[left] + np.uint64(1)) & mask
        self.known += len(key)

    def _encode_pieces(self, pieces: list[bytes], lone: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and the number of each. After the first `lone`, each begins with a separator; those are encoded in runs, cut by byte lengths."""
        ids = self.whole([p.decode() for p in pieces[:lone]])
        counts = [np.array([len(x) for x in ids], np.int64)]
        for a in range(lone, len(pieces), 8192):
            run = pieces[a : a + 8192]
            own = self.whole([b"".join(run).decode()])[0]
            ends, reached = np.cumsum([len(p) for p in run]), np.cumsum(self.lengths[own])
            cut = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and (reached[cut] == ends).all():
                ids.append(own)
                counts.append(np.diff(cut, prepend=-1))
            else:
                each = self.whole([p.decode() for p in run])
                ids += each
                counts.append(np.array([len(x) for x in each], np.int64))
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.concatenate(counts)

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in buf (of at most CHUNK bytes), and the number of each. offsets: start of each text, and the end."""
        n_texts = len(offsets) - 1
        counts = np.zeros(n_texts, np.int64)
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        if not len(full):
            return np.zeros(0, np.uint32), counts
        begin, end = offsets[:-1][full], offsets[1:][full]
        separator = (buf == _SPACE) | (buf == _NEWLINE)
        mark = separator.copy()
        mark[begin] = True
        starts = np.flatnonzero(mark)
        # texts with other white space than lone separators
        odd = np.zeros(len(full), bool)
        odd |= separator[begin] | separator[end - 1]
        twice = np.flatnonzero(separator[1:] & separator[:-1])
        for at in (twice, _spaces_beyond(buf)):
            if len(at):
                odd[np.searchsorted(begin, at, "right") - 1] = True
        ends = np.append(starts[1:], end[-1])
        hashes = []
        for pows, inverses in zip(self.pows, self.inverses, strict=True):
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pows[: len(buf)], out=total[1:])
            hashes.append((total[ends] - total[starts]) * inverses[starts])
        lengths = (ends - starts).astype(np.uint64)
        check = (hashes[1] >> np.uint64(32)).astype(np.uint32)
        key = hashes[0] ^ (lengths * _ODD)
        key = (key ^ (key >> np.uint64(31))) * _ODD
        key ^= key >> np.uint64(29)
        key *= _BASES[0]
        key |= np.uint64(1)
        slot = self._slots(key, check)
        new = np.flatnonzero(slot < 0)
        if len(new):
            _, first = np.unique(key[new], return_index=True)
            new = new[first]
            if self.known + len(new) > 1 << (self.bits - 1):
                self._forget()
                new = np.unique(key, return_index=True)[1]
            alone = ~separator[starts[new]]
            new = np.concatenate([new[alone], new[~alone]])
            raw = buf.tobytes()
            pieces = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            ids, n = self._encode_pieces(pieces, int(alone.sum()))
            at = self.used + np.cumsum(n) - n
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(ids)), self.kind)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self._store(key[new], check[new], at, n)
            slot = self._slots(key, check)
        clash = slot < 0  # equal first hashes of different pieces: their texts are encoded in one go
        text_of = np.searchsorted(begin, starts, "right") - 1
        odd[text_of[clash]] = True
        n = np.where(clash, 0, self.n[slot]).astype(np.int64)
        before = np.cumsum(n) - n
        ids = self.ids[np.repeat(self.at[slot].astype(np.int64) - before, n) + np.arange(int(n.sum()))].astype(np.uint32)
        first = np.searchsorted(starts, begin)
        counts[full] = np.add.reduceat(n, first)
        if odd.any():
            parts = np.split(ids, np.cumsum(counts[full])[:-1])
            which = np.flatnonzero(odd)
            raw = buf.tobytes()
            for i, own in zip(which.tolist(), self.whole([raw[begin[i] : end[i]].decode() for i in which.tolist()]), strict=True):
                parts[i] = own
                counts[full[i]] = len(own)
            ids = np.concatenate(parts)
        return ids, counts

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each; a null is an empty text."""
        arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        arr = arr.cast(pa.large_string()).fill_null("")
        if not len(arr):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, off, data = arr.buffers()
        offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ids, counts, i = [], [], 0
        while i < len(arr):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            a, b = int(offsets[i]), int(offsets[j])
            if b - a > CHUNK:
                own = self.whole([buf[a:b].tobytes().decode()])[0]
                got = own, np.array([len(own)], np.int64)
            else:
                got = self._chunk(buf[a:b], offsets[i : j + 1] - a)
            ids.append(got[0])
            counts.append(got[1])
            i = j
        return np.concatenate(ids), np.concatenate(counts)


def encoder(path: str) -> Encoder:
    """The encoder of this process for a file."""
    return held(f"encoder {path}", lambda: Encoder(path))


def default_path() -> str:
    """The public byte-level BPE vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
