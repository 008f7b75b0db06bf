"""Byte-level BPE over many texts: vectorised pre-tokenisation, memoised encoding of pieces.

Byte-level BPE splits a text into pieces (words with a leading blank, numbers, punctuation, white
space) and encodes each on its own, so a piece always has the same ids. Pieces are found for many
texts at once with numpy; each distinct piece is encoded once a worker by the ``tokenizers``
library and kept in a direct-mapped table. Texts whose split can't be told by character class
alone (English contractions, the special token's string, code points beyond those checked) go to
the library whole, so the ids always equal the library's.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from . import buffers as B

#: The white space of Unicode below 0x3000, the letters that may follow the
#: apostrophe of a contraction, and the code points below which classes were checked.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]
CONTRACTION = "stmdrvl"
CHECKED = 0x3000
UNSTABLE = range(0x1C80, 0x1C90)

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.full(CHECKED + 1, OTHER, np.uint8)
    for c in range(CHECKED):
        kind = unicodedata.category(chr(c))
        table[c] = UNKNOWN if kind == "Cn" else kinds.get(kind[0], OTHER)
    table[WHITE] = SPACE
    table[list(UNSTABLE)] = UNKNOWN
    table[CHECKED] = UNKNOWN
    return table


class PieceEncoder:
    """Encodes texts with one tokenizer file; made once in each worker."""

    SLOTS = 1 << 22

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.values = B.mix(np.arange(1, CHECKED + 2, dtype=np.uint64) * B._ODD)
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def plain(self, text: str) -> bool:
        """Whether a text has neither a special token's string nor what may be a contraction."""
        at = text.find("'")
        while at >= 0:
            if text[at + 1 : at + 2] and text[at + 1] in CONTRACTION:
                return False
            at = text.find("'", at + 1)
        return not any(s in text for s in self.special)

    def split(self, code: np.ndarray, offs: np.ndarray):
        """(start, end) of the pieces of code points; the texts are [offs[i], offs[i+1])."""
        n = len(code)
        kind = self.classes[np.minimum(code, CHECKED)]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        new = edge[:n].copy()
        new[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        run = kind[start]
        # a run of white space gives its last character to what follows in the same text:
        # a blank joins the next piece, anything else is a piece of its own
        gives = (run == SPACE) & ~edge[end]
        last = end - 1
        blank = gives & (code[last] == 32)
        alone = gives & ~blank & (end - start > 1)
        start2 = start.copy()
        start2[1:] -= blank[:-1]
        end2 = end - (blank | alone)
        keep = end2 > start2
        extra = last[alone]
        s, e = np.concatenate([start2[keep], extra]), np.concatenate([end2[keep], extra + 1])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _known(self, hashes, start, end, text):
        """Slots' (at, size) of all pieces; unknown pieces are encoded first."""
        mask = B.U(self.SLOTS - 1)
        slot = (hashes & mask).astype(np.int64)
        found = self.key[slot] == hashes
        rest = np.flatnonzero(~found)
        if len(rest):  # each piece has a second place
            other = ((hashes[rest] >> B.U(40)) & mask).astype(np.int64)
            slot[rest] = other
            found[rest] = self.key[other] == hashes[rest]
        at, size = self.at[slot], self.size[slot]
        miss = np.flatnonzero(~found)
        if len(miss):
            _, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            which = miss[first]
            got = [e.ids for e in self.library.encode_batch([text[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())], add_special_tokens=False)]
            n = np.array([len(x) for x in got], np.int32)
            flat = np.fromiter((i for x in got for i in x), np.uint32, int(n.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(flat)] = flat
            where = self.used + np.cumsum(n) - n
            self.used += len(flat)
            at[miss], size[miss] = where[back].astype(np.int32), n[back]
            first = (hashes[which] & mask).astype(np.int64)
            place = np.where(self.key[first] == 0, first, slot[which])
            self.key[place], self.at[place], self.size[place] = hashes[which], where, n
        return at, size

    def encode(self, texts: list[str], ids: bool = True):
        """Yield for each text in order its ids (uint32), or with ids=False their number."""
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j]) <= B.CHUNK // 2):
                total += len(texts[j])
                j += 1
            yield from self._some(texts[i:j], ids)
            i = j
            if self.used > 1 << 24:
                self.forget()

    def _some(self, texts: list[str], ids: bool):
        text = "".join(texts)
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        strange = np.flatnonzero(self.classes[np.minimum(code, CHECKED)] == UNKNOWN)
        odd = set((np.searchsorted(offs, strange, side="right") - 1).tolist())
        odd |= {i for i, t in enumerate(texts) if ("'" in t or "<" in t) and not self.plain(t)}
        if len(code):
            start, end = self.split(code, offs)
            hashes = B.range_hash(B.prefix_hash(self.values[np.minimum(code, CHECKED)]), start, end)
            if odd:  # their pieces are not looked up
                bad = np.zeros(len(texts), bool)
                bad[list(odd)] = True
                keep = ~bad[np.searchsorted(offs, start, side="right") - 1]
                start, end, hashes = start[keep], end[keep], hashes[keep]
            at, size = self._known(hashes, start, end, text)
        else:
            start = at = size = np.zeros(0, np.int64)
        piece = np.searchsorted(start, offs)
        done = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        if ids and len(size):
            n = int(done[-1])
            flat = self.pool[np.repeat(at - done[:-1], size) + np.arange(n)]
        else:
            flat = np.zeros(0, np.uint32)
        for i, t in enumerate(texts):
            if i in odd:
                own = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                yield own if ids else len(own)
            else:
                a, b = int(done[piece[i]]), int(done[piece[i + 1]])
                yield flat[a:b] if ids else b - a


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
