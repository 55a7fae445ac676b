"""Bounded memos of encoded chunks, for byte-level tokenizers that split text at spaces.

Under the usual pattern a space that is followed by a visible character begins a piece, and white space before it ends
one.  So a text with single spaces only can be cut at each of them, and every chunk encodes alone as it does in place.
``ChunkMemo`` cuts there, and texts with other runs of white space go to the encoder whole; ``ArrowMemo`` cuts the bytes
of many texts at once, wherever both sides encode alone as they do in place, and so leaves no text whole for its spaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]").search
#: Chunks longer than this are not kept beyond their batch; bytes of each of a memo's two generations, and of an entry beside its texts.
LONG, MEMO_BYTES, ENTRY_BYTES = 64, 32 << 20, 140


class ChunkMemo:
    """whole: strings of which a text is not cut, as special tokens; size: bytes a generation may hold, about."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int = MEMO_BYTES, whole: tuple[str, ...] = ()):
        self.encode_many, self.size, self.uncut = encode, size, whole
        self.forget()

    def forget(self) -> None:
        # two generations: what a full memo held is kept, and moves on when it is met again
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, chunk: str, encoded: bytes) -> None:
        if self.held >= self.size:
            self.old, self.memo, self.held = self.memo, {}, 0
        self.memo[chunk] = encoded
        self.held += ENTRY_BYTES + len(chunk) + len(encoded)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The encoded bytes of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        whole, chunks = [], {}
        for i, t in enumerate(texts):
            if not t:
                continue
            if "  " in t or " \n" in t or t[-1] == " " or _ODD(t) or any(x in t for x in self.uncut):
                whole.append(i)
            else:
                chunks[i] = t.split(" ")
        heads = [c.pop(0) for c in chunks.values()]
        seen = set().union(*chunks.values())
        get, new = {}, []
        for c in seen:
            x = self.memo.get(c)
            if x is None:
                x = self.old.get(c)
                if x is None:
                    new.append(c)
                    continue
                self._keep(c, x)
            get[c] = x
        made = self.encode_many([texts[i] for i in whole] + heads)
        for i, x in zip(whole, made):
            out[i] = x
        for c, x in zip(new, self.encode_many([" " + c for c in new])):
            get[c] = x
            if len(c) <= LONG:
                self._keep(c, x)
        find = get.__getitem__  # the batch's own chunks only: a small table that stays in the processor's cache
        for (i, c), head in zip(chunks.items(), made[len(whole) :]):
            out[i] = head + b"".join(map(find, c))
        return out


def _kinds(**bits: tuple[int, list[int]]) -> bytes:
    """A table that turns each byte into the bits of the kinds it is of."""
    out = np.zeros(256, np.uint8)
    for bit, members in bits.values():
        out[members] |= bit
    return out.tobytes()


_WHITE, _LETTER, _SIGN, _SEEN, _LAST, _TWO, _LATIN = (1 << i for i in range(7))
_VISIBLE, _LETTERS = range(0x21, 0x7F), {*range(0x41, 0x5B), *range(0x61, 0x7B)}
_KINDS = _kinds(
    white=(_WHITE, [0x09, 0x0A, 0x0D, 0x20]),
    letter=(_LETTER, [*_LETTERS]),
    sign=(_SIGN, [*{*_VISIBLE} - _LETTERS - {*range(0x30, 0x3A)}]),
    # first bytes of characters of which none is white space, those of them that begin two bytes, and such last bytes
    seen=(_SEEN, [*_VISIBLE, *range(0xC3, 0xE0), *range(0xE4, 0xF5)]),
    two=(_TWO, [*range(0xC3, 0xE0)]),
    last=(_LAST, [*_VISIBLE, *{*range(0x80, 0xC0)} - {*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF}]),
    # second bytes of letters that begin with C3: no × and ÷
    latin=(_LATIN, [*{*range(0x80, 0xC0)} - {0x97, 0xB7}]),
)


def cuts(data: bytes, offs: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte of UTF-8 texts; offs: where each text begins, and the end of the last.

    A text is cut where white space follows what is none, behind a line feed that stands alone and before a visible
    character, and between a letter and a sign: no piece of the usual pattern lies across, and none looks across.
    """
    n, raw, kind = len(data), np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KINDS), np.uint8)
    edge, seen, letter = np.zeros(n + 1, bool), (kind & _LAST) > 0, (kind & _LETTER) > 0
    seen[1:] |= (kind[:-1] & _TWO) > 0
    letter[1:] |= (raw[:-1] == 0xC3) & (kind[1:] & _LATIN > 0)
    edge[1:n] = seen[:-1] & (kind[1:] & _WHITE > 0)
    edge[offs] = True
    alone = edge[:n] & (raw == 0x0A)
    edge[1:n] |= alone[:-1] & (kind[1:] & _SEEN > 0) | letter[:-1] & (kind[1:] & _SIGN > 0)
    return edge[:n]


class ArrowMemo(ChunkMemo):
    """A memo for texts as Arrow holds them; together: encodes chunks of one space at most, in front, and no other white
    space, where the encoder has a cheaper way than one by one; usual: whether the encoder has the usual pattern, without
    which texts stay whole."""

    plain = staticmethod(re.compile(r" ?\S+").fullmatch)

    def __init__(self, encode: Callable[[list[str]], list[bytes]], together: Callable[[list[str]], list[bytes]], size: int = MEMO_BYTES, whole: tuple[str, ...] = (), usual: bool = True):
        super().__init__(encode, size, whole)
        self.together, self.usual = together, usual

    def encode_slice(self, data: np.ndarray, offs: np.ndarray) -> tuple[memoryview, list[int]]:
        """The encoded bytes of all texts, and where those of each begin, with the end of the last."""
        flat = data.tobytes()
        if self.usual:
            edge = cuts(flat, offs)
        else:
            edge = np.zeros(len(flat), bool)
            edge[offs[:-1][offs[:-1] < offs[1:]]] = True
        for x in self.uncut:
            mark = x.encode()
            at = flat.find(mark)
            while at >= 0:
                i = int(np.searchsorted(offs, at, "right"))
                edge[offs[i - 1] + 1 : offs[i]] = False
                at = flat.find(mark, max(at + 1, int(offs[i]) - len(mark) + 1))
        starts = np.flatnonzero(edge)
        bounds = np.append(starts, len(data))
        chunks = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
        own = pa.array(self._encoded(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        ends = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1) if len(own) else np.zeros(1, np.int64)
        return memoryview(own.buffers()[2] or b""), ends[np.searchsorted(starts, offs)].tolist()

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The encoded bytes of each of some different chunks."""
        out = list(map(self.memo.get, chunks))
        plain, other = [], []
        for i, x in enumerate(out):
            if x is None:
                c = chunks[i]
                x = out[i] = self.old.get(c)
                if x is None:
                    (plain if self.usual and self.plain(c) else other).append(i)
                else:
                    self._keep(c, x)
        if any(u in c for c in ["\n".join([chunks[i] for i in plain])] for u in self.uncut):
            plain, other = [], other + plain
        for where, encode in ((plain, self.together), (other, self.encode_many)):
            for i, x in zip(where, encode([chunks[i] for i in where])):
                out[i] = x
                if len(chunks[i]) <= LONG:
                    self._keep(chunks[i], x)
        return out
