"""Token ids of whole texts by the `tokenizers` library, with a bounded table of encoded pieces.

A text is cut only where the tokenizer itself always cuts, so the pieces' ids, joined, are the whole
text's ids:

* ``byte_level``: before a lone space between two characters that are not white space. The pre-tokenizer
  attaches exactly that space to what follows, whatever the context. A lone line feed between two such
  characters is a piece of its own.
* ``words``: at ASCII spaces and line feeds, which this kind of vocabulary drops.

In both, the ASCII punctuation that ends a run of Latin letters is a piece of its own. A vocabulary's special
tokens are found in texts, as the library does by default; they hold no white space, so a piece has them whole (with a
vocabulary whose special tokens are matched in other ways, texts are not cut). Pieces are hashed with
NumPy and looked up all at once in a table of `SLOTS` places, where a new piece replaces the one in its place;
the tokenizer sees only the others. The table never grows, so neither does a worker's memory.

A call of the tokenizer costs more than a short piece, so with ``byte_level`` those go to it `GROUP` at a time, with the
same cuts between them as in a text. A token of such a vocabulary stands for as many bytes as its name has characters;
these tell which ids are whose. Where they don't meet the cuts, pieces are encoded one by one.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from docloom.llm import hashing

#: Places of the table (a power of two), and the most ids that a piece in it has.
SLOTS, IDS = 1 << 21, 8
#: Pieces that the tokenizer takes as one text, and the most bytes of each.
GROUP, SHORT = 128, 64
U = np.uint64
#: A byte that UTF-8 never has, between texts.
_TEXT_BYTE = b"\xfe"
#: White space, as bytes and as the longer UTF-8 sequences; the end of a text counts as such.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33), 0xFE]] = True
_WHITE_2 = np.array([0xC285, 0xC2A0])
_WHITE_3 = np.array([0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?%&$#*")] = True
#: Bytes of ASCII letters and of the Latin letters from U+00C0 to U+023F.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = True
_loaded: dict[tuple[str, str], Encoder] = {}


def _white_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is white space."""
    out = _WHITE[data[at]]
    i = np.flatnonzero(np.isin(data[at], (0xC2, 0xE1, 0xE2, 0xE3)))
    if len(i):
        pair = data[at[i]].astype(np.int64) << 8 | data[at[i] + 1]
        out[i] = np.isin(pair, _WHITE_2) | np.isin(pair << 8 | data[at[i] + 2], _WHITE_3)
    return out


def _white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space."""
    out = _WHITE[data[at - 1]]
    i = np.flatnonzero((data[at - 1] & 0xC0) == 0x80)
    if len(i):
        pair = data[at[i] - 2].astype(np.int64) << 8 | data[at[i] - 1]
        out[i] = np.isin(pair, _WHITE_2) | np.isin(data[at[i] - 3].astype(np.int64) << 16 | pair, _WHITE_3)
    return out


class Encoder:
    def __init__(self, path: str, mode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if mode not in ("byte_level", "words"):
            raise ValueError(f"unknown mode {mode}")
        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in special]
        # for pieces in which no special token stands: it need not look for any
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.cuts = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s|[A-Za-z][.,;:!?%&$#*]+$", t.content) for t in special)
        self.mode = mode
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)  # bytes of each id
        self.width[np.fromiter(vocabulary.values(), np.int64, len(vocabulary))] = [len(x) for x in vocabulary]
        self.keys = np.zeros(SLOTS, np.uint64)
        self.n = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, IDS), np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def pieces(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, none of them empty, and whether the space before belongs to each."""
        drop, head = data == 0xFE, np.zeros(len(data) + 1, bool)
        if self.cuts and self.mode == "words":
            drop |= (data == 32) | (data == 10)
        elif self.cuts:
            at = np.flatnonzero((data == 32) | (data == 10))
            at = at[~(_white_before(data, at) | _white_at(data, at + 1))]
            line = data[at] == 10
            drop[at[~line]] = True
            head[at[line]] = head[at[line] + 1] = True
        head[1:] |= drop
        start = np.flatnonzero(head[:-1])
        after = np.append(start[1:], len(data))
        end = after - drop[after - 1]
        keep = end > start
        start, end = start[keep], end[keep]
        # the punctuation at a piece's end, after letters only; not a long run of it
        own = np.flatnonzero(_PUNCTUATION[data[end - 1]])
        mid = end[own] - 1
        for _ in range(16):
            back = _PUNCTUATION[data[mid - 1]] & (mid > start[own])
            if not back.any():
                break
            mid -= back
        odd = ~_LETTER[data]
        times = data[:-1] == 0xC3
        odd[:-1] |= times & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # signs among the letters
        count = np.concatenate(([0], np.cumsum(odd, dtype=np.int32)))
        mid = mid[(mid > start[own]) & (count[mid] == count[start[own]])]
        if len(mid):
            to = np.searchsorted(start, mid)
            start, end = np.insert(start, to, mid), np.insert(end, to - 1, mid)
        spaced = drop[start - 1] & (data[start - 1] == 32) if self.mode == "byte_level" else np.zeros(len(start), bool)
        return start, end, spaced

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        at = [i for i, t in enumerate(texts) if any(x in t for x in self.special)] if self.cuts else [*range(len(texts))]
        ids = [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        for i, e in zip(at, self.tokenizer.encode_batch_fast([texts[i] for i in at], add_special_tokens=False)):
            ids[i] = e.ids
        n = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """As `whole`, of parts that are a space or a line feed, which has no part in the ids, and what follows it to
        the next; None where ids don't end with the parts.
        """
        texts = [b"".join(parts[i : i + GROUP]).decode() for i in range(0, len(parts), GROUP)]
        if any(x in t for t in texts for x in self.special):
            return None
        got = [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), np.uint32)
        upto = np.concatenate(([0], np.cumsum(self.width[ids])))
        edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        at = np.searchsorted(upto, edge)
        line = at[:-1][np.fromiter((x[0] == 10 for x in parts), bool, len(parts))]
        if upto[-1] != edge[-1] or (upto[at] != edge).any() or (self.width[ids[line]] != 1).any():
            return None
        n = np.diff(at)
        n[np.searchsorted(at, line)] -= 1
        return np.delete(ids, line), n

    def fresh(self, blob: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces from the tokenizer, where each piece's begin, and how many it has."""
        at, n, flat, held = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), [np.zeros(0, np.uint32)], 0
        joined = np.zeros(len(start), bool)
        if self.cuts and self.mode == "byte_level":
            joined = (end - start <= SHORT) & ~_white_at(data, start) & ~_white_before(data, end)
        for rows, apart in ((np.flatnonzero(joined), False), (np.flatnonzero(~joined), True)):
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                places = [*zip(start[part].tolist(), end[part].tolist(), spaced[part].tolist())]
                got = None if apart else self.together([blob[a - 1 : b] if s else b"\n" + blob[a:b] for a, b, s in places])
                ids, n[part] = got or self.whole([blob[a - s : b].decode() for a, b, s in places])
                at[part] = held + np.cumsum(n[part]) - n[part]
                held += len(ids)
                flat.append(ids)
        return np.concatenate(flat), at, n

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null counts as empty."""
        made = [(t or "").encode() for t in texts]
        blob = _TEXT_BYTE.join((b"", *made, b""))
        data = np.frombuffer(blob, np.uint8)
        begin = np.cumsum([1] + [len(x) + 1 for x in made])
        start, end, spaced = self.pieces(data)
        if not len(start):
            return [b""] * len(texts)
        tag, place = (hashing.span_hashes(data, start, end, table) for table in (hashing.BYTE, hashing.BYTE_2))
        tag = (tag ^ spaced.astype(np.uint64)) | U(1 << 63)  # zero is an empty place
        place = ((place + spaced.astype(np.uint64)) & U(SLOTS - 1)).astype(np.int64)
        known = self.keys[place] == tag
        length = self.n[place].astype(np.int64)
        held = self.ids.ravel()[_ranges(place[known] * IDS, length[known])]
        new = np.flatnonzero(~known)
        _, first, which = np.unique(tag[new], return_index=True, return_inverse=True)
        first = new[first]
        ids, at, n = self.fresh(blob, data, start[first], end[first], spaced[first])
        length[new] = n[which]
        out = np.empty(int(length.sum()), np.uint32)
        from_table = np.repeat(known, length)
        out[from_table] = held
        out[~from_table] = ids[_ranges(at[which], n[which])]
        short = np.flatnonzero(n <= IDS)
        _, one = np.unique(place[first[short]], return_index=True)
        short = short[one]
        values = np.zeros((len(short), IDS), self.ids.dtype)
        values[np.arange(IDS) < n[short][:, None]] = ids[_ranges(at[short], n[short])]
        to = place[first[short]]
        self.keys[to], self.n[to], self.ids[to] = tag[first[short]], n[short], values
        upto = np.concatenate(([0], np.cumsum(length)))
        edge = upto[np.searchsorted(start, begin)].tolist()
        return [out[a:b].tobytes() for a, b in zip(edge, edge[1:])]


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges at .. at + n one after another."""
    return np.arange(int(n.sum())) + np.repeat(at - (np.cumsum(n) - n), n)


def release() -> None:
    """Gives back what this worker holds."""
    _loaded.clear()


def encoder(path: str, mode: str) -> Encoder:
    """The worker's own encoder for this file; it outlives the task."""
    if (path, mode) not in _loaded:
        _loaded[path, mode] = Encoder(path, mode)
    return _loaded[path, mode]
