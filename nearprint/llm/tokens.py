"""Token ids by the tokenizers library, each stretch of text encoded once.

A text is cut where its tokenizer always starts a new piece: at white space and between a
letter and a sign.  What lies between cuts is encoded on its own and remembered by hash,
so that a stretch seen before costs a lookup.  ``WHITE`` says what becomes of white space:
``keep`` cuts before each run of it (byte-level tokenizers attach it to what follows),
``drop`` leaves it out.
"""

from __future__ import annotations

import os

import numpy as np

from nearprint.llm import codes

#: Stretches a worker remembers; beyond that it starts afresh.
REMEMBERED = 1_500_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
# Special tokens such as <|endoftext|> stay whole, and so do contractions ('s).
_SIGN[ord("|")] = False
_BEFORE = _SIGN.copy()
_BEFORE[ord("'")] = False


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def largest_id(path: str) -> int:
    """The largest id a tokenizer's file gives out, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


class Encoder:
    """Ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str, white: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.white = white
        self._forget()

    @staticmethod
    def of(path: str, white: str) -> Encoder:
        """One per worker process, which keeps what it has learnt between tasks."""
        state = codes.worker_state()
        if (path, white) not in state:
            state[path, white] = Encoder(path, white)
        return state[path, white]

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def cuts(self, buf: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the stretches, in order."""
        n = len(buf)
        space = codes.SPACE[buf]
        two = np.zeros(n, bool)  # second byte of a letter of two bytes (U+00C0-00FF)
        two[1:] = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        letter = _LETTER[buf] | two
        first = _LETTER[buf]
        first[:-1] |= two[1:]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = letter[:-1] & _SIGN[buf[1:]] | _BEFORE[buf[:-1]] & first[1:]
        if self.white == "drop":
            cut[1:n] |= space[:-1] != space[1:]
        else:
            # Before a run of white space, unless other Unicode white space may come before it.
            plain = ~space[:-1] & ((buf[:-1] < 0x80) & (buf[:-1] > 0x20) | two[:-1])
            cut[1:n] |= plain & space[1:]
        cut[places] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        if self.white == "drop":
            full = ~space[starts]
            starts, ends = starts[full], ends[full]
        return starts, ends

    def _learn(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.known) + len(hashes) > REMEMBERED:
            self._forget()
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))])
        order = np.argsort(np.concatenate([self.known, hashes]), kind="stable")
        self.known = np.concatenate([self.known, hashes])[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]

    def encode(self, buf: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block as one array, and where each text's begin (one entry more than texts)."""
        starts, ends = self.cuts(buf, places) if len(buf) else (np.zeros(0, np.int64),) * 2
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(places), np.int64)
        hashes = codes.spans_hash(codes.rolling(buf), starts, ends)
        distinct, some, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        slot = np.searchsorted(self.known, distinct)
        new = slot == len(self.known)
        new[~new] = self.known[slot[~new]] != distinct[~new]
        if new.any():
            self._learn(buf, starts[some[new]], ends[some[new]], distinct[new])
            slot = np.searchsorted(self.known, distinct)
        slot = slot[back]
        size, at = self.size[slot].astype(np.int64), self.at[slot]
        ends_at = np.cumsum(size)
        take = np.arange(int(ends_at[-1])) + np.repeat(at - (ends_at - size), size)
        first = np.searchsorted(starts, places)
        return self.ids[take], np.concatenate([[0], ends_at])[first]
