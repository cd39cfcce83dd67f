"""Whole-text encoding by a public tokenizer, with a table of distinct pre-tokens.

A text is cut where the tokenizer itself always starts a new pre-token, so the
ids of a text are the ids of its pieces joined. Each distinct piece is given to
the library once; the ids are looked up afterwards. Places that are safe for
both vocabularies used here:

* before a space that an (extended) Latin character or ASCII sign follows, and
* around a line feed that stands between two such non-space characters.

Other white space, other scripts and special strings stay inside their piece
and are left to the library.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .common import kept, release

#: Distinct pieces kept by a worker; the table is emptied when it is full.
MAX_PIECES = 1_000_000
#: Longer pieces are encoded each time they occur.
MAX_PIECE_CHARS = 200

_CUT = re.compile(r" (?=[!-~¡-ʯ])")
_PLAIN = re.compile(r"[!-;=-~¡-ʯ]+")
_WORD_SIGN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?])")
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

_encoders: dict[tuple[str, str], "PieceEncoder"] = kept()


def encoder(name: str, path: str | None = None, max_pieces: int = MAX_PIECES) -> "PieceEncoder":
    """The worker's encoder for a vocabulary file, kept between tasks; what other stages kept goes."""
    import public_tokenizers

    release(_encoders)

    key = (name, path or public_tokenizers.path(name))
    if key not in _encoders:
        _encoders[key] = PieceEncoder(key[1])
    _encoders[key].max_pieces = max_pieces
    return _encoders[key]


class _Numbers(dict):
    """Piece -> its number; an unknown piece gets the next one and is noted."""

    def __init__(self, owner: "PieceEncoder", spaced: bool):
        super().__init__()
        self.owner, self.spaced = owner, spaced

    def __missing__(self, piece: str) -> int:
        own = self.owner
        number = self[piece] = own.known + len(own.pending)
        own.pending.append((self.spaced, piece))
        return number


class PieceEncoder:
    """Ids of texts through a table of distinct pieces.

    Pieces after a space and others are numbered together. The ids of piece
    ``k`` are ``pool[starts[k] : starts[k] + lengths[k]]``.
    """

    def __init__(self, path: str, max_pieces: int = MAX_PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.max_pieces = max_pieces
        # Stands between pieces in one call of the library: a line feed where
        # the vocabulary keeps white space, else a lone digit.
        self.keeps_space = bool(self._ids(["\n"])[0])
        self.separator = "\n" if self.keeps_space else " 0 "
        self.separator_ids = self._ids([self.separator])[0]
        self._start()

    def _start(self) -> None:
        """An empty table."""
        self.known = 0
        self.pending: list[tuple[bool, str]] = []
        self.bare, self.spaced = _Numbers(self, False), _Numbers(self, True)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.pool, self.filled = np.empty(1 << 16, np.uint32), 0
        self.line_feed = self.bare["\n"]
        self._learn()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    # -- cutting ---------------------------------------------------------

    @staticmethod
    def cut(text: str) -> list[list[str]]:
        """Lines of pieces: the first piece of a line follows no space, the others one.

        A text with other white space than single spaces and line feeds between
        words is one line, cut at safe spaces only.
        """
        lines = []
        for line in text.split("\n"):
            pieces = line.split(" ")
            if pieces != line.split():
                return [_CUT.split(text)]
            lines.append(pieces)
        return lines

    # -- filling the table -----------------------------------------------

    def _learn(self) -> None:
        """Encode the noted pieces, each once."""
        signed, joined, alone = [], [], []
        k = 0
        while k < len(self.pending):  # the list grows by the parts of signed words
            spaced, piece = self.pending[k]
            number = self.known + k
            if m := _WORD_SIGN.fullmatch(piece):
                signed.append((number, (self.spaced if spaced else self.bare)[m[1]], self.bare[m[2]]))
            else:
                plain = (_PLAIN if self.keeps_space else _WORD).fullmatch(piece)
                (joined if plain else alone).append((number, " " + piece if spaced else piece))
            k += 1
        self.known += len(self.pending)
        self.pending.clear()
        while self.known > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        for at in range(0, len(joined), 20_000):
            groups = [joined[i : i + 200] for i in range(at, min(at + 20_000, len(joined)), 200)]
            for own, ids in zip(groups, self._ids([self.separator.join([p for _, p in g]) for g in groups])):
                ids = np.array(ids, np.uint32)
                cuts = np.flatnonzero(ids == self.separator_ids[0])
                if len(cuts) + 1 != len(own):
                    alone.extend(own)
                    continue
                starts = np.concatenate([[0], cuts + 1])
                self._put(np.array([n for n, _ in own]), ids, starts, np.append(cuts, len(ids)) - starts)
        for at in range(0, len(alone), 2_000):
            part = alone[at : at + 2_000]
            found = self._ids([p for _, p in part])
            lengths = np.array(list(map(len, found)))
            self._put(np.array([n for n, _ in part]), np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum(lengths) - lengths, lengths)
        if signed:
            numbers, words, signs = np.array(signed).T
            ids, lengths = self._gather(np.stack([words, signs], axis=1).ravel())
            lengths = lengths.reshape(-1, 2).sum(axis=1)
            self._put(numbers, ids, np.cumsum(lengths) - lengths, lengths)

    def _put(self, numbers: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Pieces ``numbers`` have the ids at ``starts`` in ``ids``."""
        end = self.filled + len(ids)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.filled : end] = ids
        self.starts[numbers], self.lengths[numbers] = self.filled + starts, lengths
        self.filled = end

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[numbers] - ends + lengths, lengths) + np.arange(total)], lengths

    def look_up(self, texts: list[str]) -> list[list[int]]:
        """For each text the table's numbers of its pieces, in order."""
        if self.known > self.max_pieces:
            self._start()
        out = []
        bare, spaced, feed = self.bare, self.spaced.__getitem__, self.line_feed
        for text in texts:
            own: list[int] = []
            for line in self.cut(text):
                if own:
                    own.append(feed)
                own.append(bare[line[0]])
                own.extend(map(spaced, line[1:]))
            out.append(own)
        long = [(after_space, p) for after_space, p in self.pending if len(p) > MAX_PIECE_CHARS]
        self._learn()
        for after_space, piece in long:
            (self.spaced if after_space else self.bare).pop(piece, None)
        return out

    # -- results -----------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row (uint32), and the number of ids of each."""
        looked = self.look_up(texts)
        sizes = np.fromiter(map(len, looked), np.int64, len(looked))
        ids, lengths = self._gather(np.fromiter(chain.from_iterable(looked), np.int64, int(sizes.sum())))
        by_piece = np.concatenate([[0], np.cumsum(lengths)])
        last = np.cumsum(sizes)
        return ids, by_piece[last] - by_piece[last - sizes]
