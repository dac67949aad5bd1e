"""Encoding of texts through their distinct pieces: each piece is encoded once per worker."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Distinct pieces a worker remembers before it starts afresh; bounds memory, never the result.
KEPT_PIECES = 200_000


class Pieces(dict):
    """Numbers the distinct pieces as they come up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceCoder:
    """Texts to ids where a text is cut in pieces that are encoded separately."""

    def __init__(self, kept: int = KEPT_PIECES):
        self.kept = kept
        self.forget()

    def cut(self, text: str) -> Iterable[str]:
        raise NotImplementedError

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        self.pieces = Pieces()
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def learn(self) -> None:
        """Encode the pieces that came up since the last call."""
        new, self.pieces.new = self.pieces.new, []
        ids, counts = self.ids_of(new)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where the texts begin and end."""
        if len(self.pieces) > self.kept:
            self.forget()
        number = self.pieces.__getitem__
        parts = [np.fromiter(map(number, self.cut(text or "")), np.int32) for text in texts]
        self.learn()
        sizes = [int(self.counts[part].sum()) for part in parts]
        numbers = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        shift = (self.starts[numbers] - (ends - counts)).astype(np.int32)
        at = np.arange(total, dtype=np.int32) + np.repeat(shift, counts)
        return self.ids[at], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
