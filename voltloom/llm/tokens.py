"""Token ids of whole texts inside tasks, with a public tokenizer.

Before its merges the tokenizer cuts a text in front of a space that a word follows, and around a line end, comma or full
stop between words. What lies between two cuts is encoded alike wherever it stands, so the ids of such pieces are kept in
a bounded memory that outlives tasks, and only new pieces are encoded. A text in which a piece could depend on its neighbours (runs of
white space or of punctuation) is cut at spaces only, or encoded whole, as is one that holds the string of a special token.
All ways give exactly the tokenizer's ids. An empty text has none; null texts are for the caller to replace.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The vocabulary of the contract, a file of the box's public tokenizers.
DEFAULT_FILE = "byte_bpe_50k.json"
#: Pieces that a worker remembers: some 150 MB. The least lately used half goes first.
MEMORY_PIECES = 700_000
#: Pieces where the memory goes with the task.
TASK_PIECES = 1_400_000
#: Stand for a line end, a comma and a full stop that open a piece.
MARKS = {"\x01": "\n", "\x02": ",", "\x03": "."}
#: A comma or full stop next to another, as the cuts show them.
DOUBLES = [f"{a} {b}" for a in "\x02\x03" for b in "\x02\x03"]
#: New words that are encoded as one text.
WORDS = 64
_loaded: dict[tuple[str, bool], Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def encoder(path: str, literal: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file; it and its memory outlive tasks."""
    if (path, literal) not in _loaded:
        _loaded[path, literal] = Encoder(path, literal=literal)
    return _loaded[path, literal]


@contextmanager
def task_encoder(path: str, literal: bool = False) -> Iterator[Encoder]:
    """The worker's encoder, which forgets its pieces when the task ends: Spark keeps more workers than run at a time, and those that
    wait or work for another operator would each hold a memory of their own."""
    enc = encoder(path, literal)
    usual, enc.memory = enc.memory, TASK_PIECES
    try:
        yield enc
    finally:
        enc.memory = usual
        enc.forget()


class Encoder:
    """``literal``: the string of a special token in a text is ordinary text. Else it is that token, as with the tokenizer itself."""

    def __init__(self, path: str, memory: int = MEMORY_PIECES, literal: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.memory = memory
        self.size = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if not (literal and t.special)]
        opens = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        self.opens = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith(opens)
        self.forget()

    def forget(self) -> None:
        """False: the text that holds the piece needs the next slower way. ``fine`` also cuts at marks, ``plain`` only at spaces."""
        self.fine: dict[str, bytes | bool] = {"": False}
        self.plain: dict[str, bytes | bool] = {"": False}
        self.old_fine: dict[str, bytes | bool] = {}
        self.old_plain: dict[str, bytes | bool] = {}

    def age(self) -> None:
        """Keep what was used since the last time for one more time, and drop the rest: frequent pieces stay."""
        self.old_fine, self.old_plain = self.fine, self.plain
        self.fine, self.plain = {"": False}, {"": False}

    def each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def spaced(self, pieces: list[str], known: dict[str, bytes | bool]) -> None:
        """Encode pieces behind one space each, some together; a token that opens with a space begins the next piece."""
        some = [pieces[at : at + WORDS] for at in range(0, len(pieces), WORDS)]
        for part, ids in zip(some, self.each([" " + " ".join(x) for x in some]), strict=True):
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(part):
                known.update((p, self.whole(" " + p)) for p in part)
                continue
            data, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), len(ids) * 4]
            start = 0
            for p, end in zip(part, ends, strict=True):
                known[p] = data[start:end]
                start = end

    def learn_fine(self, new: set[str]) -> None:
        marked, good = [], []
        for p in new:
            if p.isalnum():
                good.append(p)
                continue
            first, rest = p[0], p[1:]
            if first in MARKS:
                if not rest and first != "\x01" or rest and rest[-1].isalnum() and rest.split() == [rest]:
                    marked.append(p)
                else:
                    self.fine[p] = False
            elif p[-1].isalnum() and p.split() == [p]:
                good.append(p)
            else:
                self.fine[p] = False
        for p, ids in zip(marked, self.each([MARKS[p[0]] + p[1:] for p in marked]), strict=True):
            self.fine[p] = ids.tobytes()
        self.spaced(good, self.fine)

    def learn_plain(self, new: set[str]) -> None:
        good = []
        for p in new:
            # What is cut at marks and known by its pieces needs no encoding of its own.
            parts = [self.fine.get(x) for x in ([p] if p.isalnum() else self.cuts(p))]
            if all(parts):
                self.plain[p] = b"".join(parts)
            elif p[0].isspace():
                self.plain[p] = False
            else:
                good.append(p)
        self.spaced(good, self.plain)

    def looked_up(self, pieces: list[list[str]], known: dict[str, bytes | bool], old: dict[str, bytes | bool], learn: Callable[[set[str]], None]) -> list[bytes | None]:
        """The ids of each list of pieces, its first one at the beginning of a text; None if one of them needs a slower way."""
        new = set().union(*[p[1:] for p in pieces]).difference(known)
        if old:
            again = new.intersection(old)
            known.update(zip(again, map(old.__getitem__, again), strict=True))
            new -= again
        if new:
            learn(new)
        heads = self.each([p[0] if p else "" for p in pieces])
        out = []
        for p, head in zip(pieces, heads, strict=True):
            try:
                out.append(head.tobytes() + b"".join(map(known.__getitem__, p[1:])) if p else None)
            except TypeError:  # a piece is False
                out.append(None)
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if 2 * (len(self.fine) + len(self.plain)) > self.memory:
            self.age()
        cut = [self.cuts(t) for t in texts]
        out = self.looked_up([p if not p[0] or p[0][-1].isalnum() else [] for p in cut], self.fine, self.old_fine, self.learn_fine)
        left = [i for i, ids in enumerate(out) if ids is None]
        split = [[] if self.holds_special(texts[i]) else texts[i].split(" ") for i in left]
        for i, ids in zip(left, self.looked_up(split, self.plain, self.old_plain, self.learn_plain), strict=True):
            out[i] = self.whole(texts[i]) if ids is None else ids
        return out

    def holds_special(self, text: str) -> bool:
        return _holds(text, self.special)

    def cuts(self, text: str) -> list[str]:
        if _holds(text, MARKS) or _holds(text, self.special):
            return ["\x01"]
        for mark, char in MARKS.items():
            text = text.replace(char, " " + mark)
        if ("\x02" in text or "\x03" in text) and _holds(text, DOUBLES):
            return ["\x01"]
        return text.split(" ")


def _holds(text: str, strings: Iterable[str]) -> bool:
    for s in strings:  # ``any`` takes longer on short pieces
        if s in text:
            return True
    return False
