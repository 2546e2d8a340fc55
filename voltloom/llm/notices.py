"""License scan: exact base phrases and fuzzy search for short notices in whole texts.

A text becomes its words (A-Z lower-cased; runs of digits, a-z and non-ASCII characters) joined by one space. A notice with
at most k edits is cut into k + 1 pieces, of which one must occur exactly (pigeonhole); places around such a piece are
candidates, and the regex library decides with bounded errors what is a match and where.

Defined results: null text counts as empty; empty texts have no words, no labels and score 0; of overlapping notices
those with the fewest edits stand, ties all; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import small_batches

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices in normal form, their labels and the edits allowed (about one in ten characters).
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("gnu general public license version 3", "gpl-3.0", 3),
    ("gnu general public license version 2", "gpl-2.0", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("mozilla public license version 2 0", "mpl-2.0", 3),
    ("redistribution and use in source and binary forms", "bsd", 5),
    ("licensed under cc by 4 0", "cc-by-4.0", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", 2),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", 2),
    ("creative commons attribution", "cc-by", 3),
    ("all rights reserved", "reserved", 2),
]
FIELDS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label:string,first_word:long,last_word:long,start:long,end:long,edits:int>>"
)
#: Lower-cased bytes that are not in a word, as spaces.
_TO_SPACE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def seeds(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """The notice in ``edits`` + 1 pieces of even length, with their places."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    def __init__(self, notices=NOTICES):
        import regex

        self.items = []
        for phrase, label, edits in notices:
            padded = f" {phrase} ".encode()
            # The best of the matches at a place; spaces around the notice keep it from beginning inside a word.
            pattern = regex.compile(b"(?e)(?:" + regex.escape(padded, literal_spaces=True) + b"){e<=%d}" % edits)
            self.items.append((label, padded, edits, seeds(padded, edits), pattern))

    def find(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, notice length) in normal text that has a space at either end."""
        found = []
        for label, padded, edits, cut, pattern in self.items:
            windows = []
            for at, piece in cut:
                p = text.find(piece)
                while p >= 0:
                    windows.append((max(0, p - at - edits), min(len(text), p - at + len(padded) + edits)))
                    p = text.find(piece, p + 1)
            if not windows:
                continue
            windows.sort()
            merged = [windows[0]]
            for a, b in windows[1:]:
                if a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            for a, b in merged:
                for m in pattern.finditer(text[a:b]):
                    found.append((label, a + m.start(), a + m.end(), sum(m.fuzzy_counts), len(padded)))
        return fewest_edits(found)


def fewest_edits(found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Where matches overlap, such as those of two versions of a licence, the ones with the fewest edits stand.

    A match meets only those kept with fewer edits: among the ones that begin before its end, the furthest end tells whether
    any reaches into it.
    """
    kept: list[tuple[str, int, int, int, int]] = []
    for _, level in itertools.groupby(sorted(found, key=lambda x: x[3]), key=lambda x: x[3]):
        better = sorted((a, b) for _, a, b, _, _ in kept)
        starts, furthest = [a for a, _ in better], list(itertools.accumulate((b for _, b in better), max))
        for x in level:
            n = bisect_left(starts, x[2] - 1)
            if not n or furthest[n - 1] <= x[1] + 1:
                kept.append(x)
    return kept


def places(text: bytes, needle: bytes) -> Iterator[int]:
    p = text.find(needle)
    while p >= 0:
        yield p
        p = text.find(needle, p + 1)


def scan_text(text: str, searcher: Searcher, base: dict[str, str] = BASE) -> tuple:
    words = text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)  # the k-th stands before word k
    for phrase, label in base.items():
        found = list(places(joined, f" {phrase} ".encode()))
        starts += np.searchsorted(spaces, found).tolist()
        labels.update([label] if found else [])
    matches, score, every = [], 1.0 if labels else 0.0, set(labels)
    hits = searcher.find(joined) if words else []
    if hits:
        at = [m.span() for m in _WORD.finditer(text)]
        for label, a, b, edits, size in hits:
            inner = joined[a:b].strip()
            if not inner:
                continue
            a = joined.index(inner, a)
            first = int(np.searchsorted(spaces, a)) - 1
            last = first + inner.count(b" ")
            matches.append({"label": label, "first_word": first, "last_word": last, "start": at[first][0], "end": at[last][1], "edits": edits})
            every.add(label)
            score = max(score, 1 - edits / size)
    matches.sort(key=lambda m: (m["start"], m["end"], m["label"]))
    edge = (min(starts), max(starts)) if starts else (None, None)
    return (len(words), len(starts), *edge, ",".join(sorted(labels)), ",".join(sorted(every)), score, matches)


def scan(docs: DataFrame, notices=NOTICES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document with base counts, all labels, the best score and the verified spans (code points)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(notices)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for batch in batches:
            out = pd.DataFrame([scan_text(t, searcher, base) for t in batch.text], columns=names)
            out.insert(0, "doc_id", batch.doc_id.to_numpy())
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, FIELDS)
