"""Fuzzy search for short license notices.

A text is lower-cased (A-Z) and taken as words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, joined by single blanks.
A notice that may be off by e edits is split into e + 1 parts: within e edits at least one part stands
exactly (pigeonhole). An Aho-Corasick automaton over all parts locates candidates in one pass; each is
verified by the regex library's bounded-error matching in a window around it, and reported with its
label, edits, words and span in the original text.

Nulls and empty texts have no words and no spans; bytes that are no UTF-8 count as U+FFFD, a character of a word. Ids may be null or repeat: every row gets its own result.
Of hits of one label that overlap, the one with the fewest edits stays, then the first. A row's work and
memory follow its own length and the hits in it; there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (phrase, label, edits allowed, counts as a base phrase); fixed values.
NOTICES: tuple[tuple[str, str, int, bool], ...] = (
    ("mit license", "mit", 1, True),
    ("apache license version 2", "apache-2", 3, True),
    ("cc by nc", "cc-by-nc", 0, True),
    ("gnu general public license", "gpl", 3, False),
    ("gnu lesser general public license", "lgpl", 3, False),
    ("gnu affero general public license", "agpl", 3, False),
    ("mozilla public license", "mpl", 2, False),
    ("bsd 2 clause license", "bsd-2-clause", 1, False),
    ("bsd 3 clause license", "bsd-3-clause", 1, False),
    ("creative commons attribution noncommercial", "cc-by-nc", 3, False),
    ("creative commons attribution sharealike", "cc-by-sa", 3, False),
    ("permission is hereby granted free of charge", "mit", 4, False),
    ("redistribution and use in source and binary forms", "bsd", 4, False),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5, False),
)

SCHEMA = "n_words long, hits array<struct<label: string, phrase: string, base: boolean, edits: int, first_word: long, last_word: long, start: long, stop: long, matched: string>>"

#: Characters of a cell in which spans that may overlap are looked for.
CELL = 64

_SEPARATORS = bytes(32 if b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str, int, bool], ...] = NOTICES):
        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.patterns = []
        for k, (phrase, _, edits, _) in enumerate(notices):
            cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(phrase[a:b], []).append((k, a))
            self.patterns.append(regex.compile(rf"(?be)(?<= )(?:{regex.escape(phrase)}){{e<={edits}}}(?= )") if edits else None)
        for seed, of in seeds.items():
            self.automaton.add_word(seed, (len(seed), of))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """The number of words and the hits, by place."""
        words = text.encode().translate(_SEPARATORS).split()
        joined = " " + b" ".join(words).decode() + " "
        found: dict[tuple[int, int, int], int] = {}
        for end, (size, of) in self.automaton.iter(joined):
            for k, before in of:
                phrase, _, edits, _ = self.notices[k]
                start = end - size + 1 - before
                if start > 0 and joined.startswith(f" {phrase} ", start - 1):
                    found[k, start, start + len(phrase)] = 0
                elif edits:
                    a, b = max(0, start - edits - 1), start + len(phrase) + edits + 1
                    if m := self.patterns[k].search(joined, a, b):
                        found.setdefault((k, m.start(), m.end()), sum(m.fuzzy_counts))
        if not found:
            return len(words), []
        spans = [m.span() for m in _WORD.finditer(text)]
        blanks = np.flatnonzero(np.array([c == " " for c in joined]) if not joined.isascii() else np.frombuffer(joined.encode(), dtype=np.uint8) == 32)
        places = sorted({x for _, start, stop in found for x in (start, stop)})
        word_at = dict(zip(places, (np.searchsorted(blanks, places) - 1).tolist()))
        hits, taken = [], {}  # taken: spans by label and the cells of the text that they touch
        for (k, start, stop), edits in sorted(found.items(), key=lambda x: (x[1], x[0][1], x[0][0])):
            phrase, label, _, base = self.notices[k]
            # exact places all stay, overlaps too; a fuzzy one that overlaps a better one of its label goes
            cells = [(label, c) for c in range(start // CELL, (stop - 1) // CELL + 1)]
            if edits and any(start < b and a < stop for c in cells for a, b in taken.get(c, ())):
                continue
            for c in cells:
                taken.setdefault(c, []).append((start, stop))
            first, last = word_at[start], word_at[stop]
            a, b = spans[first][0], spans[last][1]
            hits.append({"label": label, "phrase": phrase, "base": base and not edits, "edits": edits, "first_word": first, "last_word": last, "start": a, "stop": b, "matched": text[a:b]})
        return len(words), sorted(hits, key=lambda h: (h["start"], h["stop"], h["label"], h["phrase"]))


def scan_licenses(docs: DataFrame, notices: tuple[tuple[str, str, int, bool], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, hits (spans in code points of the original text)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(notices).scan
        struct = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("matched", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, hits = zip(*(scan((t.as_py() or b"").decode(errors="replace")) for t in part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(hits, struct)], [id_col, "n_words", "hits"])

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")
