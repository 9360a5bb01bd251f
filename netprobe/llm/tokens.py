"""Token ids of whole texts by the ``tokenizers`` library, fast for texts that repeat their words.

The byte-level vocabulary splits a text into pieces that never run from a character into white space,
so a text may be cut before every run of white space and its parts encoded apart. Parts are encoded
once and kept in a bounded table for each worker process; new parts go to the library many at a time,
as one text, and are told apart by the tokens that begin with a space. Texts with rarer white space are
encoded whole. The ids are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``,
also where a text holds the string of a special token.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
_PART = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space to Unicode or to Python, other than the four characters that texts are cut at.
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: The table of parts is emptied beyond so many parts or ids; longer parts are never kept.
MOST_PARTS, MOST_IDS, LONGEST_PART = 1_000_000, 8_000_000, 64
_TOGETHER = 5000


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` for one vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.spaced = np.zeros(self.size, bool)  # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        self._clear()

    def _clear(self) -> None:
        #: Rows of parts that have a space before them, and of parts as they are.
        self.after_space: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.n, self.n_ids = 0, 0
        self.first, self.length, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.dtype)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Append parts; returns the first one's row."""
        row = self.n
        for name, need in (("first", row + len(sizes)), ("length", row + len(sizes)), ("ids", self.n_ids + len(ids))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need - len(old), len(old)), old.dtype)]))
        self.first[row : row + len(sizes)] = self.n_ids + np.cumsum(sizes) - sizes
        self.length[row : row + len(sizes)] = sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = row + len(sizes), self.n_ids + len(ids)
        return row

    def _rows(self, parts: list[str], known: dict[str, int]) -> np.ndarray:
        """The table's row of each of these distinct parts."""
        rows = np.fromiter(map(known.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(rows < 0)
        for i in range(0, len(missing), _TOGETHER):
            at = missing[i : i + _TOGETHER]
            new = [parts[k] for k in at.tolist()]
            if known is self.after_space:
                (ids,) = self._library([" " + " ".join(new)])
                begins = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
                sizes = np.diff(begins)
            else:
                found = self._library(new)
                ids, sizes = np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
            row = self._store(ids, sizes)
            rows[at] = np.arange(row, row + len(new))
            known.update((p, k) for p, k in zip(new, range(row, row + len(new)), strict=True) if len(p) <= LONGEST_PART)
        return rows

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these parts one after another, and where each part's begin (len + 1)."""
        sizes = self.length[rows]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        return self.ids[np.repeat(self.first[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _one(self, text: str) -> np.ndarray:
        if _RARE.search(text):
            return self._library([text])[0]
        parts = _PART.findall(text)
        own = list(dict.fromkeys(parts))
        rows = dict(zip(own, self._rows(own, self.plain).tolist(), strict=True))
        return self._gather(np.fromiter(map(rows.__getitem__, parts), np.int64, len(parts)))[0]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and where each text's begin (len + 1); null as empty.

        Texts whose spaces all stand alone are split at them by Arrow and looked up by distinct part;
        others are cut one by one."""
        if self.n > MOST_PARTS or self.n_ids > MOST_IDS:
            self._clear()
        texts = texts.fill_null("") if texts.null_count else texts
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        words, code = coded.dictionary, coded.indices.to_numpy()
        if not len(code):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        bare = pc.binary_length(pc.utf8_trim_whitespace(words))
        edge = pc.or_(pc.or_(pc.equal(bare, 0), pc.not_equal(bare, pc.binary_length(words))), pc.match_substring(words, "\u180e")).to_numpy(zero_copy_only=False)
        odd = np.add.reduceat(edge[code], offsets[:-1]) > 0
        # no word holds a space, so one joined string gives them all back as Python's, faster than one by one
        listed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")
        begins_text = np.zeros(len(code), bool)
        begins_text[offsets[:-1]] = True
        in_odd = np.repeat(odd, np.diff(offsets))
        rows = np.zeros(len(words), np.int64)
        for known, wanted in ((self.after_space, ~begins_text & ~in_odd), (self.plain, begins_text & ~in_odd)):
            used = np.unique(code[wanted]) if known is self.plain else np.flatnonzero(np.bincount(code[wanted], minlength=len(words)))
            rows[used] = self._rows([listed[i] for i in used.tolist()], known)
            if known is self.after_space:
                row = rows[code]
            else:
                row[wanted] = rows[code[wanted]]
        row = row[~in_odd]
        ids, ends = self._gather(row)
        counts = np.diff(offsets)
        begins = ends[np.concatenate([[0], np.cumsum(np.where(odd, 0, counts))])]
        if odd.any():
            whole = [self._one(texts[i].as_py()) if odd[i] else ids[begins[i] : begins[i + 1]] for i in range(len(texts))]
            ids = np.concatenate(whole)
            begins = np.concatenate([[0], np.cumsum([len(x) for x in whole])])
        return ids, begins


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
