"""Texts as numbered words, so that an encoder sees each distinct word once.

A slice of texts is cut at single spaces by Arrow, which also numbers the
distinct words. A word stands for itself with the space before it; the first word
of a text has none, nor has a word that begins with ``JOIN``. Such words come from
cuts that are made before: between a Latin letter or digit and the ASCII marks
after it, before newlines, and between a newline and a Latin letter. So ``word``,
``word,`` and ``word.`` cost one encoding.

A pre-tokenizer of the pattern in ``public_tokenizers.PATTERN`` divides at all of
these places, so it makes the same of a text and of its words one by one. Texts
where a space lies between white space, or that hold ``JOIN``, are cut by
``chunked`` instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

JOIN = "\x02"
#: A space with white space on both sides (or before the end) is no boundary. RE2; white space as wide as any definition of it.
_WHITE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
_ODD = rf"[{_WHITE}] ([{_WHITE}]|$)|{JOIN}"
#: Latin letters; they are letters in every version of Unicode.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Cuts, in this order. The marks are those of ASCII but for the apostrophe.
_CUTS = ((rf"([{LETTERS}0-9])([!-&(-/:-@\[-`{{-~]+)", rf"\1 {JOIN}\2"), (r"([!-~])\n", f"\\1 {JOIN}\n"), (rf"\n([{LETTERS}])", f" {JOIN}\n {JOIN}\\1"))
_SPACE = re.compile(r" (?=\S)")
def chunked(text: str) -> list[str]:
    """The text cut before every space that is followed by what isn't white space."""
    parts, at = [], 0
    for m in _SPACE.finditer(text):
        if m.start() > at:
            parts.append(text[at : m.start()])
            at = m.start()
    return [*parts, text[at:]] if text else []


def spread(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + n[i]] for each i, one after the other."""
    at = np.repeat(start - np.cumsum(n) + n, n)
    at += np.arange(len(at))
    return values[at]


class Pool:
    """What words are encoded to, kept from slice to slice in a table of bounded size.

    learn(letters, others): letters are words of Latin letters (with a space
    before them or not), each a single piece; others are any strings. It gives
    the ids of all of them, one after the other, and how many each has; and,
    if it likes, an array with a value for each, which ``more`` holds. Nothing is a Python object for each word of a text: words are compared by
    Arrow, and ids are gathered by numpy.
    """

    def __init__(self, learn: Callable[[pa.Array, list[str]], tuple], size: int):
        self.learn, self.size = learn, size
        self._clear()

    def _clear(self) -> None:
        self.keys, self.more = pa.array([], pa.string()), None
        self.start, self.length, self.ids, self.slices = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Let go of the words that one slice alone has used; of all, if that isn't half of them."""
        kept = np.flatnonzero(self.slices > 1)
        keys, more, (ids, _), length = self.keys.take(pa.array(kept)), self.more and self.more.take(pa.array(kept)), self.gather(kept), self.length[kept]
        self._clear()
        if 2 * len(kept) <= self.size:
            self._put(keys, ids, length, more)

    def _put(self, keys: pa.Array, ids: np.ndarray, length: np.ndarray, more: pa.Array | None = None) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.more = pa.concat_arrays([self.more, more]) if self.more else more
        self.start = np.append(self.start, len(self.ids) + np.cumsum(length) - length)
        self.length, self.ids, self.slices = np.append(self.length, length), np.append(self.ids, ids), np.append(self.slices, np.zeros(len(keys), np.int32))

    def entries(self, keys: pa.Array) -> np.ndarray:
        """The table's rows of words as cut texts spell them; those that are new are learned."""
        rows = pc.index_in(keys, value_set=self.keys)
        if rows.null_count:
            new = keys.filter(pc.is_null(rows)).unique()
            letters = pc.match_substring_regex(new, f"^{JOIN}?[{LETTERS}]+$")
            plain, others = new.filter(letters), new.filter(pc.invert(letters))
            spaced = pc.if_else(pc.starts_with(plain, JOIN), pc.utf8_slice_codeunits(plain, 1), pc.binary_join_element_wise(" ", plain, ""))
            rest = [w[1:] if w[:1] == JOIN else " " + w for w in others.to_numpy(zero_copy_only=False)]
            self._put(pa.concat_arrays([plain, others]), *self.learn(spaced, rest))
            rows = pc.index_in(keys, value_set=self.keys)
        rows = np.asarray(rows).astype(np.int64)
        self.slices[rows] += 1
        return rows

    def slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, ends): rows[ends[i - 1] : ends[i]] are the table's rows of text i; null is empty."""
        if len(self.keys) > self.size:
            self._shrink()
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _ODD))).tolist()
        cut = texts
        for pattern, by in _CUTS:
            cut = pc.replace_substring_regex(cut, pattern, by)
        words = pc.split_pattern(cut, " ")
        counts = np.diff(np.asarray(words.offsets)).astype(np.int64)
        starts = np.cumsum(counts) - counts
        coded = words.flatten().dictionary_encode()
        index = np.asarray(coded.indices)
        first = pc.binary_join_element_wise(JOIN, coded.dictionary.take(pa.array(index[starts])), "")
        whole = [[JOIN + c for c in chunked(texts[i].as_py())] for i in odd]
        found = self.entries(pa.concat_arrays([coded.dictionary, first, pa.array([c for w in whole for c in w], pa.string())]))
        n = len(coded.dictionary)
        rows = found[index]
        rows[starts] = found[n : n + len(texts)]
        if not odd:
            return rows, starts + counts
        parts, at = np.split(rows, starts[1:]), n + len(texts)
        for i, w in zip(odd, whole):
            parts[i] = found[at : at + len(w)]
            at += len(w)
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of rows one after the other, and where each row's end."""
        n = self.length[rows]
        return spread(self.ids, self.start[rows], n), np.cumsum(n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of the texts."""
        rows, ends = self.slice(texts)
        ids, of_rows = self.gather(rows)
        return ids, np.append(0, of_rows)[ends]


def slices(texts: pa.Array, points: int):
    """(start, part) of texts, each part of about so many bytes at most, or one text."""
    texts = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    at = 0
    while at < len(texts):
        z = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + points, "right")))
        yield at, texts.slice(at, z - at)
        at = z
