"""Token ids of many texts with the word-level BPE vocabulary of the `tokenizers` library.

The tokenizer lower-cases a text, splits it into runs of letters, single digits and runs of
other signs, and merges within each. Most words come again and again, so words are found and
hashed with numpy, and the library encodes each distinct word of a worker once. Texts outside
that plain path (apostrophes, special tokens' first sign, composed or very high characters, letters
whose lower case is longer) go to the library as they are; the ids are the same.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np

from evidence_surface.llm.words import ragged, run_hashes

MOST_WORDS = 300_000  # distinct words a worker remembers
RUN = 2000  # words encoded as one text
WORD_END = "</w>"
_HIGH = 0x10000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each character below _HIGH: its class (0 space, 1 letter, 2 digit, 3 other, 4 not on
    the plain path) and its lower case."""
    kind, lower = np.full(_HIGH, 3, np.uint8), np.arange(_HIGH, dtype=np.uint32)
    for code in range(_HIGH):
        c = chr(code)
        group, small = unicodedata.category(c), c.lower()
        if c.isspace() or code in (0x85,):
            kind[code] = 0
        if len(small) > 1 or group in ("Cs", "Cc", "Mn", "Mc", "Me", "Cn", "Co", "Cf") or c in "'<Σ":
            kind[code] = 4 if code not in (9, 10, 11, 12, 13) else 0
        elif group[0] == "L":
            kind[code] = 1
        elif group[0] == "N":
            kind[code] = 2
        if len(small) == 1:
            lower[code] = ord(small)
    kind[0x1C:0x20] = 4
    return kind, lower


class Encoder:
    """Encodes texts with a tokenizer file; `encode` gives all ids and each text's count."""

    def __init__(self, path: str):
        # a task has one core; the library's own threads would each hold memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        """Hashes of the known words in order, and where the ids of each begin and end."""
        self.keys, self.begins, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes words, given as runs of `codes`, in texts of many words; the last id of a word
        is one that ends words. Where the ids of each word begin and end."""
        texts = []
        for i in range(0, len(starts), RUN):
            many = sizes[i : i + RUN]
            text = np.full(many.sum() + len(many), 32, np.uint32)
            step = ragged(many)
            text[np.repeat(np.cumsum(many + 1) - many - 1, many) + step] = codes[np.repeat(starts[i : i + RUN], many) + step]
            texts.append(text.tobytes().decode("utf-32-le"))
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        own = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        ends = self.used + np.flatnonzero(self.last[own]) + 1
        if len(ends) != len(starts):
            raise ValueError("the vocabulary does not end every word with an id of its own")
        begins = np.concatenate([[self.used], ends[:-1]]) if len(ends) else ends
        if self.used + len(own) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(own), np.uint32)])
        self.ids[self.used : self.used + len(own)] = own
        self.used += len(own)
        return begins, ends

    def _places(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Position among the known words of each of the words, distinct and in order of hash."""
        if len(self.keys) > MOST_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, hashes)
        known = np.append(self.keys, np.uint64(0))[at] == hashes
        known &= at < len(self.keys)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            begins, ends = self._learn(codes, starts[fresh], sizes[fresh])
            self.keys = np.insert(self.keys, at[fresh], hashes[fresh])
            self.begins = np.insert(self.begins, at[fresh], begins)
            self.ends = np.insert(self.ends, at[fresh], ends)
            at = np.searchsorted(self.keys, hashes)
        return at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kind, lower = _tables()
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        low = np.minimum(codes, _HIGH - 1)  # its class is 4: not a character
        kinds, small = kind[low], lower[low]
        odd = np.add.reduceat(np.append(kinds == 4, False), np.minimum(ends - lengths, len(codes)), dtype=np.int64) > 0
        odd &= lengths > 0
        high = np.add.reduceat(np.append(codes >= 0x300, False), np.minimum(ends - lengths, len(codes)), dtype=np.int64) > 0
        for i in np.flatnonzero(high & ~odd & (lengths > 0)):
            odd[i] = not unicodedata.is_normalized("NFC", texts[i])
        kinds = np.where(np.repeat(odd, lengths), 0, kinds)
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        fresh[(ends - lengths)[lengths > 0]] = True
        edges = np.flatnonzero(fresh)
        sizes = np.diff(np.append(edges, len(codes)))
        word = kinds[edges] > 0
        inside = np.repeat(word, sizes)
        starts, sizes = edges[word], sizes[word]
        doc = np.searchsorted(ends, starts, "right")
        hashes = run_hashes(small[inside], sizes)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._places(distinct, small, starts[first], sizes[first])
        begin, stop = self.begins[place][which], self.ends[place][which]
        many = stop - begin
        ids = self.ids[np.repeat(begin, many) + ragged(many)] if len(many) else np.zeros(0, np.uint32)
        counts = np.bincount(doc, weights=many, minlength=len(texts)).astype(np.int64)
        return self._with_odd(texts, np.flatnonzero(odd), ids, counts)

    def _with_odd(self, texts, odd, ids, counts):
        if not len(odd):
            return ids, counts
        parts, at = [], 0
        edges = np.cumsum(counts)
        for i in odd:
            parts.append(ids[at : edges[i]])
            at = edges[i]
            own = np.array(self.tokenizer.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, np.uint32)
            parts.append(own)
            counts[i] = len(own)
        parts.append(ids[at:])
        return np.concatenate(parts), counts


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, with the words it has met in earlier tasks."""
    return Encoder(path)
