"""Token ids of whole texts by the ``tokenizers`` library, with a word cache.

Both vocabularies cut a text at places that do not depend on what lies further
away, so a text's ids are those of its chunks joined. Chunks repeat, hence each
worker keeps the ids of recent chunks; a text that could break the rule is
encoded in one go.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks in a generation of a worker's cache, some 200 bytes each; bounds its memory.
CACHE_CHUNKS = 250_000
#: Characters that are cut and encoded at once.
PORTION = 4 << 20


def _byte_letters() -> str:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


LETTERS = _byte_letters()
#: A plain Latin word, perhaps with punctuation behind it: one or two pieces for either vocabulary.
WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


class _Chunks(dict):
    """Ids of chunks, in two generations.

    When the young one is full it becomes the old one, from which chunks that
    still occur move back, so frequent ones are never lost.
    """

    def __init__(self, owner):
        super().__init__()
        self.owner, self.prefix, self.marks, self.old = owner, " " if owner.spaced else "", {}, {}
        self.letter, self.most = self.prefix.translate(LETTERS), CACHE_CHUNKS

    def of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. Plain words go straight to the BPE model."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
            self.marks.clear()
        out = list(map(self.get, chunks))
        old, made, piece, letter, spaced = self.old.get, self.made, self.owner.piece, self.letter, self.owner.spaced
        for i in [i for i, ids in enumerate(out) if ids is None]:
            c = chunks[i]
            ids = old(c)
            if ids is None:
                ids = piece(letter + c) if c.isascii() and c.isalpha() and (spaced or c.islower()) else made(c)
            if len(c) <= 64:
                self[c] = ids
            out[i] = ids
        return out

    def made(self, chunk: str) -> bytes:
        owner, letter = self.owner, self.letter
        if chunk[:1] == "\n" and owner.spaced:  # the first of a line has no space before it
            return owner.line_break + (owner.whole(chunk[1:]) if len(chunk) > 1 else b"")
        m = WORD.fullmatch(chunk)
        if m is None:
            return owner.whole(self.prefix + chunk)
        word, mark = m.groups()
        if not owner.spaced:
            low = word.lower()
            if len(low) != len(word):
                return owner.whole(chunk)
            word = low
        ids = self.get(word)
        if ids is None:
            ids = owner.piece(letter + (word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)))
            if len(word) <= 64:
                self[word] = ids
        if mark:
            if mark not in self.marks:
                self.marks[mark] = owner.whole(mark)
            return ids + self.marks[mark]
        return ids


class TextEncoder:
    """Ids of texts, as little-endian unsigned numbers of type ``kind``: 16 bits if all ids fit, else 32.

    spaced=False: white space is dropped by the vocabulary (word-end BPE).
    spaced=True: a space belongs to the word after it (byte-level BPE); a white
    space run that a plain split would cut wrongly makes the text go uncut.
    """

    #: A space between white space, or after it at the end: not a safe cut.
    UNSAFE = re.compile(r"\s (?:\s|\Z)|<\||\n\s|\s\n|\A\n|\n\Z")
    #: One of these, or of the white space beyond ASCII, is in every unsafe text that neither starts nor ends with a line break or space.
    SUSPECT = ("  ", "\n\n", " \n", "\n ", "<|", *(chr(c) for c in range(128) if chr(c).isspace() and chr(c) not in " \n"))
    WIDE = tuple(chr(c) for c in range(128, 0x3001) if chr(c).isspace())

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.symbols = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind, self.code = ("<u2", "H") if self.symbols <= 1 << 16 else ("<u4", "I")
        self.chunks = _Chunks(self)
        self.line_break = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def piece(self, word: str) -> bytes:
        """Ids of one word, in the vocabulary's letters, that neither normalising nor pre-splitting would change."""
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def unsafe(self, text: str) -> bool:
        """Whether cutting a text at its spaces could change its ids."""
        if not self.spaced:
            return "\u0130" in text  # the one letter that grows in lower case
        odd = text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, self.SUSPECT)) or not text.isascii() and any(map(text.__contains__, self.WIDE))
        return odd and self.UNSAFE.search(text) is not None

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Chunks are told apart once for all texts; only distinct ones are looked up."""
        out: list = [None] * len(texts)
        cut = []
        for i, t in enumerate(texts):
            if t and not self.unsafe(t):
                cut.append(i)
            else:
                out[i] = np.frombuffer(self.whole(t) if t else b"", self.kind)
        if not cut:
            return out
        # In a spaced vocabulary, a chunk with a line break in front starts a line; so does the first one.
        lines = ["\n" + texts[i].replace("\n", " \n") if self.spaced else texts[i].replace("\n", " ") for i in cut]
        words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        flat = words.flatten().dictionary_encode()
        known = self.chunks.of(flat.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int32, len(known)) // ids.itemsize
        at = flat.indices.to_numpy()
        start, n = (np.cumsum(size, dtype=np.int32) - size)[at], size[at]
        ends = np.cumsum(n, dtype=np.int32)  # of one portion, or of one text
        place = np.repeat(start - (ends - n), n)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = ids[place]
        bounds = np.append(0, ends)[words.offsets.to_numpy()].tolist()
        skip = len(self.line_break) // ids.itemsize if self.spaced else 0
        for i, lo, hi in zip(cut, bounds, bounds[1:]):
            out[i] = ids[lo + skip : hi]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, spaced: bool) -> TextEncoder:
    """One per worker and vocabulary, kept from task to task."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = TextEncoder(path, spaced)
    return _ENCODERS[path, spaced]


def encoded(texts: pa.Array, path: str, spaced: bool, larger: int = 1):
    """Ids of each text, in order, some ``PORTION`` characters at a time; null counts as empty.

    ``larger``: that many times the memory for the cache and for what is encoded
    at once, for tasks that hold little else.
    """
    enc, held, size = encoder(path, spaced), [], 0
    enc.chunks.most = larger * CACHE_CHUNKS
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= larger * PORTION:
            yield from enc.encode_many(held)
            held, size = [], 0
    yield from enc.encode_many(held)
