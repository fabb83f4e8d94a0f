"""Token ids of texts as arrays.

Byte-level merges never cross the words that the split pattern gives, so the ids of a text are the ids of its words in a
row. Words are encoded once by the library and remembered (a bounded number of them) as the bytes of their ids. A text with
characters outside the Latin range, or with a special token, is encoded by the library as a whole.
"""
from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, compress
from operator import not_

import numpy as np

#: words that are remembered, and their longest length in characters
_KNOWN, _LONG = 1_000_000, 40
#: the split pattern whose words are known to be those of the library (fixed value of the vocabulary)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: what sends a text to the library as a whole
_BEYOND = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


@lru_cache(maxsize=1)
def _latin_split() -> re.Pattern:
    """``SPLIT`` for texts inside the Latin range, its classes written out: takes about a third of the time."""
    import regex

    inside = [ch for ch in map(chr, range(0x2060)) if not _BEYOND.match(ch)]
    written = SPLIT.replace(r"\S", r"[^\s]")
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        members = "".join(rf"\u{ord(ch):04x}" for ch in inside if regex.match(name, ch))
        written = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(name, members), written).replace(name, f"[{members}]")
    return re.compile(written)


def _raw(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class ByteLevel:
    """Ids of a byte-level ``tokenizers`` file. ``plain_specials``: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str, plain_specials: bool):
        self.model = _byte_level(path, plain_specials)
        self.specials = [] if plain_specials else [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.split = _latin_split().findall if pattern == SPLIT else None
        # words met of late, and those met before them
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line = self.model.encode("\n", add_special_tokens=False).ids[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_raw(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, many of them in one text: between words without a line break, a line break is a word of its own."""
        out: dict[str, bytes] = {}
        joined = [w for w in words if not w.isspace() and "\n" not in w]
        for lo in range(0, len(joined), 4096):
            part = joined[lo : lo + 4096]
            ids = np.array(self.model.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(part) - 1:
                raw, edges = ids.tobytes(), (ends * 4).tolist()
                out.update(zip(part, [raw[a:b] for a, b in zip([0, *(e + 4 for e in edges)], [*edges, len(raw)], strict=True)], strict=True))
        rest = [w for w in words if w not in out]
        for lo in range(0, len(rest), 4096):
            out.update(zip(rest[lo : lo + 4096], self._encode(rest[lo : lo + 4096]), strict=True))
        return [out[w] for w in words]

    def words(self, text: str) -> list[str] | None:
        """The words of a text; None where it has to be encoded as a whole."""
        if self.split is None or _BEYOND.search(text) or any(s in text for s in self.specials):
            return None
        return self.split(text)

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit integers."""
        split = [self.words(t) for t in texts]
        whole = iter(self._encode([t for t, s in zip(texts, split, strict=True) if s is None]))
        if len(self.known) > _KNOWN // 2:
            # words that are met again move on with the younger half, the others go with the older one
            self.known, self.older = {}, self.known
        here, older = self.known, self.older
        found = [list(map(here.get, s or ())) for s in split]
        missing = [list(compress(s, map(not_, f))) if s and None in f else () for s, f in zip(split, found, strict=True)]
        late = set(chain.from_iterable(missing))
        again = late.intersection(older)
        here.update(zip(again, map(older.__getitem__, again), strict=True))
        new = list(late.difference(again))
        here.update(zip(new, self._words(new), strict=True))
        out = []
        for s, f, m in zip(split, found, missing, strict=True):
            if m:
                fill = map(here.__getitem__, m)
                f = [x or next(fill) for x in f]
            out.append(next(whole) if s is None else b"".join(f))
        for word in new:
            if len(word) > _LONG:
                del here[word]
        return out


class Merges:
    """Ids of the vocabulary of a byte-level ``tokenizers`` file, special tokens being ordinary text, by another library that
    takes the ids as the order of merges. Texts beyond the Latin range, and texts with very long runs with or without white
    space, are left to ``ByteLevel``.
    """

    _LONG_RUN = re.compile(r"\s{500}|\S{2000}")

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.all = byte_level(path, pattern, True)
        spelled, special = byte_level_bytes(path), {t.content for t in self.all.model.get_added_tokens_decoder().values()}
        ranks = {b: i for i, b in enumerate(spelled) if b and b.decode(errors="replace") not in special}
        self.fast = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if pattern == SPLIT else None

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit integers."""
        left = [self.fast is None or bool(_BEYOND.search(t) or self._LONG_RUN.search(t)) for t in texts]
        rest = iter(self.all.raw([t for t, x in zip(texts, left, strict=True) if x]))
        return [next(rest) if x else _raw(self.fast.encode_ordinary(t)) for t, x in zip(texts, left, strict=True)]


@lru_cache(maxsize=1)
def merges(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


def _byte_level(path: str, plain_specials: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = plain_specials
    return model


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str, plain_specials: bool = False) -> ByteLevel:
    return ByteLevel(path, pattern, plain_specials)


class Pieces:
    """Ids of a ``sentencepiece`` model, which puts a blank before a text. A text that its pieces do not spell has none."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.spelled = piece_bytes(self.model)

    def raw(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit integers."""
        spell, out = self.spelled.__getitem__, []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True):
            out.append(_raw(ids) if text and b"".join(map(spell, ids)) == b" " + text.encode() else b"")
        return out


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others
    are counted up from 256.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level ``tokenizers`` file."""
    model, byte = _byte_level(path, True), byte_of_char()
    out = [b""] * model.get_vocab_size()
    for token, i in model.get_vocab().items():
        # a special token is written in plain characters
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a ``sentencepiece`` model."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


def lengths(table: list[bytes]) -> np.ndarray:
    return np.array([len(b) for b in table], np.int64)
