"""Pre-token splitting for the public tokenizer files.

Texts (for the word vocabulary: words) whose characters all lie below U+0250 (without U+0130) are split by patterns over explicit
character classes. For these the normalisation of the library reduces to lower-casing. The library's own normaliser and pre-tokenizer
split other words; the byte vocabulary encodes other texts whole. Results never depend on these shortcuts.
"""

from __future__ import annotations

import base64
import re

import numpy as np

#: Entries kept by a cache of pre-tokens. Beyond it, new pre-tokens are computed each time they occur.
CACHE_ENTRIES = 300_000

_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", " \\t\\n\\x0b\\f\\r\\x85\\xa0"
_BEYOND = re.compile("[^\x00-įı-ɏ]")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

_loaded: dict[tuple[str, str], object] = {}


def once(kind: type, path: str):
    """One instance per worker process."""
    key = (kind.__name__, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


class PieceCounter:
    """Pieces of words between white space, for a ``tokenizers`` file whose pre-tokens never hold white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split_special = re.compile("|".join(map(re.escape, self.special)))

    def _plain(self, part: str) -> list[str]:
        if not _BEYOND.search(part):
            return _WORD.findall(part.lower())
        normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def pretokens(self, word: str) -> tuple[list[str], int]:
        """Pre-tokens of a word, and the special strings in it."""
        if "<|" in word and (special := len(self.split_special.findall(word))):
            return [p for part in self.split_special.split(word) for p in self._plain(part)], special
        return self._plain(word), 0

    def count(self, words: list[str]) -> np.ndarray:
        """Pieces of each word: those of each distinct pre-token are counted once, joined to the words' pre-tokens and summed."""
        found = [self.pretokens(w) for w in words]
        distinct = list({p for pretokens, _ in found for p in pretokens})
        pieces = dict(zip(distinct, map(len, self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False)), strict=True))
        return np.array([special + sum(map(pieces.__getitem__, pretokens)) for pretokens, special in found], dtype=np.int64)


class ByteEncoder:
    """Ids of a byte-level vocabulary; each distinct pre-token is encoded once while cached."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path.replace(".json", ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

        core = self.core

        class Cache(dict):
            def __missing__(self, pretoken: str) -> bytes:
                ids = np.array(core.encode_single_piece(pretoken.encode()), dtype="<u4").tobytes()
                if len(self) < CACHE_ENTRIES:
                    self[pretoken] = ids
                return ids

        self.cache = Cache()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, _BYTE.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids as the library gives them without special tokens added; special strings in a text are special, its default."""
        if _BEYOND.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if "<|" in text:
            parts = self.split_special.split(text)
            return np.frombuffer(b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts)), dtype="<u4")
        return np.frombuffer(self._plain(text), dtype="<u4")
