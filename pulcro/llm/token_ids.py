"""Token ids of whole texts, with a bounded memory of words already met."""

from __future__ import annotations

import base64
import os
import re
import struct

#: Words kept in memory by one Python worker, and the longest word that is kept.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Letters up to here are letters to every version of the Unicode tables that the libraries carry.
SETTLED = "ɏ"
_SPACES = re.compile(r"\s\s")
_ENCODERS: dict[tuple[str, str | None], TextEncoder] = {}


class _Words(dict):
    """Ids of a word that follows a space; a new word is encoded and, while there is room, kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


class TextEncoder:
    """Little-endian 32-bit ids of a text, equal to those the tokenizer gives for the whole text.

    The pre-tokenizer of a byte-level vocabulary starts a piece at every single space between
    visible characters, so such a text is encoded word by word and words are looked up. Texts with
    two white spaces in a row, or with a special token, are encoded whole by the tokenizer. New
    words of settled letters are encoded from ``ranks``, the same vocabulary as a table of ranks, if
    it is given; that is several times faster for single words and gives the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )
        self.words = _Words(self._word)

    def _word(self, text: str) -> bytes:
        if self.fast is not None and (text.isascii() or max(text) <= SETTLED):
            ids = self.fast.encode_ordinary(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPACES.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        head = self._word(first) if first else b""
        return head + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str, ranks: str | None = None) -> TextEncoder:
    """One encoder a worker process: its words serve all tasks that run there."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = TextEncoder(path, ranks)
    return _ENCODERS[path, ranks]
