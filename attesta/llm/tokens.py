"""Token ids of public vocabularies."""

from __future__ import annotations

import array
import base64
import re
from collections.abc import Iterable, Iterator, Mapping
from types import MappingProxyType

import tiktoken

#: Added tokens of the public byte-level vocabulary's JSON file (fixed values).
BYTE_BPE_SPECIAL = {"<|endoftext|>": 50256}

#: The only part of the public pattern that looks ahead; it matters where white space meets white space.
_AHEAD = r"|\s+(?!\S)"
_TWO_SPACES = re.compile(r"\s\s")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Encodes texts with a byte-level vocabulary given as a file of ranks.

    The ids are those of the ``tokenizers`` library for the same vocabulary
    (``tests/llm`` compares them), several times faster. ``special`` are the
    vocabulary's added tokens: where a text holds such a token's string, the
    library takes it for the token and encodes what stands between on its own,
    and so does this. Texts in which no white space follows on white space take
    the pattern without its look-ahead, which gives the same pieces there and
    runs as a plain automaton.
    """

    def __init__(self, path: str, special: Mapping[str, int] = MappingProxyType({})):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        whole = public_tokenizers.PATTERN
        self.whole = tiktoken.Encoding(path, pat_str=whole, mergeable_ranks=ranks, special_tokens={})
        self.special = dict(special)
        self.added = re.compile("|".join(f"({re.escape(x)})" for x in sorted(special, key=len, reverse=True))) if special else None
        self.plain = tiktoken.Encoding(path + "#", pat_str=whole.replace(_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            return [i for p in parts if p for i in ([self.special[p]] if p in self.special else self._ordinary(p))]
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        encoding = self.whole if _TWO_SPACES.search(text) else self.plain
        return encoding.encode_ordinary(text)

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        for text in texts:
            yield array.array("I", self.ids(text)).tobytes()
