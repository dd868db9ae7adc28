"""Byte-level BPE ids of whole texts, as little-endian unsigned 32-bit bytes.

The vocabulary file is a parameter.  The split pattern looks ahead only to
leave the last of several white-space characters to the next word; for a text
without two neighbouring ones (nearly all) the pattern below splits alike and
needs no look-ahead, which halves the time.  A test holds both against the
``tokenizers`` library.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np

END_ID = 2
_RUN = re.compile(r"\s\s")
# Fixed value: the byte-level split pattern, its white-space part reduced to
# one character.
SINGLE_SPACE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_ENCODERS: dict[str, "TextEncoder"] = {}


class TextEncoder:
    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {"<|endoftext|>": len(ranks)}
        self.runs = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.single = tiktoken.Encoding("single", pat_str=SINGLE_SPACE_PATTERN, mergeable_ranks=ranks,
                                        special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        """Ids of the text and the end id."""
        enc = self.runs if _RUN.search(text) else self.single
        return np.append(enc.encode_to_numpy(text, allowed_special="all"), END_ID).astype("<u4")


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path, pattern)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole up to ``capacity``,
    else full pieces after a first one that takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def crc(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF
