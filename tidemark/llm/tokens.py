"""Byte-level BPE from a file of ranks, as little-endian 32-bit ids.

The ranks file and the tokenizer file of a vocabulary give the same ids; reading ranks is the
faster of the two. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import numpy as np

# Units of the vocabulary: endings, words, numbers, other signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoder(path: str) -> Callable[[str | None], bytes]:
    """A function from a text to its ids; one per worker and file. A null has none."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: np.array(encode(text), "<u4").tobytes() if text else b""
