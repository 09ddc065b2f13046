"""Token ids of whole texts with the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Latin and common punctuation, on which both libraries split alike whatever their Unicode version; others go to the slower library.
_COMMON = re.compile("[^\\x00-ſ‐-‧€]")


def vocabulary_paths() -> tuple[str, str]:
    """The JSON file and the rank file of the default vocabulary; both hold the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, json_path: str, rank_path: str) -> list[int]:
    """Ids as ``Tokenizer.from_file(json_path).encode(text, add_special_tokens=False)`` gives them; none for null.

    The rank file gives the same ids several times faster; texts with characters outside ``_COMMON`` or with the special
    token's string take the JSON file.
    """
    if not text:
        return []
    if SPECIAL in text or _COMMON.search(text):
        return _slow(json_path).encode(text, add_special_tokens=False).ids
    return _fast(rank_path).encode_ordinary(text)
