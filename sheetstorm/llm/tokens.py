"""Byte-level BPE vocabularies: ranks from either file format, and a cached encoder for tasks."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

#: Fixed value: the pattern that splits texts before byte-level BPE merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_letter() -> dict[str, int]:
    """The JSON format writes bytes as letters: visible Latin-1 as itself, the others from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a .json vocabulary or a file of ranks. Special tokens are left out."""
    if path.endswith(".json"):
        letters, special = _byte_of_letter(), special_tokens(path)
        with open(path, "rb") as file:
            return {bytes(letters[c] for c in token): rank for token, rank in json.load(file)["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def special_tokens(path: str) -> dict[str, int]:
    """Marks that a .json vocabulary takes out of texts before anything else, with their ids; rank files have none."""
    if not path.endswith(".json"):
        return {}
    with open(path, "rb") as file:
        return {x["content"]: x["id"] for x in json.load(file).get("added_tokens", ())}


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a vocabulary, once for each Python worker; path is readable on every executor."""
    import tiktoken

    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens=special_tokens(path))
