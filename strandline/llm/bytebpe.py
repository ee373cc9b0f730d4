"""Byte-level BPE ids from a tokenizer file of the ``tokenizers`` library.

The file's vocabulary is ranked by id, so a ranked encoder gives the same ids several times faster;
that is checked when the file is read (every merge must make the next id) and in the tests. Texts
that hold the string of a special token are encoded by the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Fixed value: the pre-tokeniser pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        for i, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if vocab[left + right] != 256 + i:
                raise ValueError(f"merge {i} of {path} doesn't make id {256 + i}")
        ranks = {bytes(letters[c] for c in token): rank for token, rank in vocab.items()}
        self.path = path
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = None

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids of a whole text; null is empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)
