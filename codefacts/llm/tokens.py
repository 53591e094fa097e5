"""Tokenising inside tasks. The vocabulary is read on each worker; its place is a parameter."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: Fixed value: the text of the vocabulary's only special token, and its id.
END_TEXT, END_ID = "<|endoftext|>", 50256

_PLAIN = re.compile("[^\x00-\x7f¡-ɐ‐-‧]")


class Encoder:
    """Ids of whole texts by the vocabulary file ``path`` (a ``tokenizers`` JSON).

    The same merges run through ``tiktoken``, which is several times faster and
    gives the same ids; texts with characters on which the two libraries'
    character tables might differ, or with the special token's text, go
    through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        import json

        self.exact = Tokenizer.from_file(path)
        letters = _byte_letters()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word != END_TEXT}
        self.fast = tiktoken.Encoding("bytes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids; null and empty texts have none."""
        if not text:
            return np.zeros(0, np.uint32)
        if END_TEXT in text or _PLAIN.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


# Fixed value: how the vocabulary cuts a text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
