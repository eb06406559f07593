"""Byte-level BPE over the public 50k vocabularies, one encoder per Python worker."""

from __future__ import annotations

import base64
import os

import numpy as np
import tiktoken

#: Fixed value: the special string of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}
DEFAULT = "byte_bpe_50k"
#: Fixed value: the one alternative of the public pattern that looks ahead.
AHEAD = r"|\s+(?!\S)"


def vocabulary_path(name: str, ending: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` or TOKENIZER_DIR override the installed package."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name + ending)
    import public_tokenizers

    return public_tokenizers.path(name + ending)


def grouped(pattern: str) -> str:
    """The same alternatives in the same order, those before the one that looks ahead as a group.

    The library hands a part without look-ahead to a machine that reads each character
    once; ungrouped alternatives beside one with look-ahead are tried one after the other.
    """
    plain, ahead, rest = pattern.partition(AHEAD)
    return f"(?:{plain}){ahead}{rest}" if ahead else pattern


class ByteBpe:
    """Encoder whose ids equal those of the vocabulary's JSON file with ``add_special_tokens=False``."""

    def __init__(self, name: str = DEFAULT, folder: str | None = None):
        import public_tokenizers

        with open(vocabulary_path(name, ".tiktoken", folder), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(name, pat_str=grouped(public_tokenizers.PATTERN), mergeable_ranks=self.ranks, special_tokens=SPECIAL)
        self.allowed = frozenset(SPECIAL)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text (uint32); null and empty give none. The special string is one id."""
        if not text:
            return np.empty(0, dtype=np.uint32)
        return self.encoding.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())

    def fragments(self) -> np.ndarray:
        """For each id: its bytes are no whole characters (a piece of a multi-byte character)."""
        out = np.zeros(max(self.ranks.values()) + 2, dtype=bool)
        for token, i in self.ranks.items():
            try:
                token.decode("utf-8")
            except UnicodeDecodeError:
                out[i] = True
        return out


_loaded: dict[tuple, ByteBpe] = {}


def load(name: str = DEFAULT, folder: str | None = None) -> ByteBpe:
    """The worker's own encoder of that vocabulary."""
    key = (name, folder)
    if key not in _loaded:
        _loaded[key] = ByteBpe(name, folder)
    return _loaded[key]
