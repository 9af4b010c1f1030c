"""Token ids of whole texts, by a byte-level BPE vocabulary file of ``tokenizers``."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: how a byte-level BPE of this kind parts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space of that pattern, and the length from which a run of it is encoded by itself: looking ahead at its end costs the
#: pattern's matcher a stack as deep as the run is long.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 20_000
_RUN = re.compile(f"[{_WHITE}]{{{LONG_RUN},}}")


def default_tokenizer() -> str:
    """The vocabulary file used where none is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_by_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts by a vocabulary file: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    Built from the ``tokenizers`` file itself, whose merges are in the order of the ids (tests hold one against the other), and
    several times faster. ``sizes`` has the number of bytes of each id.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"added tokens that take in or need their surroundings: {path}")
        letters = _bytes_by_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
        by_id = {i: len(token) for token, i in ranks.items()} | {i: len(token.encode()) for token, i in self.added.items()}
        self.sizes = np.zeros(max(by_id) + 1, np.int64)
        self.sizes[list(by_id)] = list(by_id.values())
        self._parted = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = tiktoken.Encoding("piece", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        longest_first = sorted(self.added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def encode_ordinary(self, text: str) -> list[int]:
        """Ids of a text whose added tokens, if any, are read as ordinary text."""
        if len(text) < LONG_RUN:
            return self._parted.encode_ordinary(text)
        out: list[int] = []
        at = 0
        for run in _RUN.finditer(text):
            out += self._parted.encode_ordinary(text[at : run.start()])
            # a run is one piece, but for its last character where text follows
            at = run.end() - (run.end() < len(text))
            out += self._whole.encode_ordinary(text[run.start() : at])
        return out + self._parted.encode_ordinary(text[at:])

    def encode(self, text: str) -> list[int]:
        """Ids of a text that is split at the file's added tokens, which get their own ids."""
        if self._split is None or not any(token in text for token in self.added):
            return self.encode_ordinary(text)
        out: list[int] = []
        for part in self._split.split(text):
            out += [self.added[part]] if part in self.added else self.encode_ordinary(part)
        return out


@lru_cache(2)
def encoder(path: str) -> tuple[Encoder, np.ndarray]:
    """The file's encoder, one for each task's process, and the number of bytes of each id."""
    own = Encoder(path)
    return own, own.sizes


def text_of(value) -> str:
    """An Arrow string (or null) as text; bytes that are no UTF-8 become replacement characters."""
    return value.as_buffer().to_pybytes().decode("utf-8", "replace") if value.is_valid else ""
