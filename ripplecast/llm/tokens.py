"""Byte-level BPE of whole texts, with the ids of the tokenizers library.

A vocabulary whose merges stand in the order of their ids gives the same ids by rank: the pair
with the lowest id merges first. Such texts go through a rank encoder built from the vocabulary
file itself, which is several times as fast; texts that hold an added token, and vocabularies of
another build, go through the library. Tests hold one against the other.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import tiktoken

# Fixed value: how byte-level vocabularies of this kind split a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet: bytes without a glyph follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _is_ranked(spec: dict) -> bool:
    """Whether merging by lowest id is what the file asks for."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and model.get("type", "BPE") == "BPE"
        and not any(model.get(name) for name in ("dropout", "byte_fallback", "ignore_merges"))
        and not any(model.get(name) for name in ("continuing_subword_prefix", "end_of_word_suffix"))
    )
    if not plain:
        return False
    pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"])
    made = [model["vocab"].get("".join(pair), -1) for pair in pairs]
    singles = [i for token, i in model["vocab"].items() if len(token) == 1]
    in_order = all(a < b for a, b in zip([max(singles), *made], made))
    return in_order and len(singles) == 256 and len(singles) + len(made) == len(model["vocab"])


class Codec:
    """Encodes whole texts to little-endian ids and decodes ids to bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"] | added
        self.size = 1 + max(vocabulary.values())
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        byte_of = _byte_of()
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocabulary.items():
            plain = token in added or any(c not in byte_of for c in token)
            self.bytes_of[i] = token.encode() if plain else bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        # added tokens may take blanks around them along, so any text that holds one is left to the library
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        ranked = [i for token, i in spec["model"]["vocab"].items() if token not in added]
        self.ranks = {self.bytes_of[i]: i for i in ranked} if _is_ranked(spec) else None

    @functools.cached_property
    def decimals(self) -> list[bytes]:
        return [b"%d," % i for i in range(self.size)]

    @functools.cached_property
    def tokenizer(self):
        """The library's tokenizer; workers that do not need it never load it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    @functools.cached_property
    def by_rank(self) -> tiktoken.Encoding:
        return tiktoken.Encoding(self.path, pat_str=_SPLIT, mergeable_ranks=self.ranks, special_tokens={})

    def library(self, texts: list[str]) -> list[bytes]:
        """Ids from the library, whatever the texts hold."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as bytes of ``dtype``."""
        if self.ranks is None:
            return self.library(texts)
        return [
            self.library([text])[0]
            if self.added is not None and self.added.search(text)
            else np.array(self.by_rank.encode_ordinary(text), dtype=self.dtype).tobytes()
            for text in texts
        ]

    def ids(self, coded: bytes) -> np.ndarray:
        return np.frombuffer(coded, dtype=self.dtype)

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by commas."""
        return b"".join(map(self.decimals.__getitem__, ids.tolist()))[:-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text the ids stand for; broken sequences become U+FFFD."""
        joined = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        try:
            joined.decode()
        except UnicodeDecodeError:
            return joined.decode(errors="replace").encode()
        return joined


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each vocabulary file and Python worker."""
    return Codec(path)
