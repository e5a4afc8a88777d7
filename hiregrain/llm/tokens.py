"""Token ids of a byte-level BPE vocabulary file.

Where the file's merges are ordered like its ids, ids follow from the tokens' ranks alone, and a rank encoder gives them a
good deal faster than the general one, whole text by whole text. Texts that spell a special token, which the general encoder
reads as one, texts with endless runs of white space, and vocabularies of another kind go through that one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Sequence
from typing import Any

from hiregrain.llm.common import worker_cache

DEEP = 50_000  # the rank encoder's splitting goes one call deeper with every blank of a run


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(vocabulary: dict[str, Any]) -> dict[bytes, int] | None:
    """Token bytes with their ids, if ids tell which merge comes first; else None."""
    model, splitting = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(o) for o in options) or vocabulary.get("normalizer") or vocabulary.get("post_processor"):
        return None
    if splitting.get("type") != "ByteLevel" or splitting.get("add_prefix_space") or not splitting.get("use_regex", True):
        return None
    special = {t["content"] for t in vocabulary.get("added_tokens") or []}
    letters, ids = byte_of(), {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(x >= y for x, y in zip(merged, merged[1:])) or len(merged) + 256 != len(ids) or not all(c in letters for t in ids for c in t):
        return None
    return {bytes(letters[c] for c in t): i for t, i in ids.items()}


class ChunkIds:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self.special = [t["content"] for t in vocabulary.get("added_tokens") or []]
        self.ranked = None
        ranks = ranks_of(vocabulary)
        if ranks:
            import public_tokenizers
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if array("I").itemsize != 4 or array("H", [1]).tobytes() != b"\x01\x00":
            raise RuntimeError("needs a little-endian machine with 32-bit unsigned ints")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return [array("I", self._ids(t)).tobytes() for t in texts]

    def _ids(self, text: str) -> list[int]:
        if self.ranked is None or any(s in text for s in self.special) or (len(text) > DEEP and re.search(rf"\s{{{DEEP}}}", text)):
            return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.ranked.encode_ordinary(text)


def chunk_ids(path: str) -> ChunkIds:
    """The worker's encoder for the vocabulary file at ``path``."""

    def build() -> ChunkIds:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return ChunkIds(path)

    return worker_cache(("chunk_ids", path), build)
