"""Exact token ids of whole texts."""

from __future__ import annotations

import base64
import json
import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the tokenizer of a byte-level BPE JSON file gives them with add_special_tokens=False.

    Ranks beside the JSON (same name, .tiktoken) give the same ids faster; a text that holds a special token's string, or
    any text where there are no ranks, goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer, self.plain = path, None, None
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def ids(self, text: str | None) -> np.ndarray:
        """Little-endian unsigned 32-bit ids; null counts as empty."""
        text = text or ""
        if self.plain is not None and not any(x in text for x in self.special):
            return np.array(self.plain(text), "<u4")
        if self.tokenizer is None:  # most workers never need it
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
