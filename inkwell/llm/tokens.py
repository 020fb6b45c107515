"""Fast exact token ids for many texts, used inside tasks.

The vocabulary is given as a ``tokenizers`` file. Where it is a byte-level BPE with the usual pattern and
ids in merge order, ``tiktoken`` is set up from the same file, since it gives the same ids in a fraction
of the time; other tokenizers, and texts with a run of thousands of characters without white space, for
which it would be slow, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json

import numpy as np

#: Fixed value: the pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 4000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The visible character that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and special tokens for tiktoken, or None where it could give other ids."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if (
        model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
        or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout")
        or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", []))
    ):
        return None
    byte_of = _byte_of()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(model["vocab"].get("".join(m)) != 256 + k for k, m in enumerate(merges)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}, special


class TokenBytes:
    """Ids of a text as little-endian unsigned 32-bit integers, without added special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.plain, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            found = _ranks(json.load(f))
        if found:
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=found[0], special_tokens=found[1])

    def __call__(self, text: str) -> bytes:
        if self.fast and (len(text) < LONG_RUN or max(map(len, text.split()), default=0) < LONG_RUN):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
