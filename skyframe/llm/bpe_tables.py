"""The public vocabulary file that the token operators read; its path is a parameter everywhere."""

from __future__ import annotations

import json
from functools import lru_cache


def default_vocabulary() -> str:
    """Path of the byte-level BPE vocabulary of 50,257 entries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the other bytes get the code points from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def to_bytes(token: str) -> bytes:
    """The bytes of a vocabulary entry."""
    back = {c: b for b, c in byte_letters().items()}
    return bytes(back[c] for c in token)


@lru_cache(maxsize=2)
def load(path: str) -> dict:
    """Parts of a vocabulary file: tokens by id as bytes, merges as pairs of ids in rank order, special strings."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    vocab, special = raw["model"]["vocab"], {x["content"]: x["id"] for x in raw["added_tokens"]}
    back = {c: b for b, c in byte_letters().items()}
    by_id = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in special}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in raw["model"]["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    return {"by_id": by_id, "merges": merges, "special": special, "bytes": [vocab[byte_letters()[b]] for b in range(256)]}
