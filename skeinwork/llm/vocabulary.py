"""Byte-level BPE vocabularies, read from the tokenizer files that are installed beside Python on every node."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
import tokenizers

DEFAULT_PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Fixed value: the pre-tokenizer pattern of this vocabulary.
PATTERN = public_tokenizers.PATTERN


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_PATH) -> dict:
    """tokens: id -> bytes; ids: bytes -> id; merges: (left id, right id) in rank order; special: text -> id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    tokens = {i: t.encode() if t in special else bytes(letters[c] for c in t) for t, i in vocab.items()}
    tokens |= {i: t.encode() for t, i in special.items()}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {
        "tokens": [tokens.get(i, b"") for i in range(max(tokens) + 1)],
        "ids": {b: i for i, b in tokens.items() if b.decode("latin-1") not in special},
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs],
        "special": special,
    }


@lru_cache(maxsize=4)
def fast_encoder(path: str = DEFAULT_PATH) -> tiktoken.Encoding:
    """The same ids as the tokenizers library gives, several times as fast; merge ranks are id order in these files."""
    v = load(path)
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=v["ids"], special_tokens=v["special"])


@lru_cache(maxsize=4)
def library(path: str = DEFAULT_PATH) -> tokenizers.Tokenizer:
    """The tokenizers library's own encoder, without truncation and padding."""
    made = tokenizers.Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


#: A plain space between two other characters: a piece begins at it, and no piece or special token spans it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_PART = 1 << 20


def _parts(text: str) -> Iterator[str]:
    """The text cut at such spaces into parts of about _PART characters, so that what is hard about it stands by itself."""
    at = 0
    while len(text) - at > _PART:
        found = _SAFE.search(text, at + _PART)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(text: str | None, path: str = DEFAULT_PATH):
    """ids of a text as a uint32 array, those of the tokenizers library; special tokens' strings in the text become their ids.

    The fast encoder gives up on runs of about a million white-space characters. Of such a text only the part with the run goes to the library, which is slower.
    """
    fast = fast_encoder(path)
    try:
        return fast.encode_to_numpy(text or "", allowed_special="all")
    except ValueError:
        out = []
        for part in _parts(text):
            try:
                out.append(fast.encode_to_numpy(part, allowed_special="all"))
            except ValueError:
                out.append(np.array(library(path).encode_batch_fast([part], add_special_tokens=False)[0].ids, np.uint32))
        return np.concatenate(out)
