"""Token ids of whole texts.

Ids are those of the public byte-level BPE with 50,257 entries; strings of
special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np


@cache
def encoding(name: str = "byte_bpe_50k.tiktoken"):
    """The vocabulary, loaded once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def patient(name: str = "byte_bpe_50k.json"):
    """The same vocabulary in the library that has no limit on runs of white space; slower."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def token_ids(text: str) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a text."""
    try:
        return encoding().encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    except ValueError:  # its pattern gives up on about a million white-space characters in a row
        return np.array(patient().encode(text, add_special_tokens=False).ids, "<u4")
