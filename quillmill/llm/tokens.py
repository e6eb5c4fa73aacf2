"""Token ids of a public byte-level vocabulary, read where it is installed.

The ids are those of the vocabulary's ``tokenizers`` file. Its rank file gives
the same (a test compares them) at several times the speed, but for the strings
of added tokens, which ``tokenizers`` takes as those tokens; so the rank file
is taken, where present, for texts without such a string.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY):
    """A function from a text to its ids (uint32), as ``tokenizers`` gives them with ``add_special_tokens=False``."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    ranks = public_tokenizers.path(vocabulary.removesuffix(".json") + ".tiktoken")
    if not os.path.exists(ranks):
        return lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(t in text for t in added):
            return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode
