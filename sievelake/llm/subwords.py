"""Public subword tokenizers, loaded once per Python worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files; every operator that tokenizes takes it as a parameter.
VOCABULARIES = os.environ.get("SIEVELAKE_VOCABULARIES", "/opt/tokenizers")
BYTE_BPE = f"{VOCABULARIES}/byte_bpe_50k.tiktoken"
MULTILINGUAL = f"{VOCABULARIES}/byte_bpe_multi_50k.tiktoken"

#: Characters encoded at once where only the number of subwords counts.
STRETCH = 4096

#: Fixed value: the public pre-tokenization pattern of byte-level BPE.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """A tiktoken encoder over the ranks in ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def chars_per_subword(text: str, path: str) -> float:
    """Mean characters per subword: about 4 for words, below 2.5 for random strings.

    The text is taken in stretches, so that the time stays in proportion to it.
    """
    encode = encoder(path).encode_ordinary
    return len(text) / max(1, sum(len(encode(text[at : at + STRETCH])) for at in range(0, len(text), STRETCH)))
