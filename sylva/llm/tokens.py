"""Public tokenizer vocabularies, loaded once per Python worker."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers
import tiktoken

#: The rank file that holds the vocabulary of byte_bpe_50k.json: the same ids, several times as fast.
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: The rank file of a vocabulary for many languages.
BYTE_BPE_MULTI = "byte_bpe_multi_50k.tiktoken"
#: The named file itself, for its added tokens.
BYTE_BPE_JSON = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def encoder(ranks: str = BYTE_BPE, added: str | None = None) -> tiktoken.Encoding:
    """The encoding of a rank file, a name known to ``public_tokenizers`` or a path.

    ``added`` is a tokenizer's JSON file whose added tokens are special tokens of the encoding; without it
    there are none, and their strings in a text are ordinary text.
    """
    path = ranks if "/" in ranks else public_tokenizers.path(ranks)
    with open(path, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    special: dict[str, int] = {}
    if added:
        with open(added if "/" in added else public_tokenizers.path(added), encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=special)
