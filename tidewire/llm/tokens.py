"""Token ids of a public byte-level vocabulary, inside tasks.

``public_tokenizers.path`` gives the vocabulary's file on every machine that has the library. The rank file holds the
same vocabulary as the JSON file but for its added token, the literal END_OF_TEXT_LITERAL, which is named here: the same
ids come out, and it is read by a faster encoder."""

from __future__ import annotations

import base64
from functools import lru_cache

END_OF_TEXT = 50256
END_OF_TEXT_LITERAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(ranks_file: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_file), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={END_OF_TEXT_LITERAL: END_OF_TEXT})


def encoder(ranks_file: str = "byte_bpe_50k.tiktoken"):
    """A function from text to a list of ids; the literal of the added token is its id."""
    plain, whole = _encoder(ranks_file).encode_ordinary, _encoder(ranks_file).encode

    def encode(text: str) -> list[int]:
        return whole(text, allowed_special="all") if END_OF_TEXT_LITERAL in text else plain(text)

    return encode
