"""Token ids of the byte-level BPE, by a fast path that gives the same ids as its ``tokenizers`` file."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

SPECIAL = "<|endoftext|>"
_SPACES = re.compile(r"\s\s")


@lru_cache(maxsize=4)
def encoder(path: str, ordinary: bool = False):
    """text -> list of ids, as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Where the same vocabulary lies beside the file as ranks, most texts go through tiktoken.  Its pattern looks ahead
    only to split runs of white space, so texts without such runs take the pattern without that part, which its engine
    matches several times faster.  Texts that spell a special token, and files without ranks, go to ``tokenizers``.  With
    ``ordinary``, special tokens spelt in a text are ordinary text.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = ordinary

    def whole(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    ranks_path = path[: -len(".json")] + ".tiktoken"
    if not (path.endswith("byte_bpe_50k.json") and os.path.exists(ranks_path)):
        return whole
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if SPECIAL in text and not ordinary:
            return whole(text)
        return full(text) if _SPACES.search(text) else plain(text)

    return encode


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
