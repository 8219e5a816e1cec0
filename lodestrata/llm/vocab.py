"""Public tokenizer vocabularies, loaded once per Python worker."""

from __future__ import annotations

import base64
import functools

DEFAULT = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """A byte-level BPE encoding from a rank file; special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path.rsplit("/", 1)[-1], pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: the split pattern that belongs to the byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(tokenizer_dir: str = TOKENIZER_DIR) -> str:
    return f"{tokenizer_dir}/{DEFAULT}"


def chars_per_subword(text: str, path: str) -> float:
    """Low for strings that no natural text contains: random keys, passwords with replaced letters."""
    return len(text) / max(1, len(encoding(path).encode_ordinary(text)))
