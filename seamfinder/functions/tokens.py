"""Exact token counts, by a vocabulary file that the caller names."""

from __future__ import annotations

import functools
from collections.abc import Callable

#: A function from texts to their numbers of tokens; it is sent to the tasks.
Counter = Callable[[list[str]], list[int]]


@functools.lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})


def byte_pairs(path: str, pattern: str) -> Counter:
    """Counts by byte-pair ranks in a file that every machine has at this path; pattern divides texts into pieces first. Null counts as empty."""

    def count(texts: list[str]) -> list[int]:
        own = _encoding(path, pattern)
        return [len(own.encode_ordinary(t or "")) for t in texts]

    return count
