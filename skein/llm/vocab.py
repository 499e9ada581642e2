"""Public vocabularies, loaded once per Python worker. Files stay where they are installed."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a whole text under a byte-level vocabulary file, as ``tokenizers`` gives them without adding special ids.

    Special strings in a text have their special id. The ids come from tiktoken over
    the file's own ranks, several times faster; a text that its pattern cannot work
    through (very long runs of blanks) goes to ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    special = {t["content"]: t["id"] for t in read["added_tokens"]}
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


@lru_cache(maxsize=4)
def pieces(path: str):
    """A sentencepiece vocabulary: the processor and which of its ids are byte-fallback pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fallback = np.fromiter((model.is_byte(i) for i in range(model.get_piece_size())), dtype=bool)
    return model, fallback
