"""Token counts by public tokenizers, whose files are named by path and loaded once per worker."""

from __future__ import annotations

import os
from collections.abc import Callable

DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
DEFAULT = f"{DIR}/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that belongs to the vocabulary in byte_bpe_50k.tiktoken.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def counter(path: str | None = DEFAULT) -> Callable[[list[str]], list[int]]:
    """Counts tokens of many texts. `path` ends in .tiktoken, .json or .model; None counts UTF-8 bytes."""
    if path is None:
        return lambda texts: [len(t.encode("utf-8", "replace")) for t in texts]
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as h:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, h)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
