"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from pathlib import Path

#: A run of so much white space, or more, is too much for the rank encoder's pattern matcher (it fails near 10**6).
LONG_SPACE = 100_000
_LONG = re.compile(r"\s{%d}" % LONG_SPACE)


def encoder(path: str | None = None, added: bool = False) -> Callable[[str], list[int]]:
    """Text to ids. ``path`` names a rank file; the default is the public 50k vocabulary's.

    The rank file and the vocabulary's JSON file beside it hold the same merges; the tests compare the ids of both. The
    rank file's encoder is five times as fast, so the JSON file's takes only texts with a white-space run of LONG_SPACE
    or more. Names of special tokens in a text are ordinary text, unless ``added`` is set: then each token that the JSON
    file adds gets its one id wherever its name stands. Lone surrogates cannot come from Spark strings.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special: dict[str, int] = {}
    vocabulary, whole = Path(path).with_suffix(".json"), None
    if vocabulary.exists():
        if added:
            special = {t["content"]: t["id"] for t in json.loads(vocabulary.read_text("utf-8"))["added_tokens"]}
        whole = Tokenizer.from_file(str(vocabulary))
        whole.encode_special_tokens = not added
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if whole and len(text) >= LONG_SPACE and _LONG.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return encoding.encode(text, allowed_special="all") if special else encoding.encode_ordinary(text)

    return encode
