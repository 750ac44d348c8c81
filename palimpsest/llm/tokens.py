"""Byte-level BPE token ids for whole texts."""

from __future__ import annotations

import os
import re

_LOADED: dict = {}
#: Texts within Latin script take the fast encoder, which gives the same ids;
#: others, and those that spell the special token, take the reference encoder.
_OTHER = re.compile("[^\x00-ɏ‐-‧€]|<\\|endoftext\\|>")


def vocabulary_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of the vocabulary for the two encoders."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """ids(texts) -> one uint32 array per text.

    The ids are those of ``tokenizers`` for the JSON vocabulary without added
    special tokens. With ``plain_special`` the special token's string in a text
    is ordinary text, so no id of a text is the special id.
    """

    def __init__(self, json_path: str, ranks_path: str | None, plain_special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.exact.encode_special_tokens = plain_special
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list:
        import numpy as np

        out: list = [None] * len(texts)
        slow = []
        seen: dict[str, int] = {}
        for i, text in enumerate(texts):
            if text in seen:
                continue
            seen[text] = i
            if self.fast is None or _OTHER.search(text):
                slow.append(i)
            else:
                out[i] = self.fast.encode_to_numpy(text)
        for k in range(0, len(slow), 64):
            part = slow[k : k + 64]
            for i, e in zip(part, self.exact.encode_batch([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype=np.uint32)
        return [out[seen[text]].astype(np.uint32, copy=False) for text in texts]


def encoder(json_path: str, ranks_path: str | None, plain_special: bool = False) -> Encoder:
    """The worker's encoder, loaded once a process."""
    key = (json_path, ranks_path, plain_special)
    if key not in _LOADED:
        _LOADED[key] = Encoder(*key)
    return _LOADED[key]
