"""The public byte-level BPE: ids and character offsets of whole texts.

Ids are those of ``tokenizers`` on the vocabulary file with
``add_special_tokens=False``. The same vocabulary and the same split pattern
run several times faster in ``tiktoken``, so that encodes a text unless it
holds a special token's string or a run without blanks of over ``LONG_RUN``
characters (there tiktoken's merge is quadratic); those go to ``tokenizers``.
A test holds the two against each other.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
LONG_RUN = 20_000


class Encoder:
    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path = json_path
        self.fast = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.long_run = re.compile(r"\S{%d,}" % LONG_RUN)

    @cached_property
    def exact(self):
        """The ``tokenizers`` object; made for the first text that needs it, as it takes more memory than all else here."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    @cached_property
    def starts(self) -> np.ndarray:
        """Characters that begin in each token's bytes: all but UTF-8's continuation bytes."""
        ranks = self.fast._mergeable_ranks
        starts = np.zeros(max(ranks.values()) + 2, np.int32)
        for token, i in ranks.items():
            starts[i] = sum(c & 0xC0 != 0x80 for c in token)
        for x, i in self.exact.get_vocab(with_added_tokens=True).items():
            if x in self.special:
                if i >= len(starts):
                    starts = np.r_[starts, np.zeros(i + 1 - len(starts), np.int32)]
                starts[i] = len(x)
        return starts

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text."""
        if any(s in text for s in self.special) or len(text) >= LONG_RUN and self.long_run.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token. A token that starts inside a character starts at that character."""
        ids = self.ids(text)
        count = self.starts[ids].astype(np.int64)
        end = np.cumsum(count)
        begins_inside = np.array([], bool) if not len(ids) else ~self.begins[ids]
        return end - count - begins_inside, end

    @property
    def begins(self) -> np.ndarray:
        """Whether each token's first byte begins a character."""
        if not hasattr(self, "_begins"):
            self._begins = np.ones(len(self.starts), bool)
            for token, i in self.fast._mergeable_ranks.items():
                self._begins[i] = token[0] & 0xC0 != 0x80
        return self._begins


@lru_cache(1)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each Python worker; the files come with the public_tokenizers package of each machine."""
    import public_tokenizers as public

    return Encoder(public.path(f"{vocabulary}.json"), public.path(f"{vocabulary}.tiktoken"), public.PATTERN)
