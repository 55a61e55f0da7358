"""Exact token ids of a byte-level BPE file for the ``tokenizers`` library, quickly.

The ids are those of ``Tokenizer.from_file(path)`` with special strings treated as
ordinary text. Texts of Latin characters, on which every Unicode version agrees
about letters, digits and blanks, are encoded with the same vocabulary by
tiktoken's faster merge loop; any other text goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers

JSON_FILE = "byte_bpe_50k.json"
_OTHER = re.compile("[^\t-\r -~\xa0-ɏ]")


def byte_letters() -> dict[str, int]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class JsonBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as unsigned 32-bit integers."""
        if _OTHER.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


@lru_cache(maxsize=2)
def json_bpe(path: str) -> JsonBpe:
    """One encoder per worker process and file."""
    return JsonBpe(path)


def default_path() -> str:
    return public_tokenizers.path(JSON_FILE)
