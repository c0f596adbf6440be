"""Reading a word-level BPE vocabulary file and cutting texts into its pre-tokens.

Only the parts used by the vocabulary format with word ends are supported: NFC, white space collapsed,
lower case, a split pattern, byte-level symbols, merges with an end-of-word suffix and literal special tokens.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex

#: By symbol, the ranks of its merges by the symbol after it; by rank, the made symbol.
Merges = tuple[list[dict[int, int]], list[int]]

#: Control characters that str.split() takes as white space and the vocabulary's pattern does not.
ODD_SPACES = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class Vocabulary:
    """Symbols, merges and pre-tokenisation rules of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        none: dict[int, int] = {}
        follow = [none] * (max(self.strings) + 1)
        for (a, b), (rank, _) in self.merges.items():
            follow[a] = follow[a] or {}
            follow[a][b] = rank
        self.table: Merges = (follow, [self.ids[a + b] for a, b in model["merges"]])
        symbols = byte_symbols()
        self.inner = [self.ids[s] for s in symbols]
        self.last = [self.ids[s + self.suffix] for s in symbols]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pre_tokens(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a piece of text without white space; a special string comes as its id."""
        out: list[str | int] = []
        if chunk.isascii() and not (self.special_split and self.special_split.search(chunk)):
            return self.split.findall(chunk.lower())
        for part in self.special_split.split(chunk) if self.special_split else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.split.findall(normal(part))
        return out

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        out = [self.inner[b] for b in raw]
        out[-1] = self.last[raw[-1]]
        return out


def normal(text: str) -> str:
    """NFC in lower case.  Lower-casing goes character by character: no final-sigma rule."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def chunks(text: str) -> list[str]:
    """Pieces between white space.  No rule of the vocabulary crosses white space, so each piece stands alone."""
    return SPACES.split(text) if ODD_SPACES.search(text) else text.split()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
