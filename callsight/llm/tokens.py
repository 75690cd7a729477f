"""Token ids of whole texts by a ``tokenizers`` file, with the ids of repeated words remembered.

The library's pre-tokenizers never join text across white space, so a text is cut at white space first and the ids of
each cut are remembered in the Python worker (a bounded memory). A cut that is new goes through the file's own
pre-tokenizer rule and the library's model, or, where it holds characters outside plain Latin text, through the whole
library. A file with other rules than the two kinds known here is left to the library as a whole. ``tests/llm/test_tokens.py`` compares the result with a direct ``encode`` call.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

#: Unicode White_Space, as in the tokenizers' own ``\s``.
WHITE = "\t-\r \x85\xa0  -     　"
#: Characters whose letter, digit and lower-case rules are the same in Python and in the tokenizers, and that NFC keeps.
PLAIN = re.compile("[\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
#: A cut that is one run of letters, after at most one space: no rule parts it.
LETTERS = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Remembered words and cuts per worker, some 100 MB; beyond it, new ones are computed each time.
WORDS, CUTS = 150_000, 500_000
LONGEST = 64

SPACED_RULE = re.compile(CONTRACTIONS + r"| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
WORD_RULE = re.compile(CONTRACTIONS + r"|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


#: The normalizer and the splitting rule of a file that WORD_RULE stands for, as its JSON states them.
LOWERING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def has(found, wanted) -> bool:
    """Whether a part of a tokenizer file states all that is wanted; lists must be of one length."""
    if isinstance(wanted, dict):
        return isinstance(found, dict) and all(has(found.get(k), v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(found, list) and len(found) == len(wanted) and all(map(has, found, wanted))
    return found == wanted


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4:
        return b"".join(i.to_bytes(4, "little") for i in ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Words(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()

    def made(self, word: str) -> bytes:
        """The ids of a word, computed and not remembered."""
        spelled = word.encode().decode("latin-1").translate(self.letters)
        return id_bytes([t.id for t in self.model.tokenize(spelled)])

    def __missing__(self, word: str) -> bytes:
        ids = self.made(word)
        if len(self) < WORDS and len(word) <= LONGEST:
            self[word] = ids
        return ids


class _Cuts(dict):
    """Cut of a text at white space -> its ids."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, cut: str) -> bytes:
        ids = self.encoder.cut_ids(cut)
        if len(self) < CUTS and len(cut) <= LONGEST:
            self[cut] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids of ``Tokenizer.encode(text, add_special_tokens=False)`` as little-endian u32 bytes."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens") or ()]
        whole = not (spec.get("truncation") or spec.get("padding"))
        cut, letters = spec.get("pre_tokenizer") or {}, {"type": "ByteLevel", "add_prefix_space": False}
        spaced = whole and spec.get("normalizer") is None and has(cut, letters | {"use_regex": True})
        lowered = whole and has(spec.get("normalizer") or {}, LOWERING) and has(cut, {"type": "Sequence", "pretokenizers": [WORD_SPLIT, letters | {"use_regex": False}]})
        self.rule = SPACED_RULE if spaced else WORD_RULE if lowered else None
        self.lower = lowered
        self.cutter = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+" if spaced else f"[^{WHITE}]+")
        self.words = _Words(self.tokenizer.model)
        self.cuts = _Cuts(self)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def direct(self, text: str) -> bytes:
        return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def cut_ids(self, cut: str) -> bytes:
        if LETTERS.fullmatch(cut):
            return self.words.made(cut.lower() if self.lower else cut)
        if not PLAIN.fullmatch(cut):
            return self.direct(cut)
        known, words = self.cuts.get, self.words
        return b"".join([known(w) or words[w] for w in self.rule.findall(cut.lower() if self.lower else cut)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.rule is None or any(s in text for s in self.special):
            return self.direct(text)
        return b"".join(map(self.cuts.__getitem__, self.cutter.findall(text)))
