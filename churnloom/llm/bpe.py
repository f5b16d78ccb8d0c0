"""Pre-tokens and pieces of a tokenizer file, the same as its library gives.

A text is split at special tokens, normalised and cut into pre-tokens; the model then
turns each pre-token into pieces without looking at its neighbours. That is why pieces can
be counted, and ids looked up, once per distinct pre-token.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import Counter

from churnloom.llm.common import Memory, ship

# The settings under which the plain path below is known to be exact.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


def _plain_patterns():
    """For texts of common Latin characters: what is outside them, and the split written out for them."""
    chars = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x180)]) if c != "İ"]
    kinds = {"L": "", "N": ""}
    for c in chars:
        kind = unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    letters, digits = kinds["L"], kinds["N"]
    outside = re.compile("[^\t\n\r " + "".join(map(re.escape, chars)) + "]")
    split = PLAIN_SPLIT.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
    return outside, re.compile(split.replace(r"\p{L}\p{N}", letters + digits))


class PreTokenizer:
    """Cuts texts into pre-tokens and pre-tokens into ids; built from the text of a tokenizer file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        settings = json.loads(spec)
        self.specials = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        steps = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if (settings["normalizer"] != PLAIN_NORMALIZER
                or steps[0].get("pattern") != {"Regex": PLAIN_SPLIT} or len(steps) != 2
                or any(t[k] for t in settings["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word"))):
            raise ValueError("this tokenizer splits texts in a way that is not known here")
        self.outside, self.split = _plain_patterns()
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        # Looked up once: every look makes a new wrapper of the model.
        self.tokenise = self.tokenizer.model.tokenize
        self.packed = Memory(self._packed)
        self.packed_word = Memory(self._packed_word, 300_000)

    def pre_tokens(self, text: str) -> list[str]:
        """In order. A special token is a pre-token of its own."""
        return [t for part in self._parts(text) for t in self._ordinary(part)]

    def words(self, text: str) -> tuple[Counter, list[str]]:
        """How often each plain word occurs, and the pre-tokens of all that is not plain."""
        words, others = Counter(), []
        for part in self._parts(text):
            if self._plain(part):
                words.update(part.lower().split())
            else:
                others += self._ordinary(part)
        return words, others

    def packed_ids(self, text: str) -> bytes:
        """The ids of the whole text, two bytes each."""
        found = []
        for part in self._parts(text):
            if self._plain(part):
                found += map(self.packed_word.__getitem__, part.lower().split())
            else:
                found += map(self.packed.__getitem__, self._ordinary(part))
        return b"".join(found)

    def _packed(self, pre_token: str) -> bytes:
        return array("H", self.ids(pre_token)).tobytes()

    def _packed_word(self, word: str) -> bytes:
        """Ids of a plain word. Short pre-tokens, such as stops, are remembered; others hardly come back alone.

        Words met for the first time are a large part of the work, so those of letters, with a stop or comma or without, go straight to the model.
        """
        body = word.rstrip(".,")
        if not body.isalpha() or body in self.specials:
            return b"".join([self.packed[t] if len(t) < 4 else self._packed(t) for t in self.cut(word)])
        written = body if body.isascii() else "".join(map(self.letters.__getitem__, body.encode()))
        found = array("H", [t.id for t in self.tokenise(written)]).tobytes()
        if len(body) == len(word):
            return found
        stop = word[len(body):]
        return found + (self.packed[stop] if len(stop) < 4 else self._packed(stop))

    def cut(self, word: str) -> list[str]:
        """Pre-tokens of a plain word in lower case; most are letters with a stop or comma at the end."""
        body = word.rstrip(".,")
        if not body.isalpha():
            return self.split.findall(word)
        return [body] if len(body) == len(word) else [body, word[len(body):]]

    def _plain(self, part: str) -> bool:
        return self.outside.search(part) is None and part not in self.specials

    def _parts(self, text: str) -> list[str]:
        return self.at_special.split(text) if "<|" in text else [text]

    def _ordinary(self, text: str) -> list[str]:
        if text in self.specials:
            return [text]
        if self.outside.search(text) is None:
            return self.split.findall(text.lower())
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]

    def ids(self, pre_token: str) -> list[int]:
        if pre_token in self.specials:
            return [self.specials[pre_token]]
        # Printable ASCII stands for itself.
        is_plain = pre_token.isascii() and pre_token.isprintable() and " " not in pre_token
        written = pre_token if is_plain else "".join(map(self.letters.__getitem__, pre_token.encode()))
        return [t.id for t in self.tokenise(written)]


ship(__name__)
