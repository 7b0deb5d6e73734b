"""Token ids of whole texts by the tokenizers library, with the ids of repeated words kept per Python worker."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from struct import pack

import pyarrow as pa
import pyarrow.compute as pc

#: A blank between two visible characters always starts a new piece in a byte-level BPE of this pattern, and what
#: stands after it doesn't depend on what stands before: words can be encoded on their own.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_GAP = re.compile(r"\s\s")
#: A piece also ends between a letter or digit and a full stop or comma.
_MARK = re.compile(r"(?<=[^\W_])[.,]")
_TAIL = re.compile(r"(\w+)([^\w\s]+)")
#: For Arrow's matcher: white space as Python has it, and common letters and digits, not all of them.
_WHITE = r"\t-\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_COMMON = (
    r"0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{391}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{52F}\x{5D0}-\x{5EA}"
    r"\x{620}-\x{64A}\x{905}-\x{939}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}"
)
#: Texts that are looked at one by one: two white spaces in a row or one at an end, a mark behind anything but a common letter or digit, a NUL.
_ODD = rf"[{_WHITE}][{_WHITE}]|^[{_WHITE}.,]|[{_WHITE}]$|[^{_COMMON}][.,]|\x{{0}}"
_OTHER_SPACE = re.compile(r"[^\S\n]")
#: Words kept in each of the two generations of a worker's memory.
KEPT_WORDS = 160_000


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level BPE writes for each byte: printable ones stand for themselves, the rest follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {x: chr(x) for x in shown} | {x: chr(256 + i) for i, x in enumerate(hidden)}


class _Memory(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes; an older generation is dropped when the newer one is full.

    A word stands for itself behind a blank, or, behind a NUL, for itself alone.
    """

    def __init__(self, whole, model):
        super().__init__()
        self.whole, self.tokenize, self.older = whole, model.tokenize, {}
        self.letters = _byte_letters()
        self.blank = self.letters[32]

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= KEPT_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def make(self, word: str) -> bytes:
        bare = word[:1] == "\0"
        if bare:
            word = word[1:]
        if word.isalpha():
            plain = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenize(plain if bare else self.blank + plain)]
            return pack(f"<{len(ids)}I", *ids)
        # Letters with marks behind them: two pieces.
        two = _TAIL.fullmatch(word)
        if two and two[1].isalpha():
            return self["\0" + two[1] if bare else two[1]] + self["\0" + two[2]]
        # A single line feed between visible characters: a piece of its own.
        lines = word.split("\n")
        if len(lines) > 1 and all(lines) and not _OTHER_SPACE.search(word):
            return self["\0" + lines[0] if bare else lines[0]] + b"".join([self["\0\n"] + self["\0" + x] for x in lines[1:]])
        return self.whole(word if bare else " " + word)


class Encoder:
    """Encodes texts with a tokenizer file: encode(text) gives the ids as little-endian unsigned 32-bit bytes.

    by_word: the file's tokenizer is a byte-level BPE whose pieces begin at a blank, so that words may be remembered.
    Texts that hold one of its added tokens are encoded whole.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if hasattr(tokenizer.model, "_resize_cache"):
            tokenizer.model._resize_cache(0)  # the words are remembered here, and its own memory is slower than merging anew
        self._np, self._tokenizer, self._by_word = np, tokenizer, by_word
        # The file's added tokens are found in whole texts only.
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self._added = re.compile("|".join(added)) if added else None
        self._odd = "|".join([_ODD, *added])
        self._words = _Memory(self._whole, tokenizer.model)

    def _whole(self, text: str) -> bytes:
        return self._np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self._by_word or "\0" in text or self._added and self._added.search(text):
            return self._whole(text)
        if text[0].isspace() or text[-1].isspace() or _GAP.search(text):
            parts = _CUT.split("\0" + text)
        else:
            parts = ("\0" + _MARK.sub(r" \0\g<0>", text).replace("\n", " \0\n \0")).split(" ")
        return b"".join(map(self._words.__getitem__, parts))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode of each text of an Arrow array (null: empty); Arrow's matcher tells which texts need a closer look."""
        words = self._words.__getitem__
        for text, odd in zip(texts, pc.match_substring_regex(texts, self._odd).to_pylist(), strict=True):
            text = text.as_py() or ""
            if odd or not text or not self._by_word:
                yield self.encode(text)
            else:
                # Every mark stands behind a letter or digit, every line feed between visible characters.
                yield b"".join(map(words, ("\0" + text.replace(".", " \0.").replace(",", " \0,").replace("\n", " \0\n \0")).split(" ")))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool = True) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    key = (path, by_word)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, by_word)
    return _ENCODERS[key]


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
