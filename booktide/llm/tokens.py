"""Token ids of whole texts by a word-level BPE file, through a cache of the strings between white space."""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable

#: Bytes that remembered strings and their ids may take, about. At half of it those not asked for since the half before are forgotten.
REMEMBERED = 96 << 20
#: What an entry takes besides its characters and ids: two objects and its share of the table.
_ENTRY = 250
#: Only of these characters is a string split here; others, and strings like special tokens, go to the library whole.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]+")
#: The file's pattern for pieces, as it reads on those characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _bytes_as_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Cache(dict):
    """Ids of a string as bytes (unsigned, 32 bits, little-endian), found when first asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _FILE_PATTERN:
            raise ValueError("this file parts words by another pattern")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        self.letters = str.maketrans({chr(b): x for b, x in _bytes_as_letters().items()})
        self.before: dict[str, bytes] = {}
        self.held = 0
        self.model = self.whole.model

    def __missing__(self, text: str) -> bytes:
        out = self.before.get(text)
        if out is None:
            if _PLAIN.fullmatch(text) and not self.special.search(text):
                low = text.lower()  # these characters are in normal form C already
                # a piece of a string is a string of one piece, so both are remembered in one place
                out = self.part(low) if low.isalpha() else b"".join([self.get(p) or self.before.get(p) or self.part(p, True) for p in _PIECE.findall(low)])
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
                out = struct.pack(f"<{len(ids)}I", *ids)
        self.remember(text, out)
        return out

    def remember(self, text: str, out: bytes) -> None:
        if len(text) > 100:
            return
        if self.held >= REMEMBERED // 2:
            self.before, self.held = dict(self), 0
            self.clear()
        self[text] = out
        self.held += _ENTRY + len(text) + len(out)

    def part(self, text: str, remember: bool = False) -> bytes:
        ids = [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if remember and not self.special.search(text):
            self.remember(text, out)
        return out


@functools.cache
def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as bytes, equal to encode(text, add_special_tokens=False) of the tokenizers library.

    White space parts tokens and has none of its own, so the strings between spaces and line feeds can be encoded one by one.
    """
    cache = _Cache(path)
    get = cache.__getitem__
    return lambda text: b"".join(map(get, text.replace("\n", " ").split(" "))) if text else b""
