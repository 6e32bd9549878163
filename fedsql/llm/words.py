"""Words of a text, as the leak search compares them.

Case, punctuation, spacing, line breaks, hyphens at line ends and full or
half width make no difference; each Chinese character is a word.
"""

from __future__ import annotations

import re
import unicodedata

HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_UNSEEN = re.compile("[­​-‍⁠﻿]")
_LINE_END = re.compile("[-‐‑­][ \t]*[\r\n]\\s*(?=\\w)")
#: In UTF-8: ASCII letters to lower case, other ASCII but digits to spaces, the rest as it is.
_PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))


class _Memo(dict):
    """What stands between two spaces or ASCII signs -> its words; texts repeat most of them."""

    LIMIT = 200_000

    def __missing__(self, chunk: bytes) -> tuple[bytes, ...]:
        if chunk.isascii():
            words_ = (chunk,)
        else:
            words_ = tuple(w.encode() for w in _WORD.findall(_UNSEEN.sub("", unicodedata.normalize("NFKC", chunk.decode())).casefold()))
        if len(chunk) <= 60:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = words_
        return words_


_memo = _Memo()


def words(text: str | None) -> list[bytes]:
    """The words of ``text`` in order, as UTF-8; none for null and empty texts."""
    if not text:
        return []
    if "\n" in text or "\r" in text:
        text = _LINE_END.sub("", text)
    chunks = text.encode("utf-8", "replace").translate(_PLAIN).split()
    if text.isascii():
        return chunks
    look = _memo.__getitem__
    return [w for chunk in chunks for w in look(chunk)]
