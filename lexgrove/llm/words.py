"""Alphanumeric words of long texts, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text whose words are listed at once; a single longer word is not cut.
PART = 1 << 22
#: ASCII letters in lower case and digits stay, as do the bytes of all other characters; the rest separates.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def word_parts(text: str | None, part: int = PART) -> Iterator[list[bytes]]:
    """Words of the text in order: runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + part) if len(data) - at > part else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
