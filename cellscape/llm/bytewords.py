"""Words of a UTF-8 text by a 256-byte table: A-Z lowered, ASCII separators blanked, then a split at blanks."""

from __future__ import annotations

from collections.abc import Iterator

#: Fixed rule: digits, letters and all bytes of characters beyond ASCII belong to words.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once.
PIECE = 1 << 20


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``size`` bytes; a text without words gives one empty list."""
    text = text.translate(LOWERED)
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def runs(text: bytes, reach: int, size: int = PIECE) -> Iterator[tuple[int, list[bytes], int, int]]:
    """Overlapping runs (place of the first word, words, from, to) of a text.

    Every place of the text lies in [from, to) of exactly one run, which also holds the ``reach`` words before
    and after it, where the text has them.
    """
    held: list[bytes] = []
    base = start = 0
    pieces = word_pieces(text, size)
    piece = next(pieces)
    while True:
        following = next(pieces, None)
        held += piece
        end = base + len(held) - (reach if following is not None else 0)
        if end > start:
            yield base, held, start - base, end - base
            cut = max(0, end - reach - base)
            held, base, start = held[cut:], base + cut, end
        if following is None:
            return
        piece = following
