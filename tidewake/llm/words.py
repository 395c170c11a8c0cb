"""Words of a text, compared without case and accents."""

from __future__ import annotations

import re
import unicodedata

_MARKS = re.compile("[̀-ͯ]")
_WORDS = re.compile(r"[^\W_]+").findall


def folded(text: str) -> str:
    """Without letter case (final sigma too) and accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.casefold())
    text = _MARKS.sub("", text)
    if not text.isascii():
        text = "".join(c for c in text if not unicodedata.combining(c)) if any(map(unicodedata.combining, set(text))) else text
    return text.casefold()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the folded text."""
    return _WORDS(folded(text)) if text else []
