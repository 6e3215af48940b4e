"""Words of texts: runs without ``[\\x20\\x09-\\x0D]``."""

from __future__ import annotations

import re

BLANK = re.compile(r"[\x20\x09-\x0D]+")
_OTHER_BLANK = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if _OTHER_BLANK.search(text):  # str.split() would cut there as well
        return [w for w in BLANK.split(text) if w]
    return text.split()
