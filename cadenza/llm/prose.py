"""What of a text is prose: code, links and markup blanked out, sentences with their places."""

from __future__ import annotations

import re

from ..functions.ship import by_value

# (signs without which the pattern can't match, pattern)
_BLANK = [
    # first, as blanks left by the others would look like an indent
    (["    ", "\t"], re.compile(r"(?:^|<p>)(?: {4}|\t)(?:(?!</)[^\n])*", re.M)),
    # fences are read in one pass, as a closing one may stand at the start of a line and have markup behind it
    (["`", "~~~"], re.compile(r"^(?:[ \t]|<\w+>)*(```|~~~)[^`\n]*\n.*?(^[ \t]*\1|\Z)|```.*?(```|\Z)", re.S | re.M)),
    (["<"], re.compile(r"<(pre|code|script|style)\b[^>]*>.*?(</\1\s*>|\Z)", re.S | re.I)),
    (["<"], re.compile(r"<a\b[^>]*>.*?</a\s*>", re.S | re.I)),
    (["`"], re.compile(r"``[^`\n]+``|`[^`\n]*`")),
    (["]("], re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)")),
    (["://", "www.", "WWW.", "Www."], re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+", re.I)),
    (["<"], re.compile(r"</?[A-Za-z][^<>\n]*>|<br\s*/?>")),
    (["&"], re.compile(r"&[a-zA-Z]+;|&#\d+;")),
    ([""], re.compile(r"\b\w*[_/\\]\w+\b|\b[a-z]+[A-Z]\w*\b")),
]
_INK = re.compile(r"[^\n]")
_CUT = re.compile(r"(?<=[.!?…])[\"'»”)\]*_]*\s+|\n+|(?<=:)\s+(?=[A-ZÀ-ÖØ-Þ¿¡])")
_LETTER = re.compile(r"[^\W\d_]")


def mask(text: str) -> str:
    """The text with everything that has no language replaced by blanks of the same length (line ends stay)."""
    for signs, p in _BLANK:
        if any(x in text for x in signs):
            text = p.sub(_blank, text)
    return text


def _blank(m: re.Match) -> str:
    s = m[0]
    return _INK.sub(" ", s) if "\n" in s else " " * len(s)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a masked text that hold letters."""
    out, a = [], 0
    for m in _CUT.finditer(text):
        out.append((a, m.start()))
        a = m.end()
    out.append((a, len(text)))
    return [(x, y) for x, y in out if _LETTER.search(text, x, y)]


by_value(__name__)
