"""What encoding a file's first bytes are in, by byte statistics, with a confidence."""

from __future__ import annotations

import codecs
import unicodedata

#: A guess counts above this; else a file is taken for UTF-8.
GATE = 0.7
#: Confidence that few and many characters beyond ASCII can give, and how many are many.
FEW, MANY, ENOUGH = 0.73, 0.99, 5
BOMS = ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF32_LE, "UTF-32LE"), (codecs.BOM_UTF32_BE, "UTF-32BE"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE"))
#: Java's and Python's name of each candidate, the scripts its text is in, those it may also hold, the largest share of letters beyond ASCII in its words.
CANDIDATES = (
    ("Shift_JIS", "shift_jis", ("HIRAGANA", "KATAKANA"), ("CJK",), 1.0),
    ("EUC-KR", "euc-kr", ("HANGUL",), (), 1.0),
    ("GB18030", "gb18030", ("CJK",), (), 1.0),
    ("windows-1252", "cp1252", ("LATIN",), (), 0.67),
    ("windows-1251", "cp1251", ("CYRILLIC",), (), 1.0),
    ("KOI8-R", "koi8-r", ("CYRILLIC",), (), 1.0),
    ("ISO-8859-7", "iso8859-7", ("GREEK",), (), 1.0),
)
#: Signs that any text may hold; longest words of scripts that put blanks between them.
PLAIN_SIGNS, LONGEST_WORD = frozenset("«»“”„‘’–—…·°§€£¿¡、。「」・ー"), 30


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0]


def plausible(text: str, scripts: tuple[str, ...], also: tuple[str, ...], most: float) -> tuple[float, int]:
    """(share, number) of the characters beyond ASCII that fit: letters of the scripts, in words of one case pattern and one script, not too long and not too dense."""
    good = seen = 0
    spaced = scripts[0] in ("LATIN", "CYRILLIC", "GREEK")
    for word in text.split():
        letters = [c for c in word if c.isalpha()]
        beyond = sum(ord(c) > 127 for c in letters)
        mixed = spaced and scripts != ("LATIN",) and beyond < len(letters)
        odd = mixed or spaced and len(letters) > LONGEST_WORD or len(letters) > 1 and beyond > most * len(letters)
        shouted = len(letters) > 1 and not any(c.islower() for c in letters)
        for i, c in enumerate(word):
            if ord(c) <= 127 or c in PLAIN_SIGNS:
                continue
            if not c.isalpha():
                seen += 1
                continue
            script = _script(c)
            if script in also:
                continue
            seen += 1
            late = i > 0 and c.isupper() and word[i - 1].islower() and not shouted
            good += script in scripts and not late and not odd
    return (good / seen if seen else 0.0), seen


def guess(probe: bytes) -> tuple[str, float]:
    """(encoding, confidence); the probe may end within a character. Without bytes beyond ASCII it is UTF-8 for sure."""
    for mark, name in BOMS:
        if probe.startswith(mark):
            return name, 1.0
    pairs = max(1, len(probe) // 2)
    zeros = [probe[0::2].count(0) / pairs, probe[1::2].count(0) / pairs]
    if max(zeros) > 0.3 and min(zeros) < 0.1:
        return ("UTF-16BE" if zeros[0] > zeros[1] else "UTF-16LE"), 0.95
    if max(probe, default=0) < 128:
        return "UTF-8", 1.0
    try:
        high = sum(ord(c) > 127 for c in codecs.getincrementaldecoder("utf-8")().decode(probe))
        if high:  # else all that is beyond ASCII is a start of a character at the end
            return "UTF-8", 1 - 0.5 ** (1 + high)
    except UnicodeDecodeError:
        pass
    best = ("UTF-8", 0.0)
    for name, codec, scripts, also, most in CANDIDATES:
        try:
            text = codecs.getincrementaldecoder(codec)().decode(probe)
        except UnicodeDecodeError:
            continue
        share, n = plausible(text, scripts, also, most)
        sure = share * (MANY if n >= ENOUGH else FEW)
        if sure > best[1]:
            best = (name, sure)
    if best[0] == "windows-1252" and not any(0x80 <= b <= 0x9F for b in probe):
        return "ISO-8859-1", best[1]  # the same without signs of its own
    return best


def encoding_of(probe: bytes) -> str:
    """The guess, if it is above GATE, else UTF-8; bytes that are no UTF-8 are read as ISO-8859-1 rather than lost."""
    name, sure = guess(probe)
    if sure > GATE:
        return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(probe)
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"
