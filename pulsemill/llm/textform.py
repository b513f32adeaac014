"""One consistent form for texts that look alike (problem 5), as plain functions over strings.

The form keeps case, digits, accents, words and the spaces between them.  It removes what
cannot be seen, gives every white-space character one shape, takes the compatibility form
(full and half width, ligatures, radicals, combining marks) and maps look-alike letters of
other scripts to one letter.  ``key_form`` builds the comparison key of the near-duplicate
operators on it: lower case, letters and digits only.
"""

from __future__ import annotations

import re
import unicodedata

# Code points that are not drawn (Unicode Default_Ignorable_Code_Point), as ranges.
DEFAULT_IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Letters of other scripts drawn like a Latin letter, each with that letter (a choice from Unicode's table of confusables, UTS 39).
LOOK_ALIKE = (
    # Cyrillic, lower case
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl "
    # Cyrillic, upper case
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ҮY ԌG ԚQ ԜW ӀI "
    # Greek, lower case
    "αa ιi κk νv οo ρp υu ϲc ϳj "
    # Greek, upper case
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    # Armenian
    "օo ոn հh սu ցg զq յj ՕO ՍU ՏS "
    # Cyrillic izhitsa; Latin letters of phonetics
    "ѵv ɑa ɡg "
    # Coptic
    "ⲟo ⲣp ⲥc ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX "
    # Cherokee
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    # Lisu
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
)

_FROM_TO = {ord(p[0]): p[1] for p in LOOK_ALIKE.split()}
_INVISIBLE = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in DEFAULT_IGNORABLE) + "]")
_SPACE = re.compile(r"[^\S ]")
# the letters themselves, and every composed letter that has one of them as its base
_LOOKS = re.compile(
    "[" + "".join(map(chr, _FROM_TO)) + "".join(c for c in map(chr, range(0xC0, 0x2000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and ord(d[0]) in _FROM_TO) + "]"
)


def consistent(text: str | None) -> str | None:
    """The consistent form of one text; None stays None, white space at either end goes.

    What becomes of a letter does not depend on the text around it, but for the marks it carries.

    >>> consistent("Ｂ\\u00adТC\\u00a0up ﬁrst")
    'BTC up first'
    """
    if text is None:
        return None
    if text.isascii():
        return _SPACE.sub(" ", text).strip()
    s = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if _LOOKS.search(s):
        s = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_FROM_TO))
    return _SPACE.sub(" ", _INVISIBLE.sub("", s)).strip()


def folded(text: str | None) -> str | None:
    """Consistent form under full case folding, for comparisons that disregard case."""
    s = consistent(text)
    return None if s is None else consistent(s.casefold())


_NOT_KEY = re.compile(r"[\W_]+")


def key_form(text: str | None) -> str:
    """Lower-cased consistent form, letters and digits only; "" for None.

    >>> key_form("Ｂuy  now: 1.5!")
    'buynow15'
    """
    s = consistent(text)
    return "" if s is None else _NOT_KEY.sub("", s.lower())
