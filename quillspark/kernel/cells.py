"""Characters and the columns they take: CJK, grapheme clusters, display width."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

# Ranges of code points, first and last.
CJK = (
    (0x1100, 0x11FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3040, 0x30FF), (0x3105, 0x312F), (0x3130, 0x318F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x2FA1F), (0x30000, 0x3134F),
)
HANGUL_L, HANGUL_V, HANGUL_T = ((0x1100, 0x115F), (0xA960, 0xA97C)), ((0x1160, 0x11A7), (0xD7B0, 0xD7C6)), ((0x11A8, 0x11FF), (0xD7CB, 0xD7FB))
SYLLABLES = (0xAC00, 0xD7A3)
FLAGS = (0x1F1E6, 0x1F1FF)
TONES = (0x1F3FB, 0x1F3FF)
TAGS = (0xE0020, 0xE007F)
PICTOGRAPHS = ((0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x21AA), (0x231A, 0x23FF), (0x24C2, 0x24C2), (0x25AA, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B55), (0x3030, 0x303D), (0x3297, 0x3299), (0x1F000, 0x1F0FF), (0x1F10D, 0x1F1AD), (0x1F201, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1FAFF))
JOINER, EMOJI_STYLE, TEXT_STYLE = 0x200D, 0xFE0F, 0xFE0E

_STARTS = [a for a, _ in CJK]


def is_cjk(ch: str) -> bool:
    """Whether a character is a CJK letter: Han, kana, bopomofo, Hangul with its jamo; punctuation is none."""
    if not ch or ch < "\u1100":
        return False
    k = bisect_right(_STARTS, ord(ch)) - 1
    return k >= 0 and ord(ch) <= CJK[k][1]


def _in(c: int, ranges) -> bool:
    return any(a <= c <= b for a, b in ranges)


#: Break classes of characters, as the rules of grapheme clusters tell them apart.
OTHER, CONTROL, EXTEND, SPACING, ZWJ, FLAG, PICTOGRAPH, L, V, T, LV, LVT, PREPEND = range(13)
PREPENDED = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD))


@lru_cache(1 << 14)
def break_class(ch: str) -> int:
    c, kind = ord(ch), unicodedata.category(ch)
    if c == JOINER:
        return ZWJ
    if _in(c, PREPENDED):
        return PREPEND
    if kind in ("Mn", "Me") or TONES[0] <= c <= TONES[1] or TAGS[0] <= c <= TAGS[1] or c in (0x200C, 0xFF9E, 0xFF9F):
        return EXTEND
    if kind in ("Cc", "Cf", "Zl", "Zp"):
        return CONTROL
    if kind == "Mc":
        return SPACING
    if FLAGS[0] <= c <= FLAGS[1]:
        return FLAG
    if SYLLABLES[0] <= c <= SYLLABLES[1]:
        return LV if (c - SYLLABLES[0]) % 28 == 0 else LVT
    for of, ranges in ((L, HANGUL_L), (V, HANGUL_V), (T, HANGUL_T), (PICTOGRAPH, PICTOGRAPHS)):
        if _in(c, ranges):
            return of
    return OTHER


#: Which class may follow which inside a cluster, beside marks, joiners, flags and pictographs.
_SYLLABLE = {L: (L, V, LV, LVT), LV: (V, T), V: (V, T), LVT: (T,), T: (T,)}


def clusters(s: str) -> list[str]:
    """Grapheme clusters: what a reader takes for one character.

    One pass that knows the class before, whether an even number of flag letters
    stands just before, and whether a pictograph and a joiner do.
    """
    out: list[str] = []
    last, odd_flag, joins = CONTROL, False, False
    picture = False  # the cluster holds a pictograph and, since it, only marks
    for i, ch in enumerate(s):
        k = break_class(ch)
        if ch == "\n" and i and s[i - 1] == "\r":
            stays = True
        elif not i or k == CONTROL or last == CONTROL:
            stays = False
        else:
            stays = k in (EXTEND, ZWJ, SPACING) or last == PREPEND or k in _SYLLABLE.get(last, ()) or (k == PICTOGRAPH and joins) or (k == FLAG and last == FLAG and odd_flag)
        if stays:
            out[-1] += ch
        else:
            out.append(ch)
        odd_flag = k == FLAG and not (last == FLAG and odd_flag)
        joins = k == ZWJ and picture
        picture = k == PICTOGRAPH or (picture and k == EXTEND)
        last = k
    return out


def cluster_width(g: str) -> int:
    """Columns of a cluster: two if its base is wide or it is shown as an emoji or a flag, none if it has no base, else one."""
    base = g[0]
    k = break_class(base)
    if k in (CONTROL, EXTEND, ZWJ):
        return 0
    if k == FLAG:
        return 2 if len(g) > 1 else 1
    if len(g) > 1 and chr(EMOJI_STYLE) in g and (k == PICTOGRAPH or base in "#*0123456789"):
        return 2
    if len(g) > 1 and chr(TEXT_STYLE) in g and k == PICTOGRAPH:
        return 1
    if k in (V, T):
        return 0
    return 2 if unicodedata.east_asian_width(base) in "WF" else 1


#: Characters that are clusters of themselves beside each other: narrow ones, and wide ones of Chinese and Japanese texts.
_WIDE_PLAIN = "\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uff01-\uff60"
_PLAIN, _WIDE_RUN = re.compile(f"[ -~\u00c0-\u024f{_WIDE_PLAIN}]*"), re.compile(f"[{_WIDE_PLAIN}]+")


def display_width(s: str) -> int:
    """Columns that a text takes where each cluster is shown as one."""
    if s.isascii():
        return sum(c >= " " and c != "\x7f" for c in s)
    if _PLAIN.fullmatch(s):
        return 2 * len(s) - len(_WIDE_RUN.sub("", s))
    return sum(map(cluster_width, clusters(s)))
