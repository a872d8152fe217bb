"""Character classes as regular-expression sources, for Java (Spark) and for RE2 (DuckDB)."""

from __future__ import annotations

#: Ranges of code points.
CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF))
GARBAGE = ((0xFFFD, 0xFFFD), (0xE000, 0xF8FF), (0xFFF0, 0xFFFF))
SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
ASCII_ALNUM = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
LATIN = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F))
#: The punctuation marks that count.
PUNCTUATION = "，。！？；：、…—·,!?;:~.-()（）[]【】《》“”‘’\"'"


def ranges(marks: str) -> tuple[tuple[int, int], ...]:
    return tuple((ord(c), ord(c)) for c in marks)


def java(*classes, negate: bool = False) -> str:
    body = "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for cls in classes for a, b in cls)
    return f"[{'^' if negate else ''}{body}]"


def quick(*classes, negate: bool = False) -> str:
    """The same class for Java with ASCII first, as one bit set, and the rest behind a range: most characters
    are decided by two tests instead of one for each mark and range. Java asks the parts of a class one inside the other, so
    of a negated one with many ranges the widest gap between them and the widest range stand by themselves."""
    inside = lambda c: any(a <= c <= b for cls in classes for a, b in cls)
    low = "".join(f"\\x{{{c:x}}}" for c in range(128) if inside(c) != negate)
    beyond = sorted((max(a, 0x80), b) for cls in classes for a, b in cls if b >= 0x80)
    if not beyond:
        return java(*classes, negate=negate)
    if not negate or len(beyond) < 6:
        return f"[{low}[\\x{{80}}-\\x{{10ffff}}&&{java(tuple(beyond), negate=negate)}]]"
    width = lambda r: r[1] - r[0]
    ends = [max(b for _, b in beyond[: k + 1]) + 1 for k in range(len(beyond) - 1)]
    gap = max(((e, a - 1) for e, (a, _) in zip(ends, beyond[1:]) if e < a), key=width, default=None)
    wide = max(beyond, key=width)
    rest = tuple(r for r in beyond if r != wide)
    high = java((wide,), negate=True) + (f"&&{java(rest, negate=True)}" if rest else "")
    return f"[{low}{f'[{chr(92)}x{{{gap[0]:x}}}-{chr(92)}x{{{gap[1]:x}}}]' if gap else ''}[\\x{{80}}-\\x{{10ffff}}&&{high}]]"


#: RE2 has the same notation.
re2 = java

ALLOWED = (CJK, ASCII_ALNUM, SPACE, ranges(PUNCTUATION))
TRIM = f"^{java(SPACE)}+|{java(SPACE)}+$"
#: The same for Java, in linear time: a run of spaces is tried at its beginning only.
TRIM_JAVA = f"^{quick(SPACE)}++|(?<!{quick(SPACE)}){quick(SPACE)}++\\z"
