"""Text expressions with Python's notion of words, whitespace and lines."""

import re

from pyspark.sql import Column, functions as F

SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_CLASSES = {
    r"\w": f"[{WORD}]",
    r"\W": f"[^{WORD}]",
    r"\s": f"[{SPACE}]",
    r"\S": f"[^{SPACE}]",
    r"\d": r"\p{Nd}",
    r"\D": r"\P{Nd}",
    r"\b": f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))",
    r"\B": f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))",
}


def java_regex(pattern: str, flags: str = "d") -> str:
    """A pattern with Unicode words and spaces, and only ``\\n`` ending a line, in Java's syntax."""
    names: dict[str, str] = {}

    def translated(m):
        if m[1]:  # Java's group names have letters and digits only
            return f"(?<{names.setdefault(m[1], f'g{len(names)}')}>"
        if m[2]:
            return rf"\k<{names.get(m[2], m[2])}>"
        return _CLASSES.get(m[0], m[0])

    body = re.sub(r"\(\?P<(\w+)>|\(\?P=(\w+)\)|\\.", translated, pattern, flags=re.S)
    return f"(?{flags}){body}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def strip_inline(text: Column) -> Column:
    """``strip`` for strings that hold one line: no pass over the text unless an end is blank."""
    return F.when(text.rlike(f"^[{SPACE}]|[{SPACE}]\\z"), strip(text)).otherwise(text)


def lines(text: Column) -> Column:
    """Lines as ``\\n`` separates them; a final ``\\n`` gives one more, empty, line."""
    return F.split(text, "\n")


def all_lines(text: Column) -> Column:
    """Lines at every line-boundary character."""
    return F.split(text, LINE_BREAKS)


def line_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def head_lines(text: Column, n: int) -> Column:
    return F.substring_index(text, "\n", n)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def literal_text(pattern: str):
    """The text a pattern stands for if it is free of regular-expression syntax, else None."""
    plain = re.sub(r"\\([^A-Za-z0-9])", r"\1", pattern)
    bare = re.sub(r"\\[^A-Za-z0-9]", "", pattern)
    return None if re.search(r"[\\.^$*+?{}\[\]|()]", bare) else plain


def required_texts(pattern: str) -> list[str]:
    """Texts that every match of the pattern holds; empty if none is certain.

    They let ``contains`` (a byte scan) rule a text out before the regular expression runs.
    """
    if "|" in pattern or "(?" in pattern:
        return []
    found, run, depth, i = [], "", 0, 0

    def close():
        nonlocal run
        if len(run) > 1 and depth == 0:
            found.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            run, i = run + pattern[i + 1], i + 2
        elif c == "\\":
            close()
            i += 2
        elif c == "[":
            close()
            i = pattern.index("]", i + 2) + 1
        elif c in "()":
            close()
            depth += 1 if c == "(" else -1
            i += 1
        elif c in "?*{":
            run = run[:-1]
            close()
            i = pattern.index("}", i) + 1 if c == "{" else i + 1
        elif c in ".+^$":
            close()
            i += 1
        else:
            run, i = run + c, i + 1
    close()
    return found


def _guarded(text: Column, pattern: str, hit: Column, miss: Column) -> Column:
    guard = None
    for needed in required_texts(pattern):
        here = F.contains(text, F.lit(needed))
        guard = here if guard is None else guard & here
    return hit if guard is None else F.when(guard, hit).otherwise(miss)


def matches(text: Column, pattern: str) -> Column:
    """Does the pattern occur in the text?"""
    plain = literal_text(pattern)
    if plain is not None:
        return F.contains(text, F.lit(plain))
    return _guarded(text, pattern, text.rlike(java_regex(pattern)), F.lit(False))


def match_count(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches."""
    plain = literal_text(pattern)
    if plain is not None:
        # octets, not characters: both lengths are stored, so no pass over the text is needed
        removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(plain), F.lit("")))
        width = len(plain.encode())
        return F.when(F.contains(text, F.lit(plain)), (removed / width).cast("int")).otherwise(F.lit(0))
    return _guarded(text, pattern, F.regexp_count(text, F.lit(java_regex(pattern))), F.lit(0))


def total_matches(text: Column, patterns) -> Column:
    counts = [match_count(text, p) for p in patterns]
    return sum(counts[1:], counts[0])


def any_match(text: Column, patterns) -> Column:
    found = matches(text, patterns[0])
    for p in patterns[1:]:
        found = found | matches(text, p)
    return found


def fold(text: Column) -> Column:
    """Lowercase with the letters that case-insensitive matching also takes for i and s."""
    return F.lower(F.translate(text, "ıİſ", "iis"))
