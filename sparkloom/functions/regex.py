"""Regular expressions on Spark's own engine, with the options and offsets of an offset-reporting matcher.

Differences from the dialect rebuilt here, which follow Java: a dot inside a set is a dot; a group without content may
repeat; of alternatives the first that matches wins even if it is empty; matches follow each other without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.errors import InvalidPattern, InvalidRequest

OPTIONS = {"multi_line": "m", "single_line": "s", "insensitive": "i"}


def check(pattern: str, branches: int | None = None, groups: int | None = None) -> None:
    """Brackets and parentheses match, repetitions have something to repeat; perhaps no more alternatives a group, or groups, than so many."""
    depth, alternatives, found, repeatable, i = 0, [1], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise InvalidPattern("metacharacter", "the pattern ends in a backslash")
            repeatable, i = True, i + 1
        elif c == "[":
            end = i + 1 + pattern.startswith("^", i + 1)
            while end < len(pattern) and pattern[end] != "]":
                end += 1 + (pattern[end] == "\\")
            if end >= len(pattern):
                raise InvalidPattern("bracket", f"a set that is not closed at {i}")
            if end == i + 1 + pattern.startswith("^", i + 1):
                raise InvalidPattern("bracket", f"an empty set at {i}")
            repeatable, i = True, end
        elif c == "]":
            raise InvalidPattern("bracket", f"a bracket that closes nothing at {i}")
        elif c == "(":
            found += not pattern.startswith("?", i + 1)
            i += pattern.startswith("?", i + 1)
            alternatives.append(1)
            depth, repeatable = depth + 1, False
        elif c == ")":
            if not depth:
                raise InvalidPattern("parenthesis", f"a parenthesis that closes nothing at {i}")
            alternatives.pop()
            depth, repeatable = depth - 1, True
        elif c == "|":
            alternatives[-1] += 1
            if branches is not None and alternatives[-1] > branches:
                raise InvalidPattern("branches", f"more than {branches} alternatives")
            repeatable = False
        elif c in "*+?" or c == "{" and pattern[i + 1 : i + 2].isdigit():
            if not repeatable:
                raise InvalidPattern("metacharacter", f"nothing to repeat at {i}")
            if c == "{":
                end = pattern.find("}", i)
                if end < 0 or not all(n.isdigit() or not n for n in pattern[i + 1 : end].split(",", 1)):
                    raise InvalidPattern("metacharacter", f"no count at {i}")
                i = end
            i += pattern[i + 1 : i + 2] in ("?", "+")
            repeatable = False
        else:
            repeatable = c not in "^"
        i += 1
    if depth:
        raise InvalidPattern("parenthesis", "a parenthesis that is not closed")
    if groups is not None and found > groups:
        raise InvalidPattern("groups", f"more than {groups} groups")


def compiled(pattern: str, *options: str) -> str:
    """The pattern for Spark: \\b is a backspace, options are inline flags."""
    if unknown := set(options) - set(OPTIONS):
        raise InvalidRequest(f"no options {sorted(unknown)}")
    check(pattern)
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append("\\x08" if pattern[i + 1] == "b" else pattern[i : i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    flags = "".join(OPTIONS[o] for o in dict.fromkeys(options))
    return (f"(?{flags})" if flags else "") + "".join(out)


def is_match(text: Column, pattern: str, *options: str) -> Column:
    return text.rlike(compiled(pattern, *options))


def match(text: Column, pattern: str, *options: str) -> Column:
    """The leftmost match, or null."""
    return group(text, pattern, 0, *options)


def group(text: Column, pattern: str, index: int, *options: str) -> Column:
    """A group of the leftmost match; null without a match."""
    own = compiled(pattern, *options)
    return F.when(text.rlike(own), F.regexp_extract(text, own, index))


def match_end(text: Column, pattern: str, *options: str) -> Column:
    """Offset behind the leftmost match, from 0; -1 without one."""
    end = F.regexp_instr(text, F.lit(compiled(pattern, *options))) - 1 + F.length(match(text, pattern, *options))
    return F.when(text.isNotNull(), F.coalesce(end, F.lit(-1))).cast("bigint")


def matches(text: Column, pattern: str, *options: str) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(text, F.lit(compiled(pattern, *options)), F.lit(0))


def match_count(text: Column, pattern: str, *options: str) -> Column:
    return F.regexp_count(text, F.lit(compiled(pattern, *options))).cast("bigint")
