"""Lexical classes of values: an ordered list of patterns, and bit masks over it.

Bit k of a mask says that sub-pattern k matches the whole value. The mask of a set of values is the
bitwise AND of theirs, which combines before a shuffle and does not mind skew. The class is the first
sub-pattern in rank order that is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes in rank order with the pattern of one token.
PUNCT = r"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]"
NON_SPACE = r"[^ \t\n\x0b\f\r]"
MIXED_WORD = r"[\x21-\x7e]*[a-zA-Z0-9][\x21-\x7e]*"
CLASSES: list[tuple[str, str]] = [
    ("digit", r"[0-9]"),
    ("digits", r"[0-9]+"),
    ("number", r"[0-9]*[.]?[0-9]+"),
    ("letter", r"[a-zA-Z]"),
    ("letters", r"[a-zA-Z]+"),
    ("alphabet_numeric", r"[a-zA-Z0-9]"),
    ("word", r"[a-zA-Z][a-zA-Z0-9]*"),
    ("punct", PUNCT),
    ("puncts", PUNCT + "+"),
    ("puncts_group", PUNCT + "+"),
    ("graph", r"[\x21-\x7e]"),
    ("mixed_number", r"[+\(\[\$-]?([0-9]+([,:/-][0-9]+)*)?[.]?[0-9]+[\]\)%a-zA-Z]*"),
    ("mixed_word", MIXED_WORD),
    ("words", r"[a-zA-Z][a-zA-Z0-9]*"),
    ("mixed_words", MIXED_WORD),
    ("non_whitespace", NON_SPACE),
    ("non_whitespaces", NON_SPACE + "+"),
    ("non_whitespaces_group", NON_SPACE + "+"),
]
# Names of the four sub-patterns of a group class; one blank or any, one token or more.
GROUPS: dict[str, tuple[str, str, str, str]] = {
    "puncts_group": ("puncts_or_phrase", "puncts_or_group", "puncts_phrase", "puncts_group"),
    "words": ("words", "word_or_group", "phrase", "word_group"),
    "mixed_words": ("mixed_words", "mixed_word_or_group", "mixed_phrase", "mixed_word_group"),
    "non_whitespaces_group": ("non_whitespaces_or_phrase", "non_whitespaces_or_group", "non_whitespaces_phrase", "non_whitespaces_group"),
}
NAMES = [name for name, _ in CLASSES]
PLURAL = "[^ ].* .*[^ ]"


def _subs() -> list[tuple[str, str, str, str]]:
    out = []
    for name, base in CLASSES:
        if name not in GROUPS:
            out.append((name, name, base, base))
            continue
        for sub, gap, times in zip(GROUPS[name], (" ", " +", " ", " +"), "**++"):
            # Possessive repetition cannot exhaust the stack of Java's engine on long lines; no token
            # holds a blank, so giving nothing back loses no match.
            out.append((name, sub, f"{base}(?:{gap}{base}){times}+", f"{base}({gap}{base}){times}"))
    return out


#: (class, sub-pattern, Java pattern, pattern for engines without possessive repetition)
SUBS = _subs()
PLURAL_BIT = len(SUBS)
#: Sub-patterns that a set of values with several tokens each does not take: those of one token or more.
SINGLE_OR_MORE = sum(1 << i for i, s in enumerate(SUBS) if s[0] in GROUPS and GROUPS[s[0]].index(s[1]) < 2)


#: For values without a blank: the bits of each class of one token, with those of the groups of such tokens.
SINGLE = [(base, sum(1 << k for k, sub in enumerate(SUBS) if sub[0] == name or (sub[0] in GROUPS and 1 << k & SINGLE_OR_MORE and dict(CLASSES)[sub[0]] == base))) for name, base in CLASSES if name not in GROUPS]


def mask(value: Column) -> Column:
    """BIGINT mask of one value; null and empty match nothing.

    A value without a blank is one token at most, so that one pattern speaks for a class and its groups.
    """
    zero = F.lit(0).cast("long")
    bits = lambda pairs: [F.when(value.rlike(rf"\A(?:{p})\z"), F.lit(m)).otherwise(zero).cast("long") for p, m in pairs]
    either = lambda cols: reduce(lambda x, y: x.bitwiseOR(y), cols)
    one = either(bits(SINGLE))
    several = either(bits([(java, 1 << k) for k, (_, _, java, _) in enumerate(SUBS)]))
    plural = F.when(F.trim(value).rlike(r"[^ \t\n\x0b\f\r][ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]"), F.lit(1 << PLURAL_BIT)).otherwise(zero).cast("long")
    return F.when(value.contains(" "), several.bitwiseOR(plural)).otherwise(one.bitwiseOR(plural))


def mask_sql(value: str) -> str:
    parts = [f"CASE WHEN regexp_full_match({value}, '{plain}') THEN {1 << k}::BIGINT ELSE 0 END" for k, (_, _, _, plain) in enumerate(SUBS)]
    plural = f"CASE WHEN regexp_matches(trim({value}), '[^ \\t\\n\\x0b\\f\\r][ \\t\\n\\x0b\\f\\r]+[^ \\t\\n\\x0b\\f\\r]') THEN {1 << PLURAL_BIT}::BIGINT ELSE 0 END"
    return "(" + " + ".join([plural, *parts]) + ")"


def _allowed(m: Column) -> Column:
    return F.when(m.bitwiseAND(1 << PLURAL_BIT) != 0, m.bitwiseAND(~SINGLE_OR_MORE)).otherwise(m)


def class_of(m: Column) -> Column:
    """The class of a mask; null where none matches."""
    return _first(m, 0)


def class_of_token(token: Column) -> Column:
    """class_of(mask()) of a value without blanks: patterns are tried one after the other, up to the first that matches.

    Letters come first, as they are most frequent and no class before theirs has any. Null and empty: null.
    """
    out = F.lit(None).cast("string")
    for name, pattern in reversed([(n, p) for n, p in CLASSES if n not in GROUPS and n not in ("letter", "letters")]):
        out = F.when(token.rlike(rf"\A(?:{pattern})\z"), name).otherwise(out)
    return F.when(token.rlike(r"\A[a-zA-Z]+\z"), F.when(F.length(token) == 1, "letter").otherwise("letters")).otherwise(out)


def actual_of(m: Column) -> Column:
    """The name of the sub-pattern of a mask."""
    return _first(m, 1)


def names_of(m: int) -> tuple[str | None, str | None]:
    """class_of() and actual_of() of a mask in hand."""
    m &= ~SINGLE_OR_MORE if m >> PLURAL_BIT & 1 else -1
    return next(((s[0], s[1]) for k, s in enumerate(SUBS) if m >> k & 1), (None, None))


def _first(m: Column, field: int) -> Column:
    allowed = _allowed(m)
    out = F.lit(None).cast("string")
    for k in reversed(range(len(SUBS))):
        out = F.when(allowed.bitwiseAND(1 << k) != 0, SUBS[k][field]).otherwise(out)
    return out


def first_sql(m: str, field: int) -> str:
    allowed = f"(CASE WHEN ({m} & {1 << PLURAL_BIT}) <> 0 THEN {m} & {((1 << PLURAL_BIT) - 1) & ~SINGLE_OR_MORE} ELSE {m} END)"
    return "CASE " + " ".join(f"WHEN ({allowed} & {1 << k}) <> 0 THEN '{s[field]}'" for k, s in enumerate(SUBS)) + " END"


def lessen_name(name: str) -> str:
    """The widened name of a sub-pattern: groups become one-or-many with any gap."""
    for subs in GROUPS.values():
        if name in subs:
            return subs[1]
    return name


def root_name(name: str) -> str:
    """The ancestor among the white-space classes."""
    if name in {"digit", "letter", "alphabet_numeric", "punct", "graph", "non_whitespace"}:
        return "non_whitespace"
    return "non_whitespaces_or_group" if any(name in subs for subs in GROUPS.values()) else "non_whitespaces"


#: (sub-pattern, class, lessen, root, pattern) of every name.
DIMENSION = [(s[1], s[0], lessen_name(s[1]), root_name(s[1]), s[3]) for s in SUBS]
PATTERN = {s[1]: s[3] for s in SUBS}
