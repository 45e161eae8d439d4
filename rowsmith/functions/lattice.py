"""Relations of lexical classes: subset, superset, and the class recommended for two."""

from __future__ import annotations

from .classes import NAMES

# For each class, those that it is a subset of.
SUBSET_OF: dict[str, set[str]] = {
    "digit": {"digit", "digits", "number", "mixed_number", "alphabet_numeric", "graph", "word", "mixed_word", "words", "mixed_words", "non_whitespace", "non_whitespaces", "non_whitespaces_group"},
    "digits": {"digits", "number", "mixed_number", "word", "mixed_word", "words", "mixed_words", "non_whitespaces", "non_whitespaces_group"},
    "number": {"number", "mixed_number", "mixed_word", "mixed_words", "non_whitespaces", "non_whitespaces_group"},
    "mixed_number": {"mixed_number", "mixed_word", "mixed_words", "non_whitespaces", "non_whitespaces_group"},
    "letter": {"letter", "letters", "alphabet_numeric", "graph", "word", "words", "mixed_word", "mixed_words", "non_whitespace", "non_whitespaces", "non_whitespaces_group"},
    "letters": {"letters", "word", "words", "mixed_word", "mixed_words", "non_whitespaces", "non_whitespaces_group"},
    "alphabet_numeric": {"alphabet_numeric", "graph", "word", "words", "mixed_word", "mixed_words", "non_whitespace", "non_whitespaces", "non_whitespaces_group"},
    "punct": {"punct", "graph", "puncts", "puncts_group", "mixed_word", "mixed_words", "non_whitespace", "non_whitespaces", "non_whitespaces_group"},
    "puncts": {"puncts", "puncts_group", "mixed_word", "mixed_words", "non_whitespaces", "non_whitespaces_group"},
    "puncts_group": {"puncts_group", "mixed_words", "non_whitespaces_group"},
    "graph": {"graph", "mixed_word", "mixed_words", "non_whitespace", "non_whitespaces", "non_whitespaces_group"},
    "word": {"word", "words", "mixed_word", "mixed_words", "non_whitespaces", "non_whitespaces_group"},
    "words": {"words", "mixed_words", "non_whitespaces_group"},
    "mixed_word": {"mixed_word", "mixed_words", "non_whitespaces", "non_whitespaces_group"},
    "mixed_words": {"mixed_words", "non_whitespaces_group"},
    "non_whitespace": {"non_whitespace", "non_whitespaces", "non_whitespaces_group"},
    "non_whitespaces": {"non_whitespaces", "non_whitespaces_group"},
    "non_whitespaces_group": {"non_whitespaces_group"},
}
# For each class, those that it is a superset of.
SUPERSET_OF: dict[str, set[str]] = {
    "digit": set(),
    "digits": {"digit"},
    "number": {"digit", "digits"},
    "mixed_number": {"digit", "digits", "number"},
    "letter": set(),
    "letters": {"letter"},
    "alphabet_numeric": {"letter", "digit"},
    "punct": set(),
    "puncts": {"punct"},
    "puncts_group": {"punct", "puncts"},
    "graph": {"letter", "digit", "alphabet_numeric", "punct"},
    "word": {"letter", "letters"},
    "words": {"letter", "letters", "word"},
    "mixed_word": {"letter", "letters", "digit", "digits", "number", "mixed_number", "alphabet_numeric", "word"},
    "mixed_words": {"letter", "letters", "digit", "digits", "number", "mixed_number", "alphabet_numeric", "word", "words", "mixed_word"},
    "non_whitespace": {"letter", "digit", "alphabet_numeric", "punct", "graph"},
    "non_whitespaces": {"digit", "digits", "number", "mixed_number", "letter", "letters", "alphabet_numeric", "graph", "punct", "puncts", "word", "mixed_word", "non_whitespace"},
    "non_whitespaces_group": set(NAMES) - {"non_whitespaces_group"},
}
# What a class recommends beside one that is neither its subset nor its superset.
BESIDE: dict[str, dict[str, str]] = {
    "digit": {"letter": "alphabet_numeric", "letters": "word", "punct": "non_whitespace", "puncts": "non_whitespaces", "puncts_group": "non_whitespaces_group"},
    "digits": {"letter": "word", "letters": "word", "alphabet_numeric": "word", "punct": "non_whitespaces", "puncts": "non_whitespaces", "graph": "non_whitespaces", "puncts_group": "non_whitespaces_group", "non_whitespace": "non_whitespaces"},
    "number": {"letter": "mixed_word", "letters": "mixed_word", "alphabet_numeric": "mixed_word", "graph": "mixed_word", "word": "mixed_word", "words": "mixed_words", "punct": "non_whitespaces", "puncts": "non_whitespaces", "non_whitespace": "non_whitespaces", "puncts_group": "non_whitespaces_group"},
    "mixed_number": {"letter": "mixed_word", "letters": "mixed_word", "alphabet_numeric": "mixed_word", "graph": "mixed_word", "word": "mixed_word", "words": "mixed_words", "punct": "non_whitespaces", "puncts": "non_whitespaces", "non_whitespace": "non_whitespaces", "puncts_group": "non_whitespaces_group"},
    "letter": {"digit": "alphabet_numeric", "digits": "word", "number": "mixed_word", "mixed_number": "mixed_word", "punct": "graph", "puncts": "non_whitespaces", "puncts_group": "non_whitespaces_group"},
    "letters": {"digit": "word", "digits": "word", "alphabet_numeric": "word", "number": "mixed_word", "mixed_number": "mixed_word", "graph": "mixed_word", "puncts_group": "non_whitespaces_group", "punct": "non_whitespaces", "puncts": "non_whitespaces", "non_whitespace": "non_whitespaces"},
    "alphabet_numeric": {"digits": "word", "letters": "word", "number": "mixed_word", "mixed_number": "mixed_word", "punct": "non_whitespace", "puncts": "non_whitespaces", "puncts_group": "non_whitespaces_group"},
    "punct": {"letter": "graph", "digit": "graph", "alphabet_numeric": "graph", "letters": "non_whitespaces", "digits": "non_whitespaces", "number": "non_whitespaces", "mixed_number": "non_whitespaces", "word": "non_whitespaces", "words": "non_whitespaces_group"},
    "puncts": {**dict.fromkeys(["letter", "digit", "alphabet_numeric", "graph", "letters", "digits", "number", "mixed_number", "word", "non_whitespace"], "non_whitespaces"), "words": "non_whitespaces_group"},
    "puncts_group": dict.fromkeys(["letter", "digit", "alphabet_numeric", "graph", "letters", "digits", "number", "mixed_number", "word", "words", "mixed_word", "non_whitespace", "non_whitespaces"], "non_whitespaces_group"),
    "graph": {**dict.fromkeys(["letters", "digits", "number", "mixed_number", "word"], "mixed_word"), "words": "mixed_words"},
    "word": {**dict.fromkeys(["graph", "digit", "digits", "number", "mixed_number", "non_whitespace", "punct", "puncts", "alphabet_numeric"], "non_whitespaces"), "puncts_group": "non_whitespaces_group"},
    "words": dict.fromkeys(["alphabet_numeric", "graph", "digit", "digits", "number", "mixed_number", "non_whitespace", "non_whitespaces", "punct", "puncts", "puncts_group", "mixed_word"], "non_whitespaces_group"),
    "mixed_word": {"words": "mixed_words", **dict.fromkeys(["graph", "non_whitespace", "punct", "puncts"], "non_whitespaces"), "puncts_group": "non_whitespaces_group"},
    "mixed_words": dict.fromkeys(["graph", "non_whitespace", "non_whitespaces", "punct", "puncts", "puncts_group"], "non_whitespaces_group"),
    "non_whitespace": {**dict.fromkeys(["letters", "digits", "puncts", "number", "mixed_number", "word", "mixed_word"], "non_whitespaces"), **dict.fromkeys(["words", "mixed_words", "puncts_group"], "non_whitespaces_group")},
    "non_whitespaces": dict.fromkeys(["puncts_group", "words", "mixed_words"], "non_whitespaces_group"),
    "non_whitespaces_group": {},
}


def recommended(a: str, b: str) -> str | None:
    """The class for values of both classes, as a sees it; not symmetric. None where there is no rule."""
    if b in SUBSET_OF[a]:
        return b
    if b in SUPERSET_OF[a]:
        return a
    return BESIDE[a].get(b)


#: (a, b, whether a is a subset of b, whether a is a superset of b, recommended)
RELATION = [(a, b, b in SUBSET_OF[a], b in SUPERSET_OF[a], recommended(a, b)) for a in NAMES for b in NAMES]
