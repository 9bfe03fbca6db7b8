"""Text functions (H1-H11, H15): terms, deletion variants, one-edit test, search texts.

Latin text is folded by built-in functions, other text by an Arrow batch function; both give the same terms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from itertools import filterfalse, groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.types import strings

#: Lengths of indexed terms, least length for typos, alternatives, terms of a query, files that are searchable.
MIN_TERM, MAX_TERM, MIN_TYPO, MAX_ALTERNATIVES, MAX_TERMS, SEARCH_FILES, LISTED_FILES = 3, 32, 4, 20, 16, 20, 200
MAX_QUERY = 200

def _folded(c: str) -> str:
    """A character as it is searched: compatibility form without marks, case folded."""
    return "".join(filterfalse(unicodedata.combining, unicodedata.normalize("NFKD", c))).casefold()


def split_terms(text: str) -> list[str]:
    """H1 in plain Python, for any script: the folded text cut at everything that is no letter or digit."""
    return ["".join(run) for kept, run in groupby(_folded(text), str.isalnum) if kept]


def _plain_fold(c: str) -> str:
    """What the built-in path makes of a character."""
    return c.lower().translate(_TABLE).replace("ß", "ss")


def _kind(c: str) -> str:
    return "w" if unicodedata.category(c)[0] in "LN" else " "


def _class(codes: Iterable[int]) -> str:
    """A pattern's character class of code points, as runs."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]"


#: Latin letters that fold to one plain letter, from the Unicode data.
_MARKED = {c: _folded(c) for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(_folded(c)) == 1 and _folded(c).isascii() and _folded(c) != c}
_TABLE = str.maketrans(_MARKED)


def _same(c: str) -> bool:
    """Whether both paths read a character alike: both as the same letters and digits, or both as a gap."""
    exact, plain = _folded(c), _plain_fold(c)
    if not any(x.isalnum() for x in exact):
        return exact != "" and not any(_kind(x) == "w" for x in plain)
    return exact == plain and all(x.isalnum() and _kind(x) == "w" for x in plain)


#: Characters that only the exact path reads rightly: those of other scripts, marks, ligatures, wide forms.
ODD = _class([*(k for k in range(0x250) if not _same(chr(k))), *(k for k in range(0x250, 0x10000) if not (0xD800 <= k < 0xE000) and (_kind(chr(k)) == "w" or not _same(chr(k)))), *range(0x10000, 0x10FFFF + 1)])


@F.pandas_udf(strings())
def terms_exact(texts: pd.Series) -> pd.Series:
    """H1 for any script; null texts give null."""
    return texts.map(split_terms, na_action="ignore")


def terms(text: Column | str) -> Column:
    """H1: by built-in functions, and texts with characters that these read otherwise by the exact function, so that an index
    and a query always agree; null texts give null."""
    text = F.col(text) if isinstance(text, str) else text
    folded = F.translate(F.lower(text), "".join(_MARKED), "".join(_MARKED.values()))
    plain = F.regexp_extract_all(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    odd = (F.octet_length(text) > F.char_length(text)) & beyond.rlike(ODD)
    return F.coalesce(terms_exact(F.when(odd, text)), F.when(~odd, plain))


def query_terms(query: str) -> list[str]:
    """The query stripped and cut, its first terms."""
    return split_terms(query.strip()[:MAX_QUERY])[:MAX_TERMS]


def deletions(term: Column) -> Column:
    """H2: all distinct strings with one character removed."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(term)), lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.char_length(term)))))


def is_indexed(term: Column) -> Column:
    return F.char_length(term).between(MIN_TERM, MAX_TERM)


def variants(term: Column) -> Column:
    """H4: the term itself and its deletions, without repeats."""
    return F.array_union(F.array(term), deletions(term))


def within_one_edit(a: Column, b: Column) -> Column:
    """H3: equal, or one substitution, insertion, deletion or swap of neighbours apart."""
    n = F.char_length(a)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.get(at, F.lit(0))
    swapped = F.concat(F.substring(a, F.lit(1), first - 1), F.substring(a, first + 1, F.lit(1)), F.substring(a, first, F.lit(1)), F.substring(a, first + 2, n))
    return (F.levenshtein(a, b, 1) >= 0) | ((n == F.char_length(b)) & (F.size(at) == 2) & (swapped == b))


def may_be_typo(term: Column) -> Column:
    """H5: long enough and not all digits."""
    return (F.char_length(term) >= MIN_TYPO) & ~term.rlike(r"^\p{N}+$")


def files_text(paths: Column) -> Column:
    """The searchable files, one a line."""
    return F.array_join(F.slice(paths, 1, SEARCH_FILES), "\n")


def search_text(name: Column, paths: Column) -> Column:
    """Name and listed paths in lower case, one a line."""
    return F.lower(F.concat(name, F.lit("\n"), F.array_join(F.slice(paths, 1, LISTED_FILES), "\n")))


def decode_text(raw: Column) -> Column:
    """H7: UTF-8 with bad bytes replaced."""
    return F.make_valid_utf8(raw.cast("string"))


def first_name(utf8: Column, plain: Column) -> Column:
    """H8: the UTF-8 name, or the plain one if that is missing or empty."""
    return F.coalesce(F.nullif(utf8, F.lit("")), plain, F.lit(""))


def join_path(parts: Column) -> Column:
    """H9"""
    return F.array_join(parts, "/")
