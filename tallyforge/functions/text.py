"""Text functions as plain column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that lose an accent or are one plain character in another form (or nothing), and those that stand for several.

    By the compatibility decompositions of all code points; syllables of Hangul follow a rule of their own.
    """
    one, several = {}, {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0x30000)):
        c = chr(code)
        if unicodedata.decomposition(c) or unicodedata.combining(c):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain != c:
                (one if len(plain) < 2 else several)[c] = plain
    return one, several


def _both(pairs: dict[str, str]) -> tuple[str, str]:
    """Arguments of ``translate``: characters without a counterpart are taken out."""
    ordered = sorted(pairs, key=lambda c: pairs[c] == "")
    return "".join(ordered), "".join(pairs[c] for c in ordered)


def _ranges(chars: Iterable[str]) -> str:
    found: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if found and code == found[-1][1] + 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in found)


_ONE, _SEVERAL = _decompositions()
#: Latin letters and signs up to U+017F and what stays of each; enough for nearly all texts.
ACCENTED, PLAIN = _both({c: p for c, p in _ONE.items() if ord(c) < 0x180})
_FROM, _TO = _both(_ONE)
_TABLE = "\x01".join(f"{k}\x02{v}" for k, v in _SEVERAL.items())
_HANGUL = r"\x{AC00}-\x{D7A3}"
_MANY = f"[{_ranges(_SEVERAL)}{_HANGUL}]"
#: Anything but ASCII, the Latin letters above, dashes and quotation marks; the range before && tells most characters at once.
_RARE = r"[\x{BC}-\x{10FFFF}&&[^\x00-\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17F}\x{2012}-\x{2016}\x{2018}-\x{2023}]]"
_SPACE = r"[\x00-\x20\x{85}-\x{2029}&&[\s\x1C-\x1F\x{85}\x{1680}\x{2028}\x{2029}]]"
#: Runs of white space other than one plain space, which stands already as it should.
_SPACES = rf"{_SPACE}(?:(?<! ){_SPACE}*+|{_SPACE}++)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _hangul(c: Column) -> Column:
    """The letters of a syllable: 21 vowels and 28 ends to each beginning."""
    letter = lambda first, n, at: F.substr(F.lit("".join(chr(first + k) for k in range(n))), at.cast("int") + 1, F.lit(1))
    k = F.ascii(c) - 0xAC00
    end = F.pmod(k, F.lit(28))
    return F.concat(letter(0x1100, 19, F.floor(k / 588)), letter(0x1161, 21, F.pmod(F.floor(k / 28), F.lit(21))), F.when(end == 0, "").otherwise(letter(0x11A7, 28, end)))


def unaccent(c: Column | str) -> Column:
    """Compatibility forms become plain characters, and marks that combine go: the decomposition of every character, without its marks.

    Most texts need one ``translate`` of Latin letters; only those with rarer characters go through the large tables.
    """
    c = _col(c)
    table = F.str_to_map(F.lit(_TABLE), F.lit("\x01"), F.lit("\x02"))
    spelled = lambda x: F.when(x.rlike(f"[{_HANGUL}]"), _hangul(x)).when(x.rlike(_MANY), F.try_element_at(table, x)).otherwise(x)
    every = F.when(c.rlike(_MANY), F.array_join(F.transform(F.split(c, ""), spelled), "")).otherwise(c)
    return F.when(F.octet_length(c) == F.length(c), c).when(~c.rlike(_RARE), F.translate(c, ACCENTED, PLAIN)).otherwise(F.translate(every, _FROM, _TO))


def _forms(char: str) -> str:
    """A class of the characters, up to the Latin letters above, that fold to ``char``."""
    every = sorted({char, char.upper(), *(a for a, b in zip(ACCENTED, PLAIN, strict=True) if b.lower() == char)})
    near, far = ("".join(rf"\x{{{ord(x):X}}}" for x in every if (x < "\u0100") == low) for low in (True, False))
    # the range before && tells most characters at once, where each of those behind it would be compared
    return rf"[{near}][\x{{100}}-\x{{10FFFF}}&&[{far}]]" if far else near


def folded_like(c: Column, phrase: str, begins: bool = False) -> Column:
    """Whether a text, in lower case and without accents, holds (or ``begins`` with) ``phrase``, which is so itself.

    Most texts are compared by a pattern, as they stand; only those with rarer characters are folded.
    """
    pattern = ("^" if begins else "") + "".join(f"[{_forms(x)}]" for x in phrase)
    return F.when(c.rlike(_RARE), (F.startswith if begins else F.contains)(F.lower(unaccent(c)), F.lit(phrase))).otherwise(c.rlike(pattern))


def may_begin(c: Column, char: str) -> Column:
    """False for texts that surely do not begin with ``char`` when they are folded."""
    return c.rlike(f"^[{_forms(char)}]") | c.rlike(_RARE)


def may_squash_to(c: Column, words: list[str]) -> Column:
    """False for texts of which ``squash`` surely gives none of ``words``: letters and digits of ASCII stay, so there are no others."""
    other = "[^A-Za-z0-9]*"
    return c.rlike(f"^{other}(?:{'|'.join(other.join(f'[{_forms(x)}]' for x in w) for w in words)}){other}$") | c.rlike(_RARE)


def collapse(c: Column | str) -> Column:
    """White space runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), _SPACES, " "))


def fold(c: Column | str, lower: bool = True) -> Column:
    """No accents, single spaces, and lower case unless told otherwise."""
    out = collapse(unaccent(c))
    return F.lower(out) if lower else out


def squash(c: Column | str) -> Column:
    """Only folded letters and digits."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def words_key(c: Column | str) -> Column:
    """Folded words of letters and digits, joined by single spaces."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def digest(*columns: Column | str) -> Column:
    """sha-256 over columns in the given order; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), _col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def contains_any(c: Column, terms: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | c.contains(term)
    return out


def count_terms(c: Column, terms: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(0)
    for term in terms:
        out = out + c.contains(term).cast("int")
    return out
