"""Text expressions."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What a blank is: every Unicode white-space character (the set ``str.strip`` removes).
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def clean_text(text: Column) -> Column:
    """Lower-case; drop URL runs; every run of anything but a-z and ' becomes one space; trim.

    ``www`` needs no word boundary but one more character after it ("awwww no" -> "a no").  ``(?U)`` makes ``\\S``
    stop at a no-break space.
    """
    lowered = F.lower(text)
    suspect = F.contains(lowered, F.lit("http")) | F.contains(lowered, F.lit("www"))  # spares most texts a regex pass
    no_urls = F.when(suspect, F.regexp_replace(lowered, r"(?U)http\S+|www\S+", "")).otherwise(lowered)
    return F.btrim(F.regexp_replace(no_urls, r"[^a-z']+", " "))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is inlined there and computed again for every element; this keeps it outside.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for the empty text."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def char_count(text: Column) -> Column:
    return F.length(text)


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without combining marks: one letter to one letter as two strings, the bare marks
    (deleted) behind the first; and the letters that become several.  Hangul syllables stay as they are."""
    source, target, marks, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
        elif base != ch:
            several[ch] = base
    return "".join(source) + "".join(marks), "".join(target), several


_ACCENTED, _PLAIN, _SEVERAL = _decompositions()


def _char_class(codes: list[int]) -> str:
    """A character class of code points, runs of them as ranges."""
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


_ANY_OF_SEVERAL = _char_class(sorted(map(ord, _SEVERAL)))
#: A superset that is cheap to test: exact among Latin letters, everything beyond them.
_MAYBE_SEVERAL = _char_class([*sorted(ord(c) for c in _SEVERAL if ord(c) < 0x250), *range(0x250, sys.maxunicode + 1)])


def strip_accents(text: Column) -> Column:
    """Compatibility forms to their base letters, without combining marks; pure ASCII texts skip all of it.

    Letters that become one letter are translated; of those that become several, each one found in a text is replaced.
    """
    table = F.from_json(F.lit(json.dumps(_SEVERAL)), "map<string,string>")
    odd = F.array_distinct(F.regexp_extract_all(text, F.lit(_ANY_OF_SEVERAL), F.lit(0)))
    spelt = F.aggregate(odd, text, lambda t, c: F.replace(t, c, F.try_element_at(table, c)))
    whole = F.when(text.rlike(_MAYBE_SEVERAL), spelt).otherwise(text)
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(whole, _ACCENTED, _PLAIN))


def word_tokens(text: Column) -> Column:
    """Lower-cased, accent-free runs of word characters (one character is enough)."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(r"(?U)\w+"), F.lit(0))


def content_tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-cased words of two or more characters without stop words; repeats and order are kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words


def _spaced(parts: list[Column]) -> list[Column]:
    return [c for p in parts for c in (F.lit(" "), p)][1:]


def ngrams(tokens: Column, n: int) -> Column:
    """Array of the space-joined n-grams of a token array; empty when there are fewer than n tokens."""
    if n == 1:
        return tokens
    last = F.slice(tokens, n, F.size(tokens) - (n - 1))
    grams = F.transform(last, lambda x, i: F.concat(*_spaced([*(F.get(tokens, i + k) for k in range(n - 1)), x])))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def ngram_range(tokens: Column, low: int, high: int) -> Column:
    """All n-grams for low <= n <= high in one array."""
    return F.concat(*[ngrams(tokens, n) for n in range(low, high + 1)])
