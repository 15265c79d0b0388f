"""Field pickers over a text or over its lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from billsift import constants as K
from billsift.functions.text import or_blank, strip_ws

#: Signs that a text can hold at most.
LONGEST = (1 << 31) - 1
AMOUNT_PATTERNS = {"parity": K.java_regex(K.AMOUNT_ONCE), "strict": K.java_regex(K.STRICT_AMOUNT)}


def first_match(text: Column, pattern: str, plain: Column | None = None) -> Column:
    """The leftmost whole match, or ``''``."""
    return or_blank(extract(text, pattern, 0, plain))


def extract(text: Column, pattern: str, group: int, plain: Column | None = None) -> Column:
    """``regexp_extract``; a plain text takes the plain pattern, with the same result.

    ``plain`` is ``is_ascii(text)`` where the caller has it already: under a condition Spark
    would count the characters again for each pattern.
    """
    if "\\" not in pattern and "(?" not in pattern:  # nothing that the wide form would widen
        return F.regexp_extract(text, K.java_regex(pattern, "d"), group)
    plain = is_ascii(text) if plain is None else plain
    return F.when(plain, F.regexp_extract(text, K.java_regex(pattern, "d"), group)).otherwise(
        F.regexp_extract(text, K.java_regex(pattern), group))


def is_ascii(text: Column) -> Column:
    """One byte per character: the plain, much faster patterns give equal results."""
    return F.octet_length(text) == F.length(text)


def plain_from(text: Column, at: Column) -> Column:
    """A plain text from a place on, cut by bytes: no character is counted on the way."""
    return F.substring(text.cast("binary"), at, F.lit(LONGEST)).cast("string")


def label_value(text: Column, *labels: str, folded: Column | None = None,
                plain: Column | None = None) -> Column:
    """What follows the first label that matches anywhere in the text.

    The blanks around the optional ``:`` or ``-`` may cross a line break, so
    a label with nothing after it takes the next line; at the very end of the
    text it takes its own mark. No blank is tried twice, so the work is linear.

    A plain text is searched for the label in its lower case (``folded``, where the
    caller has it already, as ``plain``) and read from there on. Each search stands in the expression
    once: under a condition Spark would run a repeated one each time.
    """
    low = F.lower(text) if folded is None else folded
    ascii_only = is_ascii(text) if plain is None else plain

    def after(label: str) -> Column:
        def read(source: Column, flags: str) -> Column:
            # the mark only where nothing but line breaks follows it
            pattern = label + r"\s*+(?:(?:[:\-]\s*+)?+(?=.)|(?=[:\-]\n*+\z))(.+)"
            return F.regexp_extract(source, K.java_regex(pattern, flags), 1)

        # a missing label (0) becomes a place past any end, and the rest is empty; where many labels share the
        # lower case, a plain word as a pattern is sought by leaps, where locate compares it at every place
        word = label.lower()
        place = F.locate(word, low) if folded is None else F.regexp_instr(low, F.lit(re.escape(word)))
        at = F.pmod(place - 1, F.lit(LONGEST)) + 1
        return F.when(ascii_only, read(plain_from(text, at), "id")).otherwise(read(text, "iudU"))

    found = [strip_ws(after(label)) for label in labels]
    if len(found) == 1:
        return or_blank(found[0])
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), F.lit(""))


def joined(lines: Column) -> Column:
    """The lines as one text again, each ended by a newline, for searches that
    need no pass per line."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def first_index(folded: Column, words: tuple[str, ...]) -> Column:
    """0-based number of the first line with one of the words.

    ``folded`` is the joined text in the words' own case; folding never adds
    or removes a line break, so the number also holds for the unfolded lines.
    Without a match the number is past any line; a word that is not there is only looked for.
    The line breaks ahead of a word are counted by bytes, so the lines are not cut apart for it.
    """
    def breaks(word: str) -> Column:
        ahead = F.substring_index(folded, word, 1)
        return F.length(ahead.cast("binary")) - F.length(F.replace(ahead, F.lit("\n"), F.lit("")).cast("binary"))

    spots = [F.when(F.contains(folded, F.lit(w)), breaks(w)).otherwise(F.lit(LONGEST - 1)) for w in words]
    return spots[0] if len(spots) == 1 else F.least(*spots)


def find_contains(lines: Column, keys: tuple[str, ...], folded: Column | None = None) -> Column:
    """The key held by the first line (upper-cased) that holds any key.

    When that line holds several, the first key in the given order.
    """
    upper = F.upper(joined(lines)) if folded is None else folded
    if len(keys) == 1:
        return or_blank(F.when(F.contains(upper, F.lit(keys[0])), F.lit(keys[0])))
    line = F.upper(F.get(lines, first_index(upper, keys)))
    return F.coalesce(*(F.when(F.contains(line, F.lit(k)), F.lit(k)) for k in keys), F.lit(""))


def last_amount(line: Column, mode: str = "parity") -> Column:
    """The last amount in a line without its commas; null when there is none."""
    amounts = F.regexp_extract_all(line, F.lit(AMOUNT_PATTERNS[mode]), F.lit(0))
    return F.replace(F.try_element_at(amounts, F.lit(-1)), F.lit(","), F.lit(""))


def amount_lines(lines: Column, mode: str = "parity") -> Column:
    """Only the lines that hold an amount: worth sharing between keywords."""
    pattern = K.java_regex(r"\d\.\d{2}") if mode == "parity" else AMOUNT_PATTERNS[mode]
    return F.filter(lines, lambda line: F.contains(line, F.lit(".")) & line.rlike(pattern))


def percent_lines(lines: Column) -> Column:
    """Only the lines that hold a percentage."""
    pattern = K.java_regex(K.PERCENT_ONCE)
    return F.filter(lines, lambda line: F.contains(line, F.lit("%")) & line.rlike(pattern))


def first_with(lines: Column, keyword: str, folded: Column | None = None) -> Column:
    """The first line that holds a keyword in any case, or null."""
    lower = F.lower(joined(lines)) if folded is None else folded
    return F.get(lines, first_index(lower, (keyword.lower(),)))


def pick_amount(money: Column, keyword: str, mode: str = "parity",
                folded: Column | None = None) -> Column:
    """``find_amount`` over lines already cut to those with an amount."""
    return or_blank(last_amount(first_with(money, keyword, folded), mode))


def pick_percent(percent: Column, keyword: str, folded: Column | None = None) -> Column:
    """``find_percent`` over lines already cut to those with a percentage."""
    line = first_with(percent, keyword, folded)
    return or_blank(F.regexp_extract(line, K.java_regex(K.PERCENT_ONCE), 1))


def find_amount(lines: Column, keyword: str, mode: str = "parity") -> Column:
    """Last amount of the first line that holds both the keyword and an amount."""
    return pick_amount(amount_lines(lines, mode), keyword, mode)


def find_percent(lines: Column, keyword: str) -> Column:
    """First whole number before ``%`` in the first line with the keyword and one."""
    return pick_percent(percent_lines(lines), keyword)


def first_line(lines: Column, *patterns: str) -> Column:
    """The first line that matches one of the patterns, or null."""
    tests = [K.java_regex(p) for p in patterns]
    return F.get(
        F.filter(lines, lambda x: reduce(lambda a, b: a | b, (x.rlike(t) for t in tests))),
        F.lit(0),
    )
