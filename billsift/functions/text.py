"""Text functions: ``Column -> Column``, JVM-side, null-safe."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from billsift import constants as K


def or_blank(c: Column) -> Column:
    """Missing text is ``''``, as everywhere in the text view."""
    return F.coalesce(c, F.lit(""))


def strip_ws(text: Column) -> Column:
    """Trim every Unicode blank, not only the space ``trim`` removes."""
    return F.btrim(text, F.lit(K.WHITESPACE))


def text_lines(text: Column) -> Column:
    """The stripped, non-blank lines of a text, in order.

    One pass of a pattern finds them all, so no expression runs per line.
    """
    return F.regexp_extract_all(or_blank(text), F.lit(K.LINE), F.lit(0))


def normalize_currency(text: Column) -> Column:
    """Every rupee mark, in the listed order, becomes ``INR ``.

    What is put in forms no mark with its neighbours, so a mark that the text lacks at first
    is never sought again.
    """
    prefix = F.lit(K.CURRENCY_PREFIX)
    return reduce(
        lambda t, mark: F.when(F.contains(text, F.lit(mark)), F.replace(t, F.lit(mark), prefix)).otherwise(t),
        K.CURRENCY_MARKS, text)


def safe_path(path: Column) -> Column:
    """The last part of a path, so no directory can be smuggled in."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def content_hash(content: Column) -> Column:
    """SHA-256 of text or bytes as lower-case hex."""
    return F.sha2(content.cast("binary"), 256)


def sanitize_cell(value: Column) -> Column:
    """Quote a value that a spreadsheet would run as a formula."""
    # one call: a test per sign made the code of a wide row too long for the JVM to compile
    starts = F.find_in_set(F.left(value, F.lit(1)), F.lit(",".join(K.FORMULA_STARTS))) > 0
    return F.when(starts, F.concat(F.lit("'"), value)).otherwise(value)


def redact(text: Column) -> Column:
    """Mask e-mails, tax ids and account numbers, for logs.

    A plain ASCII text takes plain patterns, and a text without ``@`` none for e-mails: same results.
    """
    masks = ((K.GSTIN, "[GSTIN]"), (K.PAN, "[PAN]"), (K.ACCOUNT, "[ACCOUNT]"), (K.AMOUNT_ONCE, "[AMOUNT]"))

    def masked(flags: str) -> Column:
        mail = F.regexp_replace(text, K.java_regex(K.EMAIL_ONCE, flags), "[EMAIL]")
        return reduce(lambda t, m: F.regexp_replace(t, K.java_regex(m[0], flags), m[1]), masks,
                      F.when(F.contains(text, F.lit("@")), mail).otherwise(text))

    return F.when(F.octet_length(text) == F.length(text), masked("d")).otherwise(masked("dU"))


def quality_score(text: Column) -> Column:
    """Words + valid characters - all other characters.

    Runs are removed whole: one match per run, not one per character.
    """
    text = or_blank(text)
    words = F.regexp_count(text, F.lit(K.java_regex(r"[^\s]+")))
    garbage = F.length(F.regexp_replace(text, K.java_regex(K.VALID_CHARACTER + "+"), ""))
    return (words + F.length(text) - 2 * garbage).cast("bigint")


def variant_slug(setting: Column) -> Column:
    """A file-name form of an engine setting."""
    return F.translate(F.replace(setting, F.lit("--"), F.lit("")), " +=,", "__")


def run_stamp(at: Column | datetime, fmt: str = K.RECORD_STAMP) -> Column:
    """A time as text, in the record's or the store's form.

    A Python time is taken as it stands on the clock, whatever the session's
    time zone.
    """
    if isinstance(at, datetime):
        at = F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.date_format(at, fmt)
