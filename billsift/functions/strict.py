"""Strict reading: identifiers by span, lines by section, items by the columns of their header row.

The plain rules take the first match anywhere; these decide by where a match stands.
Identifiers are ASCII, as printed.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from billsift import constants as K
from billsift.functions.fields import last_amount
from billsift.functions.text import or_blank

#: Signs of an e-mail's name: listed one by one, as Java looks such a set up in a table.
_NAME = "[" + string.ascii_letters + string.digits + "._%+-]"
#: Kinds of identifiers, the stronger first: where two overlap the stronger stays. A look at the first
#: sign, or one back from behind it, spares the rest of a pattern for most places.
IDENTIFIERS = (
    ("email", rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}"),
    ("gstin", K.GSTIN),
    ("ifsc", r"(?=[A-Z])(?<![A-Z0-9])" + K.IFSC + r"(?![A-Z0-9])"),
    ("phone", r"(?=[MPTmpt+])(?:(?i:\b(?:phone|mobile|tel)\b)[ .:]{0,3}+\+?+\d|(?<![\d+])\+\d)[\d ()-]{5,13}\d"),
    ("order", r"(?=[OPop])(?i:\b(?:po|purchase order|order)\b)(?i: ?+(?:no|number)\b)?+[ .:#-]{0,3}+\d++"),
    ("date", K.DATE),
    ("pan", K.PAN),
    ("account", r"\d(?<![0-9A-Za-z#./-]\d)\d{8,17}(?![0-9A-Za-z]|[./-]\d)"),
)
#: A line with an identifier holds one of these at least: a part of each pattern above, and quick to seek one by one.
SIGNS = (r"\d(?:\d{3}(?:[A-Z]|\d{5})|[/-]\d\d[/-])", "@", "[A-Z]{4}0", r"\+\d",
         "(?=[MOPTmopt])(?i:phone|mobile|tel|po|order)")
#: Put around a match, and what stands in its place in a line.
MARK, OTHER = "\x01", "\x02"
#: Items of a fold whose output is copied together.
FOLDED = 128
SPAN = "struct<line:int,start:int,rank:int,stop:int,value:string>"
FOUND = "array<struct<line_no:int,start:int,stop:int,kind:string,value:string>>"

#: What the first line of a section looks like, in lower case.
SECTIONS = (
    ("buyer", r"^(?:invoice to|bill to|ship to|buyer)\b"),
    ("items", r"^(?=.*\b(?:description|particulars)\b)(?=.*\b(?:amount|total)\b)"),
    ("totals", r"^(?:sub ?total|taxable|cgst|sgst|igst|total|grand total|discount|round)\b"),
    ("bank", r"^(?:bank|account|a/c|ifsc|branch)\b"),
)
ANY_SECTION = "|".join(f"(?:{pattern})" for _, pattern in SECTIONS)
#: Words of an item header and the column that each names.
COLUMNS = {
    "sr": ("sr", "s.no", "sno", "no", "#"),
    "description": ("description", "particulars", "item", "items"),
    "hsn": ("hsn", "sac", "hsn/sac"),
    "qty": ("qty", "quantity"),
    "unit": ("unit", "uom"),
    "rate": ("rate", "price"),
    "amount": ("amount", "total", "value"),
}
MONEY, NUMBER, CODE = r"^[\d,]*\d\.\d{2}$", r"^\d+(?:\.\d+)?$", r"^\d{4,8}$"
DECIMAL = "decimal(18,2)"


def _fold(items: Column, carry: Column, step: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """What a fold puts out and what it carries at the end, as ``struct<carry, done: array<array<span>>>``.

    ``step`` takes carry, output and an item and gives the next two. Arrays are copied where one
    is appended to, so the output is gathered in blocks, which keeps long arrays near linear.
    """
    none = F.array().cast(f"array<{SPAN}>")
    count = F.ceil(F.size(items) / F.lit(FOLDED)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda n: F.slice(items, n * FOLDED + 1, F.lit(FOLDED)))

    def inner(state: Column, x: Column) -> Column:
        new, out = step(state["carry"], state["out"], x)
        return F.struct(new.alias("carry"), out.alias("out"))

    def outer(state: Column, block: Column) -> Column:
        own = F.aggregate(block, F.struct(state["carry"].alias("carry"), none.alias("out")), inner)
        return F.get(F.transform(F.array(own), lambda x: F.struct(
            x["carry"].alias("carry"), F.array_append(state["done"], x["out"]).alias("done"))), F.lit(0))

    return F.aggregate(blocks, F.struct(carry.alias("carry"), F.array().cast(f"array<array<{SPAN}>>").alias("done")), outer)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value bound by an outer lambda, so that it is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _spans(text: Column) -> Column:
    """All matches of each pattern in a text of lines, with their lines and places, from what lies between them.

    Matches stay within a line, and line breaks bound them as the ends of a line do. One pass a pattern
    puts marks around them, so each second part between marks is a match.
    """

    def hits(pattern: str, rank: int) -> Column:
        marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)

        def hit(value: Column, gap: Column) -> Column:
            tail = F.substring_index(gap, "\n", -1)
            return F.struct(F.lit(rank).alias("rank"), value.alias("value"), F.length(tail).alias("tail"),
                            (F.length(gap) - F.length(F.replace(gap, F.lit("\n"), F.lit("")))).alias("breaks"))

        return _once(marked, lambda parts: F.array_compact(F.transform(
            parts, lambda x, i: F.when(i % 2 == 1, hit(x, F.get(parts, i - 1))))))

    def step(last: Column, out: Column, x: Column) -> tuple[Column, Column]:
        same = x["rank"] == last["rank"]
        start = x["tail"] + F.when(same & (x["breaks"] == 0), last["stop"]).otherwise(0)
        own = F.struct((x["breaks"] + F.when(same, last["line"]).otherwise(0)).alias("line"), start.alias("start"),
                       x["rank"].alias("rank"), (start + F.length(x["value"])).alias("stop"), x["value"].alias("value"))
        return own.cast(SPAN), F.array_append(out, last)

    before = F.struct(F.lit(0).alias("line"), F.lit(0).alias("start"), F.lit(-1).alias("rank"), F.lit(0).alias("stop"),
                      F.lit("").alias("value")).cast(SPAN)

    def whole(all_: Column) -> Column:
        return _once(_fold(all_, before, step), lambda r: F.array_append(F.flatten(r["done"]), r["carry"]))

    every = F.flatten(F.array(*[hits(pattern, rank) for rank, (_, pattern) in enumerate(IDENTIFIERS)]))
    return _once(every, lambda all_: F.when(F.size(all_) > 0, F.filter(whole(all_), lambda x: x["rank"] >= 0)).otherwise(
        F.array().cast(f"array<{SPAN}>")))


def _resolve(spans: Column) -> Column:
    """One fold over the spans in order: of two that overlap the stronger kind stays, else the earlier."""

    def step(last: Column, out: Column, x: Column) -> tuple[Column, Column]:
        apart = (x["line"] > last["line"]) | (x["start"] >= last["stop"])
        return F.when(apart | (x["rank"] < last["rank"]), x).otherwise(last), F.when(
            apart, F.array_append(out, last)).otherwise(out)

    def whole(ordered: Column) -> Column:
        rest = F.slice(ordered, F.lit(2), F.size(ordered) - 1)
        return _once(_fold(rest, F.get(ordered, F.lit(0)), step), lambda r: F.array_append(F.flatten(r["done"]), r["carry"]))

    return F.when(F.size(spans) < 2, spans).otherwise(_once(F.array_sort(spans), whole))


def identifiers(lines: Column) -> Column:
    """``array<struct<line_no, start, stop, kind, value>>`` of a line array, in reading order.

    Places count signs from 0 within the line. A tax number inside a longer one, the
    digits of a telephone or order number and those of a date are not taken as anything else.
    Lines that may hold any are read as one text: a pass a pattern, and one fold for all.
    """
    kinds = F.array(*[F.lit(kind) for kind, _ in IDENTIFIERS])
    signed = F.transform(lines, lambda x, i: F.when(
        reduce(or_, [x.rlike(sign) for sign in SIGNS]), F.struct((i + 1).alias("n"), x.alias("line"))))

    def read(numbered: Column) -> Column:
        # no pattern takes one of these signs, nor tells it from the one put in its place
        text = F.array_join(F.transform(numbered, lambda x: F.translate(x["line"], f"\n{MARK}", f"\r{OTHER}")), "\n")
        spans = _once(_once(text, _spans), _resolve)
        return F.when(F.size(numbered) > 0, F.transform(spans, lambda s: F.struct(
            F.get(numbered, s["line"])["n"].alias("line_no"), s["start"].alias("start"), s["stop"].alias("stop"),
            F.get(kinds, s["rank"]).alias("kind"), s["value"].alias("value")))).when(numbered.isNotNull(), F.array().cast(FOUND))

    return _once(F.array_compact(signed), read)


def of_kind(found: Column, kind: str) -> Column:
    """The distinct values of one kind, in reading order."""
    own = F.filter(found, lambda x: x["kind"] == kind)
    return F.array_distinct(F.transform(own, lambda x: x["value"]))


def nth_of_kind(found: Column, kind: str, n: int = 0) -> Column:
    return or_blank(F.get(of_kind(found, kind), F.lit(n)))


def sections(lines: Column) -> Column:
    """``array<struct<section, first, lines>>``: header, buyer, items, totals and bank, as they follow.

    A fold over the lines that may begin a section decides which do: totals only begin
    once there were items, so neither "TAX INVOICE" nor a heading counts as one; any other
    section may follow any. Each section then is one slice of the lines.
    """
    marked = F.transform(lines, lambda x, i: F.struct(
        F.when(F.lower(x).rlike(ANY_SECTION), F.coalesce(
            *[F.when(F.lower(x).rlike(p), F.lit(name)) for name, p in SECTIONS])).alias("section"),
        i.alias("first")))
    marks = F.filter(marked, lambda x: x["section"].isNotNull())
    kind = "struct<section:string,first:int>"

    def step(acc: Column, x: Column) -> Column:
        starts = (x["section"] != F.element_at(acc["found"], -1)["section"]) & (
            (x["section"] != "totals") | acc["items"])
        return F.struct(
            F.when(starts, F.array_append(acc["found"], x.cast(kind))).otherwise(acc["found"]).alias("found"),
            (acc["items"] | (x["section"] == "items")).alias("items"))

    head = F.array(F.struct(F.lit("header").alias("section"), F.lit(0).alias("first")).cast(kind))
    found = F.aggregate(marks, F.struct(head.alias("found"), F.lit(False).alias("items")), step, lambda acc: acc["found"])
    # bound by an outer lambda, so that the fold runs once
    cut = F.transform(F.array(found), lambda all_: F.transform(all_, lambda x, i: F.struct(
        x["section"].alias("section"), x["first"].alias("first"),
        F.slice(lines, x["first"] + 1, F.coalesce(F.get(all_, i + 1)["first"], F.size(lines)) - x["first"]).alias("lines"))))
    return F.filter(F.get(cut, F.lit(0)), lambda x: F.size(x["lines"]) > 0)


def section_lines(found: Column, section: str) -> Column:
    """All lines of the sections of one name, in order."""
    own = F.filter(found, lambda x: x["section"] == section)
    return F.flatten(F.transform(own, lambda x: x["lines"]))


def labelled_amount(lines: Column, pattern: str) -> Column:
    """The last whole amount of the first line that begins as ``pattern`` says (lower case) and has one; null if none."""
    amounts = F.transform(F.filter(lines, lambda x: F.lower(x).rlike(pattern)), lambda x: last_amount(x, "strict"))
    return F.get(F.filter(amounts, lambda x: x.isNotNull()), F.lit(0)).try_cast(DECIMAL)


def header_columns(line: Column) -> Column:
    """Names of the columns of an item header row, from left to right."""
    words = F.split(F.lower(line), " +")
    named = F.transform(words, lambda w: F.coalesce(*[F.when(w.isin(*known), F.lit(name)) for name, known in COLUMNS.items()]))
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def _cells(line: Column, columns: Column) -> Column:
    """One item row read from the right, a column of the header at a time."""
    text = F.lit(None).cast("string")
    fields = ("hsn", "qty", "unit", "rate", "amount")
    zero = F.struct(F.split(line, " +").alias("rest"), *[text.alias(f) for f in fields])

    def step(acc: Column, column: Column) -> Column:
        rest = acc["rest"]
        n = F.size(rest)
        last, before = F.get(rest, n - 1), F.get(rest, n - 2)
        money = column.isin("amount", "rate") & last.rlike(MONEY)
        plain = (column == "qty") & last.rlike(NUMBER)
        with_unit = (column == "qty") & ~last.rlike(NUMBER) & F.coalesce(before.rlike(NUMBER), F.lit(False))
        code = (column == "hsn") & last.rlike(CODE)
        unit = (column == "unit") & ~last.rlike(NUMBER)
        used = F.when(with_unit | code & F.coalesce(before.isin("HSN", "SAC"), F.lit(False)), 2) \
            .when(money | plain | code | unit, 1).otherwise(0)
        new = {
            "hsn": F.when(code, last), "qty": F.when(plain, last).when(with_unit, before),
            "unit": F.when(with_unit | unit, last), "rate": F.when(money & (column == "rate"), last),
            "amount": F.when(money & (column == "amount"), last)}
        return F.struct(F.slice(rest, F.lit(1), n - F.coalesce(used, F.lit(0))).alias("rest"),
                        *[F.coalesce(new[f], acc[f]).alias(f) for f in fields])

    return F.aggregate(F.reverse(columns), zero, step)


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast(DECIMAL)


def strict_items(found: Column) -> Column:
    """``array<struct<sr, description, hsn, qty, unit, rate, amount, amount_ok>>`` of the items sections.

    A section's first line names the columns. Rows are read from the right, so blanks and
    pipes in a description do no harm; a line without an amount is no item. ``amount_ok``
    tells whether quantity times rate is the amount, to the rounding of the rate; null without a rate.
    """

    def rows(section: Column) -> Column:
        head = F.array(header_columns(F.get(section["lines"], F.lit(0))))
        return F.get(F.transform(head, lambda columns: F.transform(
            F.slice(section["lines"], F.lit(2), F.size(section["lines"])),
            lambda line: F.struct(columns.alias("columns"), _cells(line, columns).alias("cells")))), F.lit(0))

    own = F.flatten(F.transform(F.filter(found, lambda x: x["section"] == "items"), rows))
    read = F.transform(F.filter(own, lambda x: x["cells"]["amount"].isNotNull()), lambda x: F.struct(
        x["columns"].alias("columns"), x["cells"]["rest"].alias("rest"), x["cells"]["hsn"].alias("hsn"),
        x["cells"]["unit"].alias("unit"), _number(x["cells"]["qty"]).alias("qty"),
        _number(x["cells"]["rate"]).alias("rate"), _number(x["cells"]["amount"]).alias("amount")))

    def item(x: Column) -> Column:
        first = F.get(x["rest"], F.lit(0))
        numbered = F.array_contains(x["columns"], "sr") & F.coalesce(first.rlike(r"^\d{1,6}\.?$"), F.lit(False))
        words = F.when(numbered, F.slice(x["rest"], F.lit(2), F.size(x["rest"]))).otherwise(x["rest"])
        off = F.abs(x["qty"] * x["rate"] - x["amount"])
        return F.struct(
            F.when(numbered, F.rtrim(first, F.lit("."))).try_cast("int").alias("sr"),
            F.array_join(words, " ").alias("description"), x["hsn"].alias("hsn"), x["qty"].alias("qty"),
            x["unit"].alias("unit"), x["rate"].alias("rate"), x["amount"].alias("amount"),
            (off <= x["qty"] * F.lit("0.005").cast("decimal(4,3)")).alias("amount_ok"))

    return F.transform(read, item)
