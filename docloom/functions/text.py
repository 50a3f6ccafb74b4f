"""Text expressions: white space as browsers see it, trims, line tools, case, escapes, tokens, n-grams.

All are Column expressions; nothing here runs Python on executors. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, inside a class.
WS = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


#: The same without the line feed.
_BLANK = WS.replace(r"\t-\r", r"\t\x0B-\r")


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of an expression that is evaluated once, however often f uses it, also within f's own lambdas."""
    return F.transform(F.array(c), f)[0]


def trim(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def round_half_up(c: Column) -> Column:
    """Rounds halves upward, also below zero."""
    return F.floor(c + F.lit(0.5))


def lines(c: Column) -> Column:
    return F.split(c, "\r?\n", -1)


def trim_lines(c: Column) -> Column:
    """Every line trimmed, runs of blank lines reduced to one.

    Blanks after a line feed go, then, with the text reversed, those before one: so each search starts at a line
    feed and long runs of blanks cost no more than their length.
    """
    ahead = lambda x: F.regexp_replace(x, f"(\\A|\\n)[{_BLANK}]++", "$1")
    return F.regexp_replace(F.reverse(ahead(F.reverse(ahead(c)))), "\n{3,}", "\n\n")


def collapse_spaces(c: Column) -> Column:
    """Runs of tabs and spaces become a space; none stay at line ends."""
    return F.regexp_replace(F.regexp_replace(c, "[\t ]{2,}", " "), "(?m)[\t ]+$", "")


def remove_linebreaks(c: Column) -> Column:
    one = F.regexp_replace(c, f"[{WS}]*\r?\n[{WS}]*", " ")
    return trim(F.regexp_replace(one, "[\t ]{2,}", " "))


def kept_lines(c: Column) -> Column:
    """Lines that are blank or whose trimmed text did not come before.

    Lines are sorted by trimmed text and place, so equal ones are neighbours: a text of n lines takes n log n steps.
    """
    marked = F.array_sort(F.transform(lines(c), lambda x, i: F.struct(trim(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = lambda own: F.filter(own, lambda e, j: (e["k"] == "") | (j == 0) | (F.get(own, j - 1)["k"] != e["k"]))
    in_order = F.array_sort(F.transform(bound(marked, first), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(in_order, lambda e: e["x"])


def dedupe_lines(c: Column) -> Column:
    return F.array_join(kept_lines(c), "\n")


def words(c: Column) -> Column:
    """Words of an identifier: upper-case runs, a capital with what follows, lower-case runs, digits."""
    return F.regexp_extract_all(c, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))


def snake_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.lower), "_")


def kebab_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), F.lower), "-")


def title_case(c: Column) -> Column:
    return F.array_join(F.transform(words(c), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), " ")


def camel_case(c: Column) -> Column:
    def one(w: Column, i: Column) -> Column:
        return F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))

    return F.array_join(F.transform(words(c), one), "")


def clean(c: Column) -> Column:
    """Line ends as line feeds, no control characters, no blanks at line ends, one blank line at most, trimmed."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFC]", "")
    c = F.regexp_replace(c, "[ \t]+\n", "\n")
    return trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def normalize(c: Column) -> Column:
    """Lower case with single spaces; for text without characters that need composing."""
    return F.lower(trim(F.regexp_replace(c, f"[{WS}]+", " ")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_html(c: Column) -> Column:
    """The six entities, the ampersand's last."""
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_xml(c: Column) -> Column:
    c = escape_html(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.replace(c, F.lit("'"), F.lit("&apos;"))


#: A run of white space, a run of letters, digits and underscores, or a single other character.
TOKEN = r"\s+|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def char_ngrams(c: Column, n: int) -> Column:
    """All n-grams; a text of n characters or fewer is its own."""
    many = F.transform(F.sequence(F.lit(1), F.length(c) - F.lit(n - 1)), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(F.length(c) <= n, F.array(c)).otherwise(many)


def file_extension(c: Column) -> Column:
    """The lower-cased last part after a dot."""
    return F.lower(F.element_at(F.split(c, r"\.", -1), -1))


def strip_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+$", "")


def ensure_extension(c: Column, ext: str) -> Column:
    return F.when(F.lower(c).endswith(f".{ext}"), c).otherwise(F.concat(c, F.lit(f".{ext}")))


def safe_file_name(c: Column, mark: str = "_", runs: bool = False) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|]' + ("+" if runs else ""), mark)


def sheet_name(c: Column) -> Column:
    """A workbook-safe name of at most 31 characters; not yet unique."""
    base = F.regexp_replace(F.regexp_replace(c, r"[\\/*?:\[\]]", "_"), "^'+|'+$", "")
    base = F.when(base == "", "Sheet").otherwise(base)
    base = F.when(F.lower(base) == "history", F.concat(base, F.lit("_"))).otherwise(base)
    return F.substring(base, 1, 31)


def quote_sheet(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def column_number(letters: Column) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))


def column_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA; up to three letters."""
    digit = lambda x: F.chr((65 + F.pmod(x, F.lit(26))).cast("int"))
    a, b, c = n - 1, F.floor((n - 1) / 26) - 1, F.floor((F.floor((n - 1) / 26) - 1) / 26) - 1
    return F.concat(F.when(c >= 0, digit(c)).otherwise(""), F.when(b >= 0, digit(b)).otherwise(""), digit(a))


def alphabetic(n: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa; up to three letters."""
    return F.lower(column_letters(n))


def circled(n: Column) -> Column:
    """The circled number for 1 to 20; others in parentheses."""
    signs = F.lit("".join(chr(0x2460 + i) for i in range(20)))
    return F.when(n.between(1, 20), F.substring(signs, n.cast("int"), F.lit(1))).otherwise(F.concat(F.lit("("), n.cast("string"), F.lit(")")))


def roman(n: Column) -> Column:
    """Roman numerals, lower case."""
    steps = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    out, rest = F.lit(""), n
    for value, sign in steps:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def unsafe_integers(c: Column) -> Column:
    """Integers outside strings whose value a double cannot hold, as text."""
    bare = F.regexp_replace(c, r'"(\\.|[^"\\])*"', '""')
    found = F.regexp_extract_all(bare, F.lit(r"-?\d+(?![.eE\d])"), F.lit(0))
    wide = lambda x: F.coalesce(F.abs(F.try_to_number(F.ltrim(F.regexp_replace(x, "^-?0*(?=\\d)", "")), F.lit("9" * 38))) > F.lit(9007199254740991), F.lit(True))
    return F.filter(found, wide)


def decimals(x: Column, n: int) -> Column:
    """A double with n (up to 7) places, as C's printf and DuckDB write it: the nearest by its exact value, of two as near the even one.

    Java's own format takes the shortest text of a double and rounds halves up. Whole parts from 2^63 on are left to it.
    """
    p = float(10**n)

    def places(f: Column) -> Column:  # of what is behind the point: the product is the sum of two doubles, exactly
        product = f * p
        high = bound(f * 134217729.0, lambda c: c - (c - f))  # its first 26 bits
        rest = (high * p - product) + (f - high) * p
        over = product - F.floor(product)
        odd = F.floor(product) % 2 == 1
        return F.floor(product) + F.when((over > 0.5) | ((over == 0.5) & ((rest > 0) | (rest == 0) & odd)), 1).otherwise(0)

    def text(a: Column) -> Column:
        whole = F.floor(a).cast("long")
        part = lambda k: F.concat((whole + F.when(k == 10**n, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((k % 10**n).cast("string"), n, "0"))
        return bound(places(a - whole), part)

    a, sign = F.abs(x), F.when(x.cast("string").startswith("-"), "-").otherwise("")
    large = F.when(F.isnan(x), "nan").when(a == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.format_string(f"%.{n}f", x))
    return F.when(a < 2.0**63, F.concat(sign, text(a))).when(x.isNotNull(), large)


def byte_size(n: Column) -> Column:
    """KB, MB or GB."""
    return (
        F.when(n < 1024 * 1024, F.concat(F.floor(F.greatest(F.lit(1), round_half_up(n / 1024))).cast("string"), F.lit(" KB")))
        .when(n < 1024**3, F.concat(decimals(n / (1024.0 * 1024.0), 1), F.lit(" MB")))
        .when(n.isNotNull(), F.concat(decimals(n / (1024.0**3), 2), F.lit(" GB")))
    )


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm; negative, null and not-a-number as zero."""
    s = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), F.lit(0.0)).otherwise(seconds)
    ms = round_half_up(s * 1000).cast("long")
    part = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3))


def coordinate(c: Column) -> Column:
    """Six decimals, without zeros at the end."""
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(decimals(c, 6), "0+$", ""), r"\.$", ""))


def classify_error(message: Column) -> Column:
    memory = r"(?i)abort(ed)?\s*\(\s*oom\s*\)|\boom\b|out of memory|memory access out of bounds|cannot enlarge memory|failed to (allocate|grow)|allocation failed"
    return F.when(message.rlike(memory), "OUT_OF_MEMORY").when(message.rlike("(?i)libx265|encoder.*not found|unknown encoder"), "CODEC_UNAVAILABLE").otherwise("VIDEO_PROCESSING_ERROR")
