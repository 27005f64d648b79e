"""Column functions for single values and lines; all run in the JVM.

``BLANK`` stands for what counts as white space: Java's Unicode class does not
hold the four information separators, so they are listed with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\u001c-\u001f\u0085   -     　]"
#: The same characters as a plain list, for trimming without a pattern.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The line grammar of paragraphs, see functions.lines for its use in folds.
LIST_ITEM = r"^[ \t]*([-*+]|[0-9]+[.)]|[A-Za-z][.)]|[ivxlcdmIVXLCDM]+[.)])[ \t]+\S"
FENCE = r"^[ \t]*(`{3,}|~{3,})"
PAGE_REF = r"^[.…]*([0-9]{1,4}|(?=[ivxl]{2})l?x{0,3}(ix|iv|v?i{0,3}))$"
COMMENT_TYPES = ("Text", "FreeText", "Highlight", "Underline", "StrikeOut", "Squiggly")
TRIM = 0.95


def page_stem(page: Column, page_count: Column) -> Column:
    """``page_`` and the number, zero-padded to the width of the page count."""
    width = F.greatest(F.length(page_count.cast("string")), F.length(page.cast("string")))
    return F.concat(F.lit("page_"), F.lpad(page.cast("string"), width, F.lit("0")))


def bare(text: Column) -> Column:
    """Text without white space at its edges."""
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", " "))


def clean_cell(text: Column) -> Column:
    return F.replace(collapse(text), F.lit("|"), F.lit("\\|"))


def norm_heading(text: Column) -> Column:
    """Text for comparing headings: no markers, single spaces, lower case, bare edges."""
    return F.regexp_replace(F.lower(collapse(F.regexp_replace(text, "[#*_`]+", ""))), r"^[.,:;!?\-—–]+|[.,:;!?\-—–]+$", "")


def clean_heading(line: Column) -> Column:
    """Visible text without heading marks and whole-line emphasis."""
    text = bare(F.regexp_replace(line, r"^[ \t]*#{1,6}[ \t]+", ""))
    unwrapped = F.regexp_replace(text, r"^(?:(\*{1,3})([^*\n]+)\1|(_{1,3})([^_\n]+)\3)$", "$2$4")
    return bare(unwrapped)


def unwrap_emphasis(text: Column) -> Column:
    """Text without emphasis around all of it, if the inner text has visible edges and no such marker."""
    return F.regexp_replace(text, r"^(?:(\*{1,3})([^*\s]|[^*\s][^*\n]*[^*\s])\1|(_{1,3})([^_\s]|[^_\s][^_\n]*[^_\s])\3)$", "$2$4")


def escape_anchor(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def escape_uri(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\()])", r"\\$1")


def is_page_ref(token: Column) -> Column:
    return token.rlike(PAGE_REF)


def is_index_entry(line: Column) -> Column:
    """Visible text, white space, then a page reference at the end."""
    last = F.regexp_extract(line, r"^[ \t]*\S.*\s(\S+?)[ \t]*$", 1)
    return (last != "") & is_page_ref(last)


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def is_table_row(line: Column) -> Column:
    return F.startswith(F.regexp_replace(line, f"^{BLANK}+", ""), F.lit("|"))


def is_boundary(line: Column) -> Column:
    """A line that no paragraph takes in."""
    heading = r"^[ \t]*#{1,6}[ \t]"
    other = rf"^{BLANK}*$|^[ \t]*[|>]|{heading}|^[ \t]*([-*_])([ \t]*\1){{2,}}[ \t]*$"
    return line.rlike(other) | line.rlike(FENCE) | is_list_item(line) | is_index_entry(line)


def fence_run(line: Column) -> Column:
    """The run of backticks or tildes that a line starts with, else empty."""
    return F.regexp_extract(line, FENCE, 1)


def closes_fence(line: Column, opening: Column) -> Column:
    """Whether a line ends the block that ``opening`` began."""
    run = fence_run(line)
    return (run != "") & (F.left(run, F.lit(1)) == F.left(opening, F.lit(1))) & (F.length(run) >= F.length(opening)) & (bare(line) == run)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: what stands in a lambda is evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fence_states(lines: Column) -> Column:
    """For an array of lines: whether each belongs to a code block, as an array of booleans.

    The fold sees only lines that could delimit a block and keeps their places; the flags are then laid out between those.
    """
    told = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"))), lambda x: x["line"].rlike(FENCE))
    zero = F.struct(F.lit("").alias("opening"), F.array().cast("array<int>").alias("places"))

    def step(acc: Column, x: Column) -> Column:
        opening = acc["opening"]
        ends = closes_fence(x["line"], opening)
        now = F.when(opening == "", fence_run(x["line"])).when(ends, "").otherwise(opening)
        places = F.when((opening == "") | ends, F.concat(acc["places"], F.array(x["i"]))).otherwise(acc["places"])
        return F.struct(now.alias("opening"), places.alias("places"))

    folded = F.struct(F.aggregate(told, zero, step, lambda acc: acc["places"]).alias("places"), (F.size(lines) - 1).alias("last"))
    flags = lambda value, n: F.array_repeat(F.lit(value), n.cast("int"))

    def laid_out(found: Column) -> Column:
        at, last = found["places"], found["last"]
        end = lambda k: F.when(k < 0, -1).otherwise(F.coalesce(F.get(at, k), last))  # noqa: E731  an open block goes to the last line
        blocks = F.when(F.size(at) > 0, F.sequence(F.lit(0), F.size(at) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(blocks, lambda k: F.concat(flags(False, F.get(at, k) - end(k - 1) - 1), flags(True, end(k + 1) - F.get(at, k) + 1)))
        closed = F.when(F.size(at) % 2 == 1, last).otherwise(end(F.size(at) - 1))
        return F.concat(F.flatten(parts), flags(False, last - closed))

    return _let(folded, laid_out)


def render_table(rows: Column) -> Column:
    """An array of rows (arrays of cells) as a Markdown table; empty for no rows.

    The first row is the header, short rows are padded, cells to the width of their column.
    """

    def numbers(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    def clean(columns: Column) -> Column:
        return F.transform(rows, lambda row: F.transform(numbers(columns), lambda c: clean_cell(F.get(row, c))))

    def render(table: Column) -> Column:
        columns = numbers(F.size(F.get(table, F.lit(0))))
        widths = F.transform(columns, lambda c: F.array_max(F.transform(table, lambda r: F.length(F.get(r, c)))))
        return _let(widths, lambda w: lines(table, w))

    def lines(table: Column, widths: Column) -> Column:
        pad = lambda text, n: F.concat(text, F.repeat(F.lit(" "), n - F.length(text)))  # noqa: E731  rpad would cut
        line = lambda row: F.concat(F.lit("| "), F.array_join(F.zip_with(row, widths, pad), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(widths, lambda n: F.repeat(F.lit("-"), n + 2)), "|"), F.lit("|"))
        return F.array_join(F.transform(table, lambda row, i: F.when(i == 0, F.concat(line(row), F.lit("\n"), rule)).otherwise(line(row))), "\n")

    most = F.array_max(F.transform(rows, F.size))
    return F.when(F.size(rows) == 0, "").when(most == 0, F.concat(F.lit("|  |\n||"), F.repeat(F.lit("\n|  |"), F.size(rows) - 1))).otherwise(_let(most, lambda n: _let(clean(n), render)))


def diagram_reference(stem: Column, number: Column) -> Column:
    return F.concat(F.lit("![Diagram "), number.cast("string"), F.lit("](diagrams/"), stem, F.lit("_diagram_"), number.cast("string"), F.lit(".jpg)"))


def rebase_references(markdown: Column, folder: Column) -> Column:
    """Diagram references, relative to the folder's parent."""
    return F.replace(markdown, F.lit("](diagrams/"), F.concat(F.lit("]("), folder, F.lit("/diagrams/")))


def trim_extent(extent: Column) -> Column:
    """A box side, less five hundredths, cut towards zero; missing as 0."""
    return (F.coalesce(extent, F.lit(0)).cast("long") * F.lit(TRIM).cast("double")).cast("long")


def base64_payload(content: Column) -> Column:
    """Bytes as base64 in one line."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corners of a box inside an image; the far corner comes from the unclamped near one."""
    zero = F.lit(0).cast("long")
    return F.struct(
        F.greatest(zero, x).alias("x0"), F.greatest(zero, y).alias("y0"), F.least(width, x + w).alias("x1"), F.least(height, y + h).alias("y1")
    )


def rotate(instances: Column, page: Column) -> Column:
    """Model instances in the order a page tries them."""
    n = F.size(instances)
    k = F.pmod(page - 1, n).cast("int")
    return F.when(n > 0, F.concat(F.slice(instances, k + 1, n), F.slice(instances, F.lit(1), k))).otherwise(instances)
