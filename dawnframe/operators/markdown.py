"""Features of markdown texts, as column expressions over their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dawnframe.functions.exprs import let, lines, strip

#: Fillers, the length of a summary, and the pattern of a link.
NO_SUMMARY = "（無法取得摘要）"
NO_TITLE = "未命名身心靈文章"
SUMMARY = 100
LINK_TARGET = r"\]\((https?://[^)\s]+)\)"
#: Beginnings and parts of texts that stand for a secret not filled in.
PLACEHOLDER_STARTS = ("YOUR_", "PLACEHOLDER", "REPLACE_ME", "CHANGE_ME", "EXAMPLE", "DUMMY", "TEST_")
PLACEHOLDER_PARTS = ("API_KEY_HERE", "TOKEN_HERE", "PLACEHOLDER", "REPLACE_ME", "CHANGE_ME")


def extract_links(md: Column, k: int = 5) -> Column:
    """The first ``k`` distinct link targets in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(md, F.lit(LINK_TARGET), F.lit(1))), 1, k)


def _from_first(rows: Column, wanted) -> Column:
    """The lines from the first that is wanted on; none if none is."""
    at = F.array_position(F.transform(rows, lambda x: F.coalesce(wanted(x), F.lit(False))), F.lit(True)).cast("int")
    return let(at, lambda n: F.when(n > 0, F.slice(rows, n, F.size(rows))).otherwise(F.array().cast("array<string>")))


def _until(rows: Column, ends) -> Column:
    """The lines before the first that ends them."""
    at = lambda r: F.array_position(F.transform(r, ends), F.lit(True)).cast("int")
    return let(rows, lambda r: let(at(r), lambda n: F.when(n > 0, F.slice(r, 1, n - 1)).otherwise(r)))


def _filling(kept: Column, length: int) -> Column:
    """The lines, joined by blanks, until they are that long.  Numbers are carried along, so the cost grows with the lines."""
    state = F.struct(F.lit(-1).alias("length"), F.lit(0).alias("n"))
    step = lambda s, x: F.when(s.length >= length, s).otherwise(F.struct((s.length + 1 + F.length(x)).alias("length"), (s.n + 1).alias("n")))
    return let(kept, lambda k: F.array_join(F.slice(k, 1, F.aggregate(k, state, step, lambda s: s.n)), " "))


def intro_summary(md: Column) -> Column:
    """The first block quote in one line, else the first paragraph (until it has 100 characters), cut at 100; else a filler."""
    inner = lambda line: strip(F.regexp_replace(line, "^>+", ""))
    plain = lambda x: (x != "") & ~x.startswith("#") & ~x.startswith(">")

    def quote(rows: Column) -> Column:
        quoted = _until(_from_first(rows, lambda x: x.startswith(">") & (inner(x) != "")), lambda x: ~x.startswith(">"))
        return F.array_join(F.filter(F.transform(quoted, inner), lambda x: x != ""), " ")

    def paragraph(rows: Column) -> Column:
        block = _until(_from_first(rows, plain), lambda x: (x == "") | x.startswith("#"))
        return _filling(F.filter(block, lambda x: ~x.startswith(">")), SUMMARY)

    text = let(F.transform(lines(F.coalesce(md, F.lit(""))), strip), lambda rows: let(quote(rows), lambda q: F.when(q != "", q).otherwise(paragraph(rows))))
    cut = lambda t: F.when(t == "", NO_SUMMARY).otherwise(F.concat(F.substring(t, 1, SUMMARY), F.when(F.length(t) > SUMMARY, "...").otherwise("")))
    return let(text, cut)


def first_heading(md: Column, default: str = NO_TITLE) -> Column:
    """The text of the first ``# `` line."""
    found = strip(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def stance(md: Column, title: Column) -> Column:
    """The summary, or the title if there is none."""
    return let(intro_summary(md), lambda summary: F.when(summary == NO_SUMMARY, title).otherwise(summary))


def patch_signature(body: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """(body, changed): ``old`` becomes ``new`` where it occurs and ``new`` doesn't yet."""
    changed = body.contains(old) & ~body.contains(new)
    return F.when(changed, F.replace(body, old, new)).otherwise(body), changed


def is_placeholder(value: Column) -> Column:
    """Null, blank, or a text that only stands for a secret."""
    text = F.upper(strip(F.coalesce(value, F.lit(""))))
    return (text == "") | text.rlike("^(" + "|".join(PLACEHOLDER_STARTS) + ")") | text.rlike("|".join(PLACEHOLDER_PARTS))


def first_matching_line(text: Column, prefix: str, default: str) -> Column:
    """The first line with the prefix, else the first that isn't blank, else the default."""
    rows = lines(F.coalesce(text, F.lit("")))
    found = F.filter(rows, lambda x: x.startswith(prefix))
    filled = F.filter(rows, lambda x: strip(x) != "")
    return F.coalesce(F.get(found, F.lit(0)), F.get(filled, F.lit(0)), F.lit(default))
