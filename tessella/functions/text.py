"""Text functions as column expressions; patterns are Java's, (?U) where Unicode classes are meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and thresholds that results depend on.
#: A quoted span: any opening mark, eight inner characters or more, any closing mark.
QUOTED = '[“"][^”"]{8,}[”"]'
#: Lines of page furniture that never belong to a paragraph.
JUNK = (
    r"^\s*(?:"
    r"\d{1,4}"
    r"|Cite as:.*"
    r"|(?:Opinion|Syllabus|Per Curiam)(?:\s+of\s+.*)?"
    r"|[A-Z][A-Za-z'’]+(?:,\s*(?:C\.\s*)?J\.)?,\s*(?:concurring|dissenting).*"
    r"|Opinion of [A-Z][A-Za-z'’]*(?:,\s*(?:C\.\s*)?J\.)?.*"
    r"|[A-Z][A-Z .,'’&()\-]{4,}\s+v\.\s+[A-Z][A-Z .,'’&()\-]{2,}"
    r"|NOTICE:.*|Page Proof Pending Publication"
    r")\s*$"
)
#: The header that starts an opinion in laid-out text: author, what stands between, role.
HEADER = (
    r"(?s)(?:CHIEF\s+JUSTICE|JUSTICE)\s+([A-Z][A-Z’']{2,})"
    r"((?:,\s*(?:with\s+whom|and)?[^.]{0,220}?)?)"
    r",?\s*(delivered the opinion of the Court[^.]{0,200}?"
    r"|announced the judgment of the Court[^.]{0,200}?"
    r"|concurring(?:\s+in[^.]{0,120})?"
    r"|dissenting(?:\s+in[^.]{0,120})?"
    r"|concurring in the judgment[^.]{0,80})\."
)
#: The same in running text, where a header begins a line.
BLOB_HEADER = (
    r"(?:^|\n)\s*((?:Mr\.\s+)?(?:Chief\s+)?Justice\s+[A-Z][a-zA-Z’']+"
    r"(?:,\s*(?:with\s+whom[^.]{0,260}?)?)?"
    r",?\s*(?:delivered the opinion|announced the judgment|concurring|dissenting)[^.]{0,400}?\.)"
)
TITLE = r"^(?:Mr\.\s+)?(?:Chief\s+)?Justice\s+"
#: Letters that Unicode's full mapping makes two or three capitals of, and the one capital they have; those without one stay.
WIDE = "[ßŉǰ\u0390\u03b0և\u1e96-\u1e9a\u1f50\u1f52\u1f54\u1f56\u1f80-\u1faf\u1fb2-\u1fb4\u1fb6\u1fb7\u1fbc\u1fc2-\u1fc4\u1fc6\u1fc7\u1fcc\u1fd2\u1fd3\u1fd6\u1fd7\u1fe2-\u1fe4\u1fe6\u1fe7\u1ff2-\u1ff4\u1ff6\u1ff7\u1ffc\ufb00-\ufb06\ufb13-\ufb17]"
CAPITALS = {c: c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1} | {"ß": "ẞ"}


def squeeze(t: Column) -> Column:
    """Runs of white space (Unicode's too) as one space, none at the ends."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def upper_each(t: Column) -> Column:
    """Upper case character by character, so that a text keeps its length."""
    runs = F.regexp_extract_all(t, F.lit(f"{WIDE}+|[^{WIDE[1:]}+"), F.lit(0))
    each = F.transform(runs, lambda r: F.when(r.rlike(WIDE), F.translate(r, "".join(CAPITALS), "".join(CAPITALS.values()))).otherwise(F.upper(r)))
    return F.when(t.rlike(WIDE), F.array_join(each, "")).otherwise(F.upper(t))


def dehyphenate(t: Column) -> Column:
    """Without soft hyphens and the space after them, and with words joined that a line's end broke."""
    soft = F.regexp_replace(t, r"(?U)\xAD\s*", "")
    return F.regexp_replace(soft, r"(?U)(\w)-\n(\w)", "$1$2")


def word_count(t: Column) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit(r"(?U)\S+"), F.lit(0)))


def quote_share(t: Column) -> Column:
    """The share of characters inside quoted spans, to four digits; 0 for an empty text."""
    spans = F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0))
    inside = F.aggregate(spans, F.lit(0), lambda n, s: n + F.length(s))
    return F.round(inside / F.greatest(F.length(t), F.lit(1)), 4)


def strip_quotes(t: Column) -> Column:
    """The text without quoted spans, squeezed."""
    return squeeze(F.regexp_replace(t, QUOTED, " "))


def author_name(t: Column) -> Column:
    """The first word of an author's name after titles; empty if there is none."""
    bare = F.btrim(F.regexp_replace(t, TITLE, ""), F.lit(" ,."))
    return F.coalesce(F.try_element_at(F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != ""), F.lit(1)), F.lit(""))


def title_case(t: Column) -> Column:
    """Each run of letters with a capital first and small letters after, as after an apostrophe too."""
    runs = F.regexp_extract_all(t, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def role_type(role: Column) -> Column:
    """The kind of opinion that a header's role means; the first rule that fits decides."""
    r = F.lower(role)
    return (
        F.when(r.contains("delivered") | r.contains("announced"), "majority")
        .when(r.startswith("concurring in the judgment"), "concurrence")
        .when(r.contains("concurring") & r.contains("dissenting"), "mixed")
        .when(r.contains("concurring"), "concurrence")
        .when(r.contains("dissenting"), "dissent")
        .otherwise("other")
    )


def is_junk(t: Column) -> Column:
    return t.rlike(JUNK)


def starts_footnote(t: Column) -> Column:
    return t.rlike(r"^\d+\s")


def first_long(columns: list[str], least: int) -> tuple[Column, Column]:
    """(text, name) of the first column with more than so many characters; both null if none has."""
    text = F.coalesce(*[F.when(F.length(c) > least, F.col(c)) for c in columns])
    name = F.coalesce(*[F.when(F.length(c) > least, F.lit(c)) for c in columns])
    return text, name
