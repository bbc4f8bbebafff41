"""String functions of the claim graph as Column expressions, kept inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HEDGES, NEGATIONS

SPACES = r"(?U)\s+"
NUMERAL = r"^[0-9]+([.][0-9]+)?$"
WORDY = r"[\p{IsAlphabetic}\p{N}]"
#: Fixed values of the shape rules: words that end a title, and nouns of reading order.
TITLE_STOPS = ("the", "a", "an", "and", "or", "of", "in", "on", "for", "to", "with", "by", "we", "i", "you", "they", "he", "she", "it", "not", "but", "if", "when", "once", "this", "that", "as", "at", "is", "was", "there", "here", "am")
STRUCTURE = ("part", "parts", "chapter", "chapters", "section", "sections", "appendix", "appendices")


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def normalize(c: Column) -> Column:
    return F.lower(collapse(c))


def blank(c: Column) -> Column:
    return c.isNull() | F.regexp_like(c, F.lit(r"(?U)^\s*$"))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda t: t != "")


def numeral(t: Column) -> Column:
    return F.regexp_like(t, F.lit(NUMERAL))


def has_negation(norm: Column) -> Column:
    return F.exists(tokens(norm), lambda t: t.isin(*NEGATIONS))


def stripped(norm: Column) -> Column:
    """Tokens without negations."""
    return F.array_join(F.filter(tokens(norm), lambda t: ~t.isin(*NEGATIONS)), " ")


def masked(norm: Column) -> Column:
    """Tokens with every numeral as one mark that no token can be."""
    return F.array_join(F.transform(tokens(norm), lambda t: F.when(numeral(t), F.lit("\u0000#\u0000")).otherwise(t)), " ")


def hedges(c: Column) -> Column:
    """Hedge words that stand free, in the vocabulary's order."""
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(h)) & F.regexp_like(low, F.lit(f"(?<!{WORDY}){h}(?!{WORDY})")), F.lit(h)) for h in HEDGES]))


def dropped_hedges(body: Column, marks: Column, span: Column) -> Column:
    """Hedges (marks) of an episode that a span which is not verbatim in its collapsed text (body) has lost."""
    return F.when(F.contains(body, collapse(span)), F.array().cast("array<string>")).otherwise(F.array_except(marks, hedges(span)))


def content_form(c: Column) -> Column:
    """Lower-case tokens without hedge words (judged without the marks around them)."""
    bare = lambda t: F.regexp_replace(F.lower(t), r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")
    norm = normalize(c)  # most texts hold no hedge at all, and need no look at their tokens
    return F.when(F.regexp_like(norm, F.lit("|".join(HEDGES))), F.lower(F.array_join(F.filter(tokens(collapse(c)), lambda t: ~bare(t).isin(*HEDGES)), " "))).otherwise(norm)


def grams(norm: Column) -> Column:
    """Distinct windows of four characters inside tokens."""
    long = F.filter(tokens(norm), lambda t: F.length(t) >= 4)
    return F.array_distinct(F.flatten(F.transform(long, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.substring(t, i, F.lit(4))))))


#: Leading words of two letters or more that are all capitals, whatever marks they hold.
CAPITALS = r"^(?:[^\p{IsAlphabetic} ]*(?:\p{IsUppercase}[^\p{IsAlphabetic} ]*){2,}(?: |$))+"


def _title(w: Column) -> Column:
    letters = F.regexp_replace(w, r"[^\p{IsAlphabetic}]", "")
    return ~F.lower(w).isin(*TITLE_STOPS) & F.regexp_like(letters, F.lit(r"^\p{IsUppercase}\p{IsLowercase}*$"))


def glued_lead(collapsed: Column) -> Column:
    """A title that runs into a sentence, or stands alone."""
    w = tokens(collapsed)
    n = F.size(w)
    opens = lambda run: F.regexp_like(F.get(w, run), F.lit(r"^\p{IsUppercase}")) & F.regexp_like(F.get(w, run - 1), F.lit(f"{WORDY}$"))
    run = F.trim(F.regexp_extract(collapsed, CAPITALS, 0))
    caps = F.when(run == "", 0).otherwise(F.length(run) - F.length(F.replace(run, F.lit(" "), F.lit(""))) + 1)
    two = (n >= 2) & F.coalesce(_title(F.get(w, F.lit(0))) & _title(F.get(w, F.lit(1))), F.lit(False))
    return ((caps >= 2) & ((caps == n) | F.coalesce(opens(caps), F.lit(False)))) | (two & ((n == 2) | F.coalesce(opens(F.lit(2)), F.lit(False))))


def structure_reference(collapsed: Column) -> Column:
    low = F.lower(collapsed)
    return F.contains(low, F.lit("following chapter")) | F.contains(low, F.lit("next chapter")) | F.regexp_like(low, F.lit(rf"(^| )({'|'.join(STRUCTURE)}) [0-9]"))


def headings(episode: Column) -> Column:
    """The heading lines of an episode, without their first mark, collapsed; worked out once an episode."""
    lines = F.filter(F.split(episode, "\r?\n"), lambda x: F.startswith(x, F.lit("#")))
    return F.array_distinct(F.transform(lines, lambda x: collapse(F.substring(x, 2, 1 << 30))))


def shape(text: Column, heads: Column) -> Column:
    """The first shape rule that a candidate breaks, or null; heads are the headings() of its episode."""
    c = collapse(text)
    heading = F.startswith(c, F.lit("#")) | ((c != "") & F.array_contains(heads, c))
    marker = r"^(?:[-*+•]|[0-9]+[.)])"  # nothing need follow it: "-next", "3.5 litres"
    rest = F.ltrim(F.regexp_replace(c, marker, ""))
    listed = F.regexp_like(c, F.lit(marker))
    idle = (rest == "") | (~F.regexp_like(rest, F.lit("[.!?]")) & (F.size(tokens(rest)) <= 6))
    pipes = F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit(""))) >= 2
    return (
        F.when(F.endswith(c, F.lit("?")), "interrogative_final")
        .when(heading | glued_lead(c), "heading_fragment")
        .when(F.contains(c, F.lit(" > ")) | pipes | (listed & idle) | structure_reference(c), "nav_boilerplate")
    )


def slug(c: Column, fallback: str = "section") -> Column:
    s = F.trim(F.regexp_replace(F.lower(collapse(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", fallback).otherwise(s)
