"""Text as column expressions: addresses, titles, names, sentences, dates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that are decoded, in this order.
ENTITIES = [("&amp;", "&"), ("&#x27;", "'"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]


def chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    """Regular expression replacements, one after the other."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def html_decode(text: Column) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), ENTITIES, text)


@dataclass(frozen=True)
class AddressRules:
    """What makes addresses of one page the same: path segments that only name its language, segments that sites
    translate (on their own, and behind another segment), and endings that a language may stand before."""

    languages: tuple[str, ...]
    words: dict[str, str]
    behind: dict[str, dict[str, str]]
    endings: tuple[str, ...]


#: Languages, the German and English names of one site's paths, and endings.
ADDRESSES = AddressRules(
    languages=("en", "de", "fr", "es", "it", "nl", "pt"),
    words={"presse": "press"},
    behind={"presse": {"reden": "speeches", "interviews": "interviews", "gastbeitraege": "contributions"}},
    endings=("html", "htm", "pdf"),
)


def canonical_url(url: Column, rules: AddressRules = ADDRESSES) -> Column:
    """Host and path of an address, in one form for all languages of a page: lower case, without scheme, www, query, fragment and empty
    segments; folders mapped by ``rules``; without a language before the ending and without a number of four or more digits behind a hyphen at the end."""
    bare = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), r"^(?:https?://)?([^?#]*)", 1), r"^www\.", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    host, folders, page = F.slice(parts, 1, 1), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), F.slice(parts, F.lit(2), F.size(parts))

    def folder(x: Column, i: Column) -> Column:
        out = F.when(x.isin(*rules.languages), "__lang__")
        for first, names in rules.behind.items():
            for name, other in names.items():
                out = out.when((x == name) & (F.get(folders, i - 1) == first), other)
        for name, other in rules.words.items():
            out = out.when(x == name, other)
        return out.otherwise(x)

    last = F.regexp_replace(F.array_join(F.slice(page, F.greatest(F.size(page), F.lit(1)), F.lit(1)), ""), r"-[0-9]{4,}$", "")
    last = F.regexp_replace(last, rf"\.(?:{'|'.join(rules.languages)})\.({'|'.join(rules.endings)})$", ".$1")
    return F.array_join(F.concat(host, F.transform(folders, folder), F.filter(F.array(last), lambda x: x != "")), "/")


def canonical_url_short(url: Column) -> Column:
    """The older form: the query stays."""
    return chain(F.lower(url), [(r"^[a-z]+://(www\.)?", ""), (r"/+$", "")])


#: What is cut from a title, in this order, and what stands for what is left between words.
TITLE_CUTS = [r"\(with q&a\)", r"\s+\|\s+.*$", r"\x{2014}.*$", r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"]
TITLE_GAPS = r"[^A-Za-z0-9_]+"


def normal_title(title: Column) -> Column:
    """The words of a title in lower case, without its additions: Latin letters without accents, digits and underscores."""
    short = chain(F.lower(html_decode(title)), [(cut, "") for cut in TITLE_CUTS])
    return F.trim(F.regexp_replace(short, TITLE_GAPS, " "))


def word_count(text: Column) -> Column:
    """Parts between white space; empty edges count."""
    return F.size(F.split(text, r"\s+"))


def sentences(text: Column, least_words: int = 6) -> Column:
    """Sentences end at . ! or ? before white space and a capital, quote or bracket."""
    flat = F.trim(F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), r"\s+", " "))
    parts = F.split(flat, r"(?<=[.!?]) (?=[A-Z\"“(])")
    return F.filter(parts, lambda s: F.size(F.split(s, " ")) >= least_words)


def guidance_sentences(text: Column) -> Column:
    """The other splitter: any end mark and white space, over 15 characters."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 15)


def speaker(title: Column) -> Column:
    """Name in front of a colon, first of several, letters only, 3 to 40 characters."""
    head = F.regexp_extract(title, r"^([^:]{2,59}):", 1)
    name = F.trim(F.regexp_extract(head, r"^(.*?)(?:,| & | and |$)", 1))
    fits = F.length(name).between(3, 40) & name.rlike(r"^[\p{L} .'-]+$")
    by = F.trim(F.regexp_extract(title, r"\bby ([A-Z][\p{L}.'-]+(?: [A-Z][\p{L}.'-]+)*)$", 1))
    return F.when(fits, name).when(by != "", by)


def sample_ends(text: Column, budget: int) -> Column:
    """Begin, middle and end of a long text, a third of the budget each."""
    third = budget // 3
    middle = (F.floor(F.length(text) / 2) - third // 2 + 1).cast("int")
    parts = F.concat_ws(" ... ", F.substring(text, 1, third), F.substring(text, middle, F.lit(third)), F.right(text, F.lit(third)))
    return F.when(F.length(text) <= budget, text).otherwise(parts)


def fingerprint(text: Column, chars: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(chars))


def percent(text: Column) -> Column:
    """First number before %; negative behind falling words unless to, at or of stand before it."""
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?) ?%", 1)
    value = F.nullif(number, F.lit("")).cast("double")
    falls = F.lower(text).rlike(r"(fell|fall|declin|decreas|drop|down|lower)[a-z]* [^.]*?[0-9]") & ~F.lower(text).rlike(r"\b(to|at|of) [0-9]+(\.[0-9]+)? ?%")
    return F.when(falls, -value).otherwise(value)


#: How sizes of moves are written, and what the fractions are worth.
BASIS = r"([0-9]+(?:\.[0-9]+)?)\s*basis\s*points?"
FRACTION = r"(1/4|1/2|3/4|one[- ]quarter|one[- ]half|three[- ]quarters?|half|quarter)\s*(?:of a\s*)?percentage\s*point"
PERCENTAGE = r"([0-9]+(?:\.[0-9]+)?)\s*percentage\s*points?"
UNSTATED = 25.0


def stated_points(text: Column) -> Column:
    """The size of a move in basis points, be it stated as such, as a fraction of a percentage point or in percentage points; null if it isn't."""
    t = F.lower(text)
    found = lambda pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))
    part = found(FRACTION)
    quarters = F.when(part.startswith("three") | part.startswith("3"), 3.0).when(part.endswith("half") | (part == "1/2"), 2.0).when(part.isNotNull(), 1.0)
    return F.coalesce(found(BASIS).cast("double"), quarters * 25, found(PERCENTAGE).cast("double") * 100)


def basis_points(text: Column) -> Column:
    """stated_points(), and 25 where none or zero is stated."""
    return F.coalesce(F.nullif(stated_points(text), F.lit(0.0)), F.lit(UNSTATED))


_PERSON = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"


def byline(text: Column) -> Column:
    """Who a text is by, without an honorific."""
    return F.nullif(F.regexp_extract(text, rf"\bby (?:(?:Mr|Ms|Mrs|Dr) )?({_PERSON})", 1), F.lit(""))


def by_president(text: Column) -> Column:
    """Surname of the president whose text it is."""
    return F.nullif(F.regexp_extract(text, r"\bby President ([A-Z][a-z]+)", 1), F.lit(""))
