"""Classes of documents by ordered rules over several fields.

A rule names a class, the field it reads, patterns of which one must be found there (ignoring case), and optionally patterns of which none
may be found in a field. The first rule that holds gives the class and the reason. A list of rules becomes one
expression, so any number of them costs one pass; fields are expressions over a row, such as a headline, a source or the first
part of a body, and precedence between fields is the order of the rules. Null fields are empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    verdict: str
    field: str
    patterns: tuple[str, ...]
    reason: str = ""
    unless: tuple[str, ...] = ()
    unless_field: str = ""
    only: tuple[tuple[str, str], ...] = ()


def openings(patterns: tuple[str, ...]) -> str:
    """The letters that matches of ``patterns`` begin with; empty unless all their alternatives begin with one plain letter."""
    letters = set()
    for pattern in patterns:
        flat = re.sub(r"\\.|\[[^]]*\]", "_", pattern)
        while (inner := re.sub(r"\([^()]*\)", "_", flat)) != flat:
            flat = inner
        for alternative in flat.split("|"):
            if not re.match(r"[a-z](?![?*{])", alternative):
                return ""
            letters.add(alternative[0])
    return "".join(sorted(letters))


def found(field: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of ``patterns`` is found; an empty tuple is found anywhere. They are only tried where a letter stands that one begins with."""
    first = f"(?=[{letters}])" if (letters := openings(patterns)) else ""
    return F.coalesce(field, F.lit("")).rlike(f"(?i){first}(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") if patterns else F.lit(True)


def classify(rules: list[Rule], fields: dict[str, Column], default: tuple[str, str] = ("", "")) -> Column:
    """struct<verdict, reason, rule> of the first rule that holds (``rule`` its place), or of ``default`` with rule -1. ``only`` of
    a rule are values that fields must have."""
    answer = lambda verdict, reason, at: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"), F.lit(at).alias("rule"))
    out = None
    for at, rule in enumerate(rules):
        test = found(fields[rule.field], rule.patterns)
        if rule.unless:
            test = test & ~found(fields[rule.unless_field or rule.field], rule.unless)
        for field, value in rule.only:
            test = test & F.coalesce(fields[field] == value, F.lit(False))
        out = (F if out is None else out).when(test, answer(rule.verdict, rule.reason, at))
    none = answer(*default, -1)
    return none if out is None else out.otherwise(none)


#: What marks operational, policy and economics-adjacent documents.
OPERATIONAL = (
    r"digital euro|digital dollar|central bank digital",
    r"payment(s)? system|target2|t2s|tips|instant payment|sepa|fedwire|fednow|check clearing",
    r"banknote|coin|counterfeit|currency circulation|cash cycle",
    r"supervis|ssm |single supervisory|prudential|resolution (board|planning)|stress test methodolog",
    r"appoint|nominat|resign|retire|obituar|in memoriam|award|prize|honou?r",
    r"call for papers|conference (announcement|programme)|vacanc|recruitment|internship",
    r"working paper series|occasional paper|technical note|methodolog(y|ical) (note|change)",
    r"website|newsletter|podcast episode announcement|social media",
    r"enforcement action|consent order|civil money penalty|banking application",
    r"financial literacy|school competition|museum|open day|anniversar",
    r"statistical (release calendar|revision policy)|data dictionary|reporting requirement",
)
POLICY = (
    r"monetary policy|policy (stance|decision|statement|rate)|interest rate|rate (cut|hike|path|decision)",
    r"inflation|disinflation|price stability|hicp|cpi|pce|wage growth",
    r"fomc|governing council|deposit facility|federal funds|refinancing operation",
    r"minutes|account of the monetary policy|press conference|projections|forecast",
    r"forward guidance|restrictive|accommodative|neutral rate|r-?star|data-?dependent",
    r"labour market|labor market|unemployment|recession|growth outlook|output gap",
    r"quantitative (easing|tightening)|asset purchase|app |pepp|balance sheet reduction",
)
ADJACENT = (
    r"financial stability|credit|bank lending|housing market|fiscal|debt|tariff|trade|energy pric",
    r"productivity|competitiveness|euro area economy|us economy|global outlook|geopolitic",
)
#: How much of a body counts, and how much of a pattern is a reason.
BODY, REASON = 4000, 28

#: Operational words in the headline win over policy in the body, but not over policy in the headline.
RELEVANCE = [
    Rule("policy", "headline", POLICY, "layer1:policy"),
    *(Rule("operational", "headline", (p,), f"layer1:operational ({p[:REASON]})") for p in OPERATIONAL),
    Rule("policy", "all", POLICY, "layer1:policy"),
    Rule("macro-adjacent", "all", ADJACENT, "layer1:macro-adjacent"),
]
NOISE = ("operational", "layer1:no-policy-content")


def relevance(title: Column, source: Column, body: Column) -> Column:
    """struct<verdict, reason, rule> of a document; ``operational`` ones aren't scored."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    headline = F.concat_ws(" ", empty(title), empty(source))
    return classify(RELEVANCE, {"headline": headline, "all": F.concat_ws(" ", headline, F.left(empty(body), F.lit(BODY)))}, NOISE)


#: Titles of surveys, which are statistics unless somebody speaks about them.
SURVEYS = (
    r"consumer\s+expectations?\s+survey", r"bank\s+lending\s+survey", r"survey\s+of\s+professional\s+forecasters", r"senior\s+loan\s+officer", r"survey\s+on\s+the\s+access\s+to\s+finance", r"survey\s+of\s+monetary\s+analysts",
    r"\bsurvey\b[^.]{0,80}\b(lending|credit|loans?|banks?)\b", r"\b(lending|credit|loans?)\b[^.]{0,80}\bsurvey\b",
)
SPOKEN = (r"speech|remark|interview|testimony",)
#: Documents that announce a decision, projections, and policy documents by their words.
DECISION, NO_DECISION = (r"fomc statement|issues fomc statement|monetary policy decisions?\b",), (r"minutes|press conf|transcript|account|projections|implementation note",)
PROJECTIONS = (r"fomc sep|summary of economic projections",)
POLICY_WORDS = (r"press conf|minutes|statement|meeting of|accounts of|monetary policy|fomc|ecb monetary",)


def is_survey(title: Column, source: Column) -> Column:
    return classify([Rule("survey", "title", SURVEYS, unless=SPOKEN, unless_field="source")], {"title": title, "source": source})["rule"] >= 0


def _of_both(rule: Rule, title: Column, source: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(source, F.lit("")), F.coalesce(title, F.lit("")))
    return classify([rule], {"both": both})["rule"] >= 0


def is_decision(title: Column, source: Column) -> Column:
    return _of_both(Rule("decision", "both", DECISION, unless=NO_DECISION), title, source)


def is_projection(title: Column, source: Column) -> Column:
    return _of_both(Rule("projections", "both", PROJECTIONS), title, source)


def is_policy_document(title: Column, source: Column) -> Column:
    """By either field on its own, so that no phrase is found across the two."""
    return found(source, POLICY_WORDS) | found(title, POLICY_WORDS)


#: Hosts, words and the path of official statements of the two banks.
OPENING = "/press_conference/monetary-policy-statement/"
STATEMENTS = [
    Rule("statement", "both", ("fomc statement|fed statement",), unless=("minutes|projections|press conference",), only=(("bank", "FED"), ("host", "www.federalreserve.gov"))),
    Rule("statement", "both", ("monetary policy decisions|monetary policy statement",), only=(("bank", "ECB"), ("host", "www.ecb.europa.eu"))),
    Rule("statement", "path", (OPENING,), only=(("bank", "ECB"), ("host", "www.ecb.europa.eu"))),
]


def is_statement(bank: Column, url: Column, title: Column, source: Column, is_statistical: Column) -> Column:
    """An official meeting statement: on the bank's own host and named so, or, of one bank, under its path. Addresses that
    are none are no statements."""
    both = F.concat_ws(" ", F.coalesce(source, F.lit("")), F.coalesce(title, F.lit("")))
    host, path = (F.try_parse_url(url, F.lit(part)) for part in ("HOST", "PATH"))
    fields = {"bank": bank, "host": F.lower(host), "path": path, "both": both}
    return ~F.coalesce(is_statistical, F.lit(False)) & url.isNotNull() & (classify(STATEMENTS, fields)["rule"] >= 0)


#: Names of sources and of the scorer in the records.
MODEL = "frozen lexicon + linear ensemble (no LLM)"
SPEECH_SOURCES, REMARK_SOURCES = {"Member Speech (BIS)": "bis", "Member Speech (Fed site)": "fed_site"}, ("GC Member Remark", "Fed Official Remark")


def score_kind(title: Column, source: Column, record: Column) -> Column:
    """How a score came about, from its JSON ``record``: sep, frozen or legacy."""
    model = F.try_variant_get(F.try_parse_json(record), "$.scoring_audit.model", "string")
    return F.when(is_projection(title, source), "sep").when(model == MODEL, "frozen").otherwise("legacy")


def text_kind(source: Column, url: Column, record: Column) -> Column:
    """Where a scored text came from. A remark is verified only if its record has a true there, no word for it, and it has an address."""
    said = F.try_variant_get(F.try_parse_json(record), "$.source_resolution.verified", "variant")
    verified = F.when(F.schema_of_variant(said) == "BOOLEAN", F.try_variant_get(said, "$", "boolean"))
    out = F.when(source.isin(*REMARK_SOURCES), F.when(F.coalesce(verified, F.lit(False)) & (F.coalesce(url, F.lit("")) != ""), "ai_verified").otherwise("ai_discovered"))
    for name, kind in SPEECH_SOURCES.items():
        out = out.when(source == name, kind)
    return out.otherwise("primary")
