"""Text out of PDF bytes and HTML containers: per-row helpers behind Arrow functions."""

from __future__ import annotations

import re
import unicodedata
import zlib
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STREAM = re.compile(rb"stream\r?\n?(.*?)endstream", re.S)
#: A literal string, or an operator that moves to another place on the page.
_TOKEN = re.compile(r"\(((?:\\.|[^\\()])*)\)|T\*|Td|TD|ET", re.S)
_ESCAPE = re.compile(r"\\(?:([nrt])|([0-7]{1,3})|(.))", re.S)
_BLANK = re.compile(r"[^\S\f]+")
#: How long prose is, in characters and words of two letters, and its share of letters and blanks.
PROSE_LENGTH, PROSE_WORDS, PROSE_SHARE = 40, 12, 0.75


def _unescaped(found: re.Match) -> str:
    blank, octal, other = found.groups()
    return " " if blank else chr(int(octal, 8) & 255) if octal else other


def _shown(content: str) -> str:
    """The text that a content stream shows."""
    parts = (" " if m[1] is None else _ESCAPE.sub(_unescaped, m[1]) for m in _TOKEN.finditer(content))
    return _BLANK.sub(" ", "".join(parts)).strip()


def _inflated(body: bytes) -> str | None:
    """A deflated stream, with or without a header, as far as it is sound."""
    body = body.rstrip(b"\r\n")
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        machine, out = zlib.decompressobj(bits), b""
        try:
            for at in range(0, len(body), 512):
                out += machine.decompress(body[at : at + 512])
        except zlib.error:
            pass
        if out:
            return out.decode("latin-1")
    return None


def is_prose(text: str) -> bool:
    if len(text) < PROSE_LENGTH or sum(len(w) > 1 for w in text.split()) < PROSE_WORDS:
        return False
    return sum(c == " " or (c.isascii() and c.isalpha()) for c in text) > PROSE_SHARE * len(text)


def pdf_pages(data: bytes | None) -> str | None:
    """Text of a PDF, pages separated by form feeds: of its streams those of prose, or all that show any
    text if there is none; of the raw file if no stream can be inflated."""
    if data is None:
        return None
    streams = [x for x in (_inflated(m[1]) for m in _STREAM.finditer(data)) if x]
    if not streams:
        return _shown(data.decode("latin-1"))
    shown = [_shown(x) for x in streams]
    return "\f".join([x for x in shown if is_prose(x)] or [x for x in shown if x])


def pdf_text(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(pdf_pages)

    return run(content)


_DROP = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*?>")


def container(html: str | None, names: tuple[str, ...] = ("article", "main")) -> str | None:
    """Text of the first balanced container, else of the whole page."""
    if html is None:
        return None
    html = _DROP.sub(" ", html)
    body = html
    for name in names:
        depth, start = 0, None
        for tag in _TAG.finditer(html):
            if tag[2].lower() != name:
                continue
            if not tag[1]:
                start, depth = tag.end() if start is None else start, depth + 1
            elif depth:
                depth -= 1
                if not depth:
                    body = html[start : tag.start()]
                    break
        if body is not html:
            break
    text = _TAG.sub(" ", body)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", text).strip()


def html_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(container)

    return run(html)


def title_key(title: Column) -> Column:
    """Without the speaker in front, marks and everything but letters and digits."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def key(t: str | None) -> str | None:
            if t is None:
                return None
            t = unicodedata.normalize("NFKD", re.sub(r"^[^:]{2,59}: ", "", t).lower())
            return "".join(c for c in t if c.isalnum() and not unicodedata.combining(c))

        return batch.map(key)

    return run(title)


def speech_key(*parts: Column) -> Column:
    """The parts joined by |, compatibility forms folded, letters, digits and blanks only."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        keep = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum() or c in " |") if t is not None else None
        return batch.map(keep)

    return run(F.concat_ws("|", *parts))


def folded(text: Column) -> Column:
    """Compatibility forms folded: the one step of a key that is no SQL function."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.str.normalize("NFKC")

    return run(text)


_NO_ALNUM, _ALNUM = re.compile(r"[\W_]+"), re.compile(r"[^\W_]")


def _lower(text: str) -> str:
    """Lower case, a character for each."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower()[:1] for c in text)


def find_quote(text: str | None, needle: str | None) -> tuple[int | None, int | None, int | None]:
    """(page, line, offset) of a quotation, by its letters and digits, or the first 60 or 30 of them."""
    low = _lower(text or "")
    flat, key = _NO_ALNUM.sub("", low), _NO_ALNUM.sub("", _lower(needle or ""))
    for n in (len(key), 60, 30):
        at = flat.find(key[:n]) if key else -1
        if at >= 0:
            offset = next(islice(_ALNUM.finditer(low), at, None)).start()
            return text.count("\f", 0, offset) + 1, text.count("\n", text.rfind("\f", 0, offset) + 1, offset) + 1, offset
    return None, None, None


def locate(text: Column, needle: Column) -> Column:
    """struct(page, line, offset): where a quotation is; pages are separated by form feeds."""

    @F.pandas_udf("page int, line int, offset int")
    def run(texts: pd.Series, needles: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(find_quote, texts, needles)), columns=["page", "line", "offset"]).astype("Int32")

    return run(text, needle)


#: What quotes or reports speech.
SPEECH = r"[\"“”]|\b(said|says|added|told|noted)\b"


def attributed(text: Column, name: str, speech: str = SPEECH) -> Column:
    """Sentences that name someone, and up to two behind that quote or report speech."""
    parts = F.split(text, r"(?<=[.!?])\s+")

    def step(state: Column, s: Column) -> Column:
        names = s.contains(name)
        follows = (state["left"] > 0) & s.rlike(speech)
        left = F.when(names, 2).when(follows, state["left"] - 1).otherwise(0)
        return F.struct(F.when(names | follows, F.concat(state["out"], F.array(s))).otherwise(state["out"]).alias("out"), left.cast("int").alias("left"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("left"))
    return F.aggregate(parts, start, step, lambda s: s["out"])
