"""HTML, link and personal-data sanitising in Arrow batches: what Spark has no built-in for.

A text goes through entities, markup, links, blanks and masks, in this order. Links become markers, which the later
steps must not touch: each is one letter that the text does not hold until the masks are done. Texts without any
character that one of these steps looks for never leave the JVM.
"""

from __future__ import annotations

import html
import ipaddress
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# fixed values: the patterns that define links, markers, addresses, phones and markup, and the words put in their place
MARK = re.compile(r"\[(?:URL|LINK):\s*[^\]\r\n]+\]", re.IGNORECASE)
LEGACY = re.compile(r"(?i)<URL:\s*((?:https?://|www\.)[^>\s]+)\s*>")
RAW = re.compile(r"(?i)(?:(?:https?://|ftp://)[^\s<>\"'\]]+|(?<![A-Za-z0-9])www\.[^\s<>\"'\]]+)")
EMAIL = re.compile(r"([A-Za-z0-9][A-Za-z0-9._%+\-]{0,63})@([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,63})\b")
NUMBER = re.compile(r"(?:\+?\d{1,3}[ .\-]?)?(?:\(?\d{2,4}\)?[ .\-]?){2,4}\d{2,4}(?!\w)")
PHONE = re.compile(rf"(?<!\w){NUMBER.pattern}")
TAG = re.compile(
    r"<\s*/?\s*(?:html|body|head|title|p|div|span|a|img|br|table|thead|tbody|tfoot|tr|td|th|ul|ol|li|h[1-6]|script|style|iframe|object|form|font|meta|link|source|video|audio|embed|blockquote|pre|hr)\b[^>]*>",
    re.IGNORECASE,
)
DROPPED, MEDIA = {"script", "style", "iframe", "object", "form"}, {"link", "source", "video", "audio", "embed"}
IMAGE, USER, PHONE_MASK, NO_HOST = " [REMOTE IMAGE REMOVED] ", "[USER]@", "[PHONE]", "unknown-host"
LINK_END, TARGET_CHARS, DECODINGS, PHONE_DIGITS = ".,;:!?)}>", 240, 8, range(7, 16)

# of HTML: elements without content, those that a new one of the kind ends, and those that hold what is open in them
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDED_BY = {"p": {"p"}, "li": {"li"}, "a": {"a"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = {"html", "body", "div", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "ol", "blockquote", "pre", "section", "article", "center"}


@dataclass
class Element:
    tag: str
    href: str = ""
    inside: list = field(default_factory=list)


class Tree(HTMLParser):
    """Elements and texts of a page. What is not closed ends with the element around it."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("")
        self.open = [self.root]
        self.feed(page)
        self.close()

    def _end(self, tags: set[str], barriers: set[str]) -> None:
        """Closes the innermost open element of these tags and all in it, unless a barrier is in between."""
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                del self.open[depth:]
                return
            if self.open[depth].tag in barriers:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDED_BY:
            self._end(ENDED_BY[tag], BLOCKS - ENDED_BY[tag])
        new = Element(tag, dict(attrs).get("href") or "")
        self.open[-1].inside.append(new)
        if tag not in VOID:
            self.open.append(new)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._end({tag}, set() if tag in BLOCKS else BLOCKS)

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def _texts(e: Element, in_link: bool = False):
    """The texts of an element in order; a link is one text. Media are kept inside a link, as its text is taken first."""
    for x in e.inside:
        if isinstance(x, str):
            yield x
        elif x.tag == "img":
            yield IMAGE
        elif x.tag == "a" and not in_link:
            words = [t.strip() for t in _texts(x, True)]
            yield " ".join(filter(None, [*words, marker(x.href) if re.match(r"(?i)https?://|www\.|ftp://", x.href) else ""]))
        elif x.tag not in DROPPED and (in_link or x.tag not in MEDIA):
            yield from _texts(x, in_link)


def html_to_text(page: str) -> str:
    return "\n".join(_texts(Tree(page).root)) if TAG.search(page) else page


def decode_entities(text: str) -> str:
    """Entities decoded DECODINGS times over: encoded ones come out as well."""
    return reduce(lambda t, _: html.unescape(t), range(DECODINGS), text) if "&" in text else text


def _users(text: str) -> str:
    return EMAIL.sub(lambda m: USER + m[2].lower(), text)


def _mask_numbers(text: str, found: Iterable[re.Match]) -> tuple[str, list[int]]:
    """text with those of the numbers found masked that have a phone's digits, and where the masks end."""
    out, ends, at, length = [], [], 0, 0
    for m in found:
        if m.start() >= at and len(re.findall(r"\d", m[0])) in PHONE_DIGITS:
            out += [text[at : m.start()], PHONE_MASK]
            length += m.start() - at + len(PHONE_MASK)
            ends.append(length)
            at = m.end()
    return "".join([*out, text[at:]]), ends


def phones(text: str) -> str:
    """Phones masked. A number that touched another becomes one of its own behind that one's mask, so these ends are looked
    at again until no mask is new."""
    text, ends = _mask_numbers(text, PHONE.finditer(text))
    while ends:
        text, ends = _mask_numbers(text, filter(None, [NUMBER.match(text, end) for end in ends]))
    return text


def normalise_space(text: str) -> str:
    lines = (re.sub(r"[\t\f\x0b ]+", " ", line).strip() for line in re.split(r"\r\n?|\n", text))
    return re.sub(r"\n\n\n+", "\n\n", "\n".join(lines)).strip()


#: An address: scheme, what is before the first slash, path, query; a fragment is left over.
_ADDRESS = re.compile(r"(?is)(?:[a-z][a-z0-9+.\-]*://)?(?P<authority>[^/?#]*)(?P<path>[^?#]*)(?P<query>\?[^#]+)?")
_SCHEME = re.compile(r"(?i)(https?|ftp):(?=//)")


def _host(authority: str) -> str | None:
    """Host without user and port in lower case, an IPv6 one in its short form; None for brackets around anything else."""
    name = authority.rpartition("@")[2]
    if "[" in authority or "]" in authority:
        inner = re.fullmatch(r"\[([^\[\]]*)\](?::.*)?", name)
        try:
            return str(ipaddress.IPv6Address(inner[1])) if inner else None
        except ValueError:
            return None
    return name.partition(":")[0].lower() or NO_HOST


def link_target(url: str) -> str:
    """Host without port, single slashes, query kept, personal data masked, cut to TARGET_CHARS."""
    parts = _ADDRESS.match(re.sub(r"[\t\r\n]", "", url.strip().rstrip(LINK_END)))
    host = _host(parts["authority"])
    if host is None:  # no address at all
        return NO_HOST
    rest = _users(re.sub("//+", "/", parts["path"] or "/") + (parts["query"] or ""))
    rest = _SCHEME.sub(lambda m: f"{m[1].lower()}-colon", _mask_numbers(rest, PHONE.finditer(rest))[0])
    return re.sub(r"[\x00-\x1f\x7f\[\]]", "", host + rest)[:TARGET_CHARS]


def marker(url: str) -> str:
    return f"[{'LINK' if url[:3].lower() == 'ftp' else 'URL'}: {link_target(url)}]"


def _placeholder(text: str) -> str:
    """A letter the text does not hold: to the masks, a marker's edge is the edge of a word."""
    held = set(text)
    return next(c for c in map(chr, range(0xA000, 0xA48D)) if c not in held)


def _marked(text: str) -> list[tuple[str, str]]:
    """The text as (plain text, marker after it), links made markers; the last marker is empty."""
    out, at = [], 0
    for found in MARK.finditer(text):
        out += [*_raw_links(text[at : found.start()]), (None, found[0])]
        at = found.end()
    return [*out, *_raw_links(text[at:])]


def _raw_links(plain: str):
    at = 0
    for found in RAW.finditer(plain):
        url = found[0].rstrip(LINK_END)
        yield plain[at : found.start()], marker(url)
        at = found.start() + len(url)
    yield plain[at:], ""


def sanitise_text(text: str | None) -> str:
    text = html_to_text(decode_entities(text or ""))
    parts = _marked(LEGACY.sub(lambda m: marker(m[1]), text))
    hold = _placeholder(text)
    plain = "".join((p or "") + (hold if m else "") for p, m in parts)
    plain = phones(_users(normalise_space(plain)))
    markers = [m for _, m in parts if m]
    pieces = plain.split(hold)
    return normalise_space("".join(p + m for p, m in zip(pieces, [*markers, ""], strict=True)))


#: What some step looks for: markup, entities, addresses, links, markers, and seven digits close together.
NEEDED = r"(?i)[<&@]|://|www\.|\[(?:URL|LINK):|[0-9](?:[ .()+-]{0,3}[0-9]){6}"


def sanitised(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([sanitise_text(t) for t in s], index=s.index), "string")(c)


def sanitised_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with a sanitised column (name: source) each. Only rows that need it go through Python; the rest is one native
    expression, which is the same where there is nothing to find."""
    need = F.lit(False)
    for source in columns.values():
        need = need | F.coalesce(F.col(source).rlike(NEEDED), F.lit(False))
    full = df.where(need).withColumns({name: sanitised(F.col(source)) for name, source in columns.items()})
    plain = df.where(~need).withColumns({name: T.whitespace(F.coalesce(F.col(source), F.lit(""))) for name, source in columns.items()})
    return full.unionByName(plain)


def html_rows(df: DataFrame, name: str, source: str) -> DataFrame:
    """df with the text of its pages; those without anything like markup or an entity stay in the JVM."""
    need = F.coalesce(F.col(source).rlike("[<&]"), F.lit(False))
    return df.where(need).withColumn(name, text_of_html(F.col(source))).unionByName(df.where(~need).withColumn(name, T.whitespace(F.coalesce(F.col(source), F.lit("")))))


def text_of_html(c: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([normalise_space(html_to_text(decode_entities(t or ""))) for t in s], index=s.index), "string")(c)
