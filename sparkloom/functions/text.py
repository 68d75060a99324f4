"""Column expressions over text: normal forms, ids, features. All JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom import config as C

#: Python's white space: Java's Unicode class and the four separators it leaves out.
SPACE = r"[\s\x1c-\x1f]"


#: The characters of SPACE.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    """Without white space at both ends: read from the ends only, unlike a pattern, which stops at each blank of a text."""
    return F.btrim(c, F.lit(_BLANKS))


def null_to_empty(c: Column) -> Column:
    """A null or a word that stands for one becomes the empty text."""
    return F.when(c.isNull() | c.isin(*C.NA_WORDS), F.lit("")).otherwise(c)


def label_key(c: Column) -> Column:
    """Text of a label: true and false as 1 and 0, whole numbers without fraction, else stripped."""
    n = c.try_cast("double")
    return F.when(F.lower(strip(c)).isin("true", "false"), (F.lower(strip(c)) == "true").cast("int").cast("string")).when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(strip(c))


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def whitespace(c: Column) -> Column:
    """One line end, one blank for a run of them, lines without white space at their ends, at most one empty line.

    A plain search goes before each pattern, so a text that is in this form passes none."""
    holds = lambda t, *parts: reduce(or_, map(t.contains, parts))
    when = lambda parts, pattern, to: lambda t: F.when(holds(t, *parts), F.regexp_replace(t, pattern, to)).otherwise(t)
    c = _bound(c, when("\r", r"\r\n?", "\n"))
    c = _bound(c, when(("  ", "\t", "\x0b", "\f"), r" [\t\x0B\f ]+|[\t\x0B\f][\t\x0B\f ]*", " "))  # a lone blank is no match
    c = F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n")
    return strip(_bound(c, when(("\n\n\n",), r"\n{3,}", "\n\n")))


def is_blank(c: Column) -> Column:
    """Nothing but white space: a search for the first other character, so it is the same before and after normalising."""
    return ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def stable_id(prefix: str, row: Column, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.format_string("%06d", row), F.lit("_"), F.substring(F.sha2(F.concat_ws("\n", *(p.cast("string") for p in parts)), 256), 1, 12))


def dedup_key(*parts: Column) -> Column:
    """Lower case, each run of white space one blank; texts that need no pattern once lines are joined are passed over."""
    pattern, odd = rf"(?U) {SPACE}+|[\s\x1c-\x1f&&[^ ]]{SPACE}*", r"(?U)[\s\x1c-\x1f&&[^ ]]"
    joined = F.replace(F.lower(F.concat_ws("\n", *parts)), F.lit("\n"), F.lit(" "))
    return strip(_bound(joined, lambda t: F.when(t.contains("  ") | t.rlike(odd), F.regexp_replace(t, pattern, " ")).otherwise(t)))


def hash_order(seed: int, c: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), c), 256)


def whole_term(term: str) -> str:
    body = r"\s+".join(re.escape(p) for p in term.split())
    return rf"(?<![a-z0-9]){body}(?![a-z0-9])"


def _folded(c: Column) -> Column:
    """Lower case, with the four other letters that a pattern without regard to case takes for ASCII ones put as these."""
    odd = "\u017f\u0131\u212a\u0130"
    return _bound(F.lower(c), lambda low: F.when(reduce(or_, map(low.contains, odd)), F.translate(low, odd, "siki")).otherwise(low))


def _holds(c: Column, terms: Iterable[str]) -> Column:
    """Whether c holds all words of some term, anywhere: plain search, much cheaper than the patterns it saves."""
    return reduce(or_, (reduce(and_, (c.contains(w) for w in t.split())) for t in terms), F.lit(False))


#: Letters that a pattern of many ways looks at together.
_GROUP = 5


def _one_of(words: set[str]) -> str:
    """A pattern for one of the words that branches letter by letter, so a place is given up at the first wrong one.

    Where many letters can come next, they are looked at in groups first: a branch tries its ways one after the other."""
    tails: dict[str, set[str]] = {}
    for w in filter(None, words):
        tails.setdefault(w[0], set()).add(w[1:])
    if not tails:
        return ""
    ways = [(letter, letter + _one_of(rest)) for letter, rest in sorted(tails.items())]
    body = "|".join(w for _, w in ways)
    if len(ways) > 2 * _GROUP:
        groups = [ways[i : i + _GROUP] for i in range(0, len(ways), _GROUP)]
        body = "|".join(f"(?=[{''.join(letter for letter, _ in g)}])(?:{'|'.join(w for _, w in g)})" for g in groups)
    return f"(?:{body})?" if "" in words else f"(?:{body})"


def keyword_chains(folded: Column, keywords: C.Keywords) -> Column:
    """What of a folded text can take part in a term: words of terms, each with its neighbours of that kind, in order.

    A term is words with white space or its own other characters between them, so every place of one lies in one chain;
    chains are parted by NUL. One search of the text replaces one for each term. A term that begins or ends with another
    character than a letter or digit keeps the whole text.
    """
    terms = [*(t for c in C.CATEGORIES for t in keywords.lists[c]), *keywords.variants, *keywords.variants.values()]
    if not all(re.fullmatch(r"[a-z0-9](?:.*[a-z0-9])?", t, re.DOTALL) for t in terms) or any("\0" in t for t in terms):
        return folded
    word = rf"{_one_of({w for t in terms for w in re.findall('[a-z0-9]+', t)})}(?![a-z0-9])"
    between = "".join(sorted(map(re.escape, {x for t in terms for x in re.sub(r"[a-z0-9\s]", "", t)})))
    chain = rf"{word}(?:[\s{between}]++{word})*+"
    # words of no term are passed over as a whole, up to a chain or the end; possessive repeats are loops in the JVM, so
    # texts and chains of any length need no stack
    passed = rf"(?:[^a-z0-9]*+(?!{word})[a-z0-9]++)*+[^a-z0-9]*+"
    return F.array_join(F.regexp_extract_all(folded, F.lit(rf"{passed}({chain}|\z)"), F.lit(1)), "\0")


def variants_normalised(c: Column, keywords: C.Keywords) -> Column:
    """Keyword chains of the folded text with variants replaced, longest first."""
    pairs = sorted(keywords.variants.items(), key=lambda x: (-len(x[0]), x[0]))
    replaced = lambda t: F.when(_holds(t, keywords.variants), reduce(lambda u, x: F.regexp_replace(u, whole_term(x[0]), x[1]), pairs, t)).otherwise(t)
    return _bound(keyword_chains(_folded(c), keywords), replaced)


def keyword_count(normalised: Column, terms: list[str]) -> Column:
    """Phrases first, longest first, each blanked once counted; then words, which are runs of letters and digits."""
    phrases = sorted((t for t in terms if " " in t), key=lambda t: (-len(t.split()), -len(t), t))
    words = [t for t in terms if " " not in t]
    rest = lambda t: F.size(F.filter(F.split(t, "[^a-z0-9]+"), lambda w: w.isin(words)))

    def counted(t: Column, left: list[str]) -> Column:
        if not left:
            return rest(t)
        there, term = _holds(t, left[:1]), whole_term(left[0])
        n = F.when(there, F.regexp_count(t, F.lit(term))).otherwise(0)
        return n + _bound(F.when(there, F.regexp_replace(t, term, " ")).otherwise(t), lambda u: counted(u, left[1:]))

    return F.when(_holds(normalised, phrases), counted(normalised, phrases)).otherwise(rest(normalised)).cast("bigint")


URL_MARK = r"(?i)\[URL:\s*([^\]\r\n]+)\]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,7}}:|(?:{_H}:){{1,6}}:{_H}|(?:{_H}:){{1,5}}(?::{_H}){{1,2}}|(?:{_H}:){{1,4}}(?::{_H}){{1,3}}|(?:{_H}:){{1,3}}(?::{_H}){{1,4}}|(?:{_H}:){{1,2}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{1,6}}|:(?::{_H}){{1,7}}|::)"


def url_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(URL_MARK)).cast("bigint")


def ip_url_count(c: Column) -> Column:
    hosts = F.transform(F.regexp_extract_all(c, F.lit(URL_MARK), F.lit(1)), lambda u: F.split_part(strip(u), F.lit("/"), F.lit(1)))
    return F.size(F.filter(hosts, lambda h: h.rlike(rf"\A(?:{IPV4}|{IPV6})\z"))).cast("bigint")


def uppercase_ratio(c: Column) -> Column:
    """Small letters are taken out of the letters, which are bound: two patterns over a whole text in one generated method cost
    three times as much as one after the other."""
    upper = lambda t: F.length(F.regexp_replace(t, "[a-z]+", ""))
    share = _bound(F.regexp_replace(c, "[^A-Za-z]+", ""), lambda t: F.when(t != "", upper(t).cast("double") / F.length(t)))
    return F.coalesce(share, F.lit(0.0))


def exclamations(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("!"), F.lit("")))).cast("bigint")


def features(subject: Column, body: Column, keywords: C.Keywords | None = None) -> dict[str, Column]:
    """The eight features, in order. `_norm` must hold variants_normalised() of the feature text."""
    keywords, text, norm = keywords or C.Keywords(), F.concat_ws("\n", subject, body), F.col("_norm")
    counts = {f"{c}_word_count": keyword_count(norm, keywords.lists[c]) for c in C.CATEGORIES}
    return {"url_count": url_count(text), "ip_address_url_count": ip_url_count(text)} | counts | {"uppercase_letter_ratio": uppercase_ratio(text), "exclamation_mark_count": exclamations(text)}


def _tenths(x: Column) -> Column:
    """x in whole tenths, rounded by its exact binary value, ties to even: as text formatting with one decimal does."""
    k = F.floor(x * 10)
    odd = (2 * k + 1).cast("double")
    half = odd / 20
    # sign of half's own error, from a product split in two exact parts
    high = half * 134217729.0 - (half * 134217729.0 - half)
    error = (high * 20 - odd) + (half - high) * 20
    up = (x > half) | ((x == half) & ((error > 0) | ((error == 0) & (k % 2 == 1))))
    return k + up.cast("bigint")


def observed_text(feature: Column, value: Column) -> Column:
    """A ratio as percent with at most one decimal, a count as a whole number."""
    m = _tenths(value * 100)
    percent = F.concat(F.floor(m / 10).cast("string"), F.when(m % 10 == 0, "").otherwise(F.concat(F.lit("."), (m % 10).cast("string"))), F.lit("%"))
    return F.when(feature == C.RATIO_FEATURE, percent).otherwise(F.round(value).cast("bigint").cast("string"))


def link_target(url: Column) -> Column:
    """Host in lower case, path with single slashes, query kept, fragment dropped, at most 240 characters."""
    full = F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    rest = F.regexp_replace(full, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(full, r"^[^:]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r":[0-9]*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/{2,}", "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(rest, r"(\?.*)$", 1)
    out = F.regexp_replace(F.concat(F.when(host == "", F.lit("unknown-host")).otherwise(host), path, query), r"[\x00-\x1f\x7f\[\]]", "")
    return F.substring(out, 1, 240)
