"""Pages and wiki markup to text; tokens for search and for classifiers."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Elements whose content isn't the article.
CHROME = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg")
ARTICLE_BYTES, SNIFF_BYTES = 1500, 4096
MARKERS = ("<html", "<!doctype", "<head", "<body", "<meta", "<div", "<title", "<p>")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_of(html: Column) -> Column:
    """The title element's text; entities stay as they are."""
    return squeeze(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?s)<[^>]+>", " "))


def strip_tags(html: Column) -> Column:
    """The page's text by patterns alone: chrome dropped, tags to spaces, white space collapsed."""
    out = html
    for tag in CHROME:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return squeeze(F.regexp_replace(out, r"(?s)<[^>]+>", " "))


def may_be_article(html: Column) -> Column:
    """A cheap test before any parsing: long enough, and markup near the start."""
    head = F.lower(F.substring(html, 1, SNIFF_BYTES))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | head.contains(m)
    return (F.octet_length(html) >= ARTICLE_BYTES) & marked


def strip_wikitext(text: Column) -> Column:
    """Wiki markup to text: templates, files and categories go; a link leaves its label."""
    for pattern, to in (
        (r"\{\{[^}]*\}\}", " "),
        (r"(?i)\[\[(?:file|image|category):[^\]]*\]\]", " "),
        (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"),
        (r"\[\[([^\]]*)\]\]", "$1"),
        (r"(?s)<[^>]+>", " "),
        (r"'{2,}", ""),
    ):
        text = F.regexp_replace(text, pattern, to)
    return squeeze(text)


class _Article(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.block, self.blocks, self.all = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in CHROME[:7]:
            self.skip += 1
        elif tag in ("p", "h1", "h2", "h3") and not self.skip:
            self.block += 1
            self.blocks.append([])

    def handle_endtag(self, tag):
        if tag in CHROME[:7]:
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "h1", "h2", "h3"):
            self.block = max(0, self.block - 1)

    def handle_data(self, data):
        if not self.skip:
            self.all.append(data)
            if self.block and self.blocks:
                self.blocks[-1].append(data)


def article_text(html: str | None) -> str:
    """The paragraphs and headings of a page; its whole body where they are short.  Never raises."""
    parser = _Article()
    try:
        parser.feed(html or "")
        parser.close()
    except Exception:  # a broken page gives what was read so far
        pass
    text = "\n".join(t for b in parser.blocks if (t := " ".join("".join(b).split())))
    return text if len(text) >= 200 else " ".join(" ".join(parser.all).split())


@F.pandas_udf(StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(article_text)


def search_terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; the tokens of an index without stemming."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def grams(text: Column) -> Column:
    """Lower-cased words and joined pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    pairs = F.when(F.size(words) > 1, F.transform(F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("a"), F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1)).alias("b")), lambda x: F.concat(x["a"], F.lit("_"), x["b"])))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


# --------------------------------------------------------------------------- stemming (Porter, 1980)

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(stem: str) -> int:
    kinds = "".join("c" if _consonant(stem, i) else "v" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 1) and not _consonant(w, n - 2) and _consonant(w, n - 3) and w[-1] not in "wxy"


# Suffixes of the published algorithm's steps 2 to 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, rules, least: int) -> str:
    for suffix, to in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + to if _measure(stem) > least else w
    return w


def porter(w: str) -> str:
    """The stem of a lower-case word."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 0), _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or m == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def fold(text: str) -> list[str]:
    """Words of letters and digits, case folded, without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(c if c.isalnum() else " " for c in plain).split()


@F.pandas_udf(ArrayType(StringType()))
def stemmed_terms(text: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        if w not in known:
            known[w] = porter(w)
        return known[w]

    return text.map(lambda t: [stem(w) for w in fold(t or "")])
