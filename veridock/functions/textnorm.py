"""Text normalisation, verbatim quotes, names and labels, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as one, currency spellings and marker forms.
QUOTES = {"’‘‛′": "'", "“”″": '"', "–—‑‒−": "-"}
#: What long texts are searched for begins with a character or a letter class, and looks around only behind that: a pattern
#: that begins with a look around does so at every character.
CURRENCY = (r"₹\s*", r"inr(?<=\binr)(?![a-z])\.?\s*", r"rs(?<=\brs)(?![a-z])\.?\s*(?=\d)", r"rupees(?<=\brupees)\b\s*")
ORDINAL = r" (?=(?:st|nd|rd|th)\b)(?<=\d )"
RAISED = r"\d(?<=[a-z]{2}\d)\d?\b"
PERCENT = r"(?=\s?%)(?<=[a-z])\s?%(?=[\s,.;:)\]]|$)"
#: Blanks that are not just one space.
BLANKS = r"(?U)[\s&&[^ ]]\s*| \s+"
RUPEE_TICK = r"`(?=\d)|(?<=\[)`(?=\])|(?<=\(in )`(?=\))"
MARKER_TICK = r"(?<=[\p{L}\p{N}])`(?=[ \t\n/,.;:)]|$)|^(\s*)`(?=\s*[A-Z(])"
SYMBOLS = r"(?=\s?[*#^~°@$!])(?<=[a-z0-9)])\s?(?:\*{1,4}|#{1,2}|\^{1,2}|~{1,2}|°{1,2}|@{1,2}|\$|!)(?=[\s,.;:)\]]|$)"
STOP_WORDS = (
    "about above across after also among around based being below between both company companies during each from"
    " further have having into itself more most other over same such than that their them then there these they this"
    " those through under very what when where which while with within without would your"
).split()
SEARCH_STOP_WORDS = "a an and are as at be by for from in is it of on or the to up upto with your you per any all this that".split()
STEM = 5
#: Names that extraction breaks, in the normal form.
SPACED_NAMES = {"t itanium+": "titanium+", "platinum +": "platinum+", "optima secure +": "optima secure+"}
#: What becomes letters a-z, or falls away between them, when the normal form is made, beside A-Z.
LETTERED = {"\u0130": "i\u0307", "\u212a": "k", "ß": "ss", "ẞ": "ss", "�": "", "`": "", "™": " tm"}
#: Runs of letters a-z that the normal form may make of something else: currency tokens, and the first run of a name that was broken.
MADE = r"^(?:inr|rs|rupees)$|(?:" + "|".join(sorted({re.match("[a-z]+", name)[0] for name in SPACED_NAMES.values()})) + ")$"
#: Sections whose texts do not go on from their heading.
APART = ("Footnotes", "Page header", "Page footer")
HEADCOUNT = r"\b(?:employees?|workforce|staff|people|headcount|professionals|workers|personnel)\b"
REVENUE = r"\b(?:revenues?|turnover|sales|income|earnings|profits?|market cap\w*)\b|[$€£]|\busd\b"
FIGURE = r"[$₹€£]?\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:k|mn|m|million|bn|billion|cr|crores?|lakhs?|lacs?)\b)?"
BAND_BEFORE = r"over|more than|above|at least|nearly|almost|around|about|approximately|approx\.?|roughly|some|close to|upwards of|in excess of|between|under|below|less than|up to|~|≈"
BAND_AFTER = r"\s*(?:\+|plus\b|or more\b|and above\b|(?:-|–|to)\s*[$₹]?\d)"
SCALED = r"(?i)[$₹€£]|k\b|mn|million|bn|billion|cr|crore|lakh|lac"
WORD = r"[A-Za-z][A-Za-z'’-]*"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: Column | str) -> Column:
    """One space between words, none around."""
    return F.trim(F.regexp_replace(_c(c), BLANKS, " "))


def rupees_shown(c: Column | str) -> Column:
    """Backticks that stand for the rupee sign become it; others stay."""
    return F.regexp_replace(_c(c), RUPEE_TICK, "₹")


def backtick_kinds(c: Column | str) -> Column:
    """Counts of rupee, marker and unclassified backticks of a text."""
    total = F.regexp_count(_c(c), F.lit("`"))
    rupee = F.regexp_count(_c(c), F.lit(RUPEE_TICK))
    marker = F.regexp_count(F.regexp_replace(_c(c), RUPEE_TICK, "₹"), F.lit(MARKER_TICK))
    return F.struct(rupee.alias("rupee"), marker.alias("marker"), (total - rupee - marker).alias("unclassified"))


def normalised(c: Column | str, keep_paren: bool = False) -> Column:
    """The form in which quotes and evidence are compared: one currency token, unified quotes and dashes, lower case,
    footnote markers removed, single spaces, broken names joined. ``keep_paren`` keeps "(7)" as it is."""
    s = F.replace(rupees_shown(F.replace(_c(c), F.lit("�"), F.lit(""))), F.lit("`"), F.lit(""))
    s = F.replace(s, F.lit("™"), F.lit(" TM"))
    for several, one in QUOTES.items():
        s = F.regexp_replace(s, f"[{several}]", one)  # translate() looks every character up
    s = F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))
    for pattern in CURRENCY:
        s = F.regexp_replace(s, pattern, " inr ")
    s = F.regexp_replace(s, ORDINAL, "")
    if not keep_paren:
        s = F.regexp_replace(s, r"\(\d{1,2}\)", " ")
    s = F.regexp_replace(s, RAISED, "")
    s = F.regexp_replace(s, SYMBOLS, "")
    s = squeezed(F.regexp_replace(s, PERCENT, ""))
    for broken, name in SPACED_NAMES.items():
        s = F.replace(s, F.lit(broken), F.lit(name))
    return s


def bounded_pattern(needle: Column) -> Column:
    """A pattern for ``needle`` that cuts no word or number: "6 months" is not in "36 months"."""
    first, last = F.substring(needle, 1, 1), F.substring(needle, -1, 1)
    before = F.when(first.rlike(r"^\d"), r"(?<![\p{L}\p{N}])(?<!\d[,.\-])").when(first.rlike(r"^[\p{L}\p{N}]"), r"(?<![\p{L}\p{N}])").otherwise("")
    after = F.when(last.rlike(r"^\d"), r"(?![\p{L}\p{N}])(?![,.\-]\d)").when(last.rlike(r"^[\p{L}\p{N}]"), r"(?![\p{L}\p{N}])").otherwise("")
    return F.concat(before, F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), after)


def bounded_in(needle: Column | str, text: Column | str) -> Column:
    """Whether ``needle`` occurs in ``text`` on word and number boundaries. The cheap test guards the regular expression."""
    needle, text = _c(needle), _c(text)
    cheap = (F.length(needle) > 0) & F.contains(text, needle)
    return F.when(cheap, F.regexp_like(text, bounded_pattern(needle))).otherwise(F.lit(False))


def quoted_in(quote: Column | str, evidence: Column | str) -> Column:
    """Whether a quote occurs verbatim in a text, both normalised. A "(n)" of the quote is dropped only if the text has
    the same "(n)"."""
    quote, evidence = _c(quote), _c(evidence)
    missing = F.exists(F.regexp_extract_all(quote, F.lit(r"(\(\d{1,2}\))")), lambda m: ~F.contains(evidence, m))
    wanted = F.when(missing, normalised(quote, keep_paren=True)).otherwise(normalised(quote))
    return bounded_in(wanted, normalised(evidence))


def quoted_in_item(quote: Column | str, text: Column | str, section: Column | str, unmarked: Column | str) -> Column:
    """Whether an evidence item has a quote: in its text, in its text without the footnote markers it records (``unmarked``,
    see ``markers.masked``), or, where the text goes on from its heading in lower case, in both together."""
    goes_on = _c(text).rlike(r"^\p{Ll}") & ~_c(section).isin(*APART)
    both = F.concat_ws(" ", _c(section), _c(text))
    return quoted_in(quote, text) | quoted_in(quote, unmarked) | F.when(goes_on, quoted_in(quote, both)).otherwise(F.lit(False))


def names(aliases: dict[str, list[str]], text: Column) -> Column:
    """Which of the named things a normalised text names in whole: sorted array of their ids."""
    parts = []
    for key in sorted(aliases):
        pattern = "|".join(f"\\Q{a}\\E" for a in aliases[key])
        parts.append(F.when(F.regexp_like(text, F.lit(f"(?<![a-z0-9])(?:{pattern})(?![a-z0-9+])")), F.lit(key)))
    return F.array_compact(F.array(*parts))


def names_only(aliases: dict[str, list[str]], text: Column, key: Column) -> Column:
    found = names(aliases, text)
    return (F.size(found) == 1) & F.array_contains(found, key)


def masked(aliases: list[str], text: Column) -> Column:
    """Names replaced by as many blanks, so that positions stay."""
    for a in sorted(aliases, key=len, reverse=True):
        text = F.regexp_replace(text, f"(?i)\\Q{a}\\E", " " * len(a))
    return text


def stems(c: Column | str, ignore: Column | None = None) -> Column:
    """Distinct first five letters of the content words (four letters or more, no function word)."""
    def of(x: Column, least: int) -> Column:
        found = F.filter(F.regexp_extract_all(x, F.lit(f"({WORD})")), lambda w: (F.length(w) >= least) & (~F.lower(w).isin(STOP_WORDS) if least else F.lit(True)))
        return F.array_distinct(F.transform(found, lambda w: F.substring(F.regexp_replace(F.replace(F.lower(w), F.lit("’"), F.lit("'")), r"^['-]+|['-]+$", ""), 1, STEM)))

    out = of(_c(c), 4)
    return out if ignore is None else F.array_except(out, of(ignore, 0))


def proper_names(c: Column | str) -> Column:
    """Distinct capitalised words that do not begin a sentence and are no acronyms, in order."""
    sentences = F.split(_c(c), r"(?<=[.!?;:])\s+")
    words = F.flatten(F.transform(sentences, lambda s: F.slice(F.regexp_extract_all(s, F.lit(f"({WORD})")), 2, 1 << 20)))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z]") & (F.upper(w) != w)))


def url_key(c: Column | str) -> Column:
    """A URL without scheme, fragment, query, www. and trailing slash, in lower case."""
    s = F.regexp_replace(F.lower(F.trim(_c(c))), r"^[a-z][a-z0-9+.-]*://", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[#?].*$", ""), r"^www\.", "")
    return F.regexp_replace(s, r"/+$", "")


def site_name(c: Column | str) -> Column:
    """The host without a first label of www, www1, en or m."""
    return F.regexp_replace(F.regexp_extract(url_key(c), r"^([^/]*)", 1), r"^(?:www\d*|en|m)\.", "")


def slug(c: Column | str, default: str = "company") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def canonical(c: Column | str) -> Column:
    """A variant name without blanks and case."""
    return F.regexp_replace(F.lower(_c(c)), r"(?U)\s+", "")


def unlabelled(c: Column | str) -> Column:
    """A statement without its trailing assumption mark."""
    return F.regexp_replace(_c(c), r"\s*(?:\*|\(Assumption\))\s*$", "")


def page_label(name: Column | str, pages: Column | str) -> Column:
    """``<name> Product Brochure, p. n`` or ``pp. a, b`` for an array of pages."""
    pages = F.array_sort(F.array_distinct(_c(pages)))
    return F.concat(_c(name), F.lit(" Product Brochure, "), F.when(F.size(pages) == 1, "p. ").otherwise("pp. "), F.array_join(F.transform(pages, lambda p: p.cast("string")), ", "))


def web_label(title: Column | str, site: Column | str, seen: Column | str) -> Column:
    return F.concat_ws(" — ", _c(title), _c(site), F.concat(F.lit("Retrieved "), F.date_format(_c(seen), "d MMMM yyyy")))


def clean_title(title: Column | str, site: Column | str, most: int = 60) -> Column:
    """A page title: file names become words; long ones are cut at the first separator behind two words and ten
    characters; empty ones become the site."""
    t = F.regexp_replace(_c(title), r"\.(?:pdf|docx?|pptx?|html?)$", "")
    t = F.when(t.rlike(r"\s"), t).otherwise(F.regexp_replace(t, r"[-_]+", " "))
    cut = F.regexp_extract(t, r"^(?=\S+\s+\S+)(.{10,}?)(?:\s*[|–—:]\s*|\s-\s)", 1)
    t = F.when((F.length(t) > most) & (F.length(cut) > 0), cut).otherwise(t)
    t = F.regexp_replace(squeezed(t), r"[\s|–—:-]+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), _c(site))


def required_words(c: Column | str) -> Column:
    """Words in quotes or asterisks behind preserve or keep, distinct, in lower case."""
    clause = F.regexp_extract(_c(c), r"(?i)\b(?:preserve|keep)\b(.*)$", 1)
    found = F.regexp_extract_all(clause, F.lit(r"[\"'*“]+([^\"'*“”]+)[\"'*”]+"))
    return F.array_distinct(F.transform(found, lambda w: F.lower(F.trim(w))))


def bullets(c: Column | str) -> Column:
    """The pieces, with three letters or digits, of a line that has bullets or, if it has none, two or more spaced pipes."""
    c = _c(c)
    bulleted, piped = c.rlike("[•●▪]"), F.regexp_count(c, F.lit(r"\s+\|\s+")) >= 2
    parts = F.when(bulleted, F.split(c, r"\s*[•●▪]\s*")).when(piped, F.split(c, r"\s+\|\s+")).otherwise(F.array(c))
    return F.filter(F.transform(parts, squeezed), lambda p: F.length(F.regexp_replace(p, r"[^\p{L}\p{N}]", "")) >= 3)


def footnotes(c: Column | str) -> Column:
    """Packed footnotes split where a sentence ends and a marker follows."""
    lead = r"(?:(?:\(\d{1,2}\)|\*{1,4}|#{1,2}|\^{1,2}|~{1,2}|°{1,2}|@{1,2}|\$|!|%|\+|`)(?=\s*[A-Z(])|\d{1,2}(?=\s*[A-Z][a-z]|\s+\d))"
    return F.split(_c(c), rf"(?<=[.;:!?'’\"])\s+(?={lead})")


def at_word_start(keyword: str, text: Column) -> Column:
    """Whether a lower-case text has the keyword where a word begins."""
    return F.regexp_like(text, F.lit(f"(?<![a-z0-9])\\Q{keyword}\\E"))


def tokens(c: Column | str) -> Column:
    """Distinct search tokens: runs of ASCII letters and digits in lower case without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z0-9]+)")), lambda w: ~w.isin(SEARCH_STOP_WORDS)))


def precise_figures(c: Column | str) -> Column:
    """Figures of head counts and revenue written as exact numbers: no bands, years, shares, nor numbers below 1000 without a
    currency or scale."""
    c = _c(c)
    # an atomic group takes the figure whole; a start inside one is none
    exact = rf"(?i)(?<![\w.])(?<!\d,)(?<![$₹€£])(?<![$₹€£]\s)(?<!(?:{BAND_BEFORE})\s{{0,5}})((?>{FIGURE}))(?!%)(?!{BAND_AFTER})"
    found = F.transform(F.regexp_extract_all(c, F.lit(exact)), lambda x: F.trim(x))
    small = lambda n: (F.regexp_replace(n, r"[^\d.]", "").try_cast("double") < 1000) & ~n.rlike(SCALED)
    real = F.filter(found, lambda n: ~n.rlike(r"^(?:18|19|20)\d\d$") & ~small(n))
    return F.when(c.rlike(f"(?i){HEADCOUNT}|{REVENUE}"), real).otherwise(F.array().cast("array<string>"))


def opening(c: Column | str, most: int = 300) -> Column:
    """How a page begins, whatever its case and punctuation: pages with one opening are the same text."""
    return F.left(F.array_join(F.regexp_extract_all(F.lower(_c(c)), F.lit("([a-z0-9]+)")), " "), F.lit(most))


# Wordings of lines that say nothing, and the shortest line that is kept.
BOILERPLATE = r"(?i)\b(?:cookies?|privacy policy|terms of use|subscribe|sign in|log ?in|newsletter|all rights reserved|skip to (?:main )?content|javascript)\b"
SHORTEST_LINE, LONGEST_TEXT = 30, 4000


def page_text(excerpt: Column | str, raw: Column | str, most: int = LONGEST_TEXT) -> Column:
    """A page's excerpt, then its lines that are long enough, no boilerplate and not in the excerpt, each once, in order."""
    head = squeezed(F.coalesce(_c(excerpt), F.lit("")))
    lines = F.transform(F.split(F.coalesce(_c(raw), F.lit("")), r"\r\n|[\n\r]"), squeezed)
    body = F.array_distinct(F.filter(lines, lambda s: (F.length(s) >= SHORTEST_LINE) & ~s.rlike(BOILERPLATE) & ~F.contains(head, s)))
    return F.left(F.array_join(F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), body), "\n"), F.lit(most))


# Words of a company's name that do not tell it apart.
NAME_FILLERS = "ltd limited inc corp plc llp pvt private the and group company".split()


def name_tokens(name: Column | str) -> Column:
    """The words of a company's name that tell it apart, else the whole name."""
    found = F.filter(F.regexp_extract_all(F.lower(_c(name)), F.lit("([a-z0-9]+)")), lambda w: (F.length(w) >= 3) & ~w.isin(NAME_FILLERS))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lower(_c(name))))


def is_official(url: Column | str, tokens: Column) -> Column:
    """Whether a site is the company's own: the label before its top domain is a word of the name, all of them joined, their
    initials, or begins with the joined ones if these are four letters or more."""
    parts = F.split(site_name(url), r"\.")
    label = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.element_at(parts, 1))
    joined = F.array_join(tokens, "")
    initials = F.array_join(F.transform(tokens, lambda w: F.left(w, F.lit(1))), "")
    return F.array_contains(tokens, label) | (label == joined) | (label == initials) | ((F.length(joined) >= 4) & F.startswith(label, joined))
