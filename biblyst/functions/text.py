"""Normalisers of bibliographic text as Column functions; everything stays in the JVM.

NULL in gives NULL out unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content in titles.
STOP_WORDS = ["the", "a", "an", "of", "and", "or", "in", "on", "for", "to", "from", "with", "by", "at", "as", "is", "are", "be", "its", "their", "this", "that", "new", "evidence", "case", "using", "some", "note"]
# Words that make no good title keyword.
WEAK_KEYWORDS = ["their", "which", "these", "those", "about", "between", "through"]
# Role of a work -> first part of its public address.
ADDRESS_KINDS = {"paper": "p", "article": "a", "chapter": "h", "book": "b", "software": "e", "editor-book": "b", "editor-series": "s"}


def handle_lc(c: Column) -> Column:
    """Comparison form of a handle or short id."""
    return F.lower(F.trim(c))


def normalize_doi(c: Column) -> Column:
    """Bare lower-case DOI, or NULL if there is none: resolver, "doi:" and closing punctuation go."""
    x = F.regexp_replace(F.trim(c), r"(?i)^(https?://)?(dx\.)?doi\.(org|example)/", "")
    x = F.regexp_replace(x, r"(?i)^doi:\s*", "")
    x = F.lower(F.regexp_replace(x, r"[!-/:-@\[-`{-~]+$", ""))
    return F.when(x.rlike(r"^10\.\d{4,9}/\S+$"), x)


def doi_from_url(c: Column) -> Column:
    """The DOI inside a URL, or NULL."""
    x = F.regexp_extract(c, r"10\.\d{4,9}/[^\s?#&]+", 0)
    return F.when(x != "", normalize_doi(x))


def guess_from_article_url(c: Column, host: str = "nature.com", prefix: str = "10.1038") -> Column:
    """prefix/<id> of <host>/articles/<id>, or NULL."""
    x = F.regexp_extract(F.lower(c), host.replace(".", r"\.") + r"/articles/([^/?#]+)", 1)
    return F.when(x != "", F.concat(F.lit(prefix + "/"), x))


def safe_article_id(c: Column, portfolio: list[str]) -> Column:
    """Whether a guessed identifier's last part has a shape that is always registered: "s" or a digit first, "d41586", or a portfolio's prefix."""
    x = F.regexp_extract(F.lower(c), r"^10\.\d+/(.*)$", 1)
    ok = x.rlike("^s[0-9]") | x.rlike("^[0-9]") | x.startswith("d41586")
    for p in portfolio:
        ok = ok | x.startswith(p.lower())
    return F.coalesce(ok, F.lit(False))


def normalize_title(c: Column) -> Column:
    """Lower case, everything but letters a-z and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def title_tokens(c: Column) -> Column:
    """Distinct words of the normalised title; empty for NULL."""
    return F.filter(F.array_distinct(F.split(F.coalesce(normalize_title(c), F.lit("")), " ")), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays read as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def title_sim(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two titles; 0 with an empty or NULL side."""
    return jaccard(title_tokens(a), title_tokens(b))


def content_tokens(c: Column) -> Column:
    """Distinct title words without stop words and numbers."""
    return F.filter(title_tokens(c), lambda w: ~w.isin(STOP_WORDS) & ~w.rlike(r"^\d+$"))


def content_key(c: Column) -> Column:
    """Sorted content words in one string: equal for titles that differ in order, case and stop words."""
    return F.array_join(F.array_sort(content_tokens(c)), " ")


def journal_name(c: Column) -> Column:
    """Comparison form of a journal's name."""
    x = F.regexp_replace(F.lower(c), "&", " and ")
    x = F.regexp_replace(x, r"\([^)]*\)", "")
    x = F.regexp_replace(x, "behaviour", "behavior")
    x = F.regexp_replace(x, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(x, "^the ", ""))


def first_author_token(c: Column) -> Column:
    """Last word of the first author in a ;-separated field, lower case; NULL if empty."""
    first = F.trim(F.element_at(F.split(c, ";"), 1))
    last = F.lower(F.element_at(F.split(first, r"\s+"), -1))
    return F.when(last != "", last)


def first_author_lastname(c: Column) -> Column:
    """The part before the first ';', NULL if blank."""
    first = F.trim(F.element_at(F.split(c, ";"), 1))
    return F.when(first != "", first)


def parse_year(c: Column, forthcoming: int) -> Column:
    """Leading four digits; "Forthcoming" reads as the year given."""
    digits = F.regexp_extract(F.trim(c), r"^(\d{4})", 1)
    return F.when(F.trim(c).rlike("(?i)^forthcoming$"), F.lit(forthcoming)).when(digits != "", digits.cast("int"))


def country(c: Column) -> Column:
    """Country of a location: closing "(X)", else what follows the last comma; '' if neither or NULL."""
    c = F.coalesce(c, F.lit(""))
    bracket = F.regexp_extract(c, r"\(([^()]*)\)\s*$", 1)
    comma = F.regexp_extract(c, r",([^,]*)$", 1)
    return F.trim(F.when(bracket != "", bracket).otherwise(comma))


def address(work: Column, kind: Column, base: str = "https://ideas.example") -> Column:
    """Public address of a work by its role; unknown roles read as papers."""
    letter = F.coalesce(F.create_map(*[x for k, v in ADDRESS_KINDS.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit("p"))
    path = F.regexp_replace(F.regexp_replace(F.lower(F.trim(work)), "^repec:", ""), ":", "/")
    return F.concat(F.lit(base + "/"), letter, F.lit("/"), path, F.lit(".html"))


def title_keyword(c: Column) -> Column:
    """First word of five or more ASCII letters that is no weak word, else the first of four or more word characters, else NULL."""
    words = F.regexp_extract_all(c, F.lit("([A-Za-z]{5,})"), F.lit(1))
    good = F.filter(words, lambda w: ~F.lower(w).isin(WEAK_KEYWORDS))
    other = F.regexp_extract(c, "[A-Za-z0-9_]{4,}", 0)
    return F.when(F.size(good) > 0, F.get(good, F.lit(0))).when(other != "", other)


def split_author_list(c: Column) -> Column:
    """Names separated by "and" or commas; empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\s+and\s+|,\s*"), lambda x: F.trim(x)), lambda x: x != "")


def slugify(c: Column, words: int = 6, length: int = 60) -> Column:
    """File-name form: the first words in lower case, joined by '-'; other signs are deleted, hyphens stay. "search" if nothing is left."""
    clean = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", "")
    kept = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    slug = F.substring(F.array_join(F.slice(kept, 1, words), "-"), 1, length)
    return F.when(slug == "", "search").otherwise(slug)


def split_marked_list(c: Column, mark: str = "|||") -> Column:
    """Values separated by a mark, trimmed; an empty or NULL field gives an empty array."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\\Q" + mark + "\\E"), lambda x: F.trim(x)), lambda x: x != "")
    return parts


def fill_bibtex_journal(bib: Column, journal: Column) -> Column:
    """Put the journal into an empty "journal = {}" and squeeze blank lines."""
    filled = F.replace(bib, F.lit("journal = {}"), F.concat(F.lit("journal = {"), F.coalesce(journal, F.lit("")), F.lit("}")))
    return F.regexp_replace(filled, r"\n\s*\n", "\n")


def doi_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^(10\.\d{4,9})/", 1)


def short_hash(*cols: Column) -> Column:
    """First eight hex digits of the SHA-256 of the values as a JSON array."""
    return F.substring(F.sha2(F.to_json(F.array(*[x.cast("string") for x in cols])), 256), 1, 8)


def hmac_sha256(key: str, c: Column) -> Column:
    """HMAC-SHA-256 of a string under a fixed key, in hex: two hashes over padded keys, so it stays in the JVM."""
    import hashlib

    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    pad = lambda n: F.lit(bytes(x ^ n for x in k))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), c.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def run_key(key: str, *cols: Column) -> Column:
    """First sixteen hex digits of the HMAC of the values as a JSON array."""
    return F.substring(hmac_sha256(key, F.to_json(F.array(*[x.cast("string") for x in cols]))), 1, 16)
