"""Wikitext expressions: noise, categories, tokens, titles, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three patterns whose matches define the results.
NOISE = r"""(\[\[:{0,1}Grafika:.+\]\])|(\[\[:{0,1}Media:.+\]\])|(\{\{Przypisy)|(\{\{Uwagi)|(\{\{SORTUJ:.+}})|(\{\{subst:.+}})|(\{\{Dokumentacja)|(<ref>|<\/ref>|<small>|<\/small>|<del>|<\/del>|<sup>|<\/sup>|<sub>|<\/sub>|<code>|<\/code>|<math>.+<\/math>|<nowiki>|<\/nowiki>|<includeonly>|<\/includeonly>|<noinclude>|<\/noinclude>)(\{\{Ujednoznacznienie}})|(\{\{Dokumentacja}})|(http:\/\/[a-zA-z0-9._+/\-?&=]+)|(\[\[Plik:.+\]\])|(\#PATRZ.+\[\[.+\]\])|(\{\{Inne znaczenia)|(\{\{Ujednoznacznienie)"""
CATEGORY = r"(\[\[Kategoria:.+\]\])"
TOKEN = r"([a-zA-ZżźćńółęąśŻŹĆĄŚĘŁÓŃÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿŒœŠšŸ]{2,})|(([0-9]{4})-([0-9]{2})-([0-9]{2}))|([0-9]{4})"


def strip_noise(body: Column) -> Column:
    """The text without noise; what stood on either side of a match is joined."""
    return F.regexp_replace(body, NOISE, "")


def blank_trim(s: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def category_name(link: Column) -> Column:
    """The name in the text of a category link, which may span several links of a line."""
    c = F.regexp_replace(link, r"\{\{.*\}\}", "")
    c = F.replace(F.replace(c, F.lit("[[Kategoria:"), F.lit("")), F.lit("]]"), F.lit(""))
    return F.substring_index(blank_trim(F.translate(c, "\t", " ")), "|", 1)


def category_names(clean: Column) -> Column:
    """All category names of a text without noise, in order, repeats kept, empty ones dropped."""
    found = F.transform(F.regexp_extract_all(clean, F.lit(CATEGORY), F.lit(1)), category_name)
    return F.filter(found, lambda c: c != "")


def tokens(clean: Column) -> Column:
    """All tokens of a text without noise, its category links left out."""
    return F.regexp_extract_all(F.regexp_replace(clean, CATEGORY, ""), F.lit(TOKEN), F.lit(0))


def sanitize_title(title: Column) -> Column:
    """Slashes, backslashes, blanks and colons become underscores; double quotes go."""
    return F.regexp_replace(F.translate(title, "/\\ :", "____"), '"', "")


def base_name(title: Column) -> Column:
    """Without what follows the last dot."""
    return F.regexp_replace(title, r"\.[^.]*$", "")


def string_hash(s: Column) -> Column:
    """The 32-bit hash over UTF-16 units h = 31 h + unit, as a signed bigint."""

    def add(h: Column, unit: Column) -> Column:
        return (h * 31 + unit) % F.lit(1 << 32)

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        over = code - 65536
        high, low = F.lit(0xD800) + F.shiftright(over, 10), F.lit(0xDC00) + over % 1024
        return F.when(code < 65536, add(h, code)).otherwise(add(add(h, high), low))

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), step, lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h))


def fold_number(title: Column, folds: int, buckets: int) -> Column:
    """The fold of an article: its hash modulo folds * buckets, in runs of buckets."""
    return ((F.abs(string_hash(title)) % (folds * buckets)) / buckets).cast("int")
