"""Text functions as Column builders. Patterns name Unicode classes, so that they do not depend on the engine's \\w and \\s."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

WORD_CHARACTER = r"[\p{L}\p{N}_]"
WORD = WORD_CHARACTER + "+"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"
#: Article markers of Vietnamese legal texts.
ARTICLE = r"(?iu)(?:điều|dieu)\s+(\d+[a-z]?)(?![\p{L}\p{N}_])"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD), F.lit(0))


def words_and_marks(c: Column | str) -> Column:
    """Lower-cased words, and every other character that is not white space."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD_OR_MARK), F.lit(0))


def single_spaced(c: Column | str) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(_text(c), SPACE + "+", " "))


def sentences(c: Column | str) -> Column:
    """Non-blank sentences: cut at white space after an end mark."""
    parts = F.split(single_spaced(c), r"(?<=[.!?。！？])\s+")
    # a function of one argument: transform() would hand the place to trim() as the characters to take off
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def url_slug(c: Column | str) -> Column:
    """Last segment of a URL's path, less its .aspx."""
    path = F.coalesce(F.regexp_extract(_text(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.aspx$", "")


def document_key(name: Column | str, link: Column | str) -> Column:
    """A document's trimmed name, or else the slug of its link."""
    trimmed = single_spaced(name)
    return F.when(trimmed != "", trimmed).otherwise(url_slug(link))


def article_number(given: Column, answer: Column, question: Column) -> Column:
    """The article a record is about: as given, or the first one named in the answer, then in the question."""
    named = [F.nullif(F.regexp_extract(_text(c), ARTICLE, 1), F.lit("")) for c in (answer, question)]
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), *named)


def article_window(text: Column, article: Column, most: int | None = None) -> Column:
    """The text from the article's marker to the next marker, or the whole text without one; at most `most` characters."""
    quoted = F.regexp_replace(article, r"([^\p{L}\p{N}])", r"\\$1")
    # an edge of a word: behind another character a word must begin
    edge = F.when(F.rlike(article, F.lit(r"[\p{L}\p{N}_]$")), r"(?![\p{L}\p{N}_])").otherwise(r"(?=[\p{L}\p{N}_])")
    pattern = F.concat(F.lit(r"(?ius)(?:điều|dieu)\s+"), quoted, edge, F.lit(r"\.?.*"))
    tail = F.regexp_substr(text, pattern)
    head = F.regexp_extract(tail, r"(?ius)^((?:điều|dieu)\s+\S+.*?)(?:\s(?:điều|dieu)\s+\d+[a-z]?(?![\p{L}\p{N}_])|\z)", 1)
    out = F.when(article.isNull() | tail.isNull(), text).otherwise(F.trim(head))
    return out if most is None else F.substring(out, 1, most)


#: Search words and what they add to a query, in order (fixed values).
REWRITES = [
    ("nghị định", "nghị định chính phủ điều khoản"),
    ("luật", "luật quốc hội điều khoản"),
    ("thông tư", "thông tư bộ điều khoản"),
]


def rewritten(query: Column | str, rules: list[tuple[str, str]] = REWRITES) -> Column:
    """A query with the additions of every rule whose search word it holds; a space follows the query in any case."""
    q = _text(query)
    added = F.array_join(F.array_compact(F.array(*[F.when(F.contains(F.lower(q), F.lit(k)), F.lit(v)) for k, v in rules])), " ")
    return F.concat(q, F.lit(" "), added)
