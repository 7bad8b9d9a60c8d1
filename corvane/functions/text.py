"""Keywords of a query, terms of a document, and small text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[0-9a-z]+(?:[._-][0-9a-z]+)*"
SHORTEST, LONGEST, MOST_TERMS = 3, 30, 12
#: Words that say nothing about code. Those with an apostrophe are left out: it splits tokens, so they can't be met.
STOPWORDS = frozenset(
    """yourselves themselves something yourself ourselves
    yours would which where whom while until under using
    through thing those these there their theirs
    between because against before during cannot myself
    himself herself itself should please having further doing
    below being above again after about could other ours your
    with will when what were want very than then that this they
    them such some same over only once once need most more make
    just into here hers have from file files each does down code
    both been like help might ought let
    you why who way was use too the she own our our out off nor
    not now how his him her has had got get for few did can but
    any are and all its use us up to so or on of no my me it is
    in if i he do by be at as an am a we""".split()
)


def extract_keywords(prompt: str) -> str:
    """The first 12 distinct tokens of 3 to 30 characters that aren't stopwords, in order."""
    tokens = re.findall(TOKEN, prompt.lower())
    return " ".join(list(dict.fromkeys(t for t in tokens if SHORTEST <= len(t) <= LONGEST and t not in STOPWORDS))[:MOST_TERMS])


def preprocess_query(query: str, mode: str) -> str:
    return query if mode == "raw" else extract_keywords(query)


def keywords(text: Column) -> Column:
    """`extract_keywords` of a column, on the JVM; null gives null."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    kept = F.filter(tokens, lambda t: F.length(t).between(SHORTEST, LONGEST) & ~t.isin(*sorted(STOPWORDS)))
    return F.concat_ws(" ", F.slice(F.array_distinct(kept), 1, MOST_TERMS))


def terms(text: Column) -> Column:
    """The terms by which documents and keywords are matched: lower-cased runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def query_terms(query: str) -> list[str]:
    """Distinct document terms of a keyword query."""
    return list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))


def trimmed(text: Column) -> Column:
    """Without white space at either end, tabs and carriage returns included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def embed_text(file_path: Column, kind: Column, name: Column, signature: Column, snippet: Column) -> Column:
    """What is embedded of a chunk: path, kind and name, signature, the snippet's first 500 characters."""
    title = F.when((kind != "") & (name != ""), F.concat(F.lit(": "), kind, F.lit(" "), name)).when(name != "", F.concat(F.lit(": "), name)).otherwise("")
    line = F.when(signature != "", F.concat(F.lit("\n"), signature)).otherwise("")
    body = F.when(snippet != "", F.concat(F.lit("\n"), F.substring(snippet, 1, 500))).otherwise("")
    return F.concat(file_path, title, line, body)
