"""Personal data: patterns first, then terms that give a protected value away.

The base finds e-mail addresses, IP addresses, card and phone numbers. The method, information-theoretic sanitisation (after
Sánchez and Batet, 2016), asks of every word of a document that holds such a value how strongly the corpus ties the two together: the
pointwise mutual information of word and value against the information content of the value,

    PMI(c; t) = log(N n(c,t) / (n(c) n(t)))        IC(c) = log(N / n(c))

in numbers of different texts, over all of them: a copied text counts once everywhere. A word that gives away at least `threshold` of
IC(c) is disclosed if the two meet in at least `support` independent texts. Texts are independent unless copying joins them: texts with a
band of equal min-hashes of their word sequences are one class, and classes are counted. A word that only ever stands right between
two values has no context of its own and is no evidence. From `removal` on a disclosed word is removed, below that it is
generalised to its class, wherever it stands in a text with that value.

A string of mixed letters and digits, like a key or a password, is a protected entity itself and gives itself away entirely. It is
removed where the corpus holds it to be identifying: its own information content is at least `identifying` of that of a term of one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.llm.batches import slices
from corvane.llm.components import connected_components
from corvane.llm.joins import sized
from corvane.session import cut, give_back, workers_can_import

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_WORD = re.compile(r"(?<![^\W_])[^\W_]{3,}")
_ANY_WORD = re.compile(r"[^\W_]{3,}")
_DIGITS, _ALNUM = re.compile(r"\d+"), re.compile(r"[^\W_]*+")
_CHANGE = re.compile(r"(?<=\d)[^\W\d_]|(?<=[^\W\d_])\d")
#: Bands of min-hashes that mark texts as copies of each other, and min-hashes of a band: of texts that share 85 % of their sequences
#: of four words 94 % agree in a band, of those that share 20 % 2 %.
BANDS, BAND = 3, 3
_SEQUENCE = 4
#: Distinct words that a task counts before it sends the counts on.
_COUNTED = 100_000
_FACTORS = np.array([xxhash.xxh64_intdigest(b"factor", k) | 1 for k in range(BANDS * BAND)], np.uint64)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches by start, then kind; in code points, end exclusive."""
    out = []
    after = 0
    if "@" in text:
        # the local part can't hold an @, so it is the run of its characters before one, back to the last match
        for m in _DOMAIN.finditer(text):
            at = m.start()
            start = at
            step = 64
            while True:  # rstrip over slices that double, so that a long run costs no more than its length
                lo = max(after, start - step)
                kept = lo + len(text[lo:start].rstrip(_LOCAL))
                start, step, done = kept, step * 2, kept > lo or lo == after
                if done:
                    break
            if start < at:
                after = m.end()
                out.append((start, 0, after))
    for chunk in _DOTTED.finditer(text):
        if chunk.end() - chunk.start() >= 7:
            for m in _IP.finditer(text, chunk.start(), chunk.end()):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _value(kind: int, match: str) -> int:
    """A number for a protected value, alike however it is written."""
    return _signed(f"{kind}:{match.lower() if kind < 2 else _NOT_DIGIT.sub('', match)}")


def _signed(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def opaque(text: str) -> list[tuple[int, int, int]]:
    """(word, start, end) of strings of 16 letters and digits or more that change between the two at least twice."""
    out, after = [], 0
    for m in _DIGITS.finditer(text):  # few words hold a digit, so only these are looked at
        start = m.start()
        if start < after:
            continue
        while start > after and text[start - 1].isalnum():
            start -= 1
        after = _ALNUM.match(text, start).end()
        if after - start >= 16 and len(_CHANGE.findall(word := text[start:after])) >= 2:
            out.append((_signed(word.lower()), start, after))
    return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> set[int]:
    """The words of a text that lie in no base span and don't only stand right between two of them."""
    out, k, last, held = set(), 0, False, None
    ends = [(s, e) for s, _, e in spans]
    reach = 0  # where the spans that began before end
    for m in _WORD.finditer(text):
        start, end = m.span()
        value = False
        while k < len(ends) and ends[k][0] < end:
            value, reach, k = True, max(reach, ends[k][1]), k + 1
        if held is not None and not value:
            out.add(held)
        held = None
        if start < reach:  # in a value
            last = True
            continue
        word = _signed(m[0].lower())
        if last or value:
            held = word  # right behind a value; to be seen whether right before one, too
        else:
            out.add(word)
        last = False
    if held is not None and k == len(ends):
        out.add(held)
    return out


def bands(text: str) -> list[int]:
    """Numbers of a text's bands of min-hashes over its sequences of words."""
    words = text.lower().split()
    n = max(1, len(words) - _SEQUENCE + 1)
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, n, 1 << 16):
        own = [xxhash.xxh64_intdigest(" ".join(words[i : i + _SEQUENCE]).encode("utf-8", "surrogatepass")) for i in range(at, min(n, at + (1 << 16)))]
        h = np.array(own, np.uint64)[:, None]
        with np.errstate(over="ignore"):
            low = np.minimum(low, ((h ^ (h >> np.uint64(29))) * _FACTORS[None, :]).min(0))
    return [_signed(f"{k}:{low[k * BAND : (k + 1) * BAND].tolist()}") for k in range(BANDS)]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_OPAQUES = pa.list_(pa.struct([("word", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
_LONGS = pa.list_(pa.int64())
_SCANNED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("base", _SPANS), ("opaque", _OPAQUES), ("held", _LONGS), ("words", _LONGS), ("bands", _LONGS), ("word", pa.int64()), ("copies", pa.int64()), ("docs", pa.int64())])
SCANNED = "doc_id long, h long, base array<struct<start:int,kind:int,end:int>>, opaque array<struct<word:long,start:int,end:int>>, held array<long>, words array<long>, bands array<long>, word long, copies long, docs long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, h, text, copies) to a row a document, and rows (word, copies, docs): in how many documents of this task with so many copies a word stands."""
    counts: dict[int, dict[str, int]] = {}  # by number of copies

    def counted() -> pa.RecordBatch:
        n = sum(map(len, counts.values()))
        null = [pa.nulls(n, t) for t in _SCANNED.types[:7]]
        columns = [np.fromiter(x, np.int64, n) for x in ((_signed(w) for own in counts.values() for w in own), (k for k, own in counts.items() for _ in own), (c for own in counts.values() for c in own.values()))]
        return pa.RecordBatch.from_arrays([*null, *map(pa.array, columns)], schema=_SCANNED)

    for batch in batches:
        base, strings, values, words, marks = [], [], [], [], []
        copies = iter(batch.column("copies").to_pylist())
        for own in slices(batch.column("text")):
            for text, k in zip(own, copies):
                text = text or ""
                spans = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                strings.append([dict(zip(("word", "start", "end"), s)) for s in opaque(text) if not any(a < s[2] and s[1] < b for a, _, b in spans)])
                values.append(list({_value(kind, text[a:b]) for a, kind, b in spans}))
                words.append(list(candidates(text, spans)) if spans else [])
                marks.append(bands(text) if spans else [])
                count = counts.setdefault(k, {})
                for w in set(_ANY_WORD.findall(text.lower())):
                    count[w] = count.get(w, 0) + 1
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *[pa.array(x, t) for x, t in zip((base, strings, values, words, marks), _SCANNED.types[2:7])], *[pa.nulls(n, pa.int64())] * 3], schema=_SCANNED)
        if sum(map(len, counts.values())) >= _COUNTED:
            yield counted()
            counts.clear()
    if counts:
        yield counted()
    counts.clear()
    give_back()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A row a document (doc_id, h, base, opaque, held, words, bands), and parts (word, copies, docs) of the number of texts in which each word of the corpus stands, see texts_with().

    One pass over the texts for their hashes, and one with how many copies each has. The copies of a text hold the same words,
    so their count, divided by the number of copies, is that of different texts; no text is shuffled unless copied ones are many.
    """
    workers_can_import(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    copied = cut(texts.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"))
    counted = texts.join(sized(copied, 64), "h", "left").select("doc_id", "h", "text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    found = cut(counted.mapInArrow(_scan, SCANNED))
    return found.where("base is not null").select("doc_id", "h", "base", "opaque", "held", "words", "bands"), found.where("word is not null").select("word", "copies", "docs")


def texts_with(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, n_word): in how many different texts the words in `asked` stand. Those not asked for, nearly all, are dropped before anything is shuffled."""
    own = words.join(sized(cut(asked), 48), "word", "left_semi").groupBy("word", "copies").agg(F.sum("docs").alias("docs"))
    return own.groupBy("word").agg(F.sum(F.expr("docs div copies")).alias("n_word"))


def disclosed(found: DataFrame, words: DataFrame, total: int, threshold: float, removal: float, support: int) -> DataFrame:
    """(h, terms): for each different text with disclosed words these, as (word, remove)."""
    values = found.where(F.size("held") > 0).select("h", F.explode("held").alias("value")).distinct()
    # a value of fewer texts than must be independent discloses nothing; these are nearly all, and only the others' words go on
    often = cut(values.groupBy("value").agg(F.count("*").alias("n_value")).where(F.col("n_value") >= support))
    own = cut(values.join(sized(often, 64), "value").select("h", "value", "n_value"))
    texts = cut(found.select("h", "words", "bands").join(sized(own.select("h").distinct(), 48), "h", "left_semi").dropDuplicates(["h"]))
    # classes of texts that copying joins: those of a band hang together
    classes = connected_components(texts.select("h", F.explode("bands").alias("band")).select(F.col("h").alias("src"), F.col("band").alias("dst"))).withColumnRenamed("node", "h")
    pairs = own.join(texts.select("h", "words"), "h").join(classes, "h").select("h", "value", "n_value", "component", F.explode("words").alias("word"))
    ties = pairs.groupBy("value", "n_value", "word", "component").agg(F.count("*").alias("n")).groupBy("value", "n_value", "word").agg(F.sum("n").alias("both"), F.count("*").alias("classes")).where(F.col("classes") >= support)
    ties = cut(ties)
    n_word = texts_with(words, ties.select("word").distinct())
    pmi = F.log(F.lit(float(max(total, 1))) * F.col("both") / (F.col("n_value") * F.col("n_word")))
    ic = F.log(F.lit(float(max(total, 1))) / F.col("n_value"))
    told = cut(ties.join(n_word, "word").withColumn("told", pmi / F.greatest(ic, F.lit(1e-9))).where((F.col("told") >= threshold) & (ic > 0)).select("value", "word", (F.col("told") >= removal).alias("remove")))
    terms = pairs.join(sized(told, 64), ["value", "word"]).groupBy("h", "word").agg(F.max("remove").alias("remove"))
    return cut(terms.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("word", "remove"))).alias("terms")))


def common_strings(found: DataFrame, words: DataFrame, total: int, identifying: float) -> list[int]:
    """Opaque strings in too many different texts to identify. Each is in more than total^(1 - identifying) texts, so they are few: about the root of their number."""
    strings = found.where(F.size("opaque") > 0).select(F.explode("opaque.word").alias("word")).distinct()
    n = texts_with(words, strings)
    return sorted(r.word for r in n.where(F.col("n_word") > float(max(total, 1)) ** (1 - identifying)).select("word").collect())


def term_spans(text: str, terms: list | None, common: frozenset[int]) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, remove) of the disclosed words and identifying strings of a text, outside its base spans."""
    told = {x["word"]: x["remove"] for x in (terms if terms is not None else ())}
    for w, _, _ in opaque(text):
        if w not in common:
            told[w] = True
    if not told:
        return []
    base = base_spans(text)
    out = [(m.start(), KINDS.index("term"), m.end(), told[w]) for m in _WORD.finditer(text) if (w := _signed(m[0].lower())) in told]
    return [x for x in out if not any(s < x[2] and x[0] < e for s, _, e in base)]


def learn(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, removal: float = 0.95, support: int = 3, identifying: float = 0.5) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """What the corpus tells: the rows of scan(), disclosed words by text, and opaque strings that identify nothing."""
    found, words = scan(docs, id_col, text_col)
    total = found.select("h").distinct().count()
    return found, disclosed(found, words, total, threshold, removal, support), frozenset(common_strings(found, words, total, identifying))


def with_terms(docs: DataFrame, text_col: str, terms: DataFrame) -> DataFrame:
    """`docs` with a column __terms: what terms (h, terms) has for a text. Texts are shuffled only if the terms are too large to be broadcast."""
    own = sized(terms, 64 + 24 * F.size("terms")).select(F.col("h").alias("__h"), F.col("terms").alias("__terms"))
    return docs.join(own, F.xxhash64(docs[text_col]) == own["__h"], "left").drop("__h")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


_ADDED = "array<struct<start:int,kind:int,end:int>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **method: float) -> DataFrame:
    """Per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (of the base and the method), n_term, n_spans.

    Null texts are empty, without spans; rows with null or equal ids are rows of their own (those with equal text get equal spans);
    other columns are ignored. Spans are kind:start:end by start, then kind.
    """
    found, terms, common = learn(docs, id_col, text_col, **method)

    @F.arrow_udf(_ADDED)
    def added(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, told in batches:
            told = iter(told.to_pylist())
            yield pa.array([[dict(zip(("start", "kind", "end"), x)) for x in term_spans(t or "", w, common)] for own in slices(texts) for t, w in zip(own, told)], _SPANS)

    # texts with disclosed words are looked at again; opaque strings have their places already
    told = with_terms(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", terms).where("__terms is not null")
    again = cut(told.select(F.xxhash64("text").alias("__h"), added("text", "__terms").alias("added")).dropDuplicates(["__h"])) if not terms.isEmpty() else None

    @F.arrow_udf(_ADDED)
    def strings(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            yield pa.array([[{"start": x["start"], "kind": KINDS.index("term"), "end": x["end"]} for x in own if x["word"] not in common] for own in s.to_pylist()], _SPANS)

    rows = found.select("doc_id", "h", "base", "opaque")
    alone = strings("opaque") if common else F.transform("opaque", lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), x["end"].alias("end")))
    rows = rows.withColumn("own", alone)
    if again is not None:
        a = sized(again, 64 + 24 * F.size("added"))
        rows = rows.join(a, rows["h"] == a["__h"], "left").withColumn("own", F.coalesce("added", "own"))
    every = F.array_sort(F.concat("base", "own"))
    count = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("doc_id", *count, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("own").cast("long").alias("n_term"), F.size(every).cast("long").alias("n_spans"))


def redact(text: str | None, added: list | None) -> str | None:
    """The text with base spans replaced by their kind and added ones generalised or removed; overlapping spans become the first one's label."""
    if text is None:
        return None
    spans = [(s, k, e, False) for s, k, e in base_spans(text)] + [(x["start"], x["kind"], x["end"], x["remove"]) for x in (added if added is not None else [])]
    out, at = [], 0
    for s, k, e, remove in sorted(spans):
        if s >= at:
            out += [text[at:s], "" if remove else LABELS[k]]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **method: float) -> DataFrame:
    """`docs` with its texts redacted: same rows, same columns. A null text stays null; n_chars, if there, is set to the new length."""

    _, terms, common = learn(docs, id_col, text_col, **method)

    @F.arrow_udf(StringType())
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, told in batches:
            parts, told = [], iter(told.to_pylist())
            for own in slices(texts):
                parts.append(pa.array([None if x is None else redact(x, [dict(zip(("start", "kind", "end", "remove"), y)) for y in term_spans(x, w, common)]) for x, w in zip(own, told)], pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        give_back()

    out = with_terms(docs, text_col, terms).withColumn(text_col, of(F.col(text_col), F.col("__terms")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
