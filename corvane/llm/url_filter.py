"""URL filters by a bit-parallel wildcard automaton.

All rules are globs over the canonical form of a URL, and one Shift-And automaton runs all of them at once: every position of
every pattern is a bit of a state of several 64-bit words. Reading a character shifts the state by one, keeps the bits whose
position accepts the character, and lets the bits that stand before a wildcard stay. The URLs of a batch advance
together, one character a step, so a step is a few operations on a (URLs x words) array.

`*` stands for any characters but `/`, `**` for any at all, everything else for itself. The canonical form is `.` and the
host in lower case, then the path: a rule for a host and its subdomains starts with `*.`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corvane.session import workers_can_import

#: (host, path, verdict): the longest that fits decides.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Globs for URLs that no rule fits: what isn't an article is blocked. Otherwise the verdict is allow.
BLOCKED = (
    "*.ads.**", "*.adserver.**", "*.tracker.**", "*.spam-**", "*.cheap-pills.**", "*.casino.**",
    "**/ads/**", "**/advert/**", "**/login", "**/login/**", "**/signin/**", "**/logout**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**/cgi-bin/**",
    "**.exe", "**.zip", "**.jpg", "**.jpeg", "**.png", "**.gif", "**.css", "**.js", "**.pdf",
)


class Globs:
    """Which of several globs match whole strings; works on bytes of UTF-8."""

    def __init__(self, globs: list[str]):
        self.n = len(globs)
        bits = 0
        spots: list[tuple[int, int]] = []  # (bit, byte)
        start, stay_any, stay_in, accept = [], [], [], []
        for g in globs:
            b, i = g.encode(), 0
            first = bits
            start.append(first)
            # bit `first + k` is set when k plain bytes are matched; a wildcard after them lets that bit stay
            while i < len(b):
                if b[i : i + 2] == b"**":
                    stay_any.append(bits)
                    i += 2
                elif b[i] == 42:
                    stay_in.append(bits)
                    i += 1
                else:
                    bits += 1
                    spots.append((bits, b[i]))
                    i += 1
            accept.append(bits)
            bits += 1
        self.words = -(-bits // 64)
        mask = self._mask
        self.accepts = np.stack([mask([p for p, x in spots if x == c]) for c in range(256)])
        self.start, self.any, self.within = mask(start), mask(stay_any), mask(stay_in)
        self.accept = accept

    def _mask(self, bits: list[int]) -> np.ndarray:
        m = np.zeros(self.words, np.uint64)
        for b in bits:
            m[b // 64] |= np.uint64(1 << (b % 64))
        return m

    def match(self, strings: list[bytes]) -> np.ndarray:
        """(strings x globs) booleans."""
        out = np.zeros((len(strings), self.n), bool)
        order = np.argsort([-len(s) for s in strings], kind="stable")
        lengths = np.array([len(strings[i]) for i in order], int)
        state = np.tile(self.start, (len(strings), 1))
        longest = int(lengths[0]) if len(lengths) else 0
        text = np.zeros((len(strings), longest), np.uint8)
        for k, i in enumerate(order):
            text[k, : lengths[k]] = np.frombuffer(strings[i], np.uint8)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(longest):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # strings longer than t
            s, c = state[:n], text[:n, t]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:n] = (moved & self.accepts[c]) | (s & self.any) | (s & self.within & np.where(c == 47, np.uint64(0), ~np.uint64(0))[:, None])
        for k, b in enumerate(self.accept):
            out[order, k] = (state[:, b // 64] >> np.uint64(b % 64)) & one == 1
        return out


#: URLs that advance together; longer ones go in smaller batches.
_BATCH_BYTES = 1 << 22


def portions(strings: list[bytes]) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(strings):
        end, longest = start, 0
        while end < len(strings) and (max(longest, len(strings[end])) * (end - start + 1) <= _BATCH_BYTES or end == start):
            longest = max(longest, len(strings[end]))
            end += 1
        yield start, end
        start = end


def host_of(url: Column) -> Column:
    """From the first :// to / ? # or the end, A-Z in lower case; empty for null and without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end to ? # or the end; empty for null and without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: tuple = RULES, blocked: tuple = BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of `pages`: page_id, host, path, rule (the longest that fits, else null), verdict (its, else block where a glob of `blocked` matches, else allow).

    A row needs nothing of any other: no shuffle. Null urls and those without :// have an empty host and path, which no rule fits; null and
    repeated ids are rows of their own; other columns are ignored. Of rules of equal length that fit, the earlier in `rules` wins.
    """
    workers_can_import(pages.sparkSession)
    order = sorted(range(len(rules)), key=lambda i: -len(rules[i][0] + rules[i][1]))
    globs = [f"*.{rules[i][0]}{rules[i][1]}**" for i in order] + list(blocked)
    n = len(order)

    @F.pandas_udf(IntegerType())
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """Number of the first glob that matches, -1 if none does."""
        automaton = Globs(globs)
        for s in batches:
            distinct, back = np.unique(s.to_numpy(object), return_inverse=True)
            strings, out = [x.encode() for x in distinct], np.full(len(distinct), -1, np.int32)
            for a, b in portions(strings):
                m = automaton.match(strings[a:b])
                out[a:b] = np.where(m.any(1), m.argmax(1), -1)
            yield pd.Series(out[back], index=s.index)

    x = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    x = x.withColumn("g", first(F.concat(F.lit("."), "host", "path")))
    names = F.array(*[F.lit(rules[i][0] + rules[i][1]) for i in order]) if n else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(rules[i][2]) for i in order]) if n else F.array().cast("array<string>")
    fits = (F.col("g") >= 0) & (F.col("g") < n)
    return x.select(
        "page_id", "host", "path",
        F.when(fits, F.get(names, F.col("g"))).alias("rule"),
        F.when(fits, F.get(verdicts, F.col("g"))).when(F.col("g") >= n, "block").otherwise("allow").alias("verdict"),
    )


def oracle_sql() -> str:
    """The same for the default rules and globs, with regular expressions in place of the automaton."""
    import re

    def pattern(glob: str) -> str:
        parts = re.split(r"(\*\*|\*)", glob)
        return "(?s)^" + "".join({"**": ".*", "*": "[^/]*"}.get(p) or re.escape(p).replace("'", "''") for p in parts) + "$"

    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"((host = '{h}' or host like '%.{h}') and starts_with(path, '{p}'))"
    block = " or ".join(f"regexp_matches('.' || host || path, '{pattern(g)}')" for g in BLOCKED)
    return f"""
with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages),
p as (select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r as (select *, case {' '.join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in order)} end as rule from p)
select page_id, host, path, rule, case {' '.join(f"when rule = '{h}{p}' then '{v}'" for h, p, v in order)} when {block} then 'block' else 'allow' end as verdict from r"""
