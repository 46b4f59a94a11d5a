"""URL filter by a Bloom filter cascade (operator 2), DataFrame functions only.

The key universe is every distinct (host, path) of the table. Its listed keys are encoded in a
first Bloom filter; those unlisted keys that it wrongly accepts go into a second, the listed keys
which that one accepts into a third, and so on until a level has no false positives. A key of the
universe is listed exactly if the first level that misses it has an odd number (counted from 0).
Verdicts therefore need no join: each row probes literals.

Rules give the listed keys. A url without a rule is blocked only if it has no host (it cannot be
fetched); the cascade holds those keys as well, so that every verdict comes from it.

Defined results: a null url, or one without ``://``, has an empty host and path; rows that are
repeated are judged each on its own; an empty table gives no rows. Only ``page_id`` and ``url``
are read. The size of all levels is a few bits for each listed key: BITS_PER_KEY for the first
level, under two for the rest. ``MOST_BITS`` is the proven bound of what one plan carries; a list
beyond it is refused with an error, never cut.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubmart.llm.common import LOWER, UPPER, staged

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
HASHES = 7
LATER_HASHES = 5
BITS_PER_KEY = 10
LATER_BITS_PER_KEY = 8
WORD = 64
MOST_BITS = 1 << 31


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_and_action(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def fits(rule) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    def pick(value) -> Column:
        chosen = [F.when(fits(r), F.lit(value(r))) for r in ordered]
        return F.coalesce(*chosen, F.lit(None).cast("string"))

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _positions(host: Column, path: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bit places by double hashing of two independent 64-bit hashes of the key and the level."""
    one = F.xxhash64(F.lit(2 * level), host, path)
    two = F.xxhash64(F.lit(2 * level + 1), path, host)
    # both reduced first, so that the sum stays far inside 64 bits
    a, b = F.pmod(one, F.lit(bits)), F.pmod(two, F.lit(bits - 1)) + 1
    return [F.pmod(a + b * F.lit(i), F.lit(bits)) for i in range(hashes)]


class Level:
    """One Bloom filter: its words are a literal of the plan."""

    def __init__(self, number: int, keys: DataFrame, count: int):
        self.number = number
        self.hashes = LATER_HASHES if number else HASHES
        wanted = math.ceil(count * (LATER_BITS_PER_KEY if number else BITS_PER_KEY))
        self.bits = WORD * max(1, math.ceil(wanted / WORD))
        if self.bits > MOST_BITS:
            raise ValueError(f"{count} keys need {self.bits} bits; the bound is {MOST_BITS}")
        places = _positions(F.col("host"), F.col("path"), number, self.bits, self.hashes)
        set_bits = (
            keys.select(F.explode(F.array(*places)).alias("place"))
            .groupBy(F.floor(F.col("place") / WORD).cast("long").alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(place % {WORD} as int))")).alias("bits"))
        )
        words = ["0"] * (self.bits // WORD)
        for row in set_bits.toLocalIterator():
            words[row["word"]] = str(row["bits"])
        self.text = ",".join(words)

    def accepts(self, host: Column, path: Column) -> Column:
        # split and cast of a literal are folded once, when the plan is made
        words = F.split(F.lit(self.text), ",").cast("array<bigint>")
        hits = [
            F.getbit(F.element_at(words, F.floor(p / WORD).cast("int") + 1), F.pmod(p, F.lit(WORD)).cast("int")) == 1
            for p in _positions(host, path, self.number, self.bits, self.hashes)
        ]
        return reduce(lambda x, y: x & y, hits)


class Cascade:
    """Exact membership for the keys of a universe with columns host, path and listed."""

    def __init__(self, universe: DataFrame, most_levels: int = 64):
        counts = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        self.levels: list[Level] = []
        inside, outside = universe.where("listed"), universe.where("not listed")
        n = counts.get(True, 0)
        while n:
            if len(self.levels) == most_levels:
                raise RuntimeError("The cascade does not end")
            level = Level(len(self.levels), inside, n)
            self.levels.append(level)
            inside, outside = outside.where(level.accepts(F.col("host"), F.col("path"))), inside
            n = inside.count()

    def listed(self, host: Column, path: Column) -> Column:
        # decided by the first level that misses the key; past the last level by its parity
        verdict: Column = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            verdict = F.when(level.accepts(host, path), verdict).otherwise(F.lit(level.number % 2 == 1))
        return verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    rule, action = rule_and_action(host, path, rules)
    blocked = F.coalesce(action == "block", host == "")
    universe = staged(rows.select("host", "path").distinct().withColumn("listed", blocked), "url-keys")
    cascade = Cascade(universe)
    verdict = F.when(cascade.listed(host, path), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
