"""Repair of text that was decoded by the wrong table, once or several times."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables by which UTF-8 was read in error. The second leaves five bytes without a character; they stay what they are. Tables that have common letters
#: where UTF-8 has following bytes, such as cp1251 and mac_roman, would take words of some languages for errors.
TABLES = ("latin-1", "cp1252")
#: Wrong steps in a row that are undone.
DEPTH = 3
#: Decoded wrongly, UTF-8 beyond ASCII is a run of characters beyond ASCII.
_RUN = re.compile(r"[^\x00-\x7f]{2,}")


def _bytes(run: str, table: str) -> bytes | None:
    """The bytes that `table` reads as this run, None if there are none."""
    try:
        return run.encode(table)
    except UnicodeEncodeError:
        if table != "cp1252":
            return None
    out = bytearray()
    for c in run:
        try:
            out += c.encode(table)
        except UnicodeEncodeError:
            if ord(c) > 0x9F:
                return None
            out.append(ord(c))
    return bytes(out)


def badness(run: str) -> int:
    """How little a run looks like text: a Latin letter, digit or mark of punctuation counts one, a letter of another script or an accent two, a symbol three, a control, unassigned or replaced character ten."""
    weight = {"C": 10, "S": 3, "M": 2}
    return sum(10 if c == "\ufffd" else 2 if c.isalpha() and c > "\u017f" else weight.get(unicodedata.category(c)[0], 1) for c in run)


def steps(run: str) -> Iterator[str]:
    """What the run is once a single wrong step is undone."""
    for table in TABLES:
        raw = _bytes(run, table)
        if raw is not None:
            try:
                yield raw.decode("utf-8")
            except UnicodeDecodeError:
                pass


def repaired_run(run: str) -> str:
    """The least bad of all texts that up to DEPTH wrong steps can have made this run of, the run itself first among equals, then fewer steps, then the tables' order."""
    best, least, now = run, badness(run), [run]
    for _ in range(DEPTH):
        now = list(dict.fromkeys(t for s in now for t in steps(s) if t != s))
        for t in now:
            if (b := badness(t)) < least:
                best, least = t, b
    return best


def _suspicious(c: Column) -> Column:
    """Has a character that the first byte of a UTF-8 sequence is read as by one of the tables, and another one beyond ASCII after it."""
    leads = "".join(sorted({bytes([b]).decode(t) for b in range(0xC2, 0xF5) for t in TABLES}))
    return c.rlike(f"[{leads}][^\\x00-\\x7f]")


def with_repaired(df: DataFrame, text: str = "text", into: str | None = None) -> DataFrame:
    """df with runs of wrongly decoded characters put right; nulls and texts without such runs as they are, and they do not leave the JVM's expressions.

    A task searches each distinct run once.
    """

    @F.pandas_udf("string")
    def repaired(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def one(m: re.Match) -> str:
            run = m.group()
            if run not in known:
                if len(known) > 100_000:
                    known.clear()
                known[run] = repaired_run(run)
            return known[run]

        for part in parts:
            yield part.map(lambda t: t if t is None else _RUN.sub(one, t))

    c = F.col(text)
    bad = F.coalesce(_suspicious(c), F.lit(False))
    return df.withColumn(into or text, F.when(bad, repaired(F.when(bad, c))).otherwise(c))
