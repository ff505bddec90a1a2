"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

A text is a run of units, code points unless another pattern says what a unit is. One full match of the
repeated group ``(unit)*`` keeps every repetition, so the ends of its captures are at once the number of
units and the offsets of both cuts; no unit is visited in Python. As each capture costs some 200 bytes, a
text longer than ``SEGMENT`` characters is matched by the segment, and only the ends (4 bytes a unit) stay.
Hashes, forms, assembly and restoring are Spark expressions; Python sees a text once and returns numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from factsieve.llm.common import Sealed, or_empty

SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle
SEGMENT = 1 << 16                  # units that one match captures
CODE_POINT = "."


@lru_cache(maxsize=8)
def _patterns(unit: str) -> tuple[regex.Pattern, regex.Pattern]:
    return regex.compile(f"({unit})*", regex.DOTALL), regex.compile(f"({unit}){{1,{SEGMENT}}}", regex.DOTALL)


def unit_ends(text: str, unit: str = CODE_POINT) -> np.ndarray | None:
    """Offset after each unit; None if the text is no run of units or a unit is empty."""
    whole, segment = _patterns(unit)
    if len(text) <= SEGMENT:
        match = whole.fullmatch(text)
        ends = np.array(match.ends(1), np.uint32) if match else None
    else:
        parts, at = [], 0
        while at < len(text) and (match := segment.match(text, at)) and match.end() > at:
            parts.append(np.array(match.ends(1), np.uint32))
            at = match.end()
        ends = np.concatenate(parts) if at == len(text) else None
    if ends is not None and len(ends) and (ends[0] == 0 or (np.diff(ends.astype(np.int64)) <= 0).any()):
        return None
    return ends


def _cuts(unit: str):
    @F.pandas_udf("n long, first long, second long")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in batches:
            rows = []
            for text, a, b in zip(texts, one, two):
                ends = unit_ends(text, unit)
                if ends is None:
                    rows.append((0, None, None))
                    continue
                n = len(ends)
                low, high = sorted((a % (n + 1), b % (n + 1)))
                rows.append((n, int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0))
            yield pd.DataFrame(rows, columns=["n", "first", "second"]).astype("Int64")

    return cuts


def numbers(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the leading 8-digit groups of the hex sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), or_empty(key.cast("string"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str = CODE_POINT,
              sentinels: tuple[str, str, str] = SENTINELS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    The form is ``plain`` (text as it is; both lengths null) for texts that are empty or null, hold a
    sentinel or are no run of units (n = 0), and for ``plain_percent`` of the others by hash of the id;
    else ``spm`` for ``spm_percent`` of them, else ``psm``. A null id hashes like an empty one, rows with
    equal ids draw the same numbers, and each row stands for itself. Texts of any length are used whole.
    An empty table gives an empty one. A column of ``docs`` named like a result gives way to it; any
    other column stays, whatever its name.
    """
    if len(set(sentinels)) < 3 or any(not s or s.count(c[0]) != (s[0] == c[0]) for s in sentinels for c in sentinels if c):
        raise ValueError("sentinels must differ, and no sentinel may hold another's first character but as its own first")
    table = Sealed(docs)
    h = numbers(table.col(id_column), seed)
    rows = table.rows.withColumns({"_text": or_empty(table.col(text_column)), "_h3": h[2], "_h4": h[3]})
    rows = rows.withColumn("_cut", _cuts(unit)("_text", h[0], h[1]))
    holds = [F.contains(F.col("_text"), F.lit(s)) for s in sentinels]
    plain = (F.col("_text") == "") | holds[0] | holds[1] | holds[2] | F.col("_cut.first").isNull() | (F.col("_h3") % 100 >= 100 - plain_percent)
    rows = rows.withColumn("_form", F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = F.col("_cut.first"), F.col("_cut.second")
    part = lambda start, length: F.substring(F.col("_text"), start + 1, length)
    prefix, middle, suffix = part(F.lit(0), first), part(first, second - first), part(second, F.length("_text") - second)
    p, s, m = map(F.lit, sentinels)
    output = (F.when(F.col("_form") == "plain", F.col("_text"))
              .when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    cut = F.col("_form") != "plain"
    return table.opened(rows, n=F.col("_cut.n"), form=F.col("_form"), prefix_chars=F.when(cut, first),
                        middle_chars=F.when(cut, second - first), output=output)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text behind an output of the form."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)  # '', then the three parts
    at = lambda i: F.get(parts, F.lit(i))
    return (F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2)))
            .otherwise(F.concat(at(2), at(3), at(1))))
