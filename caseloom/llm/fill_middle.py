"""Operator 12, fill-in-the-middle transformation by wavelet matrices over character classes.

Each character gets a class: what kind it is, and whether a unit begins with it.
A wavelet matrix over the classes of some texts answers how often a class stands
before any place. Ranks of the classes that begin a unit add up to the number of
units that begin before a place; a text's own count is the difference of two such
sums, and bisection on them finds the place where a given unit begins. So both
cuts of all texts of a slice are found at once, in rounds of the logarithm of
their length.

Units are runs of the letters A-Z and a-z, and every other character alone. The
number of units before either cut, the form (prefix-suffix-middle,
suffix-prefix-middle or plain) and so the whole result come from a hash of the
document's id; a rerun or a lost executor gives the same rows.

Defined results: a null or empty text has no units and stays plain. A text that
holds a sentinel stays plain, so that its output can be taken apart again. A null
id hashes as no digits. Repeated rows repeat results; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import mapped, pick, sized_slices
from caseloom.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many put the suffix first.
RATE, SUFFIX_FIRST = 90, 20

#: Classes of characters. Each kind of letter has one class that begins a unit and one that goes on.
DIGIT, SPACE, PUNCTUATION, OTHER, LOWER_FIRST, UPPER_FIRST, LOWER_LATER, UPPER_LATER = range(8)
LATER = LOWER_LATER - LOWER_FIRST
BEGINS = (DIGIT, SPACE, PUNCTUATION, OTHER, LOWER_FIRST, UPPER_FIRST)
LEVELS = 3

_KIND = np.full(129, PUNCTUATION, np.uint8)
_KIND[[*range(9, 14), *range(28, 33)]] = SPACE
_KIND[48:58] = DIGIT
_KIND[65:91] = UPPER_FIRST
_KIND[97:123] = LOWER_FIRST
_KIND[128] = OTHER


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each code point; ``starts`` are the places where texts begin, which end every run."""
    kind = _KIND[np.minimum(points, 128)]
    letter = kind >= LOWER_FIRST
    goes_on = np.zeros(len(points), bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[starts[starts < len(points)]] = False
    return np.where(goes_on, kind + LATER, kind).astype(np.uint8)


def cuts(texts: list[str], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, end of the prefix, end of the middle) of each text; ``first`` and ``second`` are numbers that draw units."""
    lengths = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(lengths)
    starts = stops - lengths
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    matrix = WaveletMatrix(classes(points, starts), LEVELS)
    units = matrix.count(BEGINS, stops) - matrix.count(BEGINS, starts)
    drawn = np.sort(np.stack([first % (units + 1), second % (units + 1)]), axis=0)
    ends = [matrix.select(BEGINS, number, starts, stops) - starts for number in drawn]
    return units, ends[0], ends[1]


def _arranged(batches: Iterator[pa.RecordBatch], rate: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in sized_slices(whole)):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
        units, ends, later = cuts(texts, h1, h2)
        forms, outputs = [], []
        for k, text in enumerate(texts):
            a, b = int(ends[k]), int(later[k])
            if not text or h3[k] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                forms.append("plain")
                outputs.append(text)
            elif h4[k] % 100 < suffix_first:
                forms.append("spm")
                outputs.append(f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}")
            else:
                forms.append("psm")
                outputs.append(f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}")
        plain = np.array([f == "plain" for f in forms], bool)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(units), pa.array(forms, pa.string()), pa.array(ends, mask=plain),
             pa.array(later - ends, mask=plain), pa.array(outputs, pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def transformed(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row."""
    rows = pick(docs, doc_id="doc_id", text="text")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    schema = rows.select("doc_id").schema
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)
    return mapped(rows.select("doc_id", "text", *drawn), partial(_arranged, rate=rate, suffix_first=suffix_first), schema)


def _between(text: Column, opening: str, closing: str) -> tuple[Column, Column]:
    """What stands between the sentinel that a text begins with and the next one, and the rest from there on."""
    inside = F.substring_index(text, closing, 1)
    return F.substr(inside, F.lit(len(opening) + 1)), F.substr(text, F.length(inside) + 1)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, told from the output and its form alone."""
    prefix, rest = _between(output, PREFIX, SUFFIX)
    suffix, rest = _between(rest, SUFFIX, MIDDLE)
    ordered = F.concat(prefix, F.substr(rest, F.lit(len(MIDDLE) + 1)), suffix)
    tail, rest = _between(output, SUFFIX, PREFIX)
    head, rest = _between(rest, PREFIX, MIDDLE)
    turned = F.concat(head, F.substr(rest, F.lit(len(MIDDLE) + 1)), tail)
    return F.when(form == "psm", ordered).when(form == "spm", turned).otherwise(output)


def digests(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The query's rows: what was cut where, and hashes of the output and of the text restored from it."""
    rows = transformed(docs, rate, suffix_first)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = """
with hashed as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as digest from documents),
cut as (
  select doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
    ('0x' || substr(digest, 1, 8))::bigint as h1, ('0x' || substr(digest, 9, 8))::bigint as h2,
    ('0x' || substr(digest, 17, 8))::bigint as h3, ('0x' || substr(digest, 25, 8))::bigint as h4
  from hashed),
drawn as (
  select *, len(units)::bigint as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from cut),
parts as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix
  from drawn)
select doc_id, n, form,
  case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
  case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""
