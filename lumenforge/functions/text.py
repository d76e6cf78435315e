"""Scalar text functions: token sets, similarities, markers."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words without content. Fixed values.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "be", "been", "being", "this", "that", "these",
    "those", "with", "as", "by", "we", "our", "it", "its", "which", "from", "at", "also", "can", "could", "have", "has", "had", "not", "but", "such",
    "using", "use", "used", "based", "other", "more", "most", "one", "two", "three", "between", "both", "than", "into", "how", "what", "each", "their", "they", "them",
)


#: The slots of a unit that are compared as wholes.
SLOTS = ("tag", "prev_relation", "next_relation")


def tokens(text: Column) -> Column:
    """The distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def content_tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    return F.filter(F.array_except(tokens(text), F.array(*map(F.lit, stopwords))), lambda t: F.length(t) > 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        out, matcher, last = [], SequenceMatcher(None), None
        for x, y in zip(a, b):
            if y != last:  # the matcher indexes its second string; pairs that share it come together
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        yield pd.Series(out, dtype=float)


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of the lower-cased strings; not symmetric. Null counts as empty."""
    return _ratios(*[F.lower(F.coalesce(c, F.lit(""))) for c in (a, b)])


@F.pandas_udf(DoubleType())
def _rounded(x: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(k)) for v, k in zip(x, n)])


def py_round(x: Column, digits: int) -> Column:
    """Half-even on the exact binary value, which no native rounding does."""
    return _rounded(x, F.lit(digits))


def text_similarity(a: Column, b: Column) -> Column:
    """Half the Jaccard similarity of tokens plus half the ratio; two empty strings give 0.5. Null counts as empty."""
    a, b = (F.coalesce(c, F.lit("")) for c in (a, b))
    return 0.5 * jaccard(tokens(a), tokens(b)) + 0.5 * ratio(a, b)


def clean_slot(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def slot_value(text: Column) -> Column:
    """What two slots are compared by; empty for a slot that is not filled and so agrees with none."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("="), clean_slot(text))).otherwise(F.lit(""))


def slot_similarity(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """The number of slots that are filled on both sides and equal after strip and lower case."""
    hits = [F.when((slot_value(left[k]) == slot_value(right[k])) & (slot_value(left[k]) != ""), 1).otherwise(0) for k in left]
    return sum(hits[1:], hits[0])


def marker_pattern(marker: Column) -> Column:
    """A regex for the marker's words with any space between them; null if it has none."""
    words = F.filter(F.split(marker, r"(?U)\s+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"))
    return F.when(F.size(words) > 0, F.concat(F.lit("(?iuU)"), F.array_join(quoted, r"\s*")))


def find_marker(text: Column, marker: Column, start: Column) -> Column:
    """Offset in characters of the first hit at or after ``start`` of the marker, else of the marker without its leading number; null if none."""
    rest = F.substr(text, start + 1)
    bare = F.regexp_replace(marker, r"(?U)^[\d.)\s]+", "")

    def hit(m: Column) -> Column:
        # the text before the first hit, measured in characters; places in a match count UTF-16 units
        pattern = F.coalesce(marker_pattern(m), F.lit("(?!)"))
        return F.when(F.regexp_like(rest, pattern), F.length(F.element_at(F.split(rest, pattern, 2), 1)))

    return F.coalesce(hit(marker), F.when((bare != marker) & (bare != ""), hit(bare))) + start


def slice_by_markers(text: Column, markers: Column) -> Column:
    """For each marker the stripped text from its hit to the next found marker's; null where not found."""
    empty = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("at"))

    def step(acc: Column, m: Column) -> Column:
        hit = find_marker(text, m, acc["cursor"]).cast("int")
        return F.struct(F.coalesce(hit + 1, acc["cursor"]).alias("cursor"), F.concat(acc["at"], F.array(hit)).alias("at"))

    at = F.aggregate(markers, empty, step)["at"]

    def piece(p: Column, i: Column) -> Column:
        later = F.filter(F.slice(at, i + 2, F.size(at)), lambda q: q.isNotNull())
        end = F.when(F.size(later) > 0, F.get(later, F.lit(0))).otherwise(F.length(text))
        return F.when(p.isNotNull(), F.regexp_replace(F.substr(text, p + 1, end - p), r"(?U)^\s+|\s+$", ""))

    return F.transform(at, piece)


def unwrap(response: Column, fields: list[str]) -> Column:
    """A JSON object as text; if its only key is none of ``fields``, what stands under that key."""
    keys = F.json_object_keys(response)
    stray = (F.size(keys) == 1) & ~F.arrays_overlap(keys, F.array(*map(F.lit, fields)))
    inner = F.element_at(F.map_values(F.from_json(response, "map<string,string>")), 1)
    return F.when(stray, inner).otherwise(response)


def in_domain(value: Column, domain: Column) -> Column:
    """``value`` if it is one of ``domain``, else null."""
    return F.when(F.array_contains(domain, value), value)


def ranking_in_domain(ranking: Column) -> Column:
    """A ranking given as a JSON array, without the entries that are no strings."""
    items = F.from_json(ranking, "array<variant>")
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))


def composite_key(*parts: Column, mark: str = ":") -> Column:
    return F.concat_ws(mark, *[p.cast("string") for p in parts])


def split_key(key: Column, mark: str = ":") -> tuple[Column, Column]:
    """The parts of a composite key of two, the second without ``mark`` in it."""
    last = F.length(F.substring_index(key, mark, -1))
    return F.substr(key, F.lit(1), F.length(key) - last - len(mark)), F.substring_index(key, mark, -1)


def one_line(text: Column) -> Column:
    """New lines as blanks, without blanks at the ends."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\n", " "), r"(?U)^\s+|\s+$", "")
