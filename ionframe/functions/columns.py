"""Scalar and array expressions. All JVM-side built-ins, so they stay inside whole-stage codegen."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the flat key format: separator, attribute mark, text mark, indexed-segment pattern.
SEPARATOR = ":"
ATTRIBUTE = "@"
TEXT = "#text"
INDEXED = r"^(.*)\[(\d+)\]$"

# Every character that counts as whitespace when text is stripped.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Unit accession of minutes; times stored in it are multiplied to seconds.
UNIT_MINUTE = "UO:0000031"


def within(c: Column, lo, hi, dtype: str = "float") -> Column:
    """Closed interval test with both bounds cast to the column's own type.

    A float column compared with a double literal widens the column, which both blocks the Parquet
    push-down and moves the edges (``float(10.1) <> 10.1``). Casting the bounds keeps both right.
    """
    return c.between(_bound(lo, dtype), _bound(hi, dtype))


def around(c: Column, center, tol, dtype: str = "float") -> Column:
    """``center - tol <= c <= center + tol``; the arithmetic is done in double before the cast."""
    return within(c, center - tol, center + tol, dtype)


def _bound(v, dtype: str) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast(dtype)


def null_if_zero(c: Column) -> Column:
    """Zero means 'not measured': null."""
    return F.when(c != 0, c)


def zip_shortest(a: Column, b: Column, a_name: str, b_name: str) -> Column:
    """Pair two arrays element by element, stopping at the shorter (``arrays_zip`` alone pads with null)."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n).alias(a_name), F.slice(b, 1, n).alias(b_name))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` names it, also in lambdas."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def map_of_last(entries: Column, key: str) -> Column:
    """A map of (key, value) structs; of entries with one key the last counts, and those without a key do not."""
    def kept(all_: Column) -> Column:
        later = lambda i: F.slice(all_, i + 2, F.size(all_))
        return F.filter(all_, lambda e, i: e[key].isNotNull() & ~F.exists(later(i), lambda o: o[key] == e[key]))

    return F.map_from_entries(let(entries, kept))


def any_within(values: Column, lo, hi, dtype: str = "double") -> Column:
    """True when at least one array element lies in the closed interval."""
    return F.exists(values, lambda x: within(x, lo, hi, dtype))


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_tag(c: Column) -> Column:
    """Drop a leading ``{namespace}``: the text after the first closing brace."""
    return F.regexp_replace(c, r"^[^}]*\}", "")


def to_seconds(value: Column, unit_accession: Column) -> Column:
    """Times in minutes become seconds; every other unit is taken to be seconds already."""
    return value * F.when(unit_accession == UNIT_MINUTE, F.lit(60.0)).otherwise(F.lit(1.0))


def label(code: Column, vocabulary: dict, default: str = "UNKNOWN") -> Column:
    """Look a code up in a fixed vocabulary; codes outside it (and nulls) get ``default``."""
    pairs = [x for k, v in vocabulary.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def merge_maps(existing: Column, added: Column) -> Column:
    """Union of two string maps; where both have a key the existing entry wins."""
    new_only = F.map_filter(added, lambda k, _: ~F.map_contains_key(existing, k))
    return F.map_concat(new_only, existing)


def segments(path: Column) -> Column:
    """A flat key as its list of segments."""
    return F.split(path, SEPARATOR, -1)


def segment_tag(segment: Column) -> Column:
    """``tag[i]`` to ``tag``; empty string for a segment without an index."""
    return F.regexp_extract(segment, INDEXED, 1)


def segment_index(segment: Column) -> Column:
    """``tag[i]`` to ``i``; null for a segment without a (representable) index."""
    return F.regexp_extract(segment, INDEXED, 2).try_cast("bigint")


def segment_kind(segment: Column, is_first: Column, is_last: Column) -> Column:
    """What one key segment denotes: attribute, text, element, root or malformed.

    Marks count only in last position; an element must carry an index unless it is the root.
    """
    tag = segment_tag(segment)
    return (
        F.when(is_last & segment.startswith(ATTRIBUTE), "attribute")
        .when(is_last & (segment == TEXT), "text")
        .when(_is_name(tag) & segment_index(segment).isNotNull(), "element")
        .when(is_first & _is_name(segment) & ~segment.rlike(INDEXED), "root")
        .otherwise("malformed")
    )


def _is_name(c: Column) -> Column:
    return (F.length(c) > 0) & ~c.startswith(ATTRIBUTE) & (c != TEXT)


def names_root(segment: Column) -> Column:
    """Whether a first segment names a root element at all (well-formed or not)."""
    return ~segment.startswith(ATTRIBUTE) & (segment != TEXT)


def is_good_root(segment: Column) -> Column:
    return _is_name(segment) & ~(segment.endswith("]") & segment.rlike(INDEXED))


def xml_escape_text(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def xml_escape_attribute(c: Column) -> Column:
    c = F.replace(xml_escape_text(c), F.lit('"'), F.lit("&quot;"))
    c = F.replace(c, F.lit("\r"), F.lit("&#13;"))
    c = F.replace(c, F.lit("\n"), F.lit("&#10;"))
    return F.replace(c, F.lit("\t"), F.lit("&#09;"))
