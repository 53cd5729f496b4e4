"""Secret scans: base patterns, and windows of high Shannon entropy in candidate strings. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, let, running, without

#: The base kinds in their order. Hex runs and access keys are greedy runs, so a lower bound inside the pattern
#: keeps just the matches that are long enough; an assignment's value is measured after matching.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]
MIN_VALUE = 12


@dataclass(frozen=True)
class EntropyClass:
    """Candidates: runs of `chars` of `min_length` or more that hold one of each of `require`. Bits: entropy a window must reach."""

    name: str
    chars: str
    min_length: int
    window: int
    bits: float
    require: tuple[str, ...]


#: Per character class. A window of 20 characters has at most 4.32 bits; random hex digits reach 3.0 nearly always, prose letters with a digit seldom 3.6.
CLASSES = (
    EntropyClass("hexadecimal", "0-9A-Fa-f", 20, 20, 2.8, ("[A-Fa-f]",)),
    EntropyClass("base64", "A-Za-z0-9+/_=-", 24, 20, 3.6, ("[a-z]", "[A-Z]")),
    EntropyClass("lower-case base36", "a-z0-9", 24, 20, 3.6, ("[a-z]",)),
    EntropyClass("upper-case base36", "A-Z0-9", 24, 20, 3.6, ("[A-Z]",)),
)
#: All classes lie between these two characters.
FIRST, LAST = "+", "z"
#: Candidates are suppressed whose value, what follows the last inner =, is a UUID, or of which placeholder words make up a tenth or more.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PLACEHOLDER = r"(?i)example|placeholder|changeme|xxxx|sample|dummy"
#: So are hot spans that are paths or runs of words: two signs or more, and between signs only letters of one case (a capital may lead) or up to four digits.
SIGNS = r"[/_=+-]"
NO_WORDS = r"[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"

SPANS = "array<struct<s:int,k:int,e:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """Array of (s, m): the code-point start and the text of each leftmost non-overlapping match.

    The texts between matches have lengths; starts are running sums of lengths before.
    """

    def starts(found: Column, gaps: Column) -> Column:
        before = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        return F.zip_with(running(before, "int", lambda a, b: a + b, F.lit(0)), found, lambda s, m: F.struct(s.alias("s"), m.alias("m")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: starts(found, gaps)))


def _when_found(text: Column, pattern: str, spans: Column, empty: Column) -> Column:
    """Most texts hold none: one search then settles it."""
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _hot(candidate: Column, c: EntropyClass) -> Column:
    """(lo, hi): the first and last window starts whose entropy reaches c.bits, else (-1, -1).

    For a window with counts n_x, H = log2(w) - sum(n_x log2 n_x) / w. The counts are kept as one letter each in a
    string, A for 0, at the character's place; moving on by one character takes one from the count of the one that leaves
    and adds one to that of the one that enters, and changes the sum by their terms alone. Terms are scaled to whole
    numbers, so that nothing drifts. A step costs the same whatever the candidate's length.
    """
    w, scale = c.window, 1 << 32
    term = F.array(*[F.lit(round(n * math.log2(n) * scale) if n else 0).cast("long") for n in range(w + 1)])
    most = round(w * (math.log2(w) - c.bits) * scale) + scale // 1_000_000
    base, letters = ord(FIRST) - 1, ord(LAST) - ord(FIRST) + 1
    times = lambda counts, x: F.ascii(F.substring(counts, x, F.lit(1))) - 65
    put = lambda counts, x, n: F.overlay(counts, F.char(n + 65), x, F.lit(1))
    state = lambda t, counts, lo, hi: F.struct(t.alias("t"), counts.alias("counts"), lo.alias("lo"), hi.alias("hi"))

    def enter(a: Column, x: Column) -> Column:
        n = times(a["counts"], x)
        return F.struct((a["t"] - F.get(term, n) + F.get(term, n + 1)).alias("t"), put(a["counts"], x, n + 1).alias("counts"))

    def leave(a: Column, x: Column) -> Column:
        n = times(a["counts"], x)
        return F.struct((a["t"] - F.get(term, n) + F.get(term, n - 1)).alias("t"), put(a["counts"], x, n - 1).alias("counts"))

    def fold(at: Column) -> Column:  # at: the place of each character among the letters, from 1
        nothing = F.struct(F.lit(0).cast("long").alias("t"), F.lit("A" * letters).alias("counts"))
        first = F.aggregate(F.slice(at, 1, w), nothing, enter)

        def begin(a: Column) -> Column:
            i = F.when(a["t"] <= most, 0).otherwise(-1)
            return state(a["t"], a["counts"], i, i)

        def move(a: Column, i: Column) -> Column:  # i: from 0, the place of the entering character; i - w leaves
            def after(b: Column) -> Column:
                hot, here = b["t"] <= most, i - (w - 1)
                return state(b["t"], b["counts"], F.when(hot & (a["lo"] < 0), here).otherwise(a["lo"]), F.when(hot, here).otherwise(a["hi"]))

            return let(leave(a, F.get(at, i - w)), lambda b: let(enter(b, F.get(at, i)), after))

        rest = F.when(F.size(at) > w, F.sequence(F.lit(w), F.size(at) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(rest, let(first, begin), move, lambda a: F.struct(a["lo"].alias("lo"), a["hi"].alias("hi")))

    # Candidates are ASCII: a character is a byte, and bytes are reached by their place.
    places = lambda raw: F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.ascii(F.substring(raw, i, F.lit(1)).cast("string")) - base)
    return let(let(candidate.cast("binary"), places), fold)


def _suppressed(candidate: Column) -> Column:
    """Whether the candidate's value is a UUID or mostly a placeholder."""

    def judge(value: Column) -> Column:
        left = F.length(F.regexp_replace(value, PLACEHOLDER, ""))
        return (F.length(value) == 36) & value.rlike(UUID) | ((F.length(value) - left) * 10 >= F.greatest(F.length(value), F.lit(1)))

    return let(F.substring_index(F.rtrim(candidate, F.lit("=")), "=", -1), judge)


def _entropy_spans(text: Column, c: EntropyClass) -> Column:
    """Array of (s, e), by start: in each candidate, from the first hot window to the last, unless the allow-list suppresses it."""
    pattern = f"(?<![{c.chars}])(?=[{c.chars}]*[0-9])[{c.chars}]{{{c.min_length},}}"
    kept = F.filter(_matches(text, pattern), lambda x: reduce(Column.__and__, [x["m"].rlike(r) for r in c.require]) & ~_suppressed(x["m"]))
    hot = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), _hot(x["m"], c).alias("h")))
    part = lambda x: F.substring(x["m"], x["h"]["lo"] + 1, x["h"]["hi"] - x["h"]["lo"] + c.window)
    hot = F.filter(hot, lambda x: (x["h"]["lo"] >= 0) & let(part(x), lambda p: p.rlike(NO_WORDS) | (F.regexp_count(p, F.lit(SIGNS)) < 2)))
    spans = F.transform(hot, lambda x: F.struct((x["s"] + x["h"]["lo"]).alias("s"), (x["s"] + x["h"]["hi"] + c.window).alias("e")))
    return _when_found(text, pattern, spans, F.expr("cast(array() as array<struct<s:int,e:int>>)"))


def _joined(spans: Column) -> Column:
    """Spans (s, e, ...) in order of s, those that overlap made one: array of (s, e)."""

    def islands(x: Column, ends: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["s"] >= F.get(ends, i - 1)))
        edge = lambda f, j: F.coalesce(F.get(f, j + 1), F.size(x)) - 1
        return let(first, lambda f: F.transform(f, lambda i, j: F.struct(F.get(x, i)["s"].alias("s"), F.get(ends, edge(f, j)).alias("e"))))

    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    whole = lambda x: let(running(F.transform(x, lambda y: y["e"]), "int", lambda a, b: F.greatest(a, b), F.lit(0)), lambda ends: islands(x, ends))
    return let(spans, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def secret_scan(df: DataFrame, text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES) -> DataFrame:
    """df with found added: array of (s int, k int, e int), by start, then kind, then end; k counts into KINDS.

    Base kinds: leftmost non-overlapping matches, code points, end exclusive. Kind entropy: hot spans of all classes,
    those that overlap made one, unless a base span holds the whole of one. Null and empty text have none; repeated rows
    are each judged alone; an empty table gives an empty one; a column named found is replaced, all others stay, whatever
    their names. One pass over rows without shuffle, so any skew stays where the rows are; the work grows with a text's
    length, also in one long candidate.
    """
    d = without(df, ["found"]) if text_col.lower() != "found" else df
    text, some, ent, base = fresh([*d.columns, "found"], "text_", "some_", "entropy_", "base_")
    kept = [c for c in d.columns if c.lower() != "found"]
    none = F.expr(f"cast(array() as {SPANS})")
    d = d.withColumn(text, F.coalesce(col(text_col), F.lit("")))
    t = col(text)
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), (x["s"] + F.length(x["m"])).alias("e"))
    # The value is the tail of the match: what follows the separator and an optional quote.
    long_enough = lambda x: F.length(F.regexp_extract(x["m"], f"^{ASSIGN}$", 1)) >= MIN_VALUE
    found = [
        _when_found(t, ASSIGN, F.transform(F.filter(_matches(t, ASSIGN), long_enough), span(0)), none),
        _when_found(t, ACCESS, F.transform(_matches(t, ACCESS), span(1)), none),
        _when_found(t, HEX, F.transform(_matches(t, HEX), span(2)), none),
    ]
    no = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    if classes:  # a candidate of any class is a run of these characters
        shortest = min(c.min_length for c in classes)
        chars = "".join(c.chars for c in classes)
        worth = t.rlike(f"(?<![{chars}])(?=[{chars}]*[0-9])[{chars}]{{{shortest},}}")
        hot = _joined(F.sort_array(F.concat(*[_entropy_spans(t, c) for c in classes])))
        d = d.withColumn(some, worth).withColumn(ent, F.when(col(some), hot).otherwise(no))
    else:
        d = d.withColumn(some, F.lit(False)).withColumn(ent, no)
    d = d.withColumn(base, F.concat(*found))

    def outside(every: Column) -> Column:
        """Spans come by start, base ones first: the furthest end of base spans so far tells whether one holds a later span."""
        ends = F.transform(every, lambda x: F.when(x["k"] < 3, x["e"]).otherwise(0))
        return let(running(ends, "int", lambda a, b: F.greatest(a, b), F.lit(0)), lambda far: F.filter(every, lambda x, i: (x["k"] < 3) | (F.get(far, i) < x["e"])))

    extra = F.transform(col(ent), lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    sorted_base = F.sort_array(col(base))
    out = F.when(F.size(col(ent)) > 0, let(F.sort_array(F.concat(col(base), extra)), outside)).otherwise(sorted_base)
    return d.select(*[col(c) for c in kept], out.alias("found"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every found span of the text replaced by mark; overlapping spans become one. Null text stays null.

    The text between spans is cut from UTF-32, where a character is reached by its place; a letter before each cut keeps a
    leading byte-order mark from being taken for one.
    """
    (spans,) = fresh(df.columns, "spans")
    d = secret_scan(df, text_col)
    d = d.select(*[col(c) for c in df.columns], _joined(F.col("found")).alias(spans))
    t = col(text_col)

    def body(raw: Column, found: Column) -> Column:
        cut = lambda a, b: F.substring(F.decode(F.concat(F.lit(b"\0\0\0A"), F.substring(raw, a * 4 + 1, (b - a) * 4)), "UTF-32"), 2, 1 << 30)
        between = F.transform(found, lambda x, i: cut(F.when(i > 0, F.get(found, i - 1)["e"]).otherwise(0), x["s"]))
        rest = cut(F.element_at(found, -1)["e"], (F.octet_length(raw) / 4).cast("int"))
        return F.array_join(F.concat(between, F.array(rest)), mark)

    cleaned = let(F.encode(t, "UTF-32"), lambda raw: let(col(spans), lambda found: body(raw, found)))
    return d.withColumn(text_col, F.when(F.size(col(spans)) > 0, cleaned).otherwise(t)).select(*[col(c) for c in df.columns])
