"""Column functions of featurization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say little.
STOPWORDS = ("a", "an", "and", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")


def sha1_bucket(value: Column, buckets: int) -> Column:
    """int(sha1(value)) mod buckets, folded over five groups of eight hex digits."""
    digest, out = F.sha1(value.cast("binary")), F.lit(0).cast("long")
    for i in range(5):
        out = F.pmod(out * (2**32 % buckets) + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(buckets))
    return out


def sha1_bucket_sql(col: str, buckets: int) -> str:
    """sha1_bucket as SQL of engines whose hexadecimal texts cast to integers."""
    out = "CAST(0 AS BIGINT)"
    for i in range(5):
        out = f"((({out}) * {2**32 % buckets} + CAST('0x' || substr(sha1(CAST({col} AS VARCHAR)), {8 * i + 1}, 8) AS BIGINT)) % {buckets})"
    return out


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]", "")


def clean_word(c: Column, drop_digits: bool = True, least: int = 1) -> Column:
    """Lower case, letters (and digits) alone, without stopwords and words under `least` characters."""
    kept = F.regexp_replace(F.lower(c), r"[^\p{L} ]" if drop_digits else r"[^\p{L}0-9 ]", "")
    words = F.filter(F.split(kept, " +"), lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS))
    return F.array_join(words, " ")


def char_ngrams(c: Column, n: int) -> Column:
    """All runs of n characters, in order; none if the text is shorter."""
    last = F.length(c) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def like_features(c: Column, buckets: int) -> dict[str, Column]:
    """Of a LIKE pattern: the distinct hash buckets of its runs of one, two and three characters, its length, a digit flag."""
    grams = {f"g{n}": F.sort_array(F.array_distinct(F.transform(char_ngrams(c, n), lambda g: sha1_bucket(g, buckets)))) for n in (1, 2, 3)}
    return grams | {"length": F.length(c).cast("long"), "digit": c.rlike("[0-9]").cast("long")}


def log_bucket(c: Column, base: float, buckets: int) -> Column:
    """The i with base^i < c < base^(i+1), from 0; exact powers and all else: the number of buckets."""
    out = F.lit(buckets)
    for i in reversed(range(buckets)):
        out = F.when((c > base**i) & (c < base ** (i + 1)), i).otherwise(out)
    return out.cast("long")


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1] and clamped; 0 where all values are equal."""
    return F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - low) / (high - low)))).otherwise(0.0)


MODES = ("log", "minmax", "whitening", "logwhitening", "selectivity", "selectivity-log", "log-selectivity")


def normalize(y: Column, mode: str, low: Column | None = None, high: Column | None = None, total: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
    """The label transforms. low and high: extremes of y (of the share of total, for selectivity); mean and std: of y, or of its log."""
    y = F.when(y < 1, 1.0).otherwise(y.cast("double"))
    return {
        "log": lambda: (F.log(y) - F.log(low)) / (F.log(high) - F.log(low)),
        "minmax": lambda: (y - low) / (high - low),
        "whitening": lambda: (y - mean) / std,
        "logwhitening": lambda: (F.log(y) - mean) / std,
        "selectivity": lambda: (y / total - low) / (high - low),
        "selectivity-log": lambda: F.log(y / total),
        "log-selectivity": lambda: F.log(y) / F.log(total),
    }[mode]()


def unnormalize(z: Column, mode: str, low: Column | None = None, high: Column | None = None, total: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
    """What normalize came from."""
    return {
        "log": lambda: F.exp(z * (F.log(high) - F.log(low)) + F.log(low)),
        "minmax": lambda: z * (high - low) + low,
        "whitening": lambda: F.greatest(F.lit(1.0), z * std + mean),
        "logwhitening": lambda: F.exp(z * std + mean),
        "selectivity": lambda: (z * (high - low) + low) * total,
        "selectivity-log": lambda: F.exp(z) * total,
        "log-selectivity": lambda: F.exp(z * F.log(total)),
    }[mode]()
