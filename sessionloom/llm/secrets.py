"""Secret scans: fixed patterns and a battery of randomness tests, in DataFrame functions alone.

Patterns give spans of the kinds assign, access and hex.  Every other maximal run of
20 or more token characters is a candidate:

1.  Its encoding is inferred: the smallest alphabet of `ALPHABETS` that holds it.
2.  Against the hypothesis "uniform over that alphabet": chi-squared on the counts, a
    runs test about the alphabet's middle, and the lag-1 serial correlation.  A
    candidate that any of them rejects (Bonferroni, RANDOM_ALPHA) is no secret.
3.  Against the hypothesis "structured like text": fewer repeated characters than text
    has, and more changes between upper case, lower case and digits.  Both depend on
    the length; their sum is the candidate's evidence z.
4.  False discoveries are controlled in bands of length over all candidates of the
    corpus: in each band the Benjamini-Hochberg step-up at DISCOVERY_RATE gives the
    least z that counts.

Survivors are added as kind `random` unless a pattern's span overlaps them.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

# Encodings, smallest first, as (pattern, alphabet).
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = (
    ("^[0-9]+$", DIGITS),
    ("^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z2-7]+$", LOWER + "234567"),
    ("^([a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOWER),
    ("^[A-Za-z]+$", LOWER.upper() + LOWER),
    ("^[A-Za-z0-9]+$", DIGITS + LOWER.upper() + LOWER),
    ("", LOWER.upper() + LOWER + DIGITS + "+/"),
)
BANDS = (20, 24, 32, 48, 64)  # least lengths
RANDOM_ALPHA, DISCOVERY_RATE = 0.01, 0.01
# Of text: the chance that two, and that three, characters are equal, and of a change of class.
PAIR, TRIPLE, CHANGE = 0.066, 0.0056, 0.3
BIN = 0.05


def _placed(text: Column, pattern: str, value: Column | None = None) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, by the pieces between them."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if value is None else value
    rows = F.arrays_zip(pieces.alias("piece"), found.alias("found"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["piece"])
        end = start + F.length(row["found"])
        span = F.struct(start.alias("start"), end.alias("end"), row["value"].alias("value"))
        more = F.when(row["found"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(F.coalesce(end, start).alias("at"), more.alias("out"))

    init = F.struct(F.lit(0).alias("at"), none.alias("out"))
    spans = F.aggregate(rows, init, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _kind(spans: Column, order: int, name: str) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(name).alias("kind"))
    )


def base_spans(text: Column) -> Column:
    """array<struct<start, order, end, kind>> of the patterns, by start, then kind."""
    assign = _placed(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    assign = F.filter(assign, lambda s: F.length(s["value"]) >= 8)
    parts = [_kind(assign, 0, "assign"), _kind(_placed(text, ACCESS), 1, "access"), _kind(_placed(text, HEX), 2, "hex")]
    return F.array_sort(F.concat(*parts))


def upper_tail(z: Column) -> Column:
    """The chance that a standard normal exceeds z, from above: Mills' ratio is at most 4 / (3x + sqrt(x^2 + 8))."""
    x = F.abs(z)
    tail = F.exp(-x * x / 2) * (4 / math.sqrt(2 * math.pi)) / (3 * x + F.sqrt(x * x + 8))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _by_alphabet(token: Column, value) -> Column:
    out = F.lit(value(ALPHABETS[-1][1]))
    for pattern, alphabet in reversed(ALPHABETS[:-1]):
        out = F.when(token.rlike(pattern), F.lit(value(alphabet))).otherwise(out)
    return out


def _evidence(token: Column) -> Column:
    """struct<z, p, band>: evidence against text, consistency with randomness, band of length."""
    bare = F.regexp_replace(token, "=+$", "")
    alphabet, size = _by_alphabet(bare, str), _by_alphabet(bare, lambda a: float(len(a)))
    folded = F.when(F.length(alphabet) <= 36, F.lower(bare)).otherwise(F.translate(bare, "-_=", "+/A"))
    return F.element_at(
        F.transform(F.array(F.struct(bare.alias("bare"), folded.alias("t"), alphabet.alias("a"), size.alias("k"))), _tests), 1
    )


def _tests(x: Column) -> Column:
    n = F.length(x["t"]).cast("double")
    v = F.transform(F.split(x["t"], ""), lambda c: F.instr(x["a"], c).cast("double") - 1)
    v = F.filter(v, lambda i: i >= 0)
    count = F.transform(F.split(x["a"], ""), lambda c: n - F.length(F.replace(x["t"], c)))
    squares = _sum(count, lambda c: c * c)
    chi = (squares * x["k"] / n - n - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1) * (n - 1) / n)
    high = F.transform(v, lambda i: F.when(i >= x["k"] / 2, 1.0).otherwise(0.0))
    n1 = _sum(high, lambda i: i)
    n0 = n - n1
    changes = _pairs(high, lambda a, b: F.abs(a - b))
    expected = 2 * n1 * n0 / n
    spread = F.sqrt(F.greatest(expected * (2 * n1 * n0 - n) / (n * (n - 1)), F.lit(1e-9)))
    runs = F.when((n1 < 1) | (n0 < 1), 99.0).otherwise(F.abs(changes - expected) / spread)
    mean = _sum(v, lambda i: i) / n
    power = _sum(v, lambda i: (i - mean) * (i - mean))
    lag = _pairs(v, lambda a, b: (a - mean) * (b - mean))
    serial = F.when(power <= 0, 99.0).otherwise(F.abs(F.try_divide(lag, power) + 1 / n) * F.sqrt(n))
    p = 3 * F.least(upper_tail(chi), 2 * upper_tail(runs), 2 * upper_tail(serial))

    pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2)
    repeats = (squares - n) / 2
    few = (pairs * PAIR - repeats) / F.sqrt(pairs * PAIR * (1 - PAIR) + triples * (TRIPLE - PAIR * PAIR))
    classes = F.transform(
        F.split(x["bare"], ""), lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(3)
    )
    turns = _pairs(classes, lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
    many = (turns - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))
    z = F.when(F.length(x["a"]) <= 10, -9.0).otherwise((few + many) / math.sqrt(2))
    band = reduce(lambda out, least: F.when(n >= least, least).otherwise(out), BANDS, F.lit(0))
    enough = n >= BANDS[0]
    return F.struct(
        F.when(enough, z).otherwise(-9.0).alias("z"), F.when(enough, p).otherwise(0.0).alias("p"), band.alias("band")
    )


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def _pairs(values: Column, f) -> Column:
    """Sum of f over neighbours."""
    n = F.size(values)
    both = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), f)
    return _sum(both, lambda x: x)


def candidates(text: Column) -> Column:
    """array<struct<start, end, z, p, band>> of the runs to which the battery is applied."""
    return F.transform(
        _placed(text, CANDIDATE),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _evidence(s["value"]).alias("e")),
    )


def discovery_thresholds(docs: DataFrame, *, text_col: str = "text", rate: float = DISCOVERY_RATE) -> dict[int, float]:
    """For each band of length the least z that counts, by Benjamini-Hochberg over all candidates.

    Counts are kept in bins of z, so what is gathered is at most bands x bins rows.
    """
    each = docs.select(F.explode(candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("c")).select("c.e.*")
    clipped = F.greatest(F.least(F.floor(F.col("z") / BIN), F.lit(400)), F.lit(-200))
    bins = each.where(F.col("band") > 0).groupBy("band", clipped.alias("bin")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("bin"))
    above, total = F.sum("n").over(down), F.sum("n").over(Window.partitionBy("band"))
    stepped = bins.select("band", "bin", above.alias("above"), total.alias("total"))
    passed = stepped.where(upper_tail(F.col("bin") * BIN) * F.col("total") <= rate * F.col("above"))
    least = passed.groupBy("band").agg(F.min("bin").alias("bin")).collect()
    return {r.band: r.bin * BIN for r in least}


def all_spans(text: Column, thresholds: dict[int, float]) -> Column:
    """struct<base, spans>: the patterns' spans, and those with the battery's added."""
    text = F.coalesce(text, F.lit(""))
    least = F.lit(1e9)

    def lowest(band: Column) -> Column:
        return reduce(lambda out, b: F.when(band == b[0], b[1]).otherwise(out), thresholds.items(), least)

    base = base_spans(text)
    found = F.filter(candidates(text), lambda c: (c["e"]["z"] >= lowest(c["e"]["band"])) & (c["e"]["p"] >= RANDOM_ALPHA))
    return F.element_at(
        F.transform(
            F.array(F.struct(base.alias("base"), _kind(found, 3, "random").alias("found"))),
            lambda x: F.struct(
                x["base"].alias("base"),
                F.array_sort(
                    F.concat(
                        x["base"],
                        F.filter(
                            x["found"],
                            lambda f: ~F.exists(x["base"], lambda b: (b["start"] < f["end"]) & (f["start"] < b["end"])),
                        ),
                    )
                ).alias("spans"),
            ),
        ),
        1,
    )


def find_secrets(docs: DataFrame, *, text_col: str = "text", thresholds: dict[int, float] | None = None) -> DataFrame:
    """Every row with `secrets`, a struct of base and spans, each array<struct<start, order, end, kind>>.

    Two scans: one for the thresholds of the whole corpus, one for the spans; nothing
    is shuffled but counts of bins.  Null and empty texts have no spans; repeated rows
    are scanned each (and count each in the thresholds); a column named secrets is
    replaced; an empty table gives none.
    """
    if thresholds is None:
        thresholds = discovery_thresholds(docs, text_col=text_col)
    return docs.withColumn("secrets", all_spans(F.col(text_col), thresholds))


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows, each secret in the text replaced by a mark; overlapping spans by one.

    Null texts stay null; n_chars, where there is one, follows the text; all other columns
    stay, whatever their names.
    """
    columns, own = docs.columns, "secrets"
    while own in columns:
        own += "_"
    found = docs.withColumn(own, all_spans(F.col(text_col), discovery_thresholds(docs, text_col=text_col)))
    text, spans = F.col(text_col), F.col(f"{own}.spans")

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    cleaned = F.when(F.size(spans) > 0, F.aggregate(spans, init, step, rest)).otherwise(text)
    out = found.withColumn(text_col, cleaned)
    if "n_chars" in columns:
        size = F.length(text_col).cast("long")
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, size).otherwise(F.col("n_chars")))
    return out.select(*columns)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
