"""Secret scans: patterns with places, and a battery of randomness tests, in DataFrame operations only.

Three kinds of span come from patterns: assignments to password-like names, access keys and long hexadecimal runs. Others are
runs of 20 and more characters of an encoding's alphabet that look random. The alphabet is inferred from the characters;
three tests ask whether it is used at random: chi-squared for equal use of its characters, the runs test about its middle, and serial
correlation of neighbours. Fisher's method joins them to one p-value, which is uniform for random strings and near 0 for
others. How small a value may be is decided per class of length over the different strings of all texts: the share of those
above a bound that can not be random ones (whose number follows from the values above one half) must stay within
``false_share``, but for the error of the estimate. Where they are few, a string is taken for random from ``false_share`` on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, staged
from millrace.llm.spans import in_order, masked, matches

#: The patterns and the least length of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Alphabets by the pattern a whole string must match, the first that does.
ALPHABETS = [
    (r"^[0-9]+$", "0123456789"),
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    (r"^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
#: Bounds of the p-value to choose from.
BOUNDS = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5]


def upper_tail(z: Column) -> Column:
    """Share of a normal distribution above ``z``, with an error below 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def randomness(value: Column) -> Column:
    """Fisher's joint p-value of the three tests for one string."""
    alphabet = None
    for pattern, symbols in ALPHABETS[:-1]:
        rule = value.rlike(pattern)
        alphabet = F.when(rule, symbols) if alphabet is None else alphabet.when(rule, symbols)
    parts = F.struct(alphabet.otherwise(ALPHABETS[-1][1]).alias("a"), F.array_remove(F.split(value, ""), "").alias("c"))

    def numbered(p: Column) -> Column:
        return F.struct(F.length(p["a"]).cast("double").alias("k"), F.transform(p["c"], lambda c: F.instr(p["a"], c).cast("double")).alias("x"))

    # Each step is a field of one-element arrays, so that what the next one uses many times is worked out once.
    def counted(p: Column) -> Column:
        x = p["x"]
        n = F.size(x).cast("double")
        squares = F.aggregate(
            F.sequence(F.lit(1.0).cast("int"), p["k"].cast("int")), F.lit(0.0),
            lambda a, s: a + F.pow(F.size(F.filter(x, lambda v: v == s)), F.lit(2.0)),
        )
        high = F.transform(x, lambda v: v > p["k"] / 2)
        centre = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
        return F.struct(p["k"].alias("k"), x.alias("x"), n.alias("n"), squares.alias("squares"), high.alias("high"), centre.alias("centre"))

    def summed(p: Column) -> Column:
        x, high = p["x"], p["high"]
        changes = F.zip_with(F.slice(high, 2, F.size(high) - 1), F.slice(high, 1, F.size(high) - 1), lambda a, b: (a != b).cast("int"))
        lagged = F.zip_with(
            F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda a, b: (a - p["centre"]) * (b - p["centre"])
        )
        return F.struct(
            p["n"].alias("n"), (p["squares"] * p["k"] / p["n"] - p["n"]).alias("chi"), (p["k"] - 1).alias("df"),
            F.size(F.filter(high, lambda v: v)).cast("double").alias("n1"), F.aggregate(changes, F.lit(1), lambda a, v: a + v).alias("runs"),
            F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - p["centre"]) * (v - p["centre"])).alias("power"),
            F.aggregate(lagged, F.lit(0.0), lambda a, v: a + v).alias("lagged"),
        )

    def tested(p: Column) -> Column:
        """The three statistics as normal deviates, two-sided ones twice as likely; null where a test has nothing to go by."""
        n, n1, n2, spread = p["n"], p["n1"], p["n"] - p["n1"], 2 / (9 * p["df"])
        mean = 2 * n1 * n2 / n + 1
        chi = (F.pow(p["chi"] / p["df"], F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        runs = F.when((n1 > 0) & (n2 > 0), F.abs(p["runs"] - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1)))
        serial = F.when(p["power"] > 0, F.abs(p["lagged"] / p["power"] + 1 / n) * F.sqrt(n))
        return F.array(*[F.struct(z.alias("z"), F.lit(sides).alias("sides")) for z, sides in ((chi, 1), (runs, 2), (serial, 2))])

    def joint(deviates: Column) -> Column:
        tails = F.transform(deviates, lambda d: F.coalesce(d["sides"] * upper_tail(d["z"]), F.lit(0.0)))
        half = F.aggregate(tails, F.lit(0.0), lambda a, p: a - F.log(F.greatest(p, F.lit(1e-12))))
        return F.get(F.transform(F.array(half), lambda h: F.exp(-h) * (1 + h + h * h / 2)), F.lit(0))

    out = F.array(parts)
    for step in (numbered, counted, summed, tested, joint):
        out = F.transform(out, step)
    return F.get(out, F.lit(0))


def length_class(span: Column) -> Column:
    """Half powers of two."""
    return F.floor(2 * F.log2((span["end"] - span["start"]).cast("double"))).cast("int")


def with_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the base spans of every text in order, in ``_base``, their numbers in ``_assign, _access, _hex``, and the other strings
    that could be secrets, with their places, in ``_long``."""
    text = F.col("_scanned")
    found = {
        "_assign": (ASSIGN, text.rlike(ASSIGN), 6, 2), "_access": (ACCESS, text.contains("AKIA"), 20, 0),
        "_hex": (HEX, text.rlike("[0-9a-f]{24}"), 24, 0),
    }

    def of_kind(kind: int, pattern: str, needed: Column, least: int, group: int) -> Column:
        kept = F.filter(matches(text, pattern, needed, group), lambda m: F.length(m["value"]) >= least)
        return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    long = F.transform(matches(text, CANDIDATE, text.rlike(CANDIDATE)), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
    ))
    spans = docs.withColumn("_scanned", F.coalesce(named(text_col), F.lit("")))
    spans = spans.withColumns({c: of_kind(k, *how) for k, (c, how) in enumerate(found.items())} | {"_long": long}).drop("_scanned")
    spans = spans.withColumn("_base", in_order(F.concat(*found), by_start=True))
    return spans.withColumns({c: F.size(c).cast("long") for c in found})


def with_tests(scanned: DataFrame) -> DataFrame:
    """``scanned``, as written by ``with_spans``, with length class and p-value of the strings that overlap no base span in ``_tested``."""
    free = F.filter("_long", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tested = F.transform(free, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), length_class(s).alias("length_class"), randomness(s["value"]).alias("p"),
        F.xxhash64(s["value"]).alias("hash"),
    ))
    return scanned.withColumn("_tested", tested).drop("_long")


def length_bounds(scanned: DataFrame, false_share: float) -> dict[int, float]:
    """For each class of length the least bound above which at most ``false_share`` of the different strings are not random.

    Of random strings ``1 - t`` lie above ``t``, and nearly only they lie above one half, which gives their number; two
    standard errors of it are allowed for. Bounds below ``false_share`` need so many strings that these are less than
    ``false_share``; with fewer a random string is lost with that chance. Copies count once. One row per class comes to the driver.
    """
    values = scanned.select(F.explode("_tested").alias("s")).select("s.length_class", "s.hash", "s.p").distinct()
    counts = values.groupBy("length_class").agg(*[F.sum((F.col("p") >= t).cast("long")).alias(f"b{i}") for i, t in enumerate(BOUNDS)])
    few = (2 / false_share) ** 2 if false_share else math.inf
    out = {}
    for row in counts.collect():
        above = [row[f"b{i}"] for i in range(len(BOUNDS))]
        random = above[-1] / (1 - BOUNDS[-1])
        for t, n in zip(BOUNDS, above, strict=True):
            error = 2 * math.sqrt(n * (1 - 2 * t))
            if (t >= false_share or n >= few) and n and n - min(random * (1 - t), n) <= false_share * n + error:
                out[row["length_class"]] = t
                break
    return out


def all_spans(bounds: dict[int, float]) -> Column:
    """Base spans and the tested strings that pass their class's bound."""

    def random(s: Column) -> Column:
        rule = F.lit(False)
        for c, t in sorted(bounds.items()):
            rule = rule | ((s["length_class"] == c) & (s["p"] >= t))
        return rule

    extra = F.transform(F.filter("_tested", random), lambda s: F.struct(F.lit(3).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return in_order(F.concat("_base", extra), by_start=True)


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = 0.05, work: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, counts of the base kinds, base spans and all spans.

    Returns ``id_col, n_assign, n_access, n_hex, base, found``, spans as structs of number of kind, start and end (code points,
    end exclusive), by start and kind. Strings that look random and overlap no base span are of the last kind. Null and
    empty texts have no spans; repeated rows and null ids are scanned as any other; other columns are not read.
    """
    read = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    scanned = staged(with_spans(read, "_text").drop("_text"), "secret-scan", work)
    scanned = staged(with_tests(scanned), "secret-tests", work)
    return scanned.select(
        F.col("_id").alias(id_col), F.col("_assign").alias("n_assign"), F.col("_access").alias("n_access"), F.col("_hex").alias("n_hex"),
        F.col("_base").alias("base"), all_spans(length_bounds(scanned, false_share)).alias("found"),
    )


def redact_secrets(
    docs: DataFrame, text_col: str = "text", mask: str = "[secret]", false_share: float = 0.05, work: str | None = None
) -> DataFrame:
    """``docs`` with all spans in ``text_col`` replaced by ``mask``, overlapping ones by one; null texts stay null, repeated rows stay.

    The texts are searched once and written with what was found in them; there is no shuffle but that of counts.
    """
    scanned = staged(with_spans(docs, text_col).drop("_assign", "_access", "_hex"), "secret-scan", work)
    tested = staged(with_tests(scanned.select("_base", "_long")).select("_tested"), "secret-tests", work)
    found = with_tests(scanned).withColumn("_found", all_spans(length_bounds(tested, false_share)))
    return found.withColumn(text_col, masked(named(text_col), F.col("_found"), mask)).select(*[named(c) for c in docs.columns])
