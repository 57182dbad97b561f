"""Personal data: patterns with places, and boosted trees that judge what looser patterns propose; DataFrame functions only.

Spans of four kinds come from fixed rules (e-mail and network addresses, payment cards, phone numbers). Generators of high recall propose
more, which may overlap: digits in groups of any length, phone numbers without a plus or glued to another number, addresses with a
spelled-out sign. Proposals are reduced to a few bins of format (digits, groups, separators, ends) and context (words before them, what
touches them). Trees learn from all proposals of all texts which of them the rules confirm. The features leave out what the rules themselves
test (check digit, range of a part, the plus, the sign), so a proposal that fails the rule alone is judged by the company it keeps. A part of
the proposals, told by a hash of the text, is held out: per kind, it gives the least score from which on the confirmed share is as high as
asked for. Everything is one pass over the texts; what is learned from is a histogram whose size does not depend on the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.boosting import Boosted, fit_boosted, threshold
from millrace.llm.common import named, staged
from millrace.llm.spans import SPAN, in_order, masked, matches

KINDS = ("email", "ip", "card", "phone")
# Written so that a match starts where a run starts and takes it whole, without going back: the same matches as those of the plain
# patterns, in time that does not grow with the square of a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators: kind, pattern, and what a text must hold to be searched.
GENERATORS = [
    (0, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++"
        r"(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+", r"@|(?:at|AT)[\])]"),
    (1, r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])", r"[0-9]\.[0-9]+\.[0-9]"),
    (2, r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,}+", r"[0-9](?:[\x20.-]?[0-9]){11}"),
    (2, r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9])",
        r"[0-9]{13}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}"),
    (3, r"(?<![0-9+(])(?:\+\x20?)?\(?[0-9](?:[\x20.()-]{0,2}[0-9]){6,}+", r"[0-9](?:[\x20.()-]{0,2}[0-9]){6}"),
    (3, r"(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"\([0-9]{2,4}\)"),
]
#: Features and whether their bins are in order.
FEATURES = {
    "kind": False, "digits": True, "separators": False, "left": False, "right": False, "context": False, "group": True, "variety": True,
    "ending": True,
}
#: Words that tell what a number or address before which they stand is.
CONTEXT = [
    r"mail|contact|courriel|correo|kontakt", r"\bip\b|host|server|address|adresse", r"card|visa|credit|karte|carte|tarjeta|payment",
    r"phone|tel|call|fax|mobil|cell|appel|llam", r"order|invoice|number|version|\bid\b|\bno\b|isbn|serial",
]
_BEFORE = 32


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _rule(kind: int, value: Column) -> Column:
    """Whether a match of the fixed pattern counts."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        # A part is too large if, less its zeros in front, it has four digits or is above 255.
        return ~F.exists(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) > 3) | (F.right(p, F.lit(3)).cast("int") > 255))
    n = F.length(_digits(value))
    if kind == 2:
        return n.between(13, 19) & F.coalesce(F.call_function("luhn_check", F.when(n <= 19, _digits(value))), F.lit(False))
    return n.between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans of the four fixed rules: leftmost matches of each pattern that do not overlap, less those that fail their rule."""
    needed = [text.contains("@"), text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), text.contains("+")]

    def of_kind(kind: int, pattern: str, need: Column) -> Column:
        kept = F.filter(matches(text, pattern, need), lambda m: _rule(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*[of_kind(k, p, need) for k, (p, need) in enumerate(zip((EMAIL, IP, CARD, PHONE), needed, strict=True))]).cast(SPAN)


def _binned(value: Column, *upper: int) -> Column:
    """Number of the first bound that ``value`` does not exceed."""
    out = F.lit(len(upper))
    for i, bound in reversed(list(enumerate(upper))):
        out = F.when(value <= bound, i).otherwise(out)
    return out


def _touching(char: Column) -> Column:
    return F.when(F.trim(char) == "", 0).when(char.rlike(r"\p{L}"), 1).when(char.rlike("[0-9]"), 2).when(char.rlike(r"\s"), 0).otherwise(3)


def _proposal(m: Column, kind: int) -> Column:
    value = m["value"]
    digits, separators = _digits(value), F.translate(value, "+0123456789", "")
    only = lambda c: F.translate(separators, c, "") == ""
    context = F.lit(0)
    for i, words in reversed(list(enumerate(CONTEXT))):
        context = F.when(F.lower(m["before"]).rlike(words), i + 1).otherwise(context)
    ending = F.when(value.rlike(r"[.)\]][\x20]?[A-Za-z]{2,}$"), 2).when(value.contains("."), 1).otherwise(0) if kind == 0 else F.lit(0)
    groups = F.transform(F.split(value, "[^0-9]+"), F.length)
    separator = (
        F.when(F.lit(kind == 0) | (separators == ""), 0).when(only(" "), 1).when(only("-"), 2).when(only("."), 3)
        .when(separators.contains("("), 4).otherwise(5)
    )
    return F.struct(
        m["start"].alias("start"), m["end"].alias("end"), (F.crc32(value.cast("binary")) % 4 == 0).alias("held"),
        F.lit(kind).alias("kind"), F.lit(0).alias("digits") if kind == 0 else _binned(F.length(digits), 6, 8, 12, 15, 16, 19).alias("digits"),
        separator.alias("separators"), _touching(F.right(m["before"], F.lit(1))).alias("left"),
        _touching(F.left(m["after"], F.lit(1))).alias("right"), context.alias("context"),
        F.lit(0).alias("group") if kind == 0 else _binned(F.array_max(groups), 3, 4, 9).alias("group"),
        F.lit(0).alias("variety") if kind == 0 else _binned(F.size(F.array_distinct(F.split(digits, ""))), 3, 5).alias("variety"),
        ending.alias("ending"),
    )


def proposals(text: Column) -> Column:
    """What the generators propose: place, fold and binned features."""

    def of_generator(kind: int, pattern: str, need: str) -> Column:
        return F.transform(matches(text, pattern, text.rlike(need), context=_BEFORE), lambda m: _proposal(m, kind))

    return F.concat(*[of_generator(*g) for g in GENERATORS])


def _edges(spans: str | Column) -> Column:
    """Starts and ends of spans as numbers that tell kinds and ends apart."""
    return F.flatten(F.transform(spans, lambda s: F.array(_edge(s, "start"), _edge(s, "end"))))


def _edge(s: Column, side: str) -> Column:
    return (s["kind"].cast("long") * 2 + int(side == "end")) * (1 << 32) + s[side]


def with_proposals(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the fixed rules' spans in order, in ``_base``, their edges in ``_edges``, and the proposals in ``_proposed``."""
    text = F.col("_scanned")
    scanned = docs.withColumn("_scanned", F.coalesce(named(text_col), F.lit("")))
    scanned = scanned.withColumns({"_base": in_order(base_spans(text)), "_proposed": proposals(text)}).drop("_scanned")
    return scanned.withColumn("_edges", _edges("_base"))


def _confirmed(c: Column) -> Column:
    """Whether a span of the fixed rules of the same kind starts or ends where the proposal does."""
    return F.array_contains("_edges", _edge(c, "start")) | F.array_contains("_edges", _edge(c, "end"))


def fit_proposals(scanned: DataFrame, precision: float, work: str | None = None) -> tuple[Boosted, dict[int, float]]:
    """Trees for the confirmed share of proposals, and per kind the least probability from which on it reaches ``precision``.

    All proposals of all texts count; the driver sees sums by bin and at most a hundred scores per kind.
    """
    each = scanned.select("_edges", F.explode("_proposed").alias("p")).select("p.*", _confirmed(F.col("p")).cast("long").alias("pos"))
    histogram = each.groupBy("held", *FEATURES).agg(F.sum("pos").alias("pos"), F.count("*").alias("n"))
    histogram = staged(histogram.coalesce(4), "personal-histogram", work)
    model = fit_boosted(histogram.filter("not held"), FEATURES)
    score = F.floor(model.probability(F.col) * 100) / 100
    held = histogram.filter("held").groupBy("kind", score.alias("score")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()
    of_kind = {k: [(r["score"], r["pos"], r["n"]) for r in held if r["kind"] == k] for k in range(len(KINDS))}
    return model, {k: threshold(rows, precision) for k, rows in of_kind.items()}


def all_spans(model: Boosted, least: dict[int, float]) -> Column:
    """The fixed rules' spans and the other proposals that reach their kind's threshold."""

    def wanted(c: Column) -> Column:
        bound = F.lit(2.0)
        for kind, t in least.items():
            bound = F.when(c["kind"] == kind, t).otherwise(bound)
        return (model.probability(lambda f: c[f]) >= bound) & ~_confirmed(c)

    added = F.transform(F.filter("_proposed", wanted), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return in_order(F.concat("_base", added))


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9, work: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, numbers of the fixed rules' spans, these spans, and all spans.

    Returns ``id_col, n_email, n_ip, n_card, n_phone, base, found``, spans as structs of number of kind, start and end (code points, end
    exclusive), by kind, start and end. Null and empty texts have none; repeated rows and null ids are searched as any other; other columns are
    not read; an empty table gives no rows. Where too few proposals are confirmed to reach ``precision``, none are added.
    """
    read = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    scanned = staged(with_proposals(read, "_text").drop("_text"), "personal-scan", work)
    model, least = fit_proposals(scanned, precision, work)
    kinds = F.transform("_base", lambda s: s["kind"])
    number = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return scanned.select(F.col("_id").alias(id_col), *number, F.col("_base").alias("base"), all_spans(model, least).alias("found"))


def redact_personal_data(
    docs: DataFrame, text_col: str = "text", mask: str = "[personal]", precision: float = 0.9, work: str | None = None
) -> DataFrame:
    """``docs`` with all spans in ``text_col`` replaced by ``mask``, overlapping ones by one; null texts stay null, repeated rows stay.

    The texts are searched once and written with what was found in them.
    """
    scanned = staged(with_proposals(docs, text_col), "personal-scan", work)
    model, least = fit_proposals(scanned, precision, work)
    found = scanned.withColumn("_found", all_spans(model, least))
    return found.withColumn(text_col, masked(named(text_col), F.col("_found"), mask)).select(*[named(c) for c in docs.columns])
