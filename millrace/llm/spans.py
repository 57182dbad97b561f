"""Places of pattern matches in texts, in built-in functions, with work that grows little faster than the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers added up in one go when an array is summed from its start.
_CHUNK = 128
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running_sums(numbers: Column) -> Column:
    """For each number of an array the sum of all before it. Chunks are added up on their own and then shifted, so that n numbers
    take about n * 64 + (n / 128)**2 / 2 additions instead of n**2 / 2."""
    chunks = F.when(F.size(numbers) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _CHUNK).cast("int")),
        lambda k: F.struct(k.alias("k"), F.slice(numbers, k * _CHUNK + 1, F.lit(_CHUNK)).alias("of")),
    )).otherwise(F.array().cast("array<struct<k:int,of:array<int>>>"))

    def shifted(p: Column) -> Column:
        totals = F.transform(p["chunks"], lambda c: _total(c["of"]))
        with_totals = F.transform(F.array(F.struct(p["chunks"].alias("chunks"), totals.alias("totals"))), lambda q: F.transform(
            q["chunks"], lambda c: F.struct(c["of"].alias("of"), _total(F.slice(q["totals"], F.lit(1), c["k"])).alias("from")),
        ))
        return F.flatten(F.transform(F.get(with_totals, F.lit(0)), lambda c: F.transform(
            c["of"], lambda _, j: c["from"] + _total(F.slice(c["of"], F.lit(1), j)),
        )))

    return F.get(F.transform(F.array(F.struct(chunks.alias("chunks"))), shifted), F.lit(0))


def matches(text: Column, pattern: str, needed: Column, group: int = 0, context: int = 0) -> Column:
    """Leftmost matches that do not overlap: structs of ``start, end`` (code points), ``value`` (the match or its ``group``), and
    ``before`` and ``after``: up to ``context`` code points around it that belong to no other match.

    Texts for which ``needed`` is false are not searched. The text between matches gives their places. ``pattern`` must not match empty text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), value.alias("value"))

    def parts(f: Column) -> Column:
        n = F.size(f["whole"])
        before, after = F.slice(f["gaps"], F.lit(1), n), F.slice(f["gaps"], F.lit(2), n)
        joined = F.arrays_zip(
            before.alias("b"), after.alias("a"), f["whole"].alias("w"), f["value"].alias("v"),
        )
        return F.transform(joined, lambda x: F.struct(
            F.length(x["b"]).alias("gap"), F.length(x["w"]).alias("size"), x["v"].alias("value"),
            F.right(x["b"], F.lit(context)).alias("before"), F.left(x["a"], F.lit(context)).alias("after"),
        ))

    def placed(p: Column) -> Column:
        sums = running_sums(F.transform(p, lambda x: x["gap"] + x["size"]))
        return F.zip_with(p, sums, lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"),
            x["before"].alias("before"), x["after"].alias("after"),
        ))

    # A one-element array makes each step's result a variable of the next, so that nothing is worked out twice.
    step = F.transform(F.transform(F.array(found), parts), placed)
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(needed, F.get(step, F.lit(0))).otherwise(empty)


def in_order(spans: Column, by_start: bool = False) -> Column:
    """By kind, then start and end; or by start, then kind."""
    if by_start:
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
        ))
    keyed = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(F.array_distinct(keyed))


def joined(spans: str | Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each span replaced by ``mask``, overlapping ones by one. ``text`` and ``spans`` should be plain columns."""
    edge = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    # The text between spans, from the end of one to the start of the next.
    def between(runs: Column) -> Column:
        starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text)))
        ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
        return F.array_join(F.zip_with(ends, starts, lambda e, s: F.substring(text, e + 1, s - e)), mask)

    runs = F.aggregate(F.array_sort(edge), none, merge)
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(runs), between), F.lit(0))).otherwise(text)
