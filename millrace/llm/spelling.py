"""Spelling variants: rotations of words (permuterm), sorted, so that words one edit apart stand next to each other.

A word gets a terminator and is turned round: ``x c y`` and ``$`` give the rotation ``y $ x c`` for every code point ``c``. Without its
last code point, the edited one, the rotation is ``y $ x``, a prefix that says where the edit is and all that surrounds it. The words
with another code point there share the prefix, and the word without any has it as a whole rotation. Sorted by that prefix, a group
holds at most one word per letter of the alphabet and one more, however many words there are, so that no group is hot. Where a code
point stands several times in a row, leaving out any of them gives the same word; only the first counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import named, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of words: ASCII and the upper half of Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
TERMINATOR = "$"


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, typo_every: int = 0
) -> DataFrame:
    """Words of all texts with their numbers: ``word, n``.

    Words are maximal runs of ``LETTERS``, A-Z made small, of at least ``least_length`` code points, counted where they
    occur ``least_count`` times in all. With ``typo_every`` a run whose crc32 of ``id:run`` it divides loses one code point, which makes
    a corpus with known misspellings. Null texts have no words, a null id is empty text; repeated rows count again. Counts are added up
    before the shuffle, so a frequent word is no hot key.
    """
    # A run cannot grow, so shorter ones are no use; a greedy pattern takes a run from its first letter to its last.
    runs = F.regexp_extract_all(named(text_col), F.lit(f"[{LETTERS}]{{{max(least_length, 1)},}}"), F.lit(0))
    each = docs.select(named(id_col).cast("string").alias("_id"), F.explode(runs).alias("_run"))
    word = F.translate("_run", UPPER, LOWER)
    if typo_every:
        each = each.select("_id", word.alias("_run"))
        each = each.withColumn("_h", F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "_run").cast("binary")))
        size = F.length("_run")
        at = (F.col("_h") % size).cast("int")
        cut = F.concat(F.substring("_run", 1, at), F.substring("_run", at + 2, size))
        word = F.when(F.col("_h") % typo_every == 0, cut).otherwise(F.col("_run"))
    counted = each.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def rotations(words: DataFrame) -> DataFrame:
    """``prefix, word, n, whole, first`` for every rotation of every word, without the code point it ends in (``whole`` false) and, as it
    may be the prefix of a longer word's, in full (``whole`` true). ``first`` tells the first of a row of equal code points."""
    size = F.length("word")

    def prefix(left: Column, right: Column) -> Column:
        return F.concat(right, F.lit(TERMINATOR), left)

    def skipping(i: Column) -> Column:
        here = F.substring("word", i + 1, F.lit(1))
        return F.struct(
            prefix(F.substring("word", F.lit(1), i), F.substring("word", i + 2, size)).alias("prefix"), F.lit(False).alias("whole"),
            ((i == 0) | (F.substring("word", i, F.lit(1)) != here)).alias("first"),
        )

    def whole(i: Column) -> Column:
        left, right = F.substring("word", F.lit(1), i), F.substring("word", i + 1, size)
        return F.struct(prefix(left, right).alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("first"))

    places = F.concat(F.transform(F.sequence(F.lit(0), size - 1), skipping), F.transform(F.sequence(F.lit(0), size), whole))
    return words.select("word", "n", F.inline(places)).select("prefix", "word", "n", "whole", "first")


def neighbours(words: DataFrame) -> DataFrame:
    """Per word with a near one: ``word, n_near, form, form_n``: how many words are one edit away and the most frequent of them.

    ``words`` has each word once. Ties go to the smallest in code-point order. The sorted rotations are scanned group by group; a word gets the
    number and the best of its group, so no pair of words is ever written.
    """
    group = Window.partitionBy("prefix")
    shared = rotations(words).withColumn("_members", F.count("*").over(group)).filter("_members > 1").drop("_members")
    ranked = group.orderBy(F.col("n").desc(), F.col("word"))
    everyone = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    this = F.struct("n", "word")
    other, indel = F.when(~F.col("whole"), this), F.when(~F.col("whole") & F.col("first"), this)
    shared = shared.select(
        "word", "whole", "first",
        F.count(other).over(group).alias("_others"), F.count(indel).over(group).alias("_indels"),
        F.max(F.when(F.col("whole"), this)).over(group).alias("_whole"),
        F.first(other, ignorenulls=True).over(everyone).alias("_best"), F.nth_value(other, 2, ignoreNulls=True).over(everyone).alias("_second"),
        F.first(indel, ignorenulls=True).over(everyone).alias("_best_indel"),
    )
    replaced = F.when(F.col("_best.word") == F.col("word"), F.col("_second")).otherwise(F.col("_best"))
    without = F.when(F.col("first"), F.col("_whole"))
    found = shared.select(
        "word",
        F.when(F.col("whole"), F.col("_indels")).otherwise(F.col("_others") - 1 + without.isNotNull().cast("long")).alias("near"),
        F.when(F.col("whole"), F.array("_best_indel")).otherwise(F.array(replaced, without)).alias("best"),
    ).filter("near > 0")
    best = F.min(F.array_min(F.transform(F.filter("best", lambda b: b.isNotNull()), lambda b: F.struct((-b["n"]).alias("less"), b["word"].alias("word")))))
    per_word = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_best"))
    return per_word.select("word", "n_near", F.col("_best.word").alias("form"), (-F.col("_best.less")).alias("form_n"))


def spelling_variants(words: DataFrame, ratio: int = 10, work: str | None = None) -> DataFrame:
    """Each word of ``words`` (``word, n``, each once) with its near words and the spelling it stands for.

    Returns ``word, n, form, root, n_near, form_n``. Near words differ by one inserted, deleted or replaced code point. The
    ``form`` is the near word of largest ``n``, the smallest in code-point order among equals, if its ``n`` is at least ``ratio`` times the word's,
    else null. ``root`` follows forms to the last, and is the word itself without one. As every step multiplies ``n``, chains have
    at most log(largest n) steps, and half as many are left after each join. No words give no rows; null words and words with the
    terminator in them have no place in the order and are left as they are, without near words. Columns of other names are not read.
    """
    words = staged(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words", work)
    turned = words.filter(~F.col("word").contains(TERMINATOR) & (F.length("word") > 0))
    near = neighbours(turned)
    joined = words.join(near, "word", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    found = staged(joined.select(
        "word", "n", F.when(is_form, F.col("form")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n"),
    ), "spelling-forms", work)
    links = found.filter("form is not null").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    largest = found.agg(F.max("form_n")).first()[0] or 1
    steps = math.ceil(math.log(largest, ratio)) + 1 if ratio > 1 else 64
    for _ in range(math.ceil(math.log2(steps)) if largest > 1 else 0):
        further = links.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        links = staged(
            links.join(further, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to")), "spelling-roots", work
        )
    roots = links.withColumnsRenamed({"_from": "word", "_to": "root"})
    return found.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
