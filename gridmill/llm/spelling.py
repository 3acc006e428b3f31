"""Spelling variants: words one edit apart, found by an index of variable-length grams.

A gram of a word is what stands around one stretch of it: so many letters from its start
and so many to its end. The stretches of a word's grams lie side by side, so an edit
affects every gram but the one around the stretch where it is: the bound on affected grams
is all but one, and two words one edit apart are sure to share one list. The dictionary
counts the words of every gram and is pruned by that count: a gram with few words stays,
and one with many is replaced by two longer ones, around the halves of its stretch, so
lists are short however many words there are. A stretch of one letter is not cut further:
its list is bounded by the alphabet. Words that share a list are verified.

A plain gram, unaffected by an edit anywhere else in the word, holds half the word at
most, and the lists of such grams grow with the words; hence the two ends in one gram.

Native functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.session import cut_lineage

# The letters of a word; only A-Z are lower-cased.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
# Words that a gram's list may hold before the gram grows.
LIST = 16


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(id, run): every maximal run of letters of at least `least`, lower-cased; null texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    cut = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))
    return cut.select("id", F.translate("run", UPPER, LOWER).alias("run"))


def word_counts(words: DataFrame, word: str = "word", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of so many letters that stand so often."""
    long_enough = words.where(F.length(word) >= least_letters)
    return long_enough.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _grams(rows: DataFrame) -> DataFrame:
    """With gram: a hash of the letters before and after the stretch [x, y) of m letters.

    A word of m letters and one of m + 1 have the same gram if they have the same first x
    letters and the same last m - y.
    """
    ends = [F.substring(F.col("word"), F.lit(1), F.col("x")), F.substring(F.col("word"), F.length("word") - (F.col("m") - F.col("y")) + 1, F.col("m") - F.col("y"))]
    return rows.withColumn("gram", F.xxhash64("m", "x", "y", *ends))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row as two, one for each half of its stretch."""
    middle = F.col("x") + F.call_function("div", F.col("y") - F.col("x") + 1, F.lit(2)).cast("int")
    halves = F.array(F.struct("x", middle.alias("y")), F.struct(middle.alias("x"), F.col("y")))
    return rows.select("word", "n", "m", F.explode(halves).alias("h")).select("word", "n", "m", "h.*")


def _verified(rows: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, of the words of one list that are one edit apart.

    Of words of unequal length, the stretch that counts is the one that holds the last
    place where the letter can have been left out, so a pair is found in one list only.
    """
    short = F.length("word") == F.col("m")
    left = rows.where(short).select("gram", "word", "n")
    right = rows.select("gram", "m", "y", F.col("word").alias("other"), F.col("n").alias("other_n"))
    word, other, y = F.col("word"), F.col("other"), F.col("y")
    equal_length = F.length("other") == F.col("m")
    here = (y == F.col("m")) | (F.substring(word, F.lit(1), y) != F.substring(other, F.lit(1), y))
    met = left.join(right, "gram").where((word != other) & (equal_length | here) & (F.levenshtein("word", "other", 1) == 1))
    # Equal lengths meet from both sides already.
    ways = F.when(equal_length, F.array(_way("word", "n", "other", "other_n"))).otherwise(
        F.array(_way("word", "n", "other", "other_n"), _way("other", "other_n", "word", "n"))
    )
    return met.select(F.explode(ways).alias("p")).select("p.*")


def _way(word: str, n: str, other: str, other_n: str) -> Column:
    return F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.col(other).alias("other"), F.col(other_n).alias("other_n"))


def near_words(counts: DataFrame, list_size: int = LIST) -> DataFrame:
    """(word, n, other, other_n): all pairs one inserted, deleted or replaced letter apart, both ways.

    counts(word, n), each word once, of any length from one letter on; a letter is a code
    point. Every round halves the stretches of the grams whose lists are long, so there
    are as many rounds as the longest word with a long list can be halved. Words of a list
    no one else is on go no further.
    """
    one = F.length("word")
    roles = F.explode(F.array(one, one - 1)).alias("m")
    rows = counts.select("word", "n", roles).where("m > 0").withColumns({"x": F.lit(0), "y": F.col("m")})
    found = None
    while True:
        grams = cut_lineage(_grams(_halved(rows.where("y - x > 1")).unionByName(rows.where("y - x = 1"))))
        sizes = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("words"), F.count(F.when(F.length("word") == F.col("m"), 1)).alias("short"))
        shared = sizes.where("short > 0 AND words > 1")
        dictionary = grams.join(shared.select("gram", "words"), "gram")
        final = (F.col("words") <= list_size) | (F.col("y") - F.col("x") == 1)
        pairs = cut_lineage(_verified(dictionary.where(final)))
        found = pairs if found is None else found.unionByName(pairs)
        rows = cut_lineage(dictionary.where(~final).select("word", "n", "m", "x", "y"))
        if rows.isEmpty():
            return found


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word along forms(word, form) to the last; counts grow by the
    ratio at each step, so ways are short, and each round doubles the steps taken."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        now = cut_lineage(now.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not now.where("moved").isEmpty()
        now = now.select("word", "root")
        if not moved:
            return now


def variants(counts: DataFrame, ratio: int = RATIO, list_size: int = LIST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of counts(word, n).

    n_near counts the words one edit away. form is the one of them that stands most often
    (ties: the smallest in code-point order), if it stands at least `ratio` (above 1) times
    as often as the word, else null; root is the word that forms lead to in the end, the
    word itself if it has none. Words with a null count or word take no part.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = cut_lineage(counts.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL AND n IS NOT NULL"))
    best = F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form"), F.col("other_n").alias("form_n"))).alias("b")
    near = near_words(words, list_size).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    often = (F.col("b.form_n") >= ratio * F.col("n")) & (F.col("b.form_n") > F.col("n"))
    told = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("b.form")).alias("form"), F.when(often, F.col("b.form_n")).alias("form_n")))
    roots = _roots(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
