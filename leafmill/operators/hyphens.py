"""Places where words may be broken, by patterns of letters and digits: the greatest digit at a place decides, odd for yes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(patterns: DataFrame) -> DataFrame:
    """letters, digits (before each letter and behind the last) of each ``pattern``; a dot stands for a word's end."""
    digits = F.transform(F.regexp_extract_all("pattern", F.lit("([0-9]?)([^0-9]|$)"), 1), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return patterns.select(F.regexp_replace("pattern", "[0-9]", "").alias("letters"), digits.alias("digits"))


def breaks(words: DataFrame, patterns: DataFrame, left: int = 2, right: int = 3) -> DataFrame:
    """word, at (how many letters stand before each break, in order) of the different ``word``s.

    The pieces of a word, up to the longest pattern, are joined with the patterns' letters; each match is a row a digit, of
    which the greatest a place counts. ``left`` and ``right`` letters at least stay together at the ends.
    """
    known = parsed(patterns)
    # One number: pieces longer than any pattern are never made.
    most = known.agg(F.max(F.length("letters"))).first()[0] or 0
    words = words.select("word").distinct()
    dotted = F.concat(F.lit("."), F.lower("word"), F.lit("."))
    size = F.least(F.lit(most), F.length(dotted) - F.col("i") + 1)
    spots = words.select("word", F.explode(F.sequence(F.lit(1), F.length(dotted))).alias("i"))
    pieces = spots.where(size > 0).select("word", "i", F.explode(F.transform(F.sequence(F.lit(1), size), lambda n: F.substring(dotted, F.col("i"), n))).alias("letters"))
    digits = pieces.join(known, "letters").select("word", "i", F.posexplode("digits").alias("k", "digit")).where("digit > 0")
    greatest = digits.groupBy("word", (F.col("i") + F.col("k") - 2).alias("at")).agg(F.max("digit").alias("digit")).where("digit % 2 = 1")
    may = greatest.where((F.col("at") >= left) & (F.length("word") - F.col("at") >= right))
    found = may.groupBy("word").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return words.join(found, "word", "left").select("word", F.coalesce("at", F.array().cast("array<int>")).alias("at"))


def collected(patterns: DataFrame) -> dict[str, list[int]]:
    """Digits by letters of a language's list of patterns, which no collection makes longer: it goes to every task."""
    out: dict[str, list[int]] = {}
    for r in parsed(patterns).where("letters <> ''").collect():
        out[r.letters] = [max(x) for x in zip(r.digits, out.get(r.letters, r.digits))]
    return out


def tree(known: dict[str, list[int]]) -> dict:
    """``collected`` patterns by their letters one by one: (places and digits that aren't 0, what may follow)."""
    root: dict = {}
    for letters, digits in known.items():
        node = [(), root]
        for c in letters:
            node = node[1].setdefault(c, [(), {}])
        node[0] = tuple((k, d) for k, d in enumerate(digits) if d)
    return root


def places(word: str, root: dict, left: int = 2, right: int = 3) -> list[int]:
    """``breaks`` of one word by a ``tree``, for tasks that have words as they come."""
    dotted = f".{word.lower()}."
    n = len(dotted)
    greatest = [0] * (n + 1)
    for i in range(n):
        node, j = root.get(dotted[i]), i
        while node:
            for k, digit in node[0]:
                if greatest[i + k] < digit:
                    greatest[i + k] = digit
            j += 1
            node = node[1].get(dotted[j]) if j < n else None
    return [k - 1 for k, digit in enumerate(greatest) if digit % 2 and k > left and len(word) - k + 1 >= right]


def parts(broken: DataFrame) -> DataFrame:
    """word and its parts between the breaks."""
    ends = F.concat(F.col("at"), F.array(F.length("word")))
    cut = lambda e, k: F.substring("word", F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1, e - F.coalesce(F.get(ends, k - 1), F.lit(0)))
    return broken.select("word", F.transform(ends, cut).alias("parts"))
