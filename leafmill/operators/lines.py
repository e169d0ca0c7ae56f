"""Paragraphs broken into lines as a whole, so that the sum of the lines' badness is least."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hyphens

STRETCH, SHRINK, HYPHEN = 0.5, 1 / 3, 50
LINES = "doc_id long, bi long, line int, text string, ratio double, overfull boolean"


def break_words(words: list[list[str]], measure: float, size: float = 10.0, em: float = 0.5, most_ratio: float = 4.0, hyphen: float = HYPHEN) -> list[tuple[int, int, float]]:
    """(first piece, piece after the last, ratio) of each line, over the pieces of all words; signs are all as wide.

    A line ends behind a word or, for a penalty and a hyphen's width, behind one of its pieces but the last. Blanks stretch
    by half their width and shrink by a third. When no way keeps to ``most_ratio``, any stretch will do; a piece wider than
    the measure has a line alone.
    """
    pieces = [(len(p) * size * em, k == len(w) - 1) for w in words for k, p in enumerate(w)]
    blank, n = size * em, len(pieces)
    for most in (most_ratio, float("inf")):
        best: list[tuple[float, int, float] | None] = [(0.0, 0, 0.0)] + [None] * n
        for j in range(1, n + 1):
            total, gaps = 0.0 if pieces[j - 1][1] else blank, 0  # a hyphen is as wide as a blank
            for i in range(j - 1, -1, -1):
                total += pieces[i][0]
                gaps += i < j - 1 and pieces[i][1]
                natural = total + gaps * blank
                if natural - gaps * blank * SHRINK > measure and i < j - 1:
                    break
                if best[i] is None:
                    continue
                slack = measure - natural
                if slack >= 0:
                    ratio = 0.0 if j == n else slack / (gaps * blank * STRETCH) if gaps else (0.0 if slack == 0 else float("inf"))
                else:
                    ratio = slack / (gaps * blank * SHRINK) if gaps else -1.0
                if j < n and ratio > most:
                    continue
                cost = best[i][0] + (1 + 100 * min(abs(ratio), 1e3) ** 3 + (0 if pieces[j - 1][1] else hyphen)) ** 2
                if best[j] is None or cost < best[j][0]:
                    best[j] = (cost, i, ratio)
        if best[n] is not None:
            break
    out, j = [], n
    while j > 0 and best[j] is not None:
        out.append((best[j][1], j, best[j][2]))
        j = best[j][1]
    return out[::-1]


def break_paragraph(words: list[str], measure: float, size: float = 10.0, em: float = 0.5, most_ratio: float = 4.0) -> list[tuple[int, int, float]]:
    """(first word, word after the last, ratio) of each line of words that stay whole."""
    return break_words([[w] for w in words], measure, size, em, most_ratio)


def _set(words: list[list[str]], measure: float, size: float) -> Iterator[tuple[int, str, float, bool]]:
    """line, text, ratio, overfull of each line."""
    pieces = [(p, k == len(w) - 1) for w in words for k, p in enumerate(w)]
    for n, (i, j, ratio) in enumerate(break_words(words, measure, size)):
        text = "".join(p + (" " if last and k < j - 1 else "") for k, (p, last) in enumerate(pieces[i:j], i)) + ("" if pieces[j - 1][1] else "-")
        yield n, text, min(ratio, 1e6), sum(len(p) for p, _ in pieces[i:j]) * size * 0.5 > measure


def break_blocks(blocks: DataFrame, measure: float = 324.0, size: float = 11.0) -> DataFrame:
    """doc_id, bi, line, text, ratio, overfull of the lines of each block's text; each block is set alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.doc_id, r.bi, *line) for r in frame.itertuples() for line in _set([[w] for w in (r.text or "").split()], measure, size)]
            yield pd.DataFrame(rows, columns=["doc_id", "bi", "line", "text", "ratio", "overfull"])

    return blocks.select("doc_id", "bi", "text").mapInPandas(run, LINES)


#: Pieces of the paragraphs that are set at once.
CELLS = 1 << 15
#: What a regular expression's \\s stands for in Spark.
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


class _Lines:
    """``break_words`` of many paragraphs at once: all lines' costs by table, then a step for the k-th pieces of all."""

    def __init__(self, measure: float, size: float, em: float = 0.5, most_ratio: float = 4.0, hyphen: float = HYPHEN) -> None:
        self.measure, self.size, blank = measure, size, size * em
        self.wide = int(measure / blank) + 1  # as many signs, or more, fill more than a line
        #: By kind of end (word, inside one, paragraph), blanks and signs: ratio, and cost with and without ``most_ratio``.
        self.ratio = np.full((3, self.wide + 1, self.wide + 1), -1.0)
        self.costs = np.full((2, 3, self.wide + 1, self.wide + 1), np.inf)
        for kind in range(3):
            for gaps in range(self.wide + 1):
                for signs in range(self.wide + 1):
                    natural = signs * size * em + gaps * blank
                    if signs == self.wide and gaps or natural - gaps * blank * SHRINK > measure and gaps:
                        continue
                    slack = measure - natural
                    if slack >= 0:
                        ratio = 0.0 if kind == 2 else slack / (gaps * blank * STRETCH) if gaps else (0.0 if slack == 0 else float("inf"))
                    else:
                        ratio = slack / (gaps * blank * SHRINK) if gaps else -1.0
                    self.ratio[kind, gaps, signs] = ratio
                    cost = (1 + 100 * min(abs(ratio), 1e3) ** 3 + (hyphen if kind == 1 else 0)) ** 2
                    self.costs[:, kind, gaps, signs] = [cost if kind == 2 or ratio <= most_ratio else np.inf, cost]

    def _best(self, costs: np.ndarray, sums: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least costs up to each piece, and of how many pieces the line that ends there is."""
        many, n = kinds.shape
        by = []
        for d in range(1, n + 1):
            signs = np.minimum(sums[:, d:] - sums[:, : n - d + 1] + (kinds[:, d - 1 :] == 1), self.wide)
            if d > 1 and signs.min() == self.wide:
                break
            gaps = np.minimum(ends[:, d - 1 : n] - ends[:, : n - d + 1], self.wide)
            cost = np.full((n, many), np.inf)
            found = costs[kinds[:, d - 1 :], gaps, signs]
            if d > 1:  # a piece that is too wide has a line alone, pieces don't
                found[signs == self.wide] = np.inf
            cost[d - 1 :] = found.T
            by.append(cost)
        wide, each = len(by), np.stack(by, 2)
        best, back, lanes = np.full((many, wide + n + 1), np.inf), np.zeros((n + 1, many), np.int64), np.arange(many)
        best[:, wide] = 0.0
        for j in range(1, n + 1):
            total = best[:, j : j + wide][:, ::-1] + each[j - 1]  # of equal ones the shorter line
            back[j] = k = total.argmin(1)
            best[:, wide + j] = total[lanes, k]
        return best[:, wide:], back.T + 1

    def set(self, paragraphs: list[tuple[str, list[int], list[bool]]]) -> tuple[list[int], list[str], np.ndarray, np.ndarray]:
        """Of paragraphs (text, widths of pieces, whether each ends its word) how many lines each has; texts and ratios of all lines, and whether they are overfull."""
        n, many = max(len(x) for _, x, _ in paragraphs), len(paragraphs)
        widths, last, size = np.full((many, n), self.wide, np.int64), np.ones((many, n), bool), np.array([len(x) for _, x, _ in paragraphs])
        for k, (_, x, e) in enumerate(paragraphs):
            widths[k, : len(x)], last[k, : len(x)] = x, e
        first = np.zeros((many, 1), np.int64)
        sums, ends = np.hstack([first, widths.cumsum(1)]), np.hstack([first, last.cumsum(1)])
        kinds = np.where(last, 0, 1)
        kinds[np.arange(many), size - 1] = 2
        best, back = self._best(self.costs[0], sums, ends, kinds)
        again = np.flatnonzero(np.isinf(best[np.arange(many), size]))
        if len(again):
            back[again] = self._best(self.costs[1], sums[again], ends[again], kinds[again])[1]
        count, to = [], []
        for x, steps in zip(size.tolist(), back):
            steps, j, tos = steps[: x + 1].tolist(), x, []
            while j > 0:
                tos.append(j)
                j -= steps[j]
            count.append(len(tos))
            to += tos[::-1]
        k, to = np.repeat(np.arange(many), count), np.array(to)
        at = np.concatenate([[0], to[:-1]])
        at[np.cumsum([0, *count[:-1]])] = 0
        signs, gaps, kind = sums[k, to] - sums[k, at], ends[k, to - 1] - ends[k, at], kinds[k, to - 1]
        ratio = np.minimum(self.ratio[kind, np.minimum(gaps, self.wide), np.minimum(signs + (kind == 1), self.wide)], 1e6)
        cuts = zip(k.tolist(), (sums[k, at] + ends[k, at]).tolist(), (sums[k, to] + ends[k, to - 1]).tolist(), (kind == 1).tolist())
        said = [text for text, _, _ in paragraphs]
        return count, [said[k][a:z] + "-" if cut else said[k][a:z] for k, a, z, cut in cuts], ratio, signs * self.size * 0.5 > self.measure


def break_hyphenated(blocks: DataFrame, patterns: DataFrame, measure: float = 324.0, size: float = 11.0) -> DataFrame:
    """``break_blocks`` whose words may also be broken where ``patterns`` allow it (``hyphens.breaks``).

    Words are looked up where they stand, so that none is shuffled; paragraphs of like lengths are set together.
    """
    known = hyphens.tree(hyphens.collected(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = _Lines(measure, size)

        @lru_cache(1 << 16)
        def parted(word: str) -> tuple[list[int], list[bool]]:
            letters = word[:-1] if word[-1] in "\x85\u2028\u2029" else word  # a line's end, as Java's $ has it
            ends = [*(hyphens.places(word, known) if letters.isalpha() else ()), len(word)]
            return [z - a for a, z in zip([0, *ends], ends)], [False] * (len(ends) - 1) + [True]

        for batch in batches:
            found = []
            for k, text in enumerate(batch["text"].to_pylist()):
                if words := [w for w in _BLANKS.split(text or "") if w]:
                    widths, last = [], []
                    for w in words:
                        x, e = parted(w)
                        widths += x
                        last += e
                    found.append((k, (" ".join(words), widths, last)))
            found.sort(key=lambda x: len(x[1][1]))
            while found:
                some = [found.pop()]
                while found and (len(some) + 1) * len(some[0][1][1]) <= CELLS:
                    some.append(found.pop())
                count, texts, ratios, full = lines.set([x for _, x in some])
                rows = batch.select(["doc_id", "bi"]).take(pa.array(np.repeat([k for k, _ in some], count)))
                at = np.concatenate([np.arange(n, dtype=np.int32) for n in count])
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["bi"], pa.array(at), pa.array(texts, pa.string()), pa.array(ratios), pa.array(full)],
                    ["doc_id", "bi", "line", "text", "ratio", "overfull"],
                )

    return blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("bi").cast("long").alias("bi"), "text").mapInArrow(run, LINES)
