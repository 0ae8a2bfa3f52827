"""Sequence alignment joins: words by Needleman-Wunsch, frames by dynamic time warping.

A pair of sequences is one clip against its reference; both are brought
together by key and aligned by one task with numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

GAP, SIMILAR = -0.6, 0.6
ALIGNED = "clip_id string, ref_i int, hyp_j int, sim double"


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio, which is not an edit distance."""
    return SequenceMatcher(None, a, b).ratio()


#: Letters up to which words are measured many at once; SequenceMatcher itself measures longer ones.
LETTERS = 64
#: Columns of the letters that words hold.  Letters that share one only raise what words may have in common.
SLOTS = 256
#: Words of pairs that are scored together, cells looked at and pairs of words measured in one step.
TOGETHER, BLOCK, MEASURED = 8000, 1 << 20, 1 << 16


def _matches(a: np.ndarray, b: np.ndarray, long_a: np.ndarray, long_b: np.ndarray) -> np.ndarray:
    """Of each row of letters of ``a`` and ``b`` how many SequenceMatcher matches.

    As there, the longest block that both sides share is taken, of several
    the first in ``a``, then in ``b``, and what is left and right of it in turn.
    """
    found = np.zeros(len(a), np.int64)
    zero = np.zeros(len(a), np.int64)
    todo = np.stack([np.arange(len(a)), zero, long_a, zero, long_b], axis=1)
    while len(todo):
        todo = todo[np.argsort(np.maximum(todo[:, 2] - todo[:, 1], todo[:, 4] - todo[:, 3]), kind="stable")]
        left = []
        for at in range(0, len(todo), 4096):  # of about one length
            row, a0, a1, b0, b1 = part = todo[at : at + 4096].T
            ours, theirs = np.arange((a1 - a0).max()), np.arange((b1 - b0).max())
            x = np.where(ours < (a1 - a0)[:, None], a[row[:, None], np.minimum(a0[:, None] + ours, a.shape[1] - 1)], -1)
            y = np.where(theirs < (b1 - b0)[:, None], b[row[:, None], np.minimum(b0[:, None] + theirs, b.shape[1] - 1)], -2)
            run = np.zeros((len(row), len(theirs) + 1), np.int16)  # of the letters that end here, one column later
            most, end_a, end_b, every = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
            for i in ours:
                run[:, 1:] = (run[:, :-1] + 1) * (y == x[:, i, None])
                j = run.argmax(axis=1)
                n = run[every, j]
                more = n > most
                most[more], end_a[more], end_b[more] = n[more], i + 1, j[more]
            np.add.at(found, row, most)
            row, a0, a1, b0, b1 = part[:, most > 0]
            most, end_a, end_b = most[most > 0], end_a[most > 0], end_b[most > 0]
            left += [np.stack(t, axis=1) for t in ((row, a0, a0 + end_a - most, b0, b0 + end_b - most), (row, a0 + end_a, a1, b0 + end_b, b1))]
        todo = np.concatenate(left) if left else todo[:0]
        todo = todo[(todo[:, 2] > todo[:, 1]) & (todo[:, 4] > todo[:, 3])]
    return found


class _Vocabulary:
    """Different words as numbers, with their letters."""

    def __init__(self, words: list[str]):
        self.words, self.place = words, {w: k for k, w in enumerate(words)}
        self.lengths = np.array([len(w) for w in words])
        short = [w if len(w) <= LETTERS else "" for w in words]
        width = max(1, max(map(len, short)))
        self.letters = np.array(short, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int32)
        # the first, second, .. of a letter each has its own number
        own = np.where(self.lengths <= LETTERS, self.lengths, 0)
        there = np.arange(width) < own[:, None]
        nth = np.zeros(self.letters.shape, np.int64)
        for k in range(1, width):
            nth[:, k] = (self.letters[:, :k] == self.letters[:, k, None]).sum(axis=1)
        rows, columns = np.nonzero(there)
        held = np.bincount(rows * SLOTS + (self.letters[rows, columns] + 37 * nth[rows, columns]) % SLOTS, minlength=len(words) * SLOTS)
        self.held = held.reshape(len(words), SLOTS).astype(np.float32)
        for k in np.flatnonzero(self.lengths > LETTERS):
            seen: dict[str, int] = {}
            for c in words[k]:
                n = seen[c] = seen.get(c, -1) + 1
                self.held[k, (ord(c) + 37 * n) % SLOTS] += 1

    def may_be_similar(self, ours: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs of words that share letters enough: what they have in common is at most the letters that both hold."""
        rows, columns = [], []
        many = max(1, BLOCK // len(theirs))
        for at in range(0, len(ours), many):
            some = ours[at : at + many]
            i, j = np.nonzero(2 * (self.held[some] @ self.held[theirs].T) >= (SIMILAR - 1e-6) * (self.lengths[some][:, None] + self.lengths[theirs]))
            rows.append(i + at)
            columns.append(j)
        return np.concatenate(rows), np.concatenate(columns)

    def ratios(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``similarity`` of the words of these numbers."""
        out = np.empty(len(a))
        for at in range(0, len(a), MEASURED):
            x, y = a[at : at + MEASURED], b[at : at + MEASURED]
            long = (self.lengths[x] > LETTERS) | (self.lengths[y] > LETTERS)
            ratio = 2.0 * _matches(self.letters[x], self.letters[y], np.where(long, 0, self.lengths[x]), np.where(long, 0, self.lengths[y])) / np.maximum(1, self.lengths[x] + self.lengths[y])
            for k in np.flatnonzero(long):
                ratio[k] = similarity(self.words[x[k]], self.words[y[k]])
            out[at : at + MEASURED] = ratio
        return out


def _scored(pairs: list[tuple[list[str], list[str]]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each pair of texts, none empty: the scores of its different words, and the row and column of each word of both sides.

    Equal words score 1, similar ones 2 * ratio - 1, others -1.  Pairs of
    words that may be similar are measured once for all texts.
    """
    words = _Vocabulary(sorted({w for pair in pairs for side in pair for w in side}))
    parts, keys = [], []
    for ref, hyp in pairs:
        (ours, rows), (theirs, columns) = (np.unique([words.place[w] for w in side], return_inverse=True) for side in (ref, hyp))
        i, j = words.may_be_similar(ours, theirs)
        parts.append((ours, rows, theirs, columns, i, j))
        keys.append(ours[i] * len(words.words) + theirs[j])
    each, at = np.unique(np.concatenate(keys), return_inverse=True)
    ratio = words.ratios(*np.divmod(each, len(words.words)))
    score = np.where(ratio > SIMILAR, 2 * ratio - 1, -1.0)
    start = 0
    for ours, rows, theirs, columns, i, j in parts:
        table = np.full((len(ours), len(theirs)), -1.0)
        table[i, j] = score[at[start : start + len(i)]]
        start += len(i)
        yield table, rows, columns


#: Cells up to which a table is held whole, as short turns are quicker so.
WHOLE = 1 << 20


def _whole_steps(score: np.ndarray, step: np.ndarray) -> None:
    """Fills ``step`` from a table of totals that is held whole: all steps are told at once at the end.

    Totals are held without the gaps that a path straight to the cell would
    have, so a gap costs nothing and a row is one running maximum.
    """
    n, m = score.shape
    total, gain = np.zeros((n + 1, m + 1)), score - 2 * GAP
    for i in range(n):
        best = total[i, :-1] + gain[i]
        np.maximum(best, total[i, 1:], out=best)
        np.maximum.accumulate(best, out=total[i + 1, 1:])
    best = total[1:, 1:]
    near = 1e-8 + 1e-5 * np.abs(best + GAP * (np.arange(1, n + 1)[:, None] + np.arange(1, m + 1)))  # as np.isclose
    inner = step[1:, 1:]
    inner[np.abs(total[:-1, 1:] - best) <= near] = 1
    inner[np.abs(total[:-1, :-1] + gain - best) <= near] = 0


def _steps_by_diagonals(score: np.ndarray, rows: np.ndarray, columns: np.ndarray, step: np.ndarray) -> None:
    """Fills ``step`` with only the last two diagonals of totals in memory."""
    n, m = len(rows), len(columns)
    steps = step.reshape(-1)
    before, last = np.empty(n + 1), np.empty(n + 1)  # by the row of a diagonal's cells
    last[0] = 0.0
    for d in range(1, n + m + 1):
        now = np.empty(n + 1)
        if d <= m:
            now[0] = GAP * d
        if d <= n:
            now[d] = GAP * d
        low, high = max(1, d - m), min(n, d - 1)
        if low <= high:
            pair = before[low - 1 : high] + score[rows[low - 1 : high], columns[d - high - 1 : d - low][::-1]]
            up, left = last[low - 1 : high] + GAP, last[low : high + 1] + GAP
            best = np.maximum(pair, np.maximum(up, left))
            near = 1e-8 + 1e-5 * np.abs(best)
            taken = np.full(len(best), 2, np.int8)
            taken[np.abs(up - best) <= near] = 1
            taken[np.abs(pair - best) <= near] = 0
            steps[low * (m + 1) + d - low : high * (m + 1) + d - high + 1 : m] = taken
            now[low : high + 1] = best
        before, last = last, now


def _path(n: int, m: int, scored: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> list[tuple[int | None, int | None]]:
    """The cells of the best path in order; of a long pair's table only a byte a cell is held."""
    step = np.full((n + 1, m + 1), 2, np.int8)
    step[1:, 0] = 1
    if scored:
        score, rows, columns = scored
        if n * m <= WHOLE:
            _whole_steps(score[np.ix_(rows, columns)], step)
        else:
            _steps_by_diagonals(score, rows, columns, step)
    out, i, j = [], n, m
    while i or j:
        k = step[i, j]
        if k == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif k == 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def _paths(pairs: Iterable[tuple[list[str], list[str]]]) -> Iterator[list[tuple[int | None, int | None]]]:
    """The best path of each pair, in order; pairs are scored together up to some words."""
    some, n = [], 0

    def done() -> Iterator[list[tuple[int | None, int | None]]]:
        full = [p for p in some if p[0] and p[1]]
        scored = _scored(full) if full else iter(())
        for ref, hyp in some:
            yield _path(len(ref), len(hyp), next(scored) if ref and hyp else None)

    for ref, hyp in pairs:
        if some and n + len(ref) + len(hyp) > TOGETHER:
            yield from done()
            some, n = [], 0
        some.append((ref, hyp))
        n += len(ref) + len(hyp)
    yield from done()


def _steps(ref: list[str], hyp: list[str]) -> list[tuple[int | None, int | None]]:
    return next(_paths([(ref, hyp)]))


def align_words(ref: list[str], hyp: list[str]) -> list[tuple[int | None, int | None, float | None]]:
    """Global alignment: equal 1, similar 2 * ratio - 1, other -1, gap -0.6; ties prefer a pair, then a gap in ``hyp``."""
    return [(i, j, None if i is None or j is None else 1.0 if ref[i] == hyp[j] else similarity(ref[i], hyp[j])) for i, j in _steps(ref, hyp)]


def aligned_counts(pairs: DataFrame) -> DataFrame:
    """Words of both sides and aligned pairs of ``pairs(clip_id, ref array<string>, hyp array<string>)``, one row each."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [sum(i is not None and j is not None for i, j in path) for path in _paths((list(r), list(h)) for r, h in zip(b["ref"], b["hyp"]))]
            yield pd.DataFrame({"clip_id": b["clip_id"], "ref": b["ref"].map(len), "hyp": b["hyp"].map(len), "pairs": n}).astype({c: "int64" for c in ("ref", "hyp", "pairs")})

    # few bytes but much work a row, so tasks are not to be merged by their bytes
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.select("clip_id", "ref", "hyp").repartition(tasks, "clip_id").mapInPandas(count, "clip_id string, ref long, hyp long, pairs long")


def word_alignment(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Full outer sequence join of ``ref(clip_id, i, w)`` and ``hyp(clip_id, j, w)``."""

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("i"), b.sort_values("j")
        clip = a["clip_id"].iloc[0] if len(a) else b["of_clip"].iloc[0]
        rows = [(clip, None if i is None else a["i"].iloc[i], None if j is None else b["j"].iloc[j], s) for i, j, s in align_words(list(a["w"]), list(b["heard"]))]
        return pd.DataFrame(rows, columns=["clip_id", "ref_i", "hyp_j", "sim"]).astype({"ref_i": "Int32", "hyp_j": "Int32", "sim": "Float64"})

    left = ref.select("clip_id", "i", "w")
    right = hyp.select(F.col("clip_id").alias("of_clip"), "j", F.col("w").alias("heard"))
    return left.groupBy("clip_id").cogroup(right.groupBy("of_clip")).applyInPandas(both, ALIGNED)


#: Steps (reference, participant), their multiplier and what they cost in addition.
STEPS = [(1, 1, 1.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, 1.0, 0.0), (0, 1, 0.6, 0.3), (1, 0, 0.6, 0.3)]
PATH = "clip_id string, ref_frame int, par_frame int, cost double, path_cost double"


def warp(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int, float]], float]:
    """The cheapest path between two sequences of vectors by cosine cost, and its mean cost."""
    unit = [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b)]
    cost = 1 - unit[0] @ unit[1].T
    n, m = cost.shape
    # two rows and columns more, so that no step leaves the table; all cells of a diagonal at once
    width = m + 2
    total, came = np.full((n + 2, width), np.inf), np.zeros((n, m), np.int8)
    total[2, 2] = cost[0, 0]
    flat, of_cell, steps = total.reshape(-1), cost.reshape(-1), came.reshape(-1)
    for d in range(1, n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d)
        at, to = (low + 2) * width + d - low + 2, (high + 2) * width + d - high + 3
        here = slice(low * m + d - low, high * m + d - high + 1, max(1, m - 1))
        own, best, chosen = of_cell[here], np.full(high - low + 1, np.inf), np.zeros(high - low + 1, np.int8)
        for k, (di, dj, times, more) in enumerate(STEPS):
            back = di * width + dj
            value = flat[at - back : to - back : width - 1] + (times * own + more)
            less = value < best
            best[less], chosen[less] = value[less], k
        flat[at : to : width - 1] = best
        steps[here] = chosen
    path, i, j = [(n - 1, m - 1)], n - 1, m - 1
    while (i, j) != (0, 0):
        di, dj = STEPS[came[i, j]][:2]
        i, j = i - di, j - dj
        path.append((i, j))
    rows = [(i, j, float(cost[i, j])) for i, j in path[::-1]]
    return rows, float(np.mean([c for *_, c in rows]))


def frame_alignment(ref: DataFrame, par: DataFrame) -> DataFrame:
    """The warping path of ``ref`` and ``par(clip_id, frame_i, vector array<double>)`` of each clip present in both."""

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["clip_id", "ref_frame", "par_frame", "cost", "path_cost"]
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=columns)
        a, b = a.sort_values("frame_i"), b.sort_values("frame_j")
        path, mean = warp(np.stack(a["vector"].to_list()), np.stack(b["against"].to_list()))
        return pd.DataFrame([(a["clip_id"].iloc[0], i, j, c, mean) for i, j, c in path], columns=columns)

    left = ref.select("clip_id", "frame_i", "vector")
    right = par.select(F.col("clip_id").alias("of_clip"), F.col("frame_i").alias("frame_j"), F.col("vector").alias("against"))
    return left.groupBy("clip_id").cogroup(right.groupBy("of_clip")).applyInPandas(both, PATH)


def lag_track(path: DataFrame, step_s: float = 0.01) -> DataFrame:
    """Of each reference frame the middle of its participant frames, in seconds, and the lag."""
    middle = path.groupBy("clip_id", "ref_frame").agg(((F.min("par_frame") + F.max("par_frame")) / 2 * step_s).alias("par_s"), F.avg("cost").alias("cost"))
    return middle.withColumn("lag_s", F.col("par_s") - F.col("ref_frame") * step_s)
