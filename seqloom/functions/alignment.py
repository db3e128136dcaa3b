"""Extension kernels: ungapped and gapped X-drop alignment, traceback, chaining.

A sequence is an array of codes without delimiters; its ends stop every walk.
Batch kernels take concatenated codes with the place and the bounds of each
lane and advance all lanes a residue (or a row) at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SUBSTITUTION, GAP_IN_QUERY, GAP_IN_SUBJECT = "S", "I", "D"


@dataclass(frozen=True)
class Lanes:
    """Positions in concatenated codes, each with the bounds [low, high) of its sequence."""

    codes: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


def ungapped_side(q: Lanes, s: Lanes, step: int, matrix: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best prefix score, residues of the first best prefix) of each lane, walking from its places by step (1 or -1).

    A walk ends at a sequence end or once it is `drop` or more below its best.
    """
    n = len(q.at)
    best, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live, run, i = np.arange(n), np.zeros(n, np.int64), 0
    while len(live):
        x, y = q.at[live] + step * i, s.at[live] + step * i
        inside = (x >= q.low[live]) & (x < q.high[live]) & (y >= s.low[live]) & (y < s.high[live])
        live, run, x, y = live[inside], run[inside], x[inside], y[inside]
        if not len(live):
            break
        run = run + matrix[q.codes[x], s.codes[y]]
        better = run > 0
        best[live[better]] += run[better]
        length[live[better]] = i + 1
        run[better] = 0
        go = run > -drop[live]
        live, run = live[go], run[go]
        i += 1
    return best, length


def ungapped_score(q: Lanes, s: Lanes, matrix: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """Score of each seed hit: the walk to the left from before it, plus the walk to the right from it."""
    left, _ = ungapped_side(Lanes(q.codes, q.at - 1, q.low, q.high), Lanes(s.codes, s.at - 1, s.low, s.high), -1, matrix, drop)
    right, _ = ungapped_side(q, s, 1, matrix, drop)
    return left + right


def connected(q: Lanes, s: Lanes, previous: np.ndarray, matrix: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """Whether each hit is joined to the one before it on its diagonal (query place `previous`): next to it, or reached by walking back without a drop."""
    done = q.at <= previous + 1
    score, best = np.zeros(len(q.at), np.int64), np.zeros(len(q.at), np.int64)
    live, i = np.flatnonzero(~done), 0
    while len(live):
        i += 1
        x, y = q.at[live] - i, s.at[live] - i
        reached = x <= previous[live]
        inside = (x >= q.low[live]) & (y >= s.low[live])
        done[live[reached & inside]] = True
        go = inside & ~reached
        live, x, y = live[go], x[go], y[go]
        score[live] += matrix[q.codes[x], s.codes[y]]
        best[live] = np.maximum(best[live], score[live])
        live = live[score[live] > best[live] - drop[live]]
    return done


@dataclass(frozen=True)
class Extensions:
    """Best one-sided extension of each lane: score, residues taken of query and subject, edit script from the start outward (traced lanes only)."""

    score: np.ndarray
    query: np.ndarray
    subject: np.ndarray
    scripts: list[list[tuple[str, int]]]


def _never(small: bool) -> int:
    """Stands for minus infinity in 16 or 32 bits."""
    return -(1 << 13) if small else -(1 << 28)


#: Lanes that are advanced together: their rows fit a core's cache.
LANES = 1024
#: Rows for which query residues are laid out at a time.
AHEAD = 64


def gapped_sides(q: Lanes, s: Lanes, step: int, matrix: np.ndarray, gap_open: int, gap_extend: int, cutoff: int, trace: bool = False) -> Extensions:
    """Affine X-drop extension of all lanes, from their places outward by step (1 or -1).

    A gap of g residues costs open + g * extend. Row i holds the scores after i
    subject residues. A cell more than `cutoff` below the best score before it,
    row by row and from left to right, is dead; a lane ends with its last live
    cell. The leftmost column of the band, which only a gap can prolong, goes as
    soon as the column beside it is dead. The first best cell wins; substitution
    goes before a gap in the query before a gap in the subject, prolonging a gap
    before opening one.
    """
    n = (q.high - q.at if step > 0 else q.at - q.low + 1).astype(np.int64)
    m = (s.high - s.at if step > 0 else s.at - s.low + 1).astype(np.int64)
    out = Extensions(*(np.zeros(len(n), np.int64) for _ in range(3)), [[] for _ in range(len(n) if trace else 0)])
    able = np.flatnonzero((n > 0) & (m > 0))
    able = able[np.argsort(np.minimum(n, m)[able], kind="stable")]
    small = cutoff + gap_open + gap_extend + 4 * int(np.abs(matrix).max()) < 2000
    for at in range(0, len(able), LANES):
        i = able[at : at + LANES]
        sides = i, q.codes, q.at[i].astype(np.int64), n[i], s.codes, s.at[i].astype(np.int64), m[i], step
        try:
            _advance(out, *sides, _table(matrix, small), gap_open, gap_extend, cutoff, trace)
        except OverflowError:  # a band too wide for 16 bits: once more in 32
            out.score[i] = out.query[i] = out.subject[i] = 0
            _advance(out, *sides, _table(matrix, False), gap_open, gap_extend, cutoff, trace)
    return out


def _table(matrix: np.ndarray, small: bool) -> np.ndarray:
    """The matrix with two letters more: before the first column and behind the last one, where nothing lives."""
    letters = matrix.shape[1]
    table = np.full((letters, letters + 2), _never(small) // 2, np.int16 if small else np.int32)
    table[:, :letters] = matrix
    return table


def _advance(out: Extensions, live: np.ndarray, q_codes: np.ndarray, q_first: np.ndarray, n: np.ndarray, s_codes: np.ndarray, s_first: np.ndarray, m: np.ndarray, step: int, table: np.ndarray, gap_open: int, gap_extend: int, cutoff: int, trace: bool) -> None:
    """gapped_sides() for some lanes (rows of out).

    A lane's cells lie by diagonal: column j of row i at j - i - base, so a
    substitution stays in its place; scores are relative to the best so far, so
    16 bits hold them whatever the length (unless the cutoff is large). Gaps along a row are a running maximum: a
    path through a dead cell is below the cutoff from there on, so it never
    reaches a live one.
    """
    trails: dict[int, list[tuple[int, np.ndarray]]] = {int(x): [] for x in live} if trace else {}
    wide, flat, behind = table.shape[1], table.ravel(), table.shape[1] - 1
    kind = table.dtype.type
    never, first = _never(kind is np.int16), kind(gap_open + gap_extend)
    longest = int(max(n.max(), m.max()))
    reach = min(longest, max(0, (cutoff - gap_open) // gap_extend) if gap_extend else longest) + 1  # cells that one gap can live for
    width = 2 * reach + 8
    base = np.full(len(live), -(reach + 2), np.int64)
    edge = np.zeros(len(live), np.int64)  # leftmost column of the band
    top = np.zeros(len(live), np.int64)
    # Arrays are (cell, lane): a step to the next cell is a step to the next row of memory.
    column = np.arange(width)[:, None] + base
    scores = np.where(column == 0, 0, -gap_open - gap_extend * column)
    alive = (column >= 0) & (column <= n) & (scores >= -cutoff)
    scores = np.where(alive, scores, never).astype(kind)
    gaps = np.where(alive, scores - first, never).astype(kind)

    def laid_out(lanes: np.ndarray, i: int) -> np.ndarray:
        """Letters of the columns that the lanes' cells are in from row i on."""
        c = np.arange(width + AHEAD)[:, None] + (base[lanes] + i)
        letter = q_codes[q_first[lanes] + step * np.clip(c - 1, 0, n[lanes] - 1)].astype(np.intp)
        letter[c < 1] = behind - 1
        letter[c > n[lanes]] = behind
        return letter

    i, loaded, ahead = 0, 0, None
    while len(live):
        i += 1
        tight = alive[0] | alive[width - reach :].any(axis=0)
        if tight.any():  # no room for a column to the left or a whole gap to the right
            at = np.flatnonzero(tight)
            low, high = alive[:, at].argmax(axis=0), width - 1 - alive[::-1, at].argmax(axis=0)
            if (need := int((high - low).max()) + reach + 3) > width:
                more = np.full((need, len(live)), never, kind)
                scores, gaps = np.vstack([scores, more]), np.vstack([gaps, more])
                width += need
                if kind is np.int16 and width * gap_extend > 8000:
                    raise OverflowError("a wide band")
                ahead = None
            shift = (width - reach - (high - low)) // 2 - low
            source = np.arange(width)[:, None] - shift
            outside = (source < 0) | (source >= width)
            source = np.clip(source, 0, width - 1)
            for x in (scores, gaps):
                x[:, at] = np.where(outside, never, np.take_along_axis(x[:, at], source, axis=0))
            base[at] -= shift
            if ahead is not None:
                ahead[:, at] = laid_out(at, loaded)
        if ahead is None or i - loaded >= AHEAD:
            loaded, ahead = i, laid_out(np.arange(len(live)), i)
        letter = ahead[i - loaded : i - loaded + width]
        entered = flat.take(letter + s_codes[s_first + step * (i - 1)].astype(np.intp) * wide, mode="clip")
        entered += scores
        substituted = entered.copy() if trace else None
        np.maximum(entered[:-1], gaps[1:], out=entered[:-1])
        slope = (np.arange(width, dtype=kind) * kind(gap_extend))[:, None]
        side = _running_maximum(entered + slope)
        side -= slope + kind(gap_open + gap_extend)
        side = np.concatenate([np.full((1, len(live)), never, kind), side[:-1]])
        limit = _running_maximum(entered.copy())
        peak = np.maximum(limit[-1], 0)
        np.maximum(limit, 0, out=limit)
        limit -= kind(cutoff)
        now = np.maximum(entered, side)
        alive = now >= limit
        alive &= letter != behind
        # The band's left edge.
        k = edge - i - base
        known = np.flatnonzero((k >= 0) & (k + 1 < width))
        follows = np.zeros(len(live), bool)
        follows[known] = alive[k[known] + 1, known]
        lost = known[~follows[known]]
        alive[k[lost], lost] = False
        if trace:
            entering = np.full_like(now, never)
            entering[:-1] = gaps[1:]
            opened = now - first
            marks = np.where(substituted >= np.maximum(entering, side), 0, np.where(entering >= side, 1, 2)) + 4 * (entering - gap_extend >= opened) + 8 * (side - gap_extend >= opened)
            marks = np.ascontiguousarray(marks.T.astype(np.uint8))
            for r, lane in enumerate(live.tolist()):
                trails[lane].append((int(base[r]) + i, marks[r]))
        if (r := np.flatnonzero(peak)).size:
            top[r] += peak[r]
            out.score[live[r]], out.subject[live[r]] = top[r], i
            out.query[live[r]] = base[r] + i + entered[:, r].argmax(axis=0)
        edge = np.where(follows, edge, alive.argmax(axis=0) + base + i - 1)
        left = now - first
        np.maximum(left[:-1], gaps[1:] - kind(gap_extend), out=left[:-1])
        # Dead cells fall below `never`, then everything is lifted to it.
        fall = alive.astype(kind)
        fall -= kind(1)
        fall *= kind(-never)
        fall -= peak
        now += fall
        left += fall
        scores, gaps = np.maximum(now, kind(never), out=now), np.maximum(left, kind(never), out=left)
        go = alive.any(axis=0) & (i < m)
        if not go.all():
            live, n, m, q_first, s_first, base, edge, top = (x[go] for x in (live, n, m, q_first, s_first, base, edge, top))
            scores, gaps, alive, ahead = (np.ascontiguousarray(x[:, go]) for x in (scores, gaps, alive, ahead))
    for lane, trail in trails.items():
        out.scripts[lane] = path_back(trail, int(out.subject[lane]), int(out.query[lane]))


def _running_maximum(x: np.ndarray) -> np.ndarray:
    """Greatest value up to each cell, in place: by steps of 1, 2, 4, ... cells."""
    step = 1
    while step < len(x):
        x[step:] = np.maximum(x[step:], x[:-step])
        step *= 2
    return x


def path_back(trail: list[tuple[int, np.ndarray]], i: int, j: int) -> list[tuple[str, int]]:
    """Edit script from the start to cell (i, j). trail: for rows 1, 2, ... the first column and each cell's marks: move (0-2), 4: the gap downward goes on, 8: the gap along the row goes on."""
    ops, gap = [], 0
    while i and j:
        origin, marks = trail[i - 1]
        mark = int(marks[j - origin])
        gap = gap if gap and mark & 4 * gap else mark & 3
        ops.append((SUBSTITUTION, GAP_IN_QUERY, GAP_IN_SUBJECT)[gap])
        i, j = i - (gap != 2), j - (gap != 1)
    ops += [GAP_IN_QUERY] * i + [GAP_IN_SUBJECT] * j
    return runs(reversed(ops))


def gapped_side(query: np.ndarray, subject: np.ndarray, matrix: np.ndarray, gap_open: int, gap_extend: int, cutoff: int, trace: bool = False) -> tuple[int, int, int, list[tuple[str, int]]]:
    """gapped_sides() of one lane, from the start of both arrays: (score, query residues, subject residues, edit script)."""
    one = lambda codes: Lanes(codes, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, len(codes)))
    found = gapped_sides(one(query), one(subject), 1, np.asarray(matrix), gap_open, gap_extend, cutoff, trace)
    return int(found.score[0]), int(found.query[0]), int(found.subject[0]), found.scripts[0] if trace else []


def runs(ops) -> list[tuple[str, int]]:
    """Run lengths of a sequence of moves."""
    out: list[tuple[str, int]] = []
    for op in ops:
        if out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + 1)
        else:
            out.append((op, 1))
    return out


def merge(left: list[tuple[str, int]], right: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Two scripts one after the other."""
    if left and right and left[-1][0] == right[0][0]:
        return [*left[:-1], (left[-1][0], left[-1][1] + right[0][1]), *right[1:]]
    return [*left, *right]


def flip(script: list[tuple[str, int]]) -> list[tuple[str, int]]:
    return script[::-1]


def expand(script: list[tuple[str, int]]) -> str:
    return "".join(op * n for op, n in script)


@dataclass(frozen=True)
class Alignment:
    score: int
    q_start: int  # 0-based, inclusive
    q_end: int
    s_start: int
    s_end: int
    script: list[tuple[str, int]]


def gapped_hits(q: Lanes, s: Lanes, matrix: np.ndarray, gap_open: int, gap_extend: int, cutoff: int, trace: bool = False) -> tuple[Extensions, Extensions]:
    """Extensions of hits to both sides: to the left from before each hit, to the right from it."""
    before = [Lanes(x.codes, x.at - 1, x.low, x.high) for x in (q, s)]
    return gapped_sides(*before, -1, matrix, gap_open, gap_extend, cutoff, trace), gapped_sides(q, s, 1, matrix, gap_open, gap_extend, cutoff, trace)


def edit_counts(query: np.ndarray, subject: np.ndarray, a: Alignment) -> tuple[int, int, int, int]:
    """(length, mismatches, gap openings, gap extensions); letters of equal code match, unknown ones too."""
    i, j = a.q_start, a.s_start
    length = mismatches = opens = extends = 0
    for op, n in a.script:
        length += n
        if op == SUBSTITUTION:
            mismatches += int((query[i : i + n] != subject[j : j + n]).sum())
        else:
            opens += 1
            extends += n - 1
        i += n if op != GAP_IN_QUERY else 0
        j += n if op != GAP_IN_SUBJECT else 0
    return length, mismatches, opens, extends
