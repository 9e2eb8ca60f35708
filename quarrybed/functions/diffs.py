"""Line alignment, unified diffs and line operations. Plain functions and their Arrow forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT, LINE_LIMIT = 3, 10_000


def align(a: list, b: list) -> list[tuple[int, int, int]]:
    """Runs (i, j, n) of equal items of a longest common subsequence.

    Common ends are set aside first, then items that the other side doesn't have, which are
    in no common subsequence; the rest is searched greedily over diagonals. Of each round one bit
    a diagonal is kept: a difference of 10,000 items takes some 6 MB.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    numbers: dict = {}
    x = np.array([numbers.setdefault(v, len(numbers)) for v in a[head : len(a) - tail]], np.int64)
    y = np.array([numbers.setdefault(v, len(numbers)) for v in b[head : len(b) - tail]], np.int64)
    at_x, at_y = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    inner = [(int(at_x[i]) + head, int(at_y[j]) + head) for i, j in _middle(x[at_x], y[at_y])]
    pairs = [(i, i) for i in range(head)] + inner + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    runs: list[tuple[int, int, int]] = []
    for i, j in pairs:
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1] = (runs[-1][0], runs[-1][1], runs[-1][2] + 1)
        else:
            runs.append((i, j, 1))
    return runs


def _middle(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence: all diagonals of a round are carried forward together.

    A round's furthest points follow from the moves that led there (down or right), so the
    moves of the best path, read back from the kept bits, give the path again.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    ends_a, ends_b = np.append(a, -1), np.append(b, -2)  # unlike anything beyond the ends
    reach, moves = np.zeros(1, np.int64), []
    for d in range(n + m + 1):
        k = np.arange(-d, d + 1, 2)  # diagonals of this round; those of the last one lie between
        if d:
            right = np.concatenate(([-1], reach + 1))  # from the diagonal below
            down = np.concatenate((reach, [-1]))  # from the one above
            by_down = down >= right
            reach = np.where(by_down, down, right)
            moves.append(np.packbits(by_down))
        live = np.flatnonzero((reach <= n) & (reach - k <= m) & (reach >= 0))
        while len(live):
            i = reach[live]
            live = live[ends_a[np.minimum(i, n)] == ends_b[np.minimum(i - k[live], m)]]
            reach[live] += 1
        over = (reach > n) | (reach - k > m)
        reach[over] = np.where(reach[over] > n, n, reach[over])
        done = np.flatnonzero((reach >= n) & (reach - k >= m) & (k == n - m))
        if len(done):
            return _replay(a, b, moves, int(done[0]))
    return []


def _replay(a: np.ndarray, b: np.ndarray, moves: list[np.ndarray], at: int) -> list[tuple[int, int]]:
    """The path that ends on a diagonal (its place in the last round)."""
    path = []
    for d in range(len(moves), 0, -1):
        down = bool(moves[d - 1][at >> 3] >> (7 - (at & 7)) & 1)
        path.append(down)
        at -= not down
    x, y, out, i, j = a.tolist(), b.tolist(), [], 0, 0
    for down in [None, *reversed(path)]:
        if down is not None:
            i, j = (i, j + 1) if down else (i + 1, j)
        while i < len(x) and j < len(y) and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


def _lines(text: str) -> list[str]:
    parts = text.split("\n")
    return [p.rstrip("\r") for p in (parts[:-1] if parts[-1] == "" else parts)]


def line_operations(old: str, new: str) -> list[tuple[str, int | None, int | None, str]]:
    """(op, old line, new line, content): equal, delete or insert, lines counted from 1; deletes come before inserts."""
    a, b = _lines(old), _lines(new)
    out, i, j = [], 0, 0
    for x, y, n in [*align(a, b), (len(a), len(b), 0)]:
        out += [("delete", k + 1, None, a[k]) for k in range(i, x)]
        out += [("insert", None, k + 1, b[k]) for k in range(j, y)]
        out += [("equal", x + k + 1, y + k + 1, a[x + k]) for k in range(n)]
        i, j = x + n, y + n
    return out


def unified_diff(path: str, old: str | None, new: str | None, old_id: str = "", new_id: str = "", context: int = CONTEXT) -> str:
    """Unified diff of one file; an absent or empty side is /dev/null; nothing for equal sides.

    Changes that at most twice the context of equal lines parts share a hunk. A missing last
    newline is not marked.
    """
    a, b = old or "", new or ""
    head = f"diff --git a/{path} b/{path}\n"
    if not a and b:
        head += "new file mode 100644\n"
    if a and not b:
        head += "deleted file mode 100644\n"
    head += f"index {old_id[:7] or '0' * 7}..{new_id[:7] or '0' * 7}\n"
    ops = line_operations(a, b)
    changed = [k for k, op in enumerate(ops) if op[0] != "equal"]
    if not changed:
        return ""
    out = [head, f"--- {'a/' + path if a else '/dev/null'}\n", f"+++ {'b/' + path if b else '/dev/null'}\n"]
    groups = [[changed[0], changed[0]]]
    for k in changed[1:]:
        if k - groups[-1][1] - 1 <= 2 * context:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    for first, last in groups:
        lo, hi = max(0, first - context), min(len(ops), last + context + 1)
        part = ops[lo:hi]
        n_old, n_new = sum(op[0] != "insert" for op in part), sum(op[0] != "delete" for op in part)
        seen_old, seen_new = sum(op[0] != "insert" for op in ops[:lo]), sum(op[0] != "delete" for op in ops[:lo])
        out.append(f"@@ -{seen_old + bool(n_old)},{n_old} +{seen_new + bool(n_new)},{n_new} @@\n")
        out += [{"equal": " ", "delete": "-", "insert": "+"}[op] + text + "\n" for op, _, _, text in part]
    return "".join(out)


def file_diff(path: str, old: bytes | None, new: bytes | None, limit: int = LINE_LIMIT) -> str:
    """Diff of two payloads: a note for large or binary ones."""
    n = sum((x or b"").count(b"\n") + bool(x and not x.endswith(b"\n")) for x in (old, new))
    if n > limit:
        return f"large file: {path} has {n} lines, limit {limit}"
    try:
        return unified_diff(path, (old or b"").decode(), (new or b"").decode())
    except UnicodeDecodeError:
        return f"Binary files a/{path} and b/{path} differ\n"


@F.pandas_udf(T.StringType())
def file_diff_udf(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([file_diff(p, o if o is None else bytes(o), n if n is None else bytes(n)) for p, o, n in zip(path, old, new)], dtype=object)


LINE_OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("old_line", T.IntegerType()), T.StructField("new_line", T.IntegerType()), T.StructField("content", T.StringType())]))


@F.pandas_udf(LINE_OPS)
def line_operations_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("op", "old_line", "new_line", "content"), op)) for op in line_operations(o or "", n or "")] for o, n in zip(old, new)], dtype=object)
