"""SVG path text: commands parsed from text and written back, as Column expressions, and drawn as lines."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments that each command takes at a time.
ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_WORD = r"[MmLlHhVvCcSsQqTtAaZz][^MmLlHhVvCcSsQqTtAaZz]*"
_GAP = r"[\s,]*"
#: An arc's arguments; its two flags need no gap around them.
_ARC = _GAP.join([f"({_NUMBER})"] * 3 + ["([01])", "([01])"] + [f"({_NUMBER})"] * 2)


def number(v: Column) -> Column:
    """A number without a needless fraction and never with an exponent."""
    plain = F.regexp_replace(F.format_string("%.12f", v), r"\.?0+$", "")
    return F.when(v == F.floor(v), F.floor(v).cast("decimal(38,0)").cast("string")).otherwise(plain)


def path_of(line: str, closed: bool = False) -> Column:
    """Path text of an array of points."""
    parts = F.transform(line, lambda p, i: F.concat(F.when(i == 0, F.lit("M ")).otherwise(F.lit("L ")), number(p.x), F.lit(" "), number(p.y)))
    return F.when(F.size(line) > 0, F.concat(F.array_join(parts, " "), F.lit(" Z" if closed else ""))).otherwise("")


def _words(path: str) -> Column:
    """array<struct<cmd, args, n>>: each command letter with all its numbers, and how many it takes at a time."""
    apart = lambda w: F.when(F.upper(F.substring(w, 1, 1)) == "A", F.regexp_replace(w, _ARC, "$1 $2 $3 $4 $5 $6 $7 ")).otherwise(w)
    args = lambda w: F.transform(F.regexp_extract_all(apart(w), F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double"))
    need = F.create_map(*(F.lit(x) for k, n in ARGUMENTS.items() for x in (k, n)))
    words = F.regexp_extract_all(F.col(path), F.lit(_WORD), F.lit(0))
    return F.transform(words, lambda w: F.struct(F.substring(w, 1, 1).alias("cmd"), args(w).alias("args"), F.element_at(need, F.upper(F.substring(w, 1, 1))).alias("n")))


def fault(path: str) -> Column:
    """What is wrong with a path's text, or null: an unexpected character, a start without a move, a wrong number of arguments."""
    text = F.col(path)
    rest = F.regexp_replace(F.regexp_replace(text, _NUMBER, " "), r"[MmLlHhVvCcSsQqTtAaZz\s,]+", "")
    uneven = F.exists(_words(path), lambda c: F.when(c.n == 0, F.size(c.args) > 0).otherwise((F.size(c.args) == 0) | (F.size(c.args) % F.greatest(c.n, F.lit(1)) != 0)))
    start = F.when(F.trim(text) != "", ~text.rlike(r"^\s*[Mm]"))
    return F.when(rest != "", F.concat(F.lit("unexpected character "), F.substring(rest, 1, 1))).when(start, "a path starts with a move").when(uneven, "wrong number of arguments")


def parse(path: str) -> Column:
    """array<struct<cmd, args array<double>>>; repeated arguments repeat their command (L after M), null for null.

    Characters that belong to no command or number are passed over.
    """
    read = _words(path)

    def split(c: Column) -> Column:
        times = F.when(c.n == 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.size(c.args) / F.greatest(c.n, F.lit(1)))))
        later = F.when(c.cmd == "M", "L").when(c.cmd == "m", "l").otherwise(c.cmd)
        return F.transform(F.sequence(F.lit(0), times.cast("int") - 1), lambda k: F.struct(F.when(k == 0, c.cmd).otherwise(later).alias("cmd"), F.slice(c.args, k * c.n + 1, c.n).alias("args")))

    return F.flatten(F.transform(read, split))


def write(commands: str) -> Column:
    """Path text of parsed commands."""
    return F.array_join(F.transform(commands, lambda c: F.concat_ws(" ", c.cmd, F.nullif(F.array_join(F.transform(c.args, number), " "), F.lit("")))), " ")


def _arc_points(a: np.ndarray, radii: tuple[float, float], turn: float, large: bool, sweep: bool, b: np.ndarray, tolerance: float) -> np.ndarray:
    """Points after a on an elliptic arc given by its ends."""
    rx, ry = abs(radii[0]), abs(radii[1])
    if rx == 0 or ry == 0 or (a == b).all():
        return b[None]
    c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    spin = np.array([[c, s], [-s, c]])
    m = spin @ (a - b) / 2  # half the chord in the ellipse's frame
    grow = max(1.0, float(np.hypot(m[0] / rx, m[1] / ry)))  # radii that can't span the chord are scaled up
    rx, ry = rx * grow, ry * grow
    k = max(0.0, 1 / max(1e-300, (m[0] / rx) ** 2 + (m[1] / ry) ** 2) - 1) ** 0.5 * (-1 if large == sweep else 1)
    mid = np.array([k * rx * m[1] / ry, -k * ry * m[0] / rx])
    start = np.arctan2((m[1] - mid[1]) / ry, (m[0] - mid[0]) / rx)
    end = np.arctan2((-m[1] - mid[1]) / ry, (-m[0] - mid[0]) / rx)
    angle = (end - start) % (2 * np.pi) if sweep else -((start - end) % (2 * np.pi))
    widest = 2 * np.arccos(max(-1.0, 1 - min(tolerance / max(rx, ry), 2.0)))
    t = start + angle * np.arange(1, max(1, int(np.ceil(abs(angle) / max(widest, 1e-3)))) + 1) / max(1, int(np.ceil(abs(angle) / max(widest, 1e-3))))
    out = np.stack([rx * np.cos(t) + mid[0], ry * np.sin(t) + mid[1]], 1) @ spin + (a + b) / 2
    out[-1] = b
    return out


def drawn(commands: list, tolerance: float) -> list[np.ndarray]:
    """The lines of parsed commands (pairs of a letter and its numbers), one for each move."""
    from planewright.functions.curve_kernels import flattened

    lines: list[list[np.ndarray]] = []
    at = start = np.zeros(2)
    last, before = np.zeros(2), ""  # the last control point, and the kind of curve that it belongs to
    for cmd, args in commands:
        kind, v = cmd.upper(), np.array(args, float)
        if len(v) < ARGUMENTS[kind]:
            continue
        base = at if cmd.islower() else np.zeros(2)
        if kind == "M":
            at = start = base + v
            lines.append([at[None]])
        elif kind == "Z":
            if lines and len(lines[-1]) > 1:
                lines[-1].append(start[None])
            at = start
        else:
            if not lines or before == "Z":
                lines.append([at[None]])
            if kind == "A":
                points = _arc_points(at, (v[0], v[1]), v[2], v[3] != 0, v[4] != 0, base + v[5:7], tolerance)
            elif kind in "LHV":
                points = {"L": lambda: base + v, "H": lambda: np.array([base[0] + v[0], at[1]]), "V": lambda: np.array([at[0], base[1] + v[0]])}[kind]()[None]
            else:
                inner = (base + v.reshape(-1, 2)) if len(v) else np.zeros((0, 2))
                smooth = 2 * at - last if before == {"S": "C", "T": "Q"}.get(kind, kind) else at
                control = np.concatenate([[at], [smooth] if kind in "ST" else np.zeros((0, 2)), inner])
                points, last = flattened(control, tolerance)[1:], control[-2]
            lines[-1].append(points)
            at = points[-1]
        before = {"S": "C", "T": "Q"}.get(kind, kind)
    return [np.concatenate(x) for x in lines if len(x) > 1]


def commands_of(text: str) -> list[tuple[str, list[float]]]:
    """The commands of a path's text as pairs of a letter and its numbers, as ``parse`` has them."""
    out = []
    for word in re.findall(_WORD, text):
        if word[0] in "Aa":
            word = re.sub(_ARC, r"\1 \2 \3 \4 \5 \6 \7 ", word)
        numbers, n = [float(x) for x in re.findall(_NUMBER, word)], ARGUMENTS[word[0].upper()]
        for k in range(max(1, -(-len(numbers) // n)) if n else 1):
            out.append((word[0] if k == 0 else {"M": "L", "m": "l"}.get(word[0], word[0]), numbers[k * n : (k + 1) * n]))
    return out


def lines_of(path: Column | str, tolerance: float) -> Column:
    """array<array<struct<x, y>>>: the lines that a path's text draws, curves and arcs within the tolerance; null for null.

    The text itself goes to the function: a parsed column beside it would be taken up into the call.
    """
    from planewright.operators.per_geometry import KINDS, _points

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else [_points(p) for p in drawn(commands_of(r), tolerance)] for r in rows], dtype=object)

    return F.pandas_udf(run, KINDS["rings"])(path)
