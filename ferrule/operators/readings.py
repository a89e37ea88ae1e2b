r"""Printed property tables read twice by machine: rows parsed, the two readings of a row paired, tokens put to columns, cells chosen.

A reading is a line that starts with a designation, such as ``100 x 50 x 15 x 2.00``; what follows are tokens for the columns of
its table (``profiles.LAYOUTS``). Tokens may be junk, lost, split at a lost decimal point or misread; the geometry that
the designation fixes and the other reading decide. Everything is a join or an aggregation by table and designation but the
alignment, which runs over Arrow batches, all rows of a table in a batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators import profiles
from ferrule.operators.ordered import greedy_match
from ferrule.shared import dealt, stored

# Letters read for digits, the form of a designation, standard thicknesses, tolerances by column.
CONFUSED = {"I": "1", "l": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", ",": ".", "·": ".", "Q": "0", "D": "0", "L": "1", "i": "1", "Z": "2", "z": "2", "J": "1", "a": "0", "G": "6", "b": "6", "q": "9", "g": "9", "T": "7", "U": "0"}
EDGES = ".:;'\"`‘’()[]{}_-—=~*"
DESIGNATION = r"^[^0-9A-Za-z]{0,4}([0-9OoIlSsz]{2,3})\s*[xX*&K]\s*([0-9OoIlSsz]{2,3})\s*(?:[xX*&K]?\s*([0-9OoIlSs]{1,2})\s*)?[xX*&K]\s*([0-9OoIlSs][.,·][0-9OoIlSsQ]{2})[-.]?\s+(.*)$"
NUMBER = r"^\d+(\.\d+)?\z"
STANDARD_T = (1.25, 1.60, 2.00, 2.30, 2.50, 2.55, 3.15, 4.00, 5.00, 6.00, 8.00)
TOLERANCE = {"A": 0.04, "M": 0.04, "Ixx": 0.05, "Iyy": 0.06, "Iuu": 0.05, "Ivv": 0.08, "Ixy": 0.08, "J": 0.12, "Cw": 0.15, "Cx": 0.06, "Cy": 0.06, "X0": 0.10, "tan_alpha": 0.06, "tan_theta": 0.06}
RADII = {"Rxx": "Ixx", "Ryy": "Iyy", "Ruu": "Iuu", "Rvv": "Ivv", "Rvv_min": "Ivv"}
DERIVED = ("M", *RADII, "Zxx", "Zyy", "Zuu", "Zvv")
#: Cost of a join of two tokens, joins in a row at most, and what may be left out: pairs of (junk tokens, empty columns).
JOIN_COST, JOINS, LEFT_OUT = 0.3, 2, ((0, 0), (1, 1), (1, 0), (2, 0), (0, 1), (0, 2))


def token(raw: Column) -> Column:
    """A token as a number's text, letters read for digits; null if it is none."""
    return F.when(read(raw).rlike(NUMBER), read(raw))


def read(raw: Column) -> Column:
    return F.replace(F.translate(F.trim(F.trim(raw), F.lit(EDGES)), "".join(CONFUSED), "".join(CONFUSED.values())), F.lit(".."), F.lit("."))


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Readings of ``lines(table, page, source, line, ...)``: ``h, b, c, t`` and ``tokens``; lines without a whole designation go.

    What a line gives is one generated row, through which no filter is pushed: each group of the designation is looked for once a line.
    """
    four = F.col("table").isin([k for k, (_, d, _) in profiles.LAYOUTS.items() if len(d) == 4])
    flat = F.translate(F.regexp_replace(F.trim(F.col(line)), r"\s+", " "), "X×", "xx")
    parts = F.array(*[F.regexp_extract("__flat", DESIGNATION, n) for n in range(1, 6)])
    of = lambda p: F.struct(*[token(p[n]).cast("double").alias(d) for n, d in enumerate("hbct")], F.filter(F.transform(F.split(p[4], " "), read), lambda x: x.rlike(NUMBER)).alias("tokens"))
    found = lines.withColumn("__flat", flat).drop(*"hbct", "tokens").select("*", F.inline(F.transform(F.array(parts), of))).drop("__flat")
    whole = F.col("h").isNotNull() & F.col("b").isNotNull() & F.col("t").isNotNull() & (F.col("c").isNotNull() == four)
    return found.where(whole).withColumn("c", F.coalesce("c", F.lit(0.0)))


def paired(readings: DataFrame, first: str, second: str, slip: float = 1.0) -> DataFrame:
    """Readings of sources ``first`` and ``second`` side by side, ``(table, page, h, b, c, t, first, second)``, those of one source alone too.

    Two meet if all but the thickness is equal and the thickness is too, or it is off by less than ``slip`` with the same last digit, as when
    its first digit is misread; equal ones before others, then the nearest, each once. The thicknesses of a page meet in cells of ``slip``.
    Of the readings of a source with equal keys the first line counts. The readings are written once, as each side is read to match and to join.
    """
    key = ["table", "page", "h", "b", "c"]
    once = readings.groupBy("source", *key, "t").agg(F.min(F.struct("row", "tokens")).alias("m")).select("source", *key, "t", F.col("m.row").alias("row"), F.col("m.tokens").alias("tokens"))
    once = stored(once, "readings-")
    side = lambda s, n: once.where(F.col("source") == s).select(*key, F.col("t").alias(f"t{n}"), F.col("row").alias(f"row{n}"), F.col("tokens").alias(f"tokens{n}"))
    a, b = side(first, 1), side(second, 2)
    cell = F.floor(F.col("t1") / slip)
    near = a.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).join(b.withColumn("cell", F.floor(F.col("t2") / slip)), [*key, "cell"])
    gap, last = F.abs(F.col("t1") - F.col("t2")), lambda t: F.pmod(F.round(F.col(t) * 100), F.lit(10))
    last_digit = lambda t: F.when(last(t) > 0, last(t)).otherwise(F.pmod(F.round(F.col(t) * 10), F.lit(10)))  # noqa: E731  as printed without a trailing nought
    slips = near.where((gap == 0) | ((gap < slip) & (last_digit("t1") == last_digit("t2")))).select(*key, F.round(gap, 6).alias("gap"), "row1", "row2")
    match = greedy_match(slips, key, "row1", "row2", ["gap", "row1", "row2"]).select(*key, "row1", "row2")
    both = a.join(match, [*key, "row1"], "left").join(b, [*key, "row2"], "full")
    return both.select(*key, F.coalesce("t1", "t2").alias("t"), F.least("row1", "row2").alias("row"), F.col("tokens1").alias("first"), F.col("tokens2").alias("second"))


def align(cells: np.ndarray, joined: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best way to put tokens to columns in order, for many rows at once.

    ``cells[r, i, j]`` is what row r gains by token i in column j, ``joined[r, i, j]`` by tokens i and i + 1 as one, -inf where they do
    not join. Tokens may be left out and columns stay empty as ``LEFT_OUT`` says. Returns for every row and column twice the token plus
    one if it is joined to the next, -1 for an empty column, and the gain; rows that cannot be put have no token and gain 0.
    A state is how many joins, junk tokens and empty columns there were, which with the column gives the token: 18 states a
    column, whatever the row. Of equal gains the way with fewer joins, then the earlier pair of ``LEFT_OUT`` is taken.
    """
    rows, width, n = cells.shape
    most = max(max(p) for p in LEFT_OUT)
    states = [(m, junk, gap) for m in range(JOINS + 1) for junk in range(most + 1) for gap in range(most + 1) if any(junk <= a and gap <= b for a, b in LEFT_OUT)]
    value, came = {}, np.zeros((n + 1, JOINS + 1, most + 1, most + 1, rows), np.int8)
    low = np.full(rows, -np.inf)
    idle = np.where(joined.max(2, keepdims=True) > -np.inf, 0.0, -np.inf)  # two tokens joined, and then left out

    def gain(table: np.ndarray, i: int, j: int) -> np.ndarray:
        return table[:, i, j] if 0 <= i < table.shape[1] else low

    for j in range(n + 1):
        for m, junk, gap in states:
            i = j + junk + m - gap  # tokens used so far
            ways = []
            if j == 0 and (m, junk, gap) == (0, 0, 0):
                ways.append((np.zeros(rows), 0))
            if j:
                ways.append((value[j - 1, m, junk, gap] + gain(cells, i - 1, j - 1), 1))
                if m:
                    ways.append((value[j - 1, m - 1, junk, gap] + gain(joined, i - 2, j - 1) - JOIN_COST, 2))
                if gap:
                    ways.append((value.get((j - 1, m, junk, gap - 1), low), 3))
            if junk:
                ways.append((value.get((j, m, junk - 1, gap), low), 4))
                if m:
                    ways.append((value.get((j, m - 1, junk - 1, gap), low) + gain(idle, i - 2, 0) - JOIN_COST, 5))
            if not ways or i < 0:
                value[j, m, junk, gap] = low
                continue
            stack = np.stack([w for w, _ in ways])
            best = stack.argmax(0)
            value[j, m, junk, gap] = stack[best, np.arange(rows)]
            came[j, m, junk, gap] = np.array([k for _, k in ways], np.int8)[best]
    total, last = np.full(rows, -np.inf), np.full(rows, -1)
    ends = [(m, *p) for m in range(JOINS + 1) for p in LEFT_OUT]
    for k, (m, junk, gap) in enumerate(ends):
        v = np.where(n + junk + m - gap == lengths, value[n, m, junk, gap], -np.inf)
        better = v > total + 1e-9
        total, last = np.where(better, v, total), np.where(better, k, last)
    put, own = np.full((rows, n), -1), np.flatnonzero(last >= 0)
    j, (m, junk, gap) = np.full(len(own), n), np.array(ends)[last[own]].T
    while len(own):
        how = came[j, m, junk, gap, own]
        i, placed = j + junk + m - gap - how, (how == 1) | (how == 2)
        j, m, junk, gap = j - ((how > 0) & (how < 4)), m - ((how == 2) | (how == 5)), junk - (how >= 4), gap - (how == 3)
        put[own[placed], j[placed]] = 2 * i[placed] + (how[placed] == 2)
        own, j, m, junk, gap = (x[how > 0] for x in (own, j, m, junk, gap))
    return put, np.where(last >= 0, total, 0.0)


class Tokens:
    """Tokens of many rows as arrays: text, value, half a unit of the last place over the value, digits if there is no point."""

    def __init__(self, texts: np.ndarray) -> None:
        self.text = texts
        flat = texts.ravel()
        self.value = np.array([float(x) if x else np.nan for x in flat]).reshape(texts.shape)
        places = np.array([len(x) - 1 - x.index(".") if "." in x else -1 for x in flat]).reshape(texts.shape)
        self.digits = np.where(places < 0, np.char.str_len(texts), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.half = np.where((places > 0) & (self.value != 0), np.minimum(0.5 * 10.0**-places / abs(self.value), 0.13), 0.0)

    def at(self, k: np.ndarray) -> Tokens:
        """The token of one position of each row; no token where the position is below 0."""
        own, out = np.arange(len(k)), object.__new__(Tokens)
        there = k >= 0
        out.text, out.value = np.where(there, self.text[own, k], ""), np.where(there, self.value[own, k], np.nan)
        out.half, out.digits = np.where(there, self.half[own, k], 0.0), np.where(there, self.digits[own, k], 0)
        return out

    def variants(self) -> Iterator[tuple[int, np.ndarray]]:
        """The value as it is, then with a point put in after the first digit, the second and so on, then before all."""
        yield 0, self.value
        most = int(self.digits.max(initial=0))
        for k in range(1, most + 1):
            at = np.where(k < self.digits, self.digits - k, self.digits)
            yield k, np.where((self.digits >= 2) & (k <= self.digits), self.value / 10.0**at, np.nan)


def off(value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Relative error; of nought it is nought for nought and infinite else, and infinite without a value."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(target == 0, np.where(value == 0, 0.0, np.inf), abs(value - target) / abs(target))
    return np.where(np.isnan(out), np.inf, out)


def nearest(value: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least relative error of each row's value, and the target it is from; infinite and NaN without a target."""
    if targets.shape[1] == 0:
        return np.full(len(value), np.inf), np.full(len(value), np.nan)
    err = off(value[:, None], targets)
    k = err.argmin(1)
    return err[np.arange(len(k)), k], targets[np.arange(len(k)), k]


class Sheet:
    """Rows of one table: their dimensions, what each column should say, and the calibration of its columns."""

    def __init__(self, table: str, dims: dict[str, np.ndarray], fits: dict[str, tuple[int, float, float]]) -> None:
        self.shape, self.cols, self.fits, self.dims = profiles.LAYOUTS[table][0], profiles.columns(table), fits, dims
        self.expected = profiles.expected(self.shape, *(dims[k] for k in "hbct"))

    def targets(self, c: str) -> tuple[np.ndarray, float]:
        """Values that column ``c`` may be checked by, and the tolerance: the calibrated convention, or else every one."""
        e = self.expected.get("Rvv" if c == "Rvv_min" else c)
        if e is None:
            return np.empty((len(self.dims["t"]), 0)), 0.0
        if c in self.fits and self.fits[c][0] < e.shape[1]:
            k, scale, tolerance = self.fits[c]
            return e[:, [k]] * scale, max(tolerance, 0.035)
        return np.where(e == 0, np.nan, e), TOLERANCE.get(c, 0.06) + 0.02

    def gains(self, tokens: Tokens, other: np.ndarray | None) -> np.ndarray:
        """What every token gains in every column: 1 if the other reading has it there or a target is met, 0.6 with a point put in."""
        rows, width = tokens.value.shape
        out = np.zeros((rows * width, len(self.cols)))
        half, variants = tokens.half.ravel(), [(0.6 if k else 1.0, np.flatnonzero(~np.isnan(v)), v.ravel()) for k, v in tokens.variants()]
        for j, c in enumerate(self.cols):
            targets, tolerance = (self.expected[c], 0.02) if c in profiles.DIMENSIONS else self.targets(c)
            for gain, at, v in variants if targets.shape[1] else []:
                met = at[(off(v[at, None], targets[at // width]) <= tolerance + half[at, None]).any(1)]
                out[met, j] = np.maximum(out[met, j], gain)
        out = out.reshape(rows, width, len(self.cols))
        if other is not None:
            for j in range(len(self.cols)):
                out[:, :, j] = np.where((tokens.text == other[:, j][:, None]) & (tokens.text != ""), 1.0, out[:, :, j])
        return np.where((tokens.text == "")[:, :, None], -np.inf, out)


SHORT = re.compile(r"\d{1,3}")


class Reading:
    """One source's tokens of many rows, and where they were put."""

    def __init__(self, sheet: Sheet, lists: list[list[str] | None]) -> None:
        self.sheet, self.lengths = sheet, np.array([len(x or []) for x in lists])
        width = max(2, self.lengths.max(initial=0))
        texts = np.array([[*(x or []), *[""] * (width - len(x or []))] for x in lists])
        short = [[SHORT.fullmatch(x) is not None for x in row] for row in texts.tolist()]
        pairs = [[f"{row[i]}.{row[i + 1]}" if own[i] and own[i + 1] else "" for i in range(width - 1)] for row, own in zip(texts.tolist(), short, strict=True)]
        self.tokens, self.pairs = Tokens(texts), Tokens(np.array(pairs))
        self.put, self.gain = self.align(None)

    def align(self, other: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        return align(self.sheet.gains(self.tokens, other), self.sheet.gains(self.pairs, other), self.lengths)

    def cell(self, j: int, put: np.ndarray | None = None) -> Tokens:
        put = self.put if put is None else put
        one, two = self.tokens.at(np.where(put[:, j] % 2 == 0, put[:, j] // 2, -1)), self.pairs.at(np.where((put[:, j] >= 0) & (put[:, j] % 2 == 1), put[:, j] // 2, -1))
        for k in ("text", "value", "half", "digits"):
            setattr(one, k, np.where(two.text != "", getattr(two, k), getattr(one, k)))
        return one

    def with_other(self, other: np.ndarray) -> None:
        """Aligned once more with the other reading's cells in view; where that gains less the first way stays."""
        put, gain = self.align(other)
        better = gain >= self.gain
        self.put, self.gain = np.where(better[:, None], put, self.put), np.where(better, gain, self.gain)


def voted_thickness(cols: list[str], t: np.ndarray, lists: list[list[list[str] | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The thickness that two readings at least agree on, of the designation, the t columns and the bend radii; and whether it is another."""
    votes = [[x] for x in t]
    for source in lists:
        for own, row in zip(votes, source, strict=True):
            for c, x in zip(cols, row or [], strict=False):
                if c in ("t", "Ri") and re.fullmatch(r"\d\.\d\d", x):
                    own.append(float(x) if c == "t" else round(float(x) / profiles.BEND, 2))
    most = max(map(len, votes), default=1)
    cast = np.array([[*own, *[np.nan] * (most - len(own))] for own in votes]).reshape(-1, most)
    n = (abs(cast[:, :, None] - np.array(STANDARD_T)) < 0.03).sum(1)
    best = np.array(STANDARD_T)[n.argmax(1)]
    changed = (n.max(1) >= 2) & (abs(best - t) > 1e-6)
    return np.where(changed, best, t), changed


class Choice:
    """Cells of many rows as they are chosen: values, whose they are, notes of what is wrong and of what was repaired."""

    def __init__(self, rows: int) -> None:
        self.value, self.source, self.notes, self.repairs = {}, {}, [[] for _ in range(rows)], [[] for _ in range(rows)]

    def say(self, where: np.ndarray, text) -> None:
        for r in np.flatnonzero(where):
            self.notes[r].append(text(r))

    def pick(self, c: str, cells: list[Tokens], targets: np.ndarray, tolerance: np.ndarray) -> None:
        """What both say; else the reading, or a reading with a point put in, that is nearest to a target if it is near enough."""
        a, b = cells
        rows, any_target = np.arange(len(a.value)), ~np.isnan(targets).all(1) if targets.shape[1] else np.zeros(len(a.value), bool)
        first = np.where(np.isnan(a.value), b.value, a.value)
        half = np.where(np.isnan(a.value), b.half, a.half)
        agree, differ, none = (a.text == b.text) & (a.text != ""), (a.text != b.text) & (a.text != "") & (b.text != ""), np.isnan(first)
        gross, near = nearest(first, targets)
        self.say(agree & any_target & (gross > np.maximum(0.2, 3 * tolerance) + half), lambda r: f"{c}: both read {a.text[r]}, check value {near[r]:.4g}")
        errors, values, owners, points = [], [], [], []
        for s, x in enumerate(cells):
            for k, v in x.variants():
                err = np.where(any_target, nearest(v, targets)[0] - x.half + (0.002 if k else 0.0), 1.0 if k else 0.0)
                errors.append(np.where(np.isnan(v), np.inf, err))
                values.append(v)
                owners.append(np.full(len(v), s))
                points.append(np.full(len(v), k))
        best = np.stack(errors).argmin(0)
        err, value, owner, point = (np.stack(x)[best, rows] for x in (errors, values, owners, points))
        target = nearest(value, targets)[1]
        self.say(none, lambda r: f"{c}: no reading")
        self.say(~agree & ~none & ~any_target & differ, lambda r: f"{c}: read {a.text[r]} and {b.text[r]}, nothing to check by")
        met = any_target & (err <= tolerance)
        self.say(~agree & ~none & any_target & ~met, lambda r: f"{c}: read {' and '.join(x.text[r] for x in cells if x.text[r])}, check value {target[r]:.4g}")
        for r in np.flatnonzero(~agree & met & ((point > 0) | differ)):
            self.repairs[r].append(f"{c}: {cells[owner[r]].text[r]} with a point, {value[r]:g}" if point[r] else f"{c}: {a.text[r]} or {b.text[r]}, {value[r]:g} is nearer")
        self.value[c] = np.where(agree | (any_target & ~met), first, value)
        self.source[c] = np.where(none, -1, np.where(agree, 2, np.where(any_target & ~met, np.where(np.isnan(a.value), 1, 0), owner)))


def z_targets(sheet: Sheet, c: str, chosen: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Section moduli that follow from what was chosen, NaN where none does, and their tolerance."""
    n = len(sheet.dims["t"])
    h, nothing = sheet.dims["h"] / 10, np.full(n, np.nan)
    exact, tolerance = nothing, np.full(n, 0.012)
    if c == "Zxx" and "Ixx" in chosen:
        if sheet.shape in ("channel", "lipped_channel", "lipped_zed"):
            exact = chosen["Ixx"] / (h / 2)
        elif sheet.shape == "hat" and "Cy" in chosen:
            exact = chosen["Ixx"] / np.maximum(chosen["Cy"], h - chosen["Cy"])
    geometric = nothing
    if c in sheet.fits and c in sheet.expected and sheet.fits[c][0] < sheet.expected[c].shape[1]:
        k, scale, fitted = sheet.fits[c]
        moment = {"Zuu": "Iuu", "Zvv": "Ivv"}.get(c) or ("Ixx" if (c == "Zxx") == (k < 3) else "Iyy")
        own = chosen.get(moment, chosen.get("Ixx") if moment == "Iyy" and sheet.shape == "equal_angle" else None)
        model = sheet.expected.get(moment, sheet.expected["Ixx"])[:, 0]
        geometric = sheet.expected[c][:, k] * scale
        if own is not None:
            geometric = np.where((own > 0) & (model > 0), geometric * own / model, geometric)
        tolerance = np.where(np.isnan(exact), max(fitted, 0.035), tolerance)
    elif c in sheet.expected:
        tolerance = np.where(np.isnan(exact), 0.06, tolerance)
    return np.where(np.isnan(exact), geometric, exact), tolerance


def resolve_rows(table: str, dims: dict[str, np.ndarray], lists: list[list[list[str] | None]], fits: dict[str, tuple[int, float, float]]) -> tuple[Sheet, list[np.ndarray], Choice, np.ndarray]:
    """Sheet, whether each reading could be used, the chosen cells, and whether the thickness was put right, of rows of one table."""
    cols = profiles.columns(table)
    t, changed = voted_thickness(cols, dims["t"], lists)
    was, dims = dims["t"], {**dims, "t": t}
    sheet = Sheet(table, dims, fits)
    readings = [Reading(sheet, x) for x in lists]
    texts = [np.stack([r.cell(j).text for j in range(len(cols))], 1) for r in readings]
    for own, other in zip(readings, texts[::-1], strict=True):
        own.with_other(other)
    used = [r.gain >= 0.5 * len(cols) for r in readings]
    out = Choice(len(t))
    for r in np.flatnonzero(changed):
        out.repairs[r].append(f"t: {was[r]:g} in the designation, {t[r]:g} by the columns")

    def cells(c: str) -> list[Tokens]:
        found = [r.cell(cols.index(c), np.where(u[:, None], r.put, -1)) for r, u in zip(readings, used, strict=True)]
        return found

    for c in cols:
        if c in profiles.DIMENSIONS:
            out.value[c], out.source[c] = sheet.expected[c][:, 0], np.full(len(t), 3)
        elif c not in DERIVED:
            targets, tolerance = sheet.targets(c)
            out.pick(c, cells(c), targets, np.full(len(t), tolerance))
    area = np.where(out.value["A"] > 0, out.value["A"], np.nan)
    for c in cols:
        if c not in DERIVED:
            continue
        own, tolerance = np.full(len(t), np.nan), np.full(len(t), 0.012)
        if c == "M":
            own = 0.785 * area
        elif c in RADII and RADII[c] in out.value:
            moment = out.value[RADII[c]]
            own = np.sqrt(np.where(moment > 0, moment, np.nan) / area)
        elif c.startswith("Z"):
            own, tolerance = z_targets(sheet, c, out.value)
        model, model_tolerance = sheet.targets(c)
        known = ~np.isnan(own)
        targets = np.where(known[:, None], np.concatenate([own[:, None], np.full((len(t), max(model.shape[1] - 1, 0)), np.nan)], 1), model if model.shape[1] else own[:, None])
        out.pick(c, cells(c), targets, np.where(known, tolerance, model_tolerance) + 0.004)
    out.say((out.value["M"] > 0) & (off(out.value["M"], 0.785 * area) > 0.02) & ~np.isnan(area), lambda r: f"M: {out.value['M'][r]:g} does not go with the area, {0.785 * area[r]:.3f}")
    return sheet, used, out, changed


def _tables(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, dict[str, np.ndarray]]]:
    """The rows of each table in a batch, and their dimensions."""
    names = np.array(batch.column("table").to_pylist())
    for table in dict.fromkeys(names.tolist()):
        if table in profiles.LAYOUTS:
            rows = batch.filter(pa.array(names == table))
            yield table, rows, {k: rows.column(k).to_numpy(zero_copy_only=False).astype(float) for k in "hbct"}


def calibrate(pairs: DataFrame) -> dict[str, dict[str, tuple[int, float, float]]]:
    """By table and column, from cells that both readings agree on: the convention with the least median deviation, its scale and its
    tolerance. At least three such cells are asked for; a row for each column of the layouts reaches the driver. Equal ratios are counted
    in each batch and before medians are taken, and written once for both."""

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, rows, dims in _tables(b):
                cols = profiles.columns(table)
                n, lists = len(cols), [rows.column(k) for k in ("first", "second")]
                lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
                own = np.flatnonzero(np.isin(lengths[0], (n, n + 1)) & np.isin(lengths[1], (n, n + 1)))
                if not len(own):
                    continue
                a, c = (x.flatten().take(pa.array(((np.cumsum(k) - k)[own][:, None] + np.arange(n)).ravel())) for x, k in zip(lists, lengths, strict=True))
                same = pc.fill_null(pc.equal(a, c), False)
                value = pc.if_else(same, a, pa.scalar(None, pa.string())).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
                same = same.to_numpy(zero_copy_only=False).reshape(-1, n)
                dims = {k: v[own] for k, v in dims.items()}
                if "t" in cols:
                    j = cols.index("t")
                    said = pc.match_substring_regex(a.take(pa.array(np.arange(len(own)) * n + j)), r"^\d\.\d\d$").to_numpy(zero_copy_only=False) & same[:, j]
                    dims["t"] = np.where(said, value[:, j], dims["t"])
                # Many rows are of equal dimensions.
                once, at = np.unique(np.stack([dims[k] for k in "hbct"], 1), axis=0, return_inverse=True)
                expected, found = profiles.expected(profiles.LAYOUTS[table][0], *once.T), []
                for j, col in enumerate(cols):
                    e, met = expected.get(col), same[:, j]
                    if e is None or col in profiles.DIMENSIONS or not met.any():
                        continue
                    e = e[at.ravel()[met]]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ratio = np.where(e > 0, value[met, j][:, None] / e, np.nan)
                    found += [(col, k, *np.unique(ratio[:, k][ratio[:, k] > 0], return_counts=True)) for k in range(e.shape[1])]
                many = [len(r) for *_, r, _ in found]
                if sum(many):
                    names, conventions = np.repeat([x[0] for x in found], many), np.repeat([x[1] for x in found], many)
                    yield pa.record_batch([pa.array([table] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(conventions, pa.int32()), *(pa.array(np.concatenate([x[i] for x in found]), t) for i, t in ((2, pa.float64()), (3, pa.int64())))], names=["table", "col", "convention", "ratio", "n"])

    each = pairs.select("table", "h", "b", "c", "t", "first", "second").mapInArrow(ratios, "table string, col string, convention int, ratio double, n long")
    key = ["table", "col", "convention"]
    each = stored(each.groupBy(*key, "ratio").agg(F.sum("n").alias("n")), "ratios-")
    middle = each.groupBy(*key).agg(F.percentile("ratio", F.lit(0.5), F.col("n")).alias("scale"), F.sum("n").alias("all")).where("all >= 3").drop("all")
    spread = each.join(middle, key).groupBy(*key, "scale").agg(F.percentile(F.abs(F.col("ratio") / F.col("scale") - 1), F.lit(0.5), F.col("n")).alias("spread"))
    best = spread.groupBy("table", "col").agg(F.min(F.struct("spread", "convention", "scale")).alias("m")).select("table", "col", "m.*").collect()
    out: dict[str, dict[str, tuple[int, float, float]]] = {}
    for r in best:
        out.setdefault(r.table, {})[r.col] = (r.convention, r.scale, max(0.025, 5 * r.spread))
    return out


RESOLVED = "table string, page long, row long, h double, b double, c double, t double, designation string, `values` array<double>, used array<string>, sources array<string>, notes array<string>, repairs array<string>"


def resolve(pairs: DataFrame, fits: dict[str, dict[str, tuple[int, float, float]]], names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """A row of values for each of ``paired`` that a reading could be put to: ``values`` and ``used`` (whose it is) by the layout's columns, the
    readings in use, notes of what is wrong (none: it passes) and of what was repaired."""
    owners = np.array([*names, "both", "designation", ""], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, rows, dims in _tables(b):
                lists = [rows.column(k).to_pylist() for k in ("first", "second")]
                sheet, used, chosen, _ = resolve_rows(table, dims, lists, fits.get(table, {}))
                cols, layout = sheet.cols, profiles.LAYOUTS[table][1]
                keep = np.flatnonzero(used[0] | used[1])
                values, whose = np.stack([chosen.value[c] for c in cols], 1), np.stack([chosen.source[c] for c in cols], 1)
                d = sheet.dims
                title = [" x ".join([*(f"{d[k][r]:g}" for k in ("hbc" if "c" in layout else "hb")), f"{d['t'][r]:.2f}"]) for r in keep]
                yield pa.record_batch(
                    [
                        pa.array([table] * len(keep), pa.string()), rows.column("page").take(pa.array(keep)).cast(pa.int64()), rows.column("row").take(pa.array(keep)).cast(pa.int64()),
                        *(pa.array(d[k][keep]) for k in "hbct"), pa.array(title, pa.string()),
                        pa.array([[None if np.isnan(v) else v for v in values[r].tolist()] for r in keep], pa.list_(pa.float64())),
                        pa.array([owners[whose[r]].tolist() for r in keep], pa.list_(pa.string())),
                        pa.array([[n for n, u in zip(names, used, strict=True) if u[r]] for r in keep], pa.list_(pa.string())),
                        pa.array([chosen.notes[r] for r in keep], pa.list_(pa.string())), pa.array([chosen.repairs[r] for r in keep], pa.list_(pa.string())),
                    ],
                    names=["table", "page", "row", "h", "b", "c", "t", "designation", "values", "used", "sources", "notes", "repairs"],
                )

    return dealt(pairs.select("table", "page", "row", "h", "b", "c", "t", "first", "second"), "table", "page", "row").mapInArrow(run, RESOLVED)


def settled(rows: DataFrame) -> DataFrame:
    """One row a designation: without notes before others, then the earlier one, then one that both sources read, then by all columns; and without phantoms.

    A phantom is a designation that one source alone misread: it has notes, and a row that both sources read on its page has its mass and area.
    """
    best = Window.partitionBy("table", "designation").orderBy(F.size("notes") > 0, "page", "row", -F.size("sources"), *rows.columns)
    mass = lambda name: F.coalesce(*[F.when(F.col("table") == t, F.get("values", F.lit(profiles.columns(t).index(name)))) for t in profiles.LAYOUTS])
    once = rows.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r").withColumns({"__mass": mass("M"), "__area": mass("A")})
    once = stored(once, "settled-")  # read as rows and as twins
    key = ["table", "page", "__mass", "__area"]
    twins = once.where(F.size("sources") == 2).select(*[F.col(k).alias(f"t_{k}") for k in key]).distinct()
    same = (F.size("sources") == 1) & (F.size("notes") > 0)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    return once.join(twins, same, "left_anti").drop("__mass", "__area")
