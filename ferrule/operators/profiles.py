"""Cold-formed profiles in many rows at once: rounded centre lines, sectorial properties, what a printed table should say.

Arrays hold a row for each profile and a column for each point of its centre line, in mm, y upwards. A profile whose parts
branch, such as an I, is a path that goes back over itself with no thickness.
"""

from __future__ import annotations

import numpy as np

#: The columns of the ten tables in printed order, the shape and the dimensions of a designation.
LAYOUTS = {
    "1": ("equal_angle", "hht", "h t Ri M A Cx Cy Ixx Iuu Ivv Rxx Ruu Rvv Zxx Ixy"),
    "2": ("unequal_angle", "hbt", "h b Ri t M A Cx Cy Ixx Iyy Iuu Ivv Rxx Ryy Rvv tan_alpha Zxx Zyy Ixy"),
    "3": ("channel", "hht", "h t Ri M A Cy Ixx Iyy Rxx Ryy Zxx Zyy X0 J Cw"),
    "4": ("channel", "hbt", "h b t Ri M A Cy Ixx Iyy Rxx Ryy Zxx Zyy X0 J Cw"),
    "5": ("lipped_channel", "hhct", "h c t Ri M A Cy Ixx Iyy Rxx Ryy Zxx Zyy X0 J Cw"),
    "6": ("lipped_channel", "hbct", "h b c t Ri M A Cy Ixx Iyy Rxx Ryy Zxx Zyy X0 J Cw"),
    "7": ("hat", "hhct", "h c t Ri M A Cy Ixx Iyy Rxx Ryy Zxx Zyy X0 J Cw"),
    "8": ("hat", "hbct", "h b c t Ri M A Cy Ixx Iyy Rxx Ryy Zxx Zyy X0 J Cw"),
    "9": ("hat", "hbct", "h b c t Ri M A Cy Ixx Iyy Rxx Ryy Zxx Zyy X0 J Cw"),
    "10": ("lipped_zed", "hbct", "M A Ixx Iyy Iuu Ivv Rvv_min tan_theta Zxx Zyy Zuu Zvv Ixy J Cw"),
}
DIMENSIONS = ("h", "b", "c", "t", "Ri")
#: Inner bend radius over thickness, and straight pieces of an arc.
BEND, PIECES = 1.5, 8


def columns(table: str) -> list[str]:
    return LAYOUTS[table][2].split()


def centreline(shape: str, h, b, c, t) -> tuple[np.ndarray, np.ndarray]:
    """Sharp centre line of profiles with outside dimensions ``h``, ``b``, lip or outstand ``c`` and thickness ``t``."""
    h, b, c, t = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (h, b, c, t)))
    zero, top, leg, lip = 0 * h, (h - t) / 2, b - t / 2, c - t / 2
    if shape in ("equal_angle", "unequal_angle"):
        return np.stack([zero, zero, leg], 1), np.stack([h - t / 2, zero, zero], 1)
    if shape == "channel":
        return np.stack([leg, zero, zero, leg], 1), np.stack([top, top, -top, -top], 1)
    flange = b - t
    if shape in ("lipped_channel", "lipped_zed"):
        low = flange if shape == "lipped_channel" else -flange
        return np.stack([flange, flange, zero, zero, low, low], 1), np.stack([top - lip, top, top, -top, -top, lip - top], 1)
    if shape == "hat":
        half = flange / 2
        return np.stack([-half - lip, -half, -half, half, half, half + lip], 1), np.stack([zero, zero, 2 * top, 2 * top, zero, zero], 1)
    raise ValueError(f"no such shape: {shape}")


def rounded(x: np.ndarray, y: np.ndarray, radius, pieces: int = PIECES) -> tuple[np.ndarray, np.ndarray]:
    """The path with an arc of ``radius`` in each corner; where a leg is too short for it, of the radius that fits. Straight corners stay."""
    p, out = x + 1j * y, [x[:, :1] + 1j * y[:, :1]]
    for k in range(1, p.shape[1] - 1):
        back, ahead, corner = p[:, k - 1] - p[:, k], p[:, k + 1] - p[:, k], p[:, k]
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = back / abs(back), ahead / abs(ahead)
            half = abs(np.angle(v / u)) / 2
            reach = np.minimum(np.asarray(radius) / np.tan(half), 0.49 * np.minimum(abs(back), abs(ahead)))
            r = reach * np.tan(half)
            centre = corner + (u + v) / abs(u + v) * r / np.sin(half)
            first, last = corner + u * reach - centre, corner + v * reach - centre
            turn = np.angle(last / first)
            arc = centre[:, None] + first[:, None] * np.exp(1j * turn[:, None] * np.arange(pieces + 1) / pieces)
        bent = (half > 5e-7) & (half < np.pi / 2 - 5e-7)
        out.append(np.where(bent[:, None], arc, corner[:, None]))
    p = np.concatenate([*out, p[:, -1:]], 1)
    return p.real, p.imag


def properties(x: np.ndarray, y: np.ndarray, t) -> dict[str, np.ndarray]:
    """Properties of thin paths; ``t`` is one thickness a row, or one for each segment.

    Area ``A``, centroid ``xc, yc``, second moments about it ``Ix, Iy, Ixy``, principal ``Iu, Iv`` and the angle ``theta`` of u, torsion ``J``, shear
    centre ``xs, ys`` and warping constant ``Cw`` from the sectorial coordinate along the path.
    """
    t = np.asarray(t, float)
    t = np.broadcast_to(t[:, None] if t.ndim == 1 else t, (x.shape[0], x.shape[1] - 1))
    length = np.hypot(np.diff(x), np.diff(y))
    area = t * length
    total = area.sum(1)

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The integral over the area of two quantities that run straight along each segment."""
        return (area * (2 * a[:, :-1] * b[:, :-1] + a[:, :-1] * b[:, 1:] + a[:, 1:] * b[:, :-1] + 2 * a[:, 1:] * b[:, 1:])).sum(1) / 6

    def mean(a: np.ndarray) -> np.ndarray:
        return (area * (a[:, :-1] + a[:, 1:])).sum(1) / 2 / total

    def sectorial(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        u, v = x - px[:, None], y - py[:, None]
        swept = np.cumsum(u[:, :-1] * v[:, 1:] - u[:, 1:] * v[:, :-1], 1)
        return np.concatenate([np.zeros((len(x), 1)), swept], 1)

    xc, yc = mean(x), mean(y)
    u, v = x - xc[:, None], y - yc[:, None]
    ix, iy, ixy = product(v, v), product(u, u), product(u, v)
    w = sectorial(xc, yc)
    wx, wy, det = product(w, v), product(w, u), ix * iy - ixy**2
    with np.errstate(divide="ignore", invalid="ignore"):
        xs, ys = xc + (iy * wx - ixy * wy) / det, yc - (ix * wy - ixy * wx) / det
    ws = sectorial(xs, ys)
    ws = ws - mean(ws)[:, None]
    middle, reach = (ix + iy) / 2, np.hypot((ix - iy) / 2, ixy)
    theta = np.where((abs(ix - iy) > 1e-9) | (abs(ixy) > 1e-9), np.arctan2(-2 * ixy, ix - iy) / 2, 0.0)
    return {"A": total, "xc": xc, "yc": yc, "Ix": ix, "Iy": iy, "Ixy": ixy, "Iu": middle + reach, "Iv": middle - reach, "theta": theta, "J": (t**3 * length).sum(1) / 3, "xs": xs, "ys": ys, "Cw": product(ws, ws)}


def sections(shape: str, h, b, c, t, bend: float = BEND) -> dict[str, np.ndarray]:
    """Properties of rounded profiles, and their outer edges and distances of the extreme fibres from the principal axes."""
    t = np.atleast_1d(np.asarray(t, float))
    sharp = centreline(shape, h, b, c, t)
    x, y = rounded(*sharp, bend * t + t / 2)
    g = properties(x, y, t)
    u, v, cos, sin = x - g["xc"][:, None], y - g["yc"][:, None], np.cos(g["theta"])[:, None], np.sin(g["theta"])[:, None]
    g["du"], g["dv"] = abs(v * cos - u * sin).max(1) + t / 2, abs(u * cos + v * sin).max(1) + t / 2
    for name, at in zip("xy", sharp, strict=True):
        g[f"{name}min"], g[f"{name}max"] = at.min(1) - t / 2, at.max(1) + t / 2
    return g


def expected(shape: str, h, b, c, t) -> dict[str, np.ndarray]:
    """What each column should say, in the tables' units of mm for dimensions and cm for the rest: an array of a row for each
    profile and a column for each convention that a table may follow, in the order in which they are tried."""
    h, b, c, t = np.broadcast_arrays(*(np.atleast_1d(np.asarray(v, float)) for v in (h, b, c, t)))
    g = sections(shape, h, b, c, t)
    area, ix, iy, iu, iv = g["A"] / 100, g["Ix"] / 1e4, g["Iy"] / 1e4, g["Iu"] / 1e4, np.maximum(g["Iv"], 1e-9) / 1e4
    left, right, low, top = (g["xc"] - g["xmin"]) / 10, (g["xmax"] - g["xc"]) / 10, (g["yc"] - g["ymin"]) / 10, (g["ymax"] - g["yc"]) / 10
    out = {"h": [h], "b": [b], "c": [c], "t": [t], "Ri": [np.round(BEND * t + 1e-9, 2)], "A": [area], "M": [0.785 * area], "J": [g["J"] / 1e4], "Cw": [g["Cw"] / 1e6]}
    out |= {"Ixx": [ix], "Iyy": [iy], "Rxx": [np.sqrt(ix / area), np.sqrt(iy / area)], "Ryy": [np.sqrt(iy / area), np.sqrt(ix / area)], "Ruu": [np.sqrt(iu / area)], "Rvv": [np.sqrt(iv / area)]}
    out["Zxx"] = [ix / top, ix / low, ix / np.maximum(top, low), iy / left, iy / right]
    out["Zyy"] = [iy / left, iy / right, iy / np.maximum(left, right), ix / top, ix / low]
    out |= {"Zuu": [iu / (g["du"] / 10)], "Zvv": [iv / (g["dv"] / 10)]}
    if shape in ("equal_angle", "unequal_angle", "lipped_zed"):
        slope = abs(np.tan(g["theta"]))
        out["tan_alpha"] = out["tan_theta"] = [slope, np.divide(1, slope, out=np.zeros_like(slope), where=slope > 0)]
        out |= {"Iuu": [iu], "Ivv": [g["Iv"] / 1e4], "Ixy": [abs(g["Ixy"]) / 1e4], "Cx": [left, low], "Cy": [low, left]}
        out["Ixx"] = [ix, iy] if shape == "equal_angle" else [ix]
    elif shape == "hat":
        out |= {"Cy": [top, low], "X0": [abs(g["ys"] - g[k]) / 10 for k in ("yc", "ymax", "ymin")]}
    else:
        out |= {"Cy": [left, low, top, right], "X0": [abs(g["xs"] - g["xc"]) / 10, abs(g["xs"]) / 10, (abs(g["xs"]) + t / 2) / 10]}
    return {k: np.stack(v, 1) for k, v in out.items()}
