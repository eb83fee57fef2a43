"""Bivariate-bicycle codes and GF(2) algebra on row masks (Python integers): planner-side, at most a few hundred rows.

H_x = [A | B] and H_z = [B^T | A^T], with A a sum of shifts of one grid and B of the other.
"""

from __future__ import annotations

from functools import cache

#: (n, l, m, exponents of A, exponents of B); A = x^a1 + y^a2 + y^a3, B = y^b1 + x^b2 + x^b3.  Fixed values.
LADDER = (
    (72, 6, 6, (3, 1, 2), (3, 1, 2)),
    (90, 15, 3, (9, 1, 2), (0, 2, 7)),
    (108, 9, 6, (3, 1, 2), (3, 1, 2)),
    (144, 12, 6, (3, 1, 2), (3, 1, 2)),
    (288, 12, 12, (3, 2, 7), (3, 1, 2)),
    (784, 28, 14, (26, 6, 8), (7, 9, 20)),
)
C18 = (18, 3, 3, (1, 0, 2), (1, 0, 2))
#: Logical Z operators of the 18-bit code, character i for coordinate i.  Fixed values.
LOGICAL_18 = ("101110001100000000", "101011110000000000", "011000010010000000", "110000100100000000")


def mask(bits: str) -> int:
    return int(bits[::-1], 2)


def shifts(l: int, m: int, exponents: tuple[int, int, int], first: str) -> list[int]:
    """Rows of the sum of one shift along ``first`` and two along the other axis."""
    out = []
    for i in range(l):
        for j in range(m):
            row = 0
            for k, e in enumerate(exponents):
                along_x = (k == 0) == (first == "x")
                a, b = ((i + e) % l, j) if along_x else (i, (j + e) % m)
                row ^= 1 << (a * m + b)
            out.append(row)
    return out


def transpose(rows: list[int], width: int) -> list[int]:
    return [sum((r >> c & 1) << i for i, r in enumerate(rows)) for c in range(width)]


@cache
def checks(code: tuple) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(H_x, H_z) as row masks."""
    n, l, m, a, b = code
    half = l * m
    left, right = shifts(l, m, a, "x"), shifts(l, m, b, "y")
    hx = tuple(p | q << half for p, q in zip(left, right))
    hz = tuple(p | q << half for p, q in zip(transpose(right, half), transpose(left, half)))
    return hx, hz


def independent(rows) -> list[int]:
    """Indices of the lexicographically first independent rows."""
    pivots: dict[int, int] = {}
    out = []
    for i, r in enumerate(rows):
        while r and r.bit_length() in pivots:
            r ^= pivots[r.bit_length()]
        if r:
            pivots[r.bit_length()] = r
            out.append(i)
    return out


def reduced(rows, width: int) -> tuple[list[int], list[int]]:
    """Reduced echelon rows, and their pivots (lowest coordinate first)."""
    rows, pivots = list(rows), []
    for c in range(width):
        k = len(pivots)
        i = next((i for i in range(k, len(rows)) if rows[i] >> c & 1), None)
        if i is None:
            continue
        rows[k], rows[i] = rows[i], rows[k]
        rows = [r ^ rows[k] if j != k and r >> c & 1 else r for j, r in enumerate(rows)]
        pivots.append(c)
    return rows[: len(pivots)], pivots


def nullspace(rows, width: int) -> list[int]:
    """One vector for each free coordinate, ascending."""
    r, pivots = reduced(rows, width)
    free = [c for c in range(width) if c not in set(pivots)]
    return [1 << f | sum(1 << p for row, p in zip(r, pivots) if row >> f & 1) for f in free]


def inverse(columns: list[int]) -> list[int]:
    """Columns of the inverse of a square matrix given by its columns; an error where they are dependent."""
    width = len(columns)
    rows = [r | 1 << width + i for i, r in enumerate(transpose(columns, width))]
    rows, pivots = reduced(rows, width)
    if len(pivots) < width:
        raise ValueError("the columns are dependent")
    return transpose([r >> width for r in rows], width)


def solve(columns: list[int], target: int) -> int:
    """The columns, as a mask, that add up to the target."""
    out = 0
    for i, c in enumerate(inverse(columns)):
        out ^= c * (target >> i & 1)
    return out


def functional_columns(code: tuple) -> tuple[list[int], list[int], int]:
    """Coordinates whose unit errors generate every selector, the selector of each, and the number of syndrome bits."""
    _, hz = checks(code)
    independent_checks = [hz[i] for i in independent(hz)]
    rows = [*independent_checks, *logical_basis(code)]
    places = selector_qubits(code)
    columns = transpose(rows, code[0])
    return places, [columns[q] for q in places], len(independent_checks)


def logical_basis(code: tuple) -> list[int]:
    """Kernel vectors of H_x, ascending by free coordinate, that extend the row space of H_z."""
    hx, hz = checks(code)
    have = [hz[i] for i in independent(hz)]
    pool = nullspace(hx, code[0])
    picked = independent([*have, *pool])
    return [pool[i - len(have)] for i in picked if i >= len(have)]


def scopes(code: tuple) -> list[tuple[int, ...]]:
    """For each coordinate, the independent X checks that hold it."""
    hx, _ = checks(code)
    rows = [hx[i] for i in independent(hx)]
    return [tuple(v for v, r in enumerate(rows) if r >> q & 1) for q in range(code[0])]


CHECKS_18 = list(checks(C18)[0])
LOGICALS_18 = [mask(x) for x in LOGICAL_18]


def selector_qubits(code: tuple) -> list[int]:
    """Coordinates whose unit errors generate every selector: first independent columns of Z checks and logicals."""
    _, hz = checks(code)
    rows = [*(hz[i] for i in independent(hz)), *logical_basis(code)]
    return independent(transpose(rows, code[0]))
