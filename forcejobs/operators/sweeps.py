"""Grids of rule parameters, and what they say of a trial."""

from __future__ import annotations

from collections.abc import Iterable

#: Most combinations of a grid unless stated.
CAP = 512


def grid(axes: dict[str, Iterable], cap: int = CAP) -> tuple[list[dict], bool]:
    """(variants, whether the cap cut them) of named axes in the order given, the first axis fastest."""
    names, values = list(axes), [list(v) for v in axes.values()]
    total = 1
    for v in values:
        total *= len(v)
    out = []
    for i in range(min(total, cap)):
        row, rest = {}, i
        for name, v in zip(names, values):
            rest, at = divmod(rest, len(v))
            row[name] = v[at]
        out.append(row)
    return out, total > cap


def label(variant: dict) -> str:
    return ",".join(f"{k}={v}" for k, v in variant.items())
