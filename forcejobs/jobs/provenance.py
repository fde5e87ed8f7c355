"""Chains of rules with their parameters: the identity of a result is the hash of what made it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default chain by slot: rule and parameters, in the order in which they run.
DEFAULT = {
    "weighing": ("fixed_window", {"centre": "mean", "dispersion": "sample", "seconds": "1.0"}),
    "takeoff": ("absolute_force", {"persistence": "3", "threshold_newtons": "20.0"}),
    "onset": ("noise_relative", {"back": "3", "direction": "below_only", "k": "5.0", "span": "3"}),
    "touchdown": ("return_to_plate", {"threshold_newtons": "20.0"}),
}


def lines(slots: dict[str, tuple[str, dict[str, str]]]) -> list[tuple[int, str, str, str, str]]:
    """(depth, slot, rule, parameter, value) of every parameter of a chain; a rule without parameters is one line."""
    return [
        (depth, slot, rule, name, value)
        for depth, (slot, (rule, parameters)) in enumerate(slots.items())
        for name, value in (sorted(parameters.items()) or [("", "")])
    ]


def canonical(slots: dict[str, tuple[str, dict[str, str]]]) -> str:
    """The chain's lines as one text, sorted: the same whatever the order in which they were given."""
    return ";".join(sorted("|".join(map(str, x)) for x in lines(slots)))


def identity(slots: dict[str, tuple[str, dict[str, str]]]) -> str:
    return hashlib.sha256(canonical(slots).encode()).hexdigest()[:16]


def variants_by(conditions: dict[str, Column], slots: dict = DEFAULT) -> tuple[Column, dict[str, dict]]:
    """(id of the chain that ran for a row, chain of every id): a slot whose condition fails ran no rule.

    conditions name, for some slots, whether the rule of the slot gave an answer.
    """
    names, chains, out = list(conditions), {}, F.lit(None).cast("string")
    for bits in range(1 << len(names)):
        held = [bool(bits >> i & 1) for i in range(len(names))]
        own = {s: ("declined", {}) if s in names and not held[names.index(s)] else v for s, v in slots.items()}
        chains[identity(own)] = own
        test = F.lit(True)
        for name, yes in zip(names, held):
            test = test & (conditions[name] == F.lit(yes))
        out = F.when(test, identity(own)).otherwise(out)
    return out, chains
