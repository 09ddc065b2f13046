"""Settings of a deployment, resolved on the driver before a plan is made."""

from __future__ import annotations

from collections.abc import Mapping


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with the values of ``over`` at the leaves; sections that only one has are kept."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), Mapping) and isinstance(over.get(k), Mapping) else over.get(k, base.get(k)) for k in [*base, *[k for k in over if k not in base]]}


def faults(patch: Mapping, allowed: Mapping, shares: frozenset = frozenset(), at: str = "") -> list[str]:
    """Why a patch can't be taken: unknown keys, other kinds of values, numbers below zero, shares above one."""
    found = []
    for key, value in patch.items():
        name = f"{at}{key}"
        if key not in allowed:
            found.append(f"{name}: unknown")
        elif isinstance(allowed[key], Mapping):
            found += faults(value, allowed[key], shares, f"{name}.") if isinstance(value, Mapping) else [f"{name}: a section is needed"]
        elif isinstance(allowed[key], bool) != isinstance(value, bool) or not isinstance(value, (int, float) if isinstance(allowed[key], (int, float)) else type(allowed[key])):
            found.append(f"{name}: {type(allowed[key]).__name__} is needed")
        elif isinstance(value, (int, float)) and not isinstance(value, bool) and value < 0:
            found.append(f"{name}: below zero")
        elif name in shares and value > 1:
            found.append(f"{name}: above one")
    return found


def out_of_order(values: Mapping[str, float], names: list[str]) -> list[str]:
    """Neighbours among ``names`` whose values don't rise."""
    return [f"{a} must be below {b}" for a, b in zip(names, names[1:], strict=False) if values[a] >= values[b]]


def sees_plates(role: str, permissions: Mapping[str, set], masked_roles: set) -> bool:
    """Whether a role may see plates: it has the permission, and the settings don't mask it."""
    return "plates:raw" in permissions.get(role, set()) and role not in masked_roles
