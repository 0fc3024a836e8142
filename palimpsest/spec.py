"""Kinds of perceptual hashes and their thresholds."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class HashSpec:
    """A hash by name. Specs of one name are equal whatever their threshold; matches have a distance below it, strictly."""

    name: str
    threshold: float = field(compare=False)
    words: int = field(compare=False)

    def with_threshold(self, threshold: int) -> HashSpec:
        """Another threshold; zero and below keep the present one."""
        return replace(self, threshold=float(threshold)) if threshold > 0 else self


# Default thresholds, and 64-bit words of a fingerprint.
DHASH = HashSpec("dhash", 10.0, 2)
DCT = HashSpec("dct", 22.0, 1)
SPECS = {s.name: s for s in (DCT, DHASH)}


def spec_named(name: str) -> HashSpec:
    """An unknown name is logged and means dct."""
    if name not in SPECS:
        logging.getLogger(__name__).error("unknown hash %r; using dct", name)
    return SPECS.get(name, DCT)
