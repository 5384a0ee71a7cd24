"""Loss and fidelity reports."""

from __future__ import annotations

from dataclasses import dataclass, field

EXAMPLES = 64
LEVELS = ("lossless", "conditional", "approximating")


@dataclass
class LossReport:
    """Counts by category, and for each category and field one example, EXAMPLES in all."""

    counts: dict[str, int] = field(default_factory=dict)
    examples: list[tuple[str, str]] = field(default_factory=list)

    def add(self, category: str, name: str = "", count: int = 1) -> None:
        if count <= 0:
            return
        self.counts[category] = self.counts.get(category, 0) + count
        if len(self.examples) < EXAMPLES and (category, name) not in self.examples:
            self.examples.append((category, name))

    def merge(self, other: LossReport) -> LossReport:
        out = LossReport(dict(self.counts), list(self.examples))
        for category, n in other.counts.items():
            out.counts[category] = out.counts.get(category, 0) + n
        for example in other.examples:
            if len(out.examples) < EXAMPLES and example not in out.examples:
                out.examples.append(example)
        return out

    def to_dict(self) -> dict:
        return {"counts": dict(sorted(self.counts.items())), "examples": [{"category": c, "field": f} for c, f in self.examples]}


@dataclass(frozen=True)
class Fidelity:
    level: str
    reasons: tuple[str, ...] = ()

    def to_dict(self) -> dict:
        return {"level": self.level, "reasons": list(self.reasons)}


def fidelity(level: str, losses: LossReport) -> Fidelity:
    """A format's own level, or approximating once a loss is seen."""
    return Fidelity("approximating" if losses.counts else level, tuple(sorted(losses.counts))[:EXAMPLES])


def end_to_end(*parts: Fidelity) -> Fidelity:
    """The worst level and all reasons."""
    reasons = tuple(dict.fromkeys(r for p in parts for r in p.reasons))[:EXAMPLES]
    return Fidelity(max((p.level for p in parts), key=LEVELS.index), reasons)
