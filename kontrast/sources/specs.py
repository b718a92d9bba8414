"""The small grammars that name data sets, patterns and objectives."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.alphabet import IUPAC
from ..functions.measures import MEASURES
from ..operators.search import Objective


@dataclass
class Dataset:
    path: str
    contrast: str = ""
    motifs: list[str] = field(default_factory=list)
    is_control: bool = False


@dataclass
class Motif:
    spec: str
    kind: str  # file, seed or search
    name: str = ""
    insertions: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    multiplicity: int = 1


def parse_list(text: str) -> list[int]:
    """``5-7,9`` is 5, 6, 7, 9."""
    out: list[int] = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"not a list of numbers: {text}")
        lo, hi = int(m[1]), int(m[2] or m[1])
        if hi < lo:
            raise ValueError(f"a range runs backwards: {part}")
        out += range(lo, hi + 1)
    return out


def parse_dataset(text: str) -> Dataset:
    """``[NAMES:[CONTRAST:]]PATH``; NAMES are patterns that the set has, or ``control``."""
    parts = text.split(":")
    if len(parts) > 3 and "//" in text:  # a path with a scheme
        parts = [*parts[: len(parts) - 2], ":".join(parts[-2:])]
    elif len(parts) in (2, 3) and parts[-1].startswith("//"):
        parts = [*parts[:-2], ":".join(parts[-2:])]
    if len(parts) > 3 or not parts[-1]:
        raise ValueError(f"not [NAMES:[CONTRAST:]]PATH: {text}")
    names = [x for x in parts[0].split(",") if x] if len(parts) > 1 else []
    control = names == ["control"]
    return Dataset(parts[-1], parts[1] if len(parts) == 3 else "", [] if control else names, control)


def parse_motif(text: str) -> Motif:
    """``[NAME:[INSERT:]]SPEC``; SPEC is a pattern of IUPAC letters, lengths with an optional ``xN``, or else a file."""
    *head, spec = text.split(":")
    if len(head) > 2 or not spec:
        raise ValueError(f"not [NAME:[INSERT:]]SPEC: {text}")
    name, insertions = head[0] if head else "", parse_list(head[1]) if len(head) == 2 and head[1] else []
    if m := re.fullmatch(r"([\d,\-]+)(?:x(\d+))?", spec):
        return Motif(spec, "search", name, insertions, parse_list(m[1]), int(m[2] or 1))
    word = spec.lower().replace("u", "t")
    if set(word) <= set(IUPAC):
        if any(not 0 < i < len(word) for i in insertions):
            raise ValueError(f"an insertion lies outside the pattern: {text}")
        return Motif(word, "seed", name, insertions, [len(word)])
    return Motif(spec, "file", name, insertions)


def parse_objective(text: str) -> Objective:
    """``[NAME:[CONTRASTS:]]MEASURE``; CONTRASTS as ``+A-B``."""
    *head, measure = text.split(":")
    if len(head) > 2 or measure not in MEASURES:
        raise ValueError(f"not [NAME:[CONTRASTS:]]MEASURE: {text}")
    signs: dict[str, int] = {}
    if len(head) == 2 and head[1]:
        if not re.fullmatch(r"[+-]?[^+-]+([+-][^+-]+)*", head[1]):
            raise ValueError(f"not a list of signed contrasts: {head[1]}")
        signs = {m[2]: -1 if m[1] == "-" else 1 for m in re.finditer(r"([+-]?)([^+-]+)", head[1])}
    return Objective(measure, signs, motif=head[0] if head else "")


def harmonised(motifs: list[Motif], sets: list[Dataset], objectives: list[Objective]) -> tuple[list[Motif], list[Dataset], list[Objective]]:
    """Names filled in and checked, on copies: unnamed contrasts and patterns get one, each pattern an objective, and a
    contrast where no set names a pattern takes its first set as the signal of all."""
    from dataclasses import replace

    motifs = [replace(m, name=m.name or f"motif{i}") for i, m in enumerate(motifs)]
    if len({m.name for m in motifs}) < len(motifs):
        raise ValueError("two patterns have one name")
    sets = [replace(s, contrast=s.contrast or "contrast0") for s in sets]
    names = {m.name for m in motifs}
    if unknown := {x for s in sets for x in s.motifs} - names:
        raise ValueError(f"no such pattern: {', '.join(sorted(unknown))}")
    for c in {s.contrast for s in sets}:
        mine = [i for i, s in enumerate(sets) if s.contrast == c]
        if not any(sets[i].motifs for i in mine):
            free = [i for i in mine if not sets[i].is_control]
            for i in free[:1]:
                sets[i] = replace(sets[i], motifs=sorted(names))
    named = {o.motif: o for o in objectives if o.motif}
    default = next((o for o in objectives if not o.motif), Objective("mi"))
    if unknown := set(named) - names:
        raise ValueError(f"no such pattern: {', '.join(sorted(unknown))}")
    for o in [*named.values(), default]:
        if missing := set(o.contrasts) - {s.contrast for s in sets}:
            raise ValueError(f"no such contrast: {', '.join(sorted(missing))}")
    return motifs, sets, [named.get(m.name) or replace(default, motif=m.name) for m in motifs]
