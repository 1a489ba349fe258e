"""The template tree of one host of bounded size, grown and merged in its task; ``url_filters`` states the method."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable

#: A segment that is a number or a long hexadecimal name, and a file ending.
VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F-]{16,})(?:\.[A-Za-z0-9]{1,5})?"
ENDING = r"(\.[A-Za-z0-9]{1,5})"
_variable, _ending = re.compile(VARIABLE + r"\Z"), re.compile(ENDING + r"\Z")


def differ(good: int, bad: int, g: int, b: int, host_purity: float, strength: float, z: float) -> bool:
    """Whether a template's purity lies significantly over that of the branch with the pooled counts ``g`` and ``b``."""
    w, v = good + bad + strength, g + b + strength
    p, q = (good + strength * host_purity) / w, (g + strength * host_purity) / v
    pool = (p * w + q * v) / (w + v)
    return p - q > z * math.sqrt(max(pool * (1 - pool), 0.0) * (1 / w + 1 / v))


def ending(segment: str) -> str:
    found = _ending.search(segment)
    return found[0] if found else ""


def grow(segments: list[list[str]], most: int) -> list[str]:
    """The template of each path of a host."""
    out = [""] * len(segments)
    live = [list(range(len(segments)))]  # paths of one template so far
    level = 0
    while live:
        after: list[list[int]] = []
        for members in live:
            members = [i for i in members if len(segments[i]) > level]
            if len(members) == 1:
                i = members[0]
                out[i] += "".join("/*" + ending(s) if _variable.match(s) else "/" + s for s in segments[i][level:])
                continue
            kinds = {segments[i][level] for i in members}
            wild = kinds if len(kinds) > most else {s for s in kinds if _variable.match(s)}
            endings = {ending(s) for s in wild}
            step = {s: "/*" + (ending(s) if len(endings) <= most else "") if s in wild else "/" + s for s in kinds}
            groups: dict[str, list[int]] = defaultdict(list)
            for i in members:
                groups[step[segments[i][level]]].append(i)
            for text, below in groups.items():
                for i in below:
                    out[i] += text
                after.append(below)
        live, level = [g for g in after if g], level + 1
    return out


def merge(counts: dict[str, tuple[int, int]], host_purity: float, strength: float, z: float) -> dict[str, float]:
    """Purity of each template, that of its merged branch."""

    def smooth(g: int, b: int) -> float:
        return (g + strength * host_purity) / (g + b + strength)

    steps = {t: [s for s in t.split("/") if s] for t in counts}
    purity: dict[str, float] = {}
    live, level = [list(counts)], 0
    while live:
        after = []
        for branch in live:
            ended = [t for t in branch if len(steps[t]) == level]
            g, b = (sum(counts[t][k] for t in ended) for k in (0, 1))
            purity |= dict.fromkeys(ended, smooth(g, b))
            below: dict[str, list[str]] = defaultdict(list)
            for t in branch:
                if len(steps[t]) > level:
                    below[steps[t][level]].append(t)
            after += _branches({s: (tuple(sum(counts[t][k] for t in ts) for k in (0, 1)), ts) for s, ts in below.items()}, smooth, host_purity, strength, z)
        live, level = after, level + 1
    return purity


def _branches(children: dict, smooth: Callable[[int, int], float], host_purity: float, strength: float, z: float) -> list[list[str]]:
    """Templates below the children of one branch, put together where the children are alike."""
    out = []
    for kind in {s if s.startswith("*") else "+" for s in children}:
        mine = [(smooth(*c), s, *c, ts) for s, (c, ts) in children.items() if (s if s.startswith("*") else "+") == kind]
        runs: list[list] = []
        for _, _, good, bad, ts in sorted(m for m in mine if m[2] + m[3]):
            if not runs or differ(good, bad, runs[-1][0], runs[-1][1], host_purity, strength, z):
                runs.append([0, 0, []])
            runs[-1][0] += good
            runs[-1][1] += bad
            runs[-1][2] += ts
        runs = runs or [[0, 0, []]]
        near = min(runs, key=lambda r: abs(smooth(r[0], r[1]) - host_purity))
        for m in mine:
            if not m[2] + m[3]:
                near[2] += m[4]  # without labels: to the branch nearest to the host
        out += [r[2] for r in runs]
    return out


def verdicts(paths: list[str], good: list[int], bad: list[int], prior: float, most: int, strength: float, z: float) -> list[tuple[str, float]]:
    """(template, purity) of each path of a host."""
    found = grow([[s for s in p.split("/") if s] for p in paths], most)
    counts: dict[str, tuple[int, int]] = {}
    for t, g, b in zip(found, good, bad):
        have = counts.get(t, (0, 0))
        counts[t] = (have[0] + g, have[1] + b)
    host_purity = (sum(good) + strength * prior) / (sum(good) + sum(bad) + strength)
    purity = merge(counts, host_purity, strength, z)
    return [(t, purity[t]) for t in found]
