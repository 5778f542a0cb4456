"""A chain of named steps with ranges, skipping and dry runs, for batch drivers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Step:
    name: str
    run: Callable[[], object]
    done: Callable[[], bool] = lambda: False


@dataclass
class Report:
    rows: list[dict] = field(default_factory=list)


def run_steps(steps: list[Step], first: str | None = None, last: str | None = None, force: bool = False, dry: bool = False) -> Report:
    """Steps in order; one whose result exists is skipped unless forced; a failing step ends the run."""
    names = [s.name for s in steps]
    lo, hi = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    report = Report()
    for i, step in enumerate(steps):
        state, began = "out of range", time.time()
        if lo <= i <= hi:
            if step.done() and not force:
                state = "skipped"
            elif dry:
                state = "would run"
            else:
                try:
                    step.run()
                    state = "done"
                except Exception as e:
                    report.rows.append({"step": step.name, "state": f"failed: {e}", "seconds": time.time() - began})
                    raise
        report.rows.append({"step": step.name, "state": state, "seconds": time.time() - began})
    return report


def preflight(checks: dict[str, bool]) -> None:
    failed = [name for name, ok in checks.items() if not ok]
    if failed:
        raise RuntimeError(f"not ready: {', '.join(failed)}")


def merged(base: dict, *overrides: dict) -> dict:
    """Nested settings, later ones winning key by key."""
    out = dict(base)
    for o in overrides:
        for k, v in o.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def the_only(candidates: list[str]) -> str:
    """The one file that a run may adopt; none or several are an error."""
    if len(candidates) != 1:
        raise ValueError(f"expected one candidate, found {len(candidates)}: {candidates}")
    return candidates[0]
