"""A fail-fast chain of steps behind a quality gate."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class GateFailed(RuntimeError):
    """The quality gate let nothing through."""


def run_steps(steps: list[tuple[str, Callable[[dict], DataFrame | None]]], gate: Callable[[], DataFrame] | None = None, gate_only: bool = False) -> dict[str, tuple[DataFrame | None, float]]:
    """{name: (result, seconds)} of the steps in order; each is given the results so far by name. The first that fails ends the chain, its exception told with the step's name.

    gate: a DataFrame of checks (name, ok); any check that is not true, or none at all, raises GateFailed before the first step. gate_only: nothing but the gate.
    """
    if gate is not None:
        checks = gate().select("name", "ok").collect()  # one row per check
        bad = [c.name for c in checks if not c.ok]
        if bad or not checks:
            raise GateFailed(f"checks failed: {', '.join(bad) or 'there is none'}")
    done: dict[str, tuple[DataFrame | None, float]] = {}
    for name, step in [] if gate_only else steps:
        began = time.monotonic()
        try:
            got = step({k: v[0] for k, v in done.items()})
        except Exception as e:
            e.add_note(f"step {name!r} failed after {time.monotonic() - began:.1f} s; {len(done)} steps before it were done")
            raise
        done[name] = (got, time.monotonic() - began)
    return done
