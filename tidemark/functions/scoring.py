"""Score arithmetic: rounding, grades and the per-check formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Round with halves towards +infinity (-2.5 -> -2), as a BIGINT."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normal_score(x: Column) -> Column:
    """Whole score in 0..100; text that is no finite number counts as 0."""
    number = x.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(finite, round_half_up(clamp(number))).otherwise(F.lit(0).cast("bigint"))


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    )


def ratio(a: Column, b: Column, scale: int) -> Column:
    """``a / b`` rounded half up to ``scale`` decimals, 0 for an empty base."""
    factor = 10**scale
    return F.when(b > 0, F.floor(a / b * factor + 0.5) / factor).otherwise(F.lit(0.0))


def _cap(limit: float, x: Column) -> Column:
    return F.least(F.lit(float(limit)), x)


def _num(x: Column) -> Column:
    return x.cast("double")


def _base(n: Column) -> Column:
    return F.greatest(F.lit(1.0), _num(n))


# Penalty formulas by check. e/w/i are error, warning and info counts and n the
# number of files (or of the check's own unit). They must give the
# same scores as the engine being matched.
FORMULAS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "structure": lambda e, w, i, n: 100 - 15 * e - 5 * w,
    "lint": lambda e, w, i, n: 100
    - _cap(70, e * F.least(F.lit(10.0), 40 / F.greatest(e, F.lit(1.0))))
    - _cap(25, w * F.least(F.lit(2.0), 15 / F.greatest(w, F.lit(1.0)))),
    "types": lambda e, w, i, n: 100 - 5 * e,
    "react": lambda e, w, i, n: 100 - _cap(50, e / n * 200) - _cap(30, w / n * 80),
    "accessibility": lambda e, w, i, n: 100 - _cap(60, e / n * 200) - _cap(30, w / n * 100),
    "best-practices": lambda e, w, i, n: 100 - 15 * e - 8 * w - 2 * i,
    "frontend-health": lambda e, w, i, n: 100 - 25 * e - 10 * w,
    "styling": lambda e, w, i, n: 100
    - _cap(75, 25 * e)
    - F.least(4 * w, F.floor(w / n * 16 + 0.5), F.lit(45.0))
    - _cap(8, i),
    "env-validation": lambda e, w, i, n: 100 - 25 * e - 10 * w,
    "git-hygiene": lambda e, w, i, n: 100 - 30 * e - 10 * w,
    "security": lambda e, w, i, n: 100
    - _cap(70, e * F.greatest(F.lit(10.0), 50 / F.sqrt(n)))
    - _cap(25, w * F.greatest(F.lit(3.0), 20 / F.sqrt(n))),
    "html-quality": lambda e, w, i, n: 100 - 15 * e - 5 * w,
    "container-health": lambda e, w, i, n: 100 - 25 * e - 10 * w,
    "flutter": lambda e, w, i, n: 100 - 20 * e - 8 * w - _cap(20, 2 * i),
    "cloudflare-workers": lambda e, w, i, n: 100 - 15 * e - 5 * w,
    "sqlite-d1": lambda e, w, i, n: 100 - _cap(60, e / n * 500) - _cap(25, w / n * 100),
    "dead-patterns": lambda e, w, i, n: F.greatest(F.lit(15.0), 100 - 10 * w - 3 * (e + i)),
    "test-audit": lambda e, w, i, n: F.greatest(F.lit(10.0), 100 - 12 * w - 3 * (e + i)),
    "doc-coherence": lambda e, w, i, n: F.greatest(F.lit(20.0), 100 - 10 * (e + w + i)),
    "code-coherence": lambda e, w, i, n: F.greatest(F.lit(30.0), 100 - 8 * (e + w + i)),
    # Our own definition: the matched engine's source for this one is not public.
    "secrets": lambda e, w, i, n: 100 - _cap(100, e / n * 200) - _cap(20, w / n * 50),
}


def check_score(check: Column, errors: Column, warnings: Column, infos: Column, units: Column) -> Column:
    """Score of one check from its finding counts; unknown checks use the html formula."""
    e, w, i, n = _num(errors), _num(warnings), _num(infos), _base(units)
    branches = None
    for name, formula in FORMULAS.items():
        value = formula(e, w, i, n)
        branches = F.when(check == name, value) if branches is None else branches.when(check == name, value)
    return round_half_up(clamp(branches.otherwise(100 - 15 * e - 5 * w)))


def capped_sum_score(*terms: tuple[Column, float]) -> Column:
    """100 minus capped penalties: ``(penalty, cap)`` pairs."""
    score = F.lit(100.0)
    for penalty, cap in terms:
        score = score - _cap(cap, penalty)
    return round_half_up(clamp(score))


def standards_score(errors, warnings, large_penalty, files) -> Column:
    n = _base(files)
    return capped_sum_score((errors / n * 150, 40), (warnings / n * 80, 30), (large_penalty / n * 3, 80))


def type_safety_score(weight, lines) -> Column:
    return round_half_up(clamp(100 - weight / F.greatest(F.lit(100.0), _num(lines)) * 1000 * 3))


def complexity_score(long_functions, complex_functions, functions) -> Column:
    n = _base(functions)
    return round_half_up(clamp(100 - long_functions / n * 150 - complex_functions / n * 250))


def error_handling_score(empty_catch, throw_string, promises, runtime, files) -> Column:
    n = _base(files)
    return capped_sum_score(
        (empty_catch / n * 200, 40), (throw_string / n * 100, 15), (promises / n * 100, 15), (runtime / n * 100, 15)
    )


def memory_safety_score(affected, files) -> Column:
    return round_half_up(clamp(100 - affected / _base(files) * 200))


def architecture_score(cycles, gods, orphans, fan_out, connectors, modules) -> Column:
    n = _base(modules)
    return capped_sum_score(
        (cycles * F.greatest(F.lit(5.0), 30 / F.sqrt(n)), 30),
        (gods / n * 100, 15),
        (orphans / n * 50, 10),
        (fan_out / n * 80, 15),
        (connectors / n * 60, 10),
    )


def performance_score(barrels, heavy, dynamic, runtime_css, dead, files) -> Column:
    n = _base(files)
    return capped_sum_score(
        (barrels / n * 200, 15), (heavy * 8.0, 30), (dynamic * 3.0, 10), (runtime_css * 5.0, 10), (dead / n * 100, 15)
    )


def dependency_score(critical, high, moderate, major_outdated, copyleft) -> Column:
    return capped_sum_score(
        (critical * 20.0, 50), (high * 10.0, 30), (moderate * 3.0, 15), (major_outdated * 1.0, 10), (copyleft * 5.0, 15)
    )


def confusion_score(confusable, generic, collisions, abbreviations, files) -> Column:
    n = _base(files)
    return round_half_up(
        clamp(100 - (confusable / n * 200 + generic / n * 80 + collisions / n * 400 + abbreviations / n * 100))
    )


def context_score(high_token, heavy_import, sinks, files) -> Column:
    n = _base(files)
    return round_half_up(clamp(100 - (high_token / n * 150 + heavy_import / n * 100 + sinks * 3.0)))


def docs_score(readme, exports, changelog) -> Column:
    return round_half_up(readme * 0.4 + exports * 0.4 + changelog * 0.2)


def comment_score(stale, rest) -> Column:
    return round_half_up(F.greatest(F.lit(20.0), 100.0 - stale * 8 - rest * 2))


def cohesion_score(multi_concern, files) -> Column:
    return round_half_up(F.greatest(F.lit(0.0), 100 - multi_concern / _base(files) * 300))


def dead_code_score(files, deps, exports, configured) -> Column:
    strict = F.greatest(F.lit(0.0), 100 - _cap(90, files * 10.0 + deps * 8 + exports * 2))
    lenient = F.greatest(F.lit(60.0), 100 - _cap(40, files * 1.0 + deps + F.ceil(exports / 25)))
    return round_half_up(F.when(files + deps + exports == 0, 100.0).when(configured, strict).otherwise(lenient))
