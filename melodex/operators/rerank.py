"""Rerank signals: column expressions of an anchor and a candidate, by name, added up by weight.

A signal takes two dictionaries of columns. New ones are registered by name; a pandas UDF's column is as good as any.
Signals of weight zero are never built, so that the plan doesn't read their inputs.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from melodex.functions.vectors import TINY, cosine, dot

Signal = Callable[[dict[str, Column], dict[str, Column]], Column]
SIGNALS: dict[str, Signal] = {}

# The default weights; tempo difference at which the tempo signal is gone.
DEFAULTS = {"artist": 0.15}
TEMPO_SPAN = 60.0


def signal(name: str) -> Callable[[Signal], Signal]:
    """Register a signal under a name."""

    def wrap(f: Signal) -> Signal:
        SIGNALS[name] = f
        return f

    return wrap


def _equal(field: str) -> Signal:
    return lambda a, c: F.when((a[field] == c[field]) & (a[field] != ""), 1.0).otherwise(0.0)


for _field in ("artist", "composer", "lyricist", "mood"):
    signal(_field)(_equal(_field))


@signal("vocal_energy")
def vocal_energy(a: dict, c: dict) -> Column:
    return F.coalesce(1 - F.abs(a["vocal_energy"] - c["vocal_energy"]), F.lit(0.0))


@signal("tempo")
def tempo(a: dict, c: dict) -> Column:
    near = 1 - F.abs(a["tempo"] - c["tempo"]) / TEMPO_SPAN
    return F.when(near.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), near))


@signal("tonnetz")
def tonnetz(a: dict, c: dict) -> Column:
    return F.coalesce(cosine(a["tonnetz"], c["tonnetz"]), F.lit(0.0))


@signal("lyric")
def lyric(a: dict, c: dict) -> Column:
    some = lambda v: F.exists(v, lambda x: F.abs(x) > TINY)
    return F.coalesce(F.when(some(a["lyric"]) & some(c["lyric"]), dot(a["lyric"], c["lyric"])), F.lit(0.0))


def rerank_score(a: dict[str, Column], c: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Sum of weight times signal over the weights that aren't zero; an unknown name is an error."""
    given = DEFAULTS if weights is None else weights
    if unknown := set(given) - set(SIGNALS):
        raise ValueError(f"no such signal: {', '.join(sorted(unknown))}")
    return sum((F.lit(w) * SIGNALS[k](a, c) for k, w in given.items() if w), F.lit(0.0))


def weights_from(pairs: list[str], defaults: dict[str, float] | None = None) -> dict[str, float]:
    """NAME=VALUE texts over the defaults, the last one winning; an unknown name is an error."""
    out = {k: 0.0 for k in SIGNALS} | DEFAULTS | (defaults or {})
    for p in pairs:
        name, _, value = p.partition("=")
        if name not in SIGNALS:
            raise ValueError(f"no such signal: {name}")
        out[name] = float(value)
    return out


def weight_overrides(text: Column, defaults: dict[str, float] | None = None) -> Column:
    """A map of all signals' weights: texts of NAME=VALUE pairs, parted by commas, over the defaults; the last one wins.

    Null or empty texts give the defaults. An unknown name, or a pair without a number, is an error.
    """
    base = {k: 0.0 for k in SIGNALS} | DEFAULTS | (defaults or {})
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p != "")
    name, value = lambda p: F.substring_index(p, "=", 1), lambda p: F.substring_index(p, "=", -1).try_cast("double")
    known = F.array(*map(F.lit, SIGNALS))
    bad = F.filter(pairs, lambda p: ~F.array_contains(known, name(p)) | ~p.contains("=") | value(p).isNull())
    given = lambda k: F.transform(F.filter(pairs, lambda p: name(p) == k), value)
    last = [F.coalesce(F.try_element_at(given(k), F.lit(-1)), F.lit(float(v))) for k, v in base.items()]
    merged = F.map_from_arrays(F.array(*map(F.lit, base)), F.array(*last))
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("no such weight: "), F.array_join(bad, ", ")))).otherwise(merged)
