"""SQL fragments of the index model, for the equivalent queries."""

from __future__ import annotations

from heatloom import constants as C
from heatloom.operators.weights import equal_weights_map


def d(v: float) -> str:
    """A double literal."""
    return f"{float(v)!r}::double"


def stats(columns: list[str], src: str = "cells", by: str = "aoi_id", name: str = "st") -> str:
    p = ", ".join(f"quantile_cont({c}, 0.02) as lo_{c}, quantile_cont({c}, 0.98) as hi_{c}" for c in columns)
    return f"{name} as (select {by}, {p} from {src} group by {by})"


def scaled(c: str, prefix: str = "") -> str:
    return (
        f"case when {prefix}{c} is null then null when hi_{c} - lo_{c} < 1e-12 then 0.5::double "
        f"else (least(greatest({prefix}{c}, lo_{c}), hi_{c}) - lo_{c}) / (hi_{c} - lo_{c}) end"
    )


def normed(columns: list[str] = C.INDICATORS, src: str = "cells", by: str = "aoi_id", keep: str = "aoi_id, cell_id") -> str:
    """Views st and norm."""
    cols = ", ".join(f"{scaled(c)} as {c}" for c in columns)
    return f"{stats(columns, src, by)},\nnorm as (select {keep}, {cols} from {src} join st using ({by}))"


def subindex(weights: dict[str, float | str]) -> str:
    num = " + ".join(f"coalesce({c} * {w if isinstance(w, str) else d(w)}, 0)" for c, w in weights.items())
    den = " + ".join(f"case when {c} is null then 0 else {w if isinstance(w, str) else d(w)} end" for c, w in weights.items())
    return f"case when {den} > 1e-12 then ({num}) / ({den}) end"


def subindices(weights: dict[str, dict[str, float | str]] | None = None) -> str:
    weights = weights or equal_weights_map()
    return ", ".join(f"{subindex(weights[s])} as {C.SUB_INDEX_COLUMN[s]}" for s in C.SUB_INDEX_WEIGHTS)


def formula(e: str = "e", s: str = "s", ac: str = "ac") -> str:
    return f"case when {ac} is null then null else {e} * {s} / greatest({ac}, 0.01::double) end"


def minmax(c: str, over: str) -> str:
    lo, hi = f"min({c}) over ({over})", f"max({c}) over ({over})"
    return f"case when {c} is null then null when {hi} - {lo} < 1e-12 then 0.5::double else ({c} - {lo}) / ({hi} - {lo}) end"


def hvi(src: str = "cells", by: str = "aoi_id", keep: str = "aoi_id, cell_id", extra: str = "") -> str:
    """Views up to hvi: keys, normalised indicators, h_s, e, s, ac, hvi_raw, hvi."""
    return (
        f"{normed(C.INDICATORS, src, by, keep + extra)},\n"
        f"subs as (select *, {subindices()} from norm),\n"
        f"raw as (select *, {formula()} as hvi_raw from subs),\n"
        f"hvi as (select *, {minmax('hvi_raw', f'partition by {by}')} as hvi from raw)"
    )


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


def heat_index(t: str = "t2m_c", rh: str = "rh_pct") -> str:
    f = f"({t} * 9::double / 5 + 32)"
    return (
        f"case when {t} > 27::double then ((-42.379::double + 2.04901523::double * {f} + 10.14333127::double * {rh} "
        f"- 0.22475541::double * {f} * {rh} - 0.00683783::double * {f} * {f} - 0.05481717::double * {rh} * {rh} "
        f"+ 0.00122874::double * {f} * {f} * {rh} + 0.00085282::double * {f} * {rh} * {rh} "
        f"- 0.00000199::double * {f} * {f} * {rh} * {rh}) - 32) * 5 / 9 else {t} end"
    )


def dewpoint_rh(t: str, td: str) -> str:
    return (
        f"least(greatest(100::double * exp(17.625::double * {td} / (243.04::double + {td})) "
        f"/ exp(17.625::double * {t} / (243.04::double + {t})), 0), 100)"
    )


def af(t: str, mmt: str, hvi: str, beta: str, lam: float = 0.5) -> str:
    rr = f"(exp({beta} * greatest(0::double, {t} - {mmt})) * (1 + {d(lam)} * {hvi}))"
    return f"case when {hvi} is null then null else least(greatest(({rr} - 1) / {rr}, 0), 1) end"


def uniform(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"{k}::varchar" for k in keys]])
    return f"((('0x' || substr(md5({text}), 1, 8))::bigint + 0.5::double) / 4294967296::double)"


def normal(seed: int, *keys: str, hashes: int = 1) -> str:
    """``hashes``: 1, both uniform numbers come from one md5, or 2, each has one of its own."""
    text = " || '|' || ".join([f"'{seed}'", *[f"{k}::varchar" for k in keys]])
    parts = [(text, 1), (text, 9)] if hashes == 1 else [(f"({text}) || '|' || '{x}'", 1) for x in "ab"]
    a, b = (f"((('0x' || substr(md5({t}), {i}, 8))::bigint + 0.5::double) / 4294967296::double)" for t, i in parts)
    return f"(sqrt(-2::double * ln({a})) * cos({b} * 6.283185307179586::double))"


def avg_rank(c: str, over: str) -> str:
    return f"(rank() over ({over} order by {c}) + (count(*) over ({over}, {c}) - 1) / 2::double)"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    """A view of literal rows."""

    def lit(v: object) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return d(v)
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) as (values {body})"
