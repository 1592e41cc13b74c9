"""The queries once more, in plain SQL for DuckDB: an independent check of every operator.

The text is put together from the definitions (not from the Spark plans): a pixel relation, one
expression per channel, and one statement per family. Every result is rounded to six places.
"""

from __future__ import annotations

import math

from .plans.features import FeaturePlan

D = "CAST({} AS DOUBLE)".format


def rounded(columns: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}" for n, e in columns.items())


# --- pixels and channels ------------------------------------------------------------------------


def pixels(bands: tuple[str, ...], zero: tuple[str, ...] = ()) -> list[str]:
    """CTEs up to ``p0 (patch_id, pos, <bands>)``."""
    size = 4 * len(bands)
    spread = ", ".join(f"{'0.0' if b in zero else f'max(v) FILTER (WHERE band = {k})'} AS {b}" for k, b in enumerate(bands))
    return [
        "vecs AS (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS j FROM embeddings)",
        f"cells AS (SELECT vec_id // {size} AS patch_id, (vec_id % {size}) // 4 AS band, (vec_id % 4) * 64 + j AS pos, "
        f"floor(CAST(1000 AS DOUBLE) * (CAST(e AS DOUBLE) + CAST(1 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) AS v FROM vecs "
        f"WHERE vec_id // {size} < (SELECT count(*) // {size} FROM embeddings))",
        f"p0 AS (SELECT patch_id, CAST(pos AS BIGINT) AS pos, {spread.replace('0.0 AS', 'CAST(0 AS DOUBLE) AS')} FROM cells GROUP BY patch_id, pos)",
    ]


def pooled(bands: tuple[str, ...], scale: int, side: int = 16) -> list[str]:
    out = []
    for k in range(1, scale + 1):
        w = side >> (k - 1)
        means = ", ".join(f"avg({b}) AS {b}" for b in bands)
        out.append(f"p{k} AS (SELECT patch_id, (pos // {w} // 2) * {w // 2} + (pos % {w}) // 2 AS pos, {means} FROM p{k - 1} GROUP BY 1, 2)")
    return out


def channel(plan: FeaturePlan, name: str) -> str:
    r = plan.roles
    if name in plan.bands:
        return name
    if name == "pan":
        return f"({' + '.join(plan.bands)}) / {D(len(plan.bands))}"
    nd = lambda a, b: f"({a} - {b}) / ({a} + {b} + 1e-6)"
    pairs = {"ndvi": ("nir", "red"), "ndwi": ("green", "nir"), "ndbi": ("swir1", "nir"), "ndmi": ("nir", "swir1"), "nbr": ("nir", "swir2"), "ngrdi": ("green", "red"), "ngbdi": ("green", "blue"), "nrbdi": ("red", "blue")}
    if name in pairs:
        return nd(*(r[x] for x in pairs[name]))
    if name == "bsi":
        return f"(({r['swir1']} + {r['red']}) - ({r['nir']} + {r['blue']})) / (({r['swir1']} + {r['red']}) + ({r['nir']} + {r['blue']}) + 1e-6)"
    red, green, blue = r["red"], r["green"], r["blue"]
    return {
        "exg": f"(2 * {green} - {red} - {blue}) / ({red} + {green} + {blue} + 1e-6)",
        "saturation": f"(greatest({red}, {green}, {blue}) - least({red}, {green}, {blue})) / (greatest({red}, {green}, {blue}) + 1e-6)",
        "lightness": f"(greatest({red}, {green}, {blue}) + least({red}, {green}, {blue})) / CAST(2 AS DOUBLE)",
    }[name]


def channels(plan: FeaturePlan, names: list[str], scale: int) -> str:
    rows = " UNION ALL ".join(f"SELECT patch_id, '{c}' AS channel, pos, {channel(plan, c)} AS v FROM p{scale}" for c in names)
    return f"ch AS ({rows})"


def statement(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


# --- families: (CTEs, {measure: expression}, source) ------------------------------------------------

LINE = "OVER (PARTITION BY patch_id, channel ORDER BY pos)"
ALL = "OVER (PARTITION BY patch_id, channel)"


def _differences(n: int) -> list[str]:
    return [
        f"d0 AS (SELECT patch_id, channel, pos, (lead(v, 1) {LINE}) - v AS gx, (lead(v, {n}) {LINE}) - v AS gy FROM ch)",
        f"g AS (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM d0 WHERE pos // {n} < {n - 1} AND pos % {n} < {n - 1})",
    ]


def _orientation(n: int, bins: int) -> list[str]:
    turn = f"CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END"
    cell = f"least(CAST(floor((CASE WHEN ({turn}) >= pi() THEN ({turn}) - pi() ELSE ({turn}) END) / (pi() / {bins})) AS BIGINT), {bins - 1})"
    sums = ", ".join(f"sum(CASE WHEN cell = {b} THEN m ELSE 0 END) AS m{b}" for b in range(bins))
    total = " + ".join(f"m{b}" for b in range(bins))
    return [
        *_differences(n),
        f"o AS (SELECT patch_id, channel, m, {cell} AS cell FROM g)",
        f"os AS (SELECT patch_id, channel, {sums} FROM o GROUP BY ALL)",
        "src AS (SELECT patch_id, channel, " + ", ".join(f"m{b} / ({total} + 1e-6) AS s{b}" for b in range(bins)) + " FROM os)",
    ]


def _spectrum(n: int) -> list[str]:
    """Power of the de-meaned channel by a separable transform."""
    f = lambda k: f"(CASE WHEN {k} >= {n} / 2 THEN {k} - {n} ELSE {k} END)"
    turn = f"2 * pi() / {n}"
    return [
        f"cm AS (SELECT patch_id, channel, pos // {n} AS y, pos % {n} AS x, v - avg(v) {ALL} AS v FROM ch)",
        f"fr AS (SELECT patch_id, channel, y, k.k AS kx, sum(v * cos({turn} * k.k * x)) AS re, -sum(v * sin({turn} * k.k * x)) AS im FROM cm, (SELECT unnest(range({n})) AS k) k GROUP BY patch_id, channel, y, k.k)",
        f"fc AS (SELECT patch_id, channel, kx, k.k AS ky, sum(re * cos({turn} * k.k * y) + im * sin({turn} * k.k * y)) AS re, sum(im * cos({turn} * k.k * y) - re * sin({turn} * k.k * y)) AS im FROM fr, (SELECT unnest(range({n})) AS k) k GROUP BY patch_id, channel, kx, k.k)",
        f"pw AS (SELECT patch_id, channel, sqrt(CAST({f('kx')} * {f('kx')} + {f('ky')} * {f('ky')} AS DOUBLE)) AS r, re * re + im * im AS p FROM fc)",
    ]


def family(name: str, n: int) -> tuple[list[str], dict[str, str], str]:
    """CTEs from ``ch`` on, the measures over grouped rows of a source, and that source's clause."""
    grouped = "FROM {} GROUP BY patch_id, channel"
    if name == "moments":
        return [], {"mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)"}, grouped.format("ch")
    if name == "percentiles":
        q = {f"p{k}": f"quantile_cont(v, {k / 100})" for k in (10, 25, 50, 75, 90)}
        return [], q | {"spread": f"{q['p90']} - {q['p10']}"}, grouped.format("ch")
    if name == "gradient":
        return _differences(n), {"grad_mean": "avg(m)", "grad_std": "stddev_pop(m)"}, grouped.format("g")
    if name == "coherence":
        c = [*_differences(n), "src AS (SELECT patch_id, channel, avg(gx * gx) AS a, avg(gy * gy) AS b, avg(gx * gy) AS c FROM g GROUP BY ALL)"]
        return c, {"coherence": "sqrt((a - b) * (a - b) + 4 * c * c) / (a + b + 1e-6)"}, "FROM src"
    if name == "entropy":
        return _orientation(n, 8), {"orient_entropy": "-(" + " + ".join(f"s{b} * ln(s{b} + 1e-6)" for b in range(8)) + ")"}, "FROM src"
    if name == "histogram":
        return _orientation(n, 4), {f"orient_hist{b}": f"s{b}" for b in range(4)}, "FROM src"
    if name == "fft_peak":
        return [*_spectrum(n)], {"fft_peak": "ln(1 + max(p) / (avg(p) + 1e-6))"}, f"FROM pw WHERE r >= {n} / CAST(16 AS DOUBLE) AND r <= 3 * {n} / CAST(8 AS DOUBLE) GROUP BY patch_id, channel"
    if name == "fft_slope":
        c = [*_spectrum(n), "rp AS (SELECT patch_id, channel, round_even(r, 0) AS rb, avg(p) AS p FROM pw GROUP BY patch_id, channel, rb)"]
        return c, {"fft_slope": "regr_slope(ln(p + 1e-6), ln(rb))"}, f"FROM rp WHERE rb BETWEEN 1 AND {n // 2} GROUP BY patch_id, channel"
    if name == "hough":
        diag = math.hypot(n - 1, n - 1)
        c = [
            *_differences(n),
            f"ed AS (SELECT * FROM (SELECT *, quantile_cont(m, 0.85) {ALL} AS cut FROM g) WHERE m > cut)",
            "en AS (SELECT patch_id, channel, CAST(count(*) AS DOUBLE) AS edges FROM ed GROUP BY ALL)",
            f"vo AS (SELECT patch_id, channel, k.k AS k, greatest(0, least({math.ceil(diag)}, CAST(floor((cos(k.k * (pi() / 60)) * (pos % {n}) + sin(k.k * (pi() / 60)) * (pos // {n}) + {diag!r}) / 2) AS BIGINT))) AS cell FROM ed, (SELECT unnest(range(60)) AS k) k)",
            "pk AS (SELECT patch_id, channel, k, max(c) AS c FROM (SELECT patch_id, channel, k, cell, count(*) AS c FROM vo GROUP BY ALL) GROUP BY patch_id, channel, k)",
            f"tp AS (SELECT *, row_number() OVER (PARTITION BY patch_id, channel ORDER BY c DESC, k) AS rn FROM pk)",
            "src AS (SELECT patch_id, channel, CAST(max(c) AS DOUBLE) AS top, CAST(sum(c) FILTER (WHERE rn <= 3) AS DOUBLE) AS three FROM tp GROUP BY ALL)",
            "hs AS (SELECT * FROM (SELECT DISTINCT patch_id, channel FROM ch) LEFT JOIN src USING (patch_id, channel) LEFT JOIN en USING (patch_id, channel))",
        ]
        n_ = "(coalesce(edges, 0) + 1e-6)"
        return c, {"line_peak_frac": f"coalesce(top, 0) / {n_}", "line_peak_len": f"coalesce(top, 0) / {diag!r}", "line_top3": f"coalesce(three, 0) / {n_}"}, "FROM hs"
    if name == "harris":
        def slope(k: int, place: str) -> str:
            return f"CASE WHEN {place} = 0 THEN (lead(v, {k}) {LINE}) - v WHEN {place} = {n - 1} THEN v - (lag(v, {k}) {LINE}) ELSE ((lead(v, {k}) {LINE}) - (lag(v, {k}) {LINE})) / 2 END"

        def three(c: str, k: int, place: str) -> str:
            return f"(CASE WHEN {place} = 0 THEN {c} ELSE lag({c}, {k}) {LINE} END) + {c} + (CASE WHEN {place} = {n - 1} THEN {c} ELSE lead({c}, {k}) {LINE} END)"

        x, y, prods = f"pos % {n}", f"pos // {n}", ("xx", "yy", "xy")
        c = [
            f"h0 AS (SELECT patch_id, channel, pos, {slope(1, x)} AS gx, {slope(n, y)} AS gy FROM ch)",
            "h1 AS (SELECT patch_id, channel, pos, gx * gx AS xx, gy * gy AS yy, gx * gy AS xy FROM h0)",
            "h2 AS (SELECT patch_id, channel, pos, " + ", ".join(f"{three(p, 1, x)} AS {p}" for p in prods) + " FROM h1)",
            "h3 AS (SELECT patch_id, channel, " + ", ".join(f"({three(p, n, y)}) / 9 AS {p}" for p in prods) + " FROM h2)",
            "h4 AS (SELECT patch_id, channel, xx + yy AS t, (xx * yy - xy * xy) - CAST(0.05 AS DOUBLE) * (xx + yy) * (xx + yy) AS r FROM h3)",
            f"src AS (SELECT *, quantile_cont(t, 0.5) {ALL} AS cut FROM h4)",
        ]
        m = {"corner_frac": "CAST(count(*) FILTER (WHERE r > 0 AND t > cut) AS DOUBLE) / (CAST(count(*) FILTER (WHERE t > cut) AS DOUBLE) + 1e-6)", "corner_mag": "sum(sqrt(greatest(r, 0))) / (sum(t) + 1e-6)"}
        return c, m, grouped.format("src")
    if name == "lbp":
        ring = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
        bits = ", ".join(f"CAST(({'lead' if dy * n + dx > 0 else 'lag'}(v, {abs(dy * n + dx)}) {LINE}) > v AS INT) AS b{k}" for k, (dy, dx) in enumerate(ring))
        ones, turns = " + ".join(f"b{k}" for k in range(8)), " + ".join(f"CAST(b{k} <> b{(k + 1) % 8} AS INT)" for k in range(8))
        c = [
            f"l0 AS (SELECT patch_id, channel, pos, {bits} FROM ch)",
            f"l1 AS (SELECT patch_id, channel, CASE WHEN {turns} <= 2 THEN {ones} ELSE 9 END AS code FROM l0 WHERE pos // {n} BETWEEN 1 AND {n - 2} AND pos % {n} BETWEEN 1 AND {n - 2})",
            "src AS (SELECT patch_id, channel, " + ", ".join(f"CAST(count(*) FILTER (WHERE code = {k}) AS DOUBLE) / {D((n - 2) ** 2)} AS h{k}" for k in range(10)) + " FROM l1 GROUP BY ALL)",
        ]
        return c, {"lbp_entropy": "-(" + " + ".join(f"greatest(h{k}, 1e-12) * ln(greatest(h{k}, 1e-12))" for k in range(10)) + ")", "lbp_uniform": " + ".join(f"h{k}" for k in range(9))}, "FROM src"
    if name == "blobs":
        near = f"abs(a.pos // {n} - b.pos // {n}) <= 1 AND abs(a.pos % {n} - b.pos % {n}) <= 1"
        c = [
            f"mk AS (SELECT patch_id, channel, pos FROM (SELECT *, quantile_cont(v, 0.5) {ALL} AS cut FROM ch) WHERE v > cut)",
            f"nb AS (SELECT a.patch_id, a.channel, a.pos AS a, b.pos AS b FROM mk a JOIN mk b ON a.patch_id = b.patch_id AND a.channel = b.channel AND {near})",
            "rc AS (SELECT patch_id, channel, pos AS node, pos AS root FROM mk UNION SELECT nb.patch_id, nb.channel, nb.b, rc.root FROM rc JOIN nb ON nb.patch_id = rc.patch_id AND nb.channel = rc.channel AND nb.a = rc.node)",
            "cc AS (SELECT patch_id, channel, root, count(*) AS size FROM (SELECT patch_id, channel, node, min(root) AS root FROM rc GROUP BY patch_id, channel, node) GROUP BY patch_id, channel, root)",
            "bs AS (SELECT patch_id, channel, max(size) AS top, count(*) AS n, sum(size) AS total FROM cc GROUP BY patch_id, channel)",
            "src AS (SELECT * FROM (SELECT DISTINCT patch_id, channel FROM ch) LEFT JOIN bs USING (patch_id, channel))",
        ]
        area = D(n * n)
        return c, {"blob_largest": f"coalesce(top, 0) / {area}", "blob_count": "ln(CAST(1 AS DOUBLE) + coalesce(n, 0))", "blob_mean": f"CAST(coalesce(total, 0) AS DOUBLE) / greatest(coalesce(n, 0), 1) / {area}"}, "FROM src"
    if name == "tail":
        c = [
            f"t0 AS (SELECT *, quantile_cont(v, 0.25) {ALL} AS q1, quantile_cont(v, 0.75) {ALL} AS q3, CAST(-1 AS DOUBLE) + (pos % {n}) * ({D(2)} / {n - 1}) AS x, CAST(-1 AS DOUBLE) + (pos // {n}) * ({D(2)} / {n - 1}) AS y FROM ch)",
            "t1 AS (SELECT patch_id, channel, x, y, greatest(q1 - v, 0) AS low, greatest(v - q3, 0) AS high FROM t0)",
        ]
        out = {}
        for s in ("low", "high"):
            c.append(f"m{s} AS (SELECT patch_id, channel, sum({s}) + 1e-6 AS mass, sum({s} * x) / (sum({s}) + 1e-6) AS mx, sum({s} * y) / (sum({s}) + 1e-6) AS my FROM t1 GROUP BY ALL)")
            c.append(f"s{s} AS (SELECT patch_id, channel, sum({s} * (x - mx) * (x - mx)) / max(mass) AS xx, sum({s} * (y - my) * (y - my)) / max(mass) AS yy, sum({s} * (x - mx) * (y - my)) / max(mass) AS xy FROM t1 JOIN m{s} USING (patch_id, channel) GROUP BY patch_id, channel)")
            out |= {f"tail_aniso_{s}": f"sqrt((s{s}.xx - s{s}.yy) * (s{s}.xx - s{s}.yy) + 4 * s{s}.xy * s{s}.xy) / (s{s}.xx + s{s}.yy + 1e-6)", f"tail_spread_{s}": f"sqrt(s{s}.xx + s{s}.yy)"}
        return c, out, "FROM slow JOIN shigh USING (patch_id, channel)"
    raise KeyError(name)


def family_query(plan: FeaturePlan, name: str, names: list[str], scale: int = 0, side: int = 16) -> str:
    ctes, measures, source = family(name, side >> scale)
    body = f"SELECT CAST(patch_id AS BIGINT) AS patch_id, channel, {rounded(measures)} {source}"
    return statement([*pixels(plan.bands), *pooled(plan.bands, scale, side), channels(plan, names, scale), *ctes], body, recursive=name == "blobs")


def correlation_expr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / ((stddev_pop({a}) + 1e-6) * (stddev_pop({b}) + 1e-6))"


def vector_query(plan: FeaturePlan, side: int = 16, zero: tuple[str, ...] = ()) -> str:
    """``patch_id, pos, value`` of a whole plan: one sub-select for each family and scale."""
    parts, base = [], pixels(plan.bands, zero) + pooled(plan.bands, plan.max_scale, side)
    places: dict[tuple, list[int]] = {}
    for k, f in enumerate(plan.features):
        places.setdefault(tuple(f), []).append(k)
    for (name, scale), (targets, measures) in plan.groups.items():
        if name == "correlation":
            parts += [f"SELECT patch_id, {k} AS pos, {correlation_expr(channel(plan, a), channel(plan, b))} AS value FROM p{scale} GROUP BY patch_id" for a, b in targets for k in places["corr", scale, a, b]]
            continue
        ctes, made, source = family(name, side >> scale)
        inner = statement([channels(plan, targets, scale), *ctes], f"SELECT patch_id, channel, {', '.join(f'{made[m]} AS {m}' for m in measures)} {source}", recursive=name == "blobs")
        asked = [f"({k}, '{c}', '{m}')" for m in measures for c in targets for k in places.get((m, scale, c, None), [])]
        value = " ".join(f"WHEN '{m}' THEN i.{m}" for m in measures)
        parts.append(f"SELECT patch_id, pos, CASE measure {value} END AS value FROM ({inner}) i JOIN (VALUES {', '.join(asked)}) a(pos, channel, measure) ON i.channel = a.channel")
    body = f"SELECT CAST(patch_id AS BIGINT) AS patch_id, CAST(pos AS INT) AS pos, {rounded({'value': 'value'})} FROM ({' UNION ALL '.join(parts)})"
    return statement(base, body)


def map_query(plan: FeaturePlan, names: list[str], scale: int = 0, zero: tuple[str, ...] = ()) -> str:
    values = {c: channel(plan, c) for c in names}
    body = f"SELECT CAST(patch_id AS BIGINT) AS patch_id, CAST(pos AS INT) AS pos, {rounded(values)} FROM p{scale}"
    return statement([*pixels(plan.bands, zero), *pooled(plan.bands, scale)], body)

