"""SQL for the registered interval queries, written independently of the Spark plans."""

from __future__ import annotations

from spanforge.plans.fixtures import FEATURES, K_SERIES, sql_views

VIEWS = sql_views()


def _with(views: str, *ctes: tuple[str, str], final: str) -> str:
    need = views.split()
    if "iv_dirty" in need and "iv_part" not in need:
        need.insert(0, "iv_part")
    parts = [(v, VIEWS[v]) for v in need] + list(ctes)
    return "with " + ",\n".join(f"{n} as ({q})" for n, q in parts) + "\n" + final


def r6(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 as {name}"


def _cols(view: str) -> list[tuple[str, str]]:
    return [(f"{f}_lower", f"{f}_upper") for f in FEATURES[view]]


def _d(p, q, a="a", b="b"):
    return f"({a}.{p[0]} - {b}.{q[0]})", f"({a}.{p[1]} - {b}.{q[1]})"


def distance(name: str, ps, qs=None, a="a", b="b", eps=False) -> str:
    qs = qs or ps
    gaps = [_d(p, q, a, b) for p, q in zip(ps, qs)]
    squares = " + ".join(f"{x} * {x} + {y} * {y}" for x, y in gaps)
    norm = lambda t, cs: " + ".join(f"{t}.{lo} * {t}.{lo} + {t}.{up} * {t}.{up}" for lo, up in cs)
    dot = " + ".join(f"{a}.{p[k]} * {b}.{q[k]}" for p, q in zip(ps, qs) for k in (0, 1))
    return {
        "hausdorff": " + ".join(f"greatest(abs{x}, abs{y})" for x, y in gaps),
        "euclidean": f"sqrt({squares}{' + 1e-16' if eps else ''})",
        "euclidean_optimized": f"sqrt(greatest({norm(a, ps)} + {norm(b, qs)} - 2 * ({dot}), 0.0) + 1e-16)",
        "manhattan": " + ".join(f"abs{x} + abs{y}" for x, y in gaps),
        "chebyshev": f"greatest({', '.join(f'abs{g}' for pair in gaps for g in pair)})",
        "cosine": f"case when sqrt({norm(a, ps)}) * sqrt({norm(b, qs)}) = 0 then 1.0 else 1 - ({dot}) / (sqrt({norm(a, ps)}) * sqrt({norm(b, qs)})) end",
    }[name]


def similarity(name: str, ps, qs=None, a="a", b="b") -> str:
    qs = qs or ps
    out = []
    for p, q in zip(ps, qs):
        la, ua, lb, ub = f"{a}.{p[0]}", f"{a}.{p[1]}", f"{b}.{q[0]}", f"{b}.{q[1]}"
        i = f"greatest(0.0, least({ua}, {ub}) - greatest({la}, {lb}))"
        wa, wb = f"({ua} - {la})", f"({ub} - {lb})"
        u = f"({wa} + {wb} - {i})"
        safe = lambda n, d: f"(case when {d} > 0 then ({n}) / ({d}) else 0.0 end)"
        ra, rb = safe(i, f"({i} + greatest(0.0, {wa} - {i}))"), safe(i, f"({i} + greatest(0.0, {wb} - {i}))")
        gap, dom = f"greatest(0.0, greatest({la}, {lb}) - least({ua}, {ub}))", f"(greatest({ua}, {ub}) - least({la}, {lb}))"
        out.append(
            {
                "jaccard": safe(i, u),
                "dice": safe(f"2 * {i}", f"({wa} + {wb})"),
                "bidirectional_min": f"least({ra}, {rb})",
                "bidirectional_prod": f"{ra} * {rb}",
                "hedjazi": f"(case when {u} > 0 and {dom} > 0 then 0.5 * ({i} / {u} + 1 - {gap} / {dom}) else 0.0 end)",
            }[name]
        )
    return f"({' + '.join(out)}) / {len(out)}"


def _pairs(view: str, value: str) -> str:
    return _with(view, final=f"select a.row_id as i, b.row_id as j, {r6(value, 'value')} from {view} a join {view} b on a.row_id < b.row_id")


def _stats(view: str, *stats: tuple[str, str]) -> str:
    """One row with name_feature per statistic; {lo}, {up} stand for the bounds."""
    return "select " + ", ".join(f"{s.format(lo=lo, up=up)} as {n}_{f}" for f, (lo, up) in zip(FEATURES[view], _cols(view)) for n, s in stats) + f" from {view}"


def _projected(view: str, lower: str, upper: str, stats=(), extra: str = "") -> str:
    cols = []
    for f, (lo, up) in zip(FEATURES[view], _cols(view)):
        cols += [r6(lower.format(lo=lo, up=up, f=f), lo), r6(upper.format(lo=lo, up=up, f=f), up)]
    ctes = [("s", _stats(view, *stats))] if stats else []
    return _with(view, *ctes, final=f"select row_id, {', '.join(cols)} from {view}{', s' if stats else ''} {extra}")


MM = (("mn", "least(min({lo}), min({up}))"), ("mx", "greatest(max({lo}), max({up}))"))
ZS = (("mu", "avg(({lo} + {up}) / 2)"), ("sd", "stddev_samp(({lo} + {up}) / 2)"))
MW = (("m0", "min(({lo} + {up}) / 2)"), ("m1", "max(({lo} + {up}) / 2)"), ("w0", "min({up} - {lo})"), ("w1", "max({up} - {lo})"))
RQ = (("q1", "quantile_cont({lo}, 0.05)"), ("q2", "quantile_cont({up}, 0.95)"))


def _scaled(view: str, name: str = "x") -> list[tuple[str, str]]:
    cols = ", ".join(f"({c} - mn_{f}) / (mx_{f} - mn_{f}) as {c}" for f, pair in zip(FEATURES[view], _cols(view)) for c in pair)
    return [("s", _stats(view, *MM)), (name, f"select row_id, {cols} from {view}, s")]


def _long(view: str) -> str:
    return " union all ".join(f"select row_id, {i} as dim, '{f}' as feature, {lo} as lower, {up} as upper from {view}" for i, (f, (lo, up)) in enumerate(zip(FEATURES[view], _cols(view))))


def _assign(rows: str, centres: str, cols, name: str) -> tuple[str, str]:
    d = distance("euclidean", cols, a="x", b="c", eps=True)
    return name, f"select row_id, cluster from (select x.row_id, c.cluster, row_number() over (partition by x.row_id order by {d}, c.cluster) as n from {rows} x, {centres} c) where n = 1"


def _lloyd(steps: int, k: int = 3):
    view = "iv_supplier"
    cols = _cols(view)
    flat = [c for p in cols for c in p]
    ctes = _scaled(view)
    ctes.append(("c0", f"select (row_number() over (order by row_id) - 1) as cluster, {', '.join(flat)} from x order by row_id limit {k}"))
    ctes.append(_assign("x", "c0", cols, "a0"))
    for i in range(1, steps + 1):
        mean = ", ".join(f"avg(x.{c}) as {c}" for c in flat)
        ctes.append((f"m{i}", f"select a.cluster, {mean} from x join a{i - 1} a using (row_id) group by a.cluster"))
        ctes.append((f"c{i}", f"select p.cluster, {', '.join(f'coalesce(m.{c}, p.{c}) as {c}' for c in flat)} from c{i - 1} p left join m{i} m using (cluster)"))
        ctes.append(_assign("x", f"c{i}", cols, f"a{i}"))
    return view, cols, flat, ctes


def _fuzzy():
    view = "iv_user"
    cols = _cols(view)
    flat = [c for p in cols for c in p]
    ctes = _scaled(view)
    ctes.append(("c", f"select (row_number() over (order by row_id) - 1) as cluster, {', '.join(flat)} from x order by row_id limit 2"))
    per = [f"sqrt(pow(x.{lo} - c.{lo}, 2) + pow(x.{up} - c.{up}, 2))" for lo, up in cols]
    ctes.append(("d", f"select x.row_id, c.cluster, {', '.join(f'{p} as d{j}' for j, p in enumerate(per))}, {' + '.join(per)} as t from x, c"))
    ctes.append(("z", "select row_id, min(cluster) as first_zero from d where t = 0 group by row_id"))
    ctes.append(
        (
            "u",
            "select d.*, case when z.first_zero is not null then (case when d.cluster = z.first_zero then 1.0 else 0.0 end) "
            "else 1.0 / ((select sum(pow(d.t / (o.t + 1e-16), 2.0)) from d o where o.row_id = d.row_id) + 1e-16) end as u from d left join z using (row_id)",
        )
    )
    return view, flat, ctes


def _fuzzy_rounds(rounds: int, adaptive: bool) -> str:
    """Memberships after some rounds from u0 = (row_id % 3 + 1) / 4, two clusters side by side."""
    view = "iv_user"
    cols = _cols(view)
    flat = [c for p in cols for c in p]
    ctes = [*_scaled(view), ("u0", "select row_id, (row_id % 3 + 1) / 4.0::double as u0, 1 - (row_id % 3 + 1) / 4.0::double as u1 from x")]
    for i in range(1, rounds + 1):
        mean = ", ".join(f"sum(u{k} * u{k} * x.{c}) / (sum(u{k} * u{k}) + 1e-16) as c{k}_{c}" for k in (0, 1) for c in flat)
        ctes.append((f"c{i}", f"select {mean} from x join u{i - 1} using (row_id)"))
        gap = ", ".join(f"sqrt(pow({lo} - c{k}_{lo}, 2) + pow({up} - c{k}_{up}, 2)) as d{k}_{j}" for k in (0, 1) for j, (lo, up) in enumerate(cols))
        ctes.append((f"d{i}", f"select row_id, {gap} from x, c{i}"))
        logs = ", ".join(f"ln(sum(u{k} * u{k} * d{k}_{j} * d{k}_{j}) + 1e-16) as l{k}_{j}" for k in (0, 1) for j in (0, 1))
        weight = ", ".join(f"least(1e6, greatest(1e-6, exp((l{k}_0 + l{k}_1) / 2 - l{k}_{j})))" + f" as w{k}_{j}" if adaptive else f"1.0::double as w{k}_{j}" for k in (0, 1) for j in (0, 1))
        ctes.append((f"w{i}", f"select {weight} from (select {logs} from d{i} join u{i - 1} using (row_id))"))
        whole = ", ".join(f"d{k}_0 * w{k}_0 + d{k}_1 * w{k}_1 as t{k}" for k in (0, 1))
        share = lambda a, b: f"case when least(t0, t1) = 0 then (case when t{a} = 0 and ({a} = 0 or t0 > 0) then 1.0 else 0.0 end) else 1.0 / (pow(t{a} / (t{a} + 1e-16), 2) + pow(t{a} / (t{b} + 1e-16), 2) + 1e-16) end as u{a}"
        ctes.append((f"u{i}", f"select row_id, {share(0, 1)}, {share(1, 0)} from (select row_id, {whole} from d{i}, w{i})"))
    return _with(view, *ctes, final=f"select row_id, {r6('u0', 'u0')}, {r6('u1', 'u1')} from u{rounds}")


def _labelled():
    view = "iv_supplier"
    cols = _cols(view)
    flat = [c for p in cols for c in p]
    ctes = _scaled(view)
    ctes.append(("l", f"select *, row_id % 3 as cluster from x"))
    ctes.append(("c", f"select cluster, count(*) as n, {', '.join(f'avg({c}) as {c}' for c in flat)} from l group by cluster"))
    return view, cols, flat, ctes


def _merged(linkage: str, final: str, k: int) -> str:
    """Merges the closest two clusters until ``k`` are left; a cluster is named by its smallest row.

    m: step, row, cluster. Linkages by their definitions over rows, not by updates.
    """
    view = "iv_nation"
    cols = _cols(view)
    value = {"single": "min(d.d)", "complete": "max(d.d)", "average": "avg(d.d)"}.get(linkage)
    if value:
        best = f"select a.c as ca, b.c as cb, {value} as v from m a join m b on a.c < b.c join d on d.i = a.r and d.j = b.r group by a.c, b.c"
    else:
        flat = [c for p in cols for c in p]
        mean = ", ".join(f"avg(x.{c}) as {c}" for c in flat)
        middle = f"(select m.c, count(*) as n, {mean} from m join x on x.row_id = m.r group by m.c)"
        square = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in flat)
        best = f"select a.c as ca, b.c as cb, 2.0 * a.n * b.n / (a.n + b.n) * ({square}) as v from {middle} a join {middle} b on a.c < b.c"
    dist = f"select a.row_id as i, b.row_id as j, {distance('euclidean', cols, eps=True)} as d from x a join x b on a.row_id <> b.row_id"
    step = f"select m.step + 1, m.r, case when m.c = p.cb then p.ca else m.c end from m, ({best} order by v, ca, cb limit 1) p where m.step < (select count(*) from x) - {k}"
    ctes = [(view, VIEWS[view]), *_scaled(view), ("d", dist), ("m(step, r, c)", f"select 0, row_id, row_id from x union all {step}")]
    return "with recursive " + ",\n".join(f"{n} as ({q})" for n, q in ctes) + "\n" + final


def statements() -> dict[str, str]:
    o: dict[str, str] = {}
    sup = _cols("iv_supplier")
    for n in ("hausdorff", "euclidean", "euclidean_optimized", "manhattan", "chebyshev", "cosine"):
        o[f"pair_{n}"] = _pairs("iv_supplier", distance(n, sup))
    # Scaled first: with large norms the difference of squares cancels, differently in each engine.
    o["pair_euclidean_optimized"] = _with("iv_supplier", *_scaled("iv_supplier"), final=f"select a.row_id as i, b.row_id as j, {r6(distance('euclidean_optimized', sup), 'value')} from x a join x b on a.row_id < b.row_id")
    for n in ("jaccard", "dice", "bidirectional_min", "bidirectional_prod", "hedjazi"):
        o[f"pair_{n}"] = _pairs("iv_supplier", similarity(n, sup))
    nat = _cols("iv_nation")
    square = lambda v, diag: _with("iv_nation", final=f"select a.row_id as i, b.row_id as j, case when a.row_id = b.row_id then {diag} else {r6(v, 'x').removesuffix(' as x')} end as value from iv_nation a, iv_nation b")
    o["matrix_distance"] = square(distance("hausdorff", nat), "0.0")
    o["matrix_similarity"] = square(similarity("jaccard", nat), "1.0")
    o["condensed_euclidean"] = _pairs("iv_nation", distance("euclidean", nat, eps=True))
    cross = lambda v: _with("iv_nation iv_supplier", final=f"select a.row_id as i, b.row_id as j, {r6(v, 'value')} from iv_nation a, iv_supplier b")
    o["cross_distance"] = cross(distance("manhattan", nat, sup[:2]))
    o["cross_similarity"] = cross(similarity("hedjazi", nat, sup[:2]))
    o["sim_to_dist"] = _pairs("iv_nation", f"1 - ({similarity('dice', nat)})")
    o["dist_to_sim"] = _pairs("iv_nation", f"1 / (1 + ({distance('manhattan', nat)}))")

    one = lambda c: "case when mx_{f} = mn_{f} then 0.0 else ({" + c + "} - mn_{f}) / (mx_{f} - mn_{f}) end"
    o["norm_minmax"] = _projected("iv_dirty", one("lo"), one("up"), MM)
    wide = lambda c: "-1 + ({" + c + "} - mn_{f}) * 2.0 / (mx_{f} - mn_{f})"
    o["norm_minmax_range"] = _projected("iv_user", wide("lo"), wide("up"), MM)
    mid, half = "(({lo} + {up}) / 2 - mu_{f}) / sd_{f}", "({up} - {lo}) / (2 * sd_{f})"
    both = lambda v, c: "case when {lo} is not null and {up} is not null then " + v + " else {" + c + "} end"
    o["norm_zscore"] = _projected("iv_dirty", both(f"{mid} - {half}", "lo"), both(f"{mid} + {half}", "up"), ZS)
    m = "(case when m1_{f} > m0_{f} then (({lo} + {up}) / 2 - m0_{f}) / (m1_{f} - m0_{f}) else 0 end)"
    w = "(case when w1_{f} > w0_{f} then ({up} - {lo} - w0_{f}) / (w1_{f} - w0_{f}) else 0 end)"
    o["norm_midwidth"] = _projected("iv_user", f"{m} - {w} / 2", f"{m} + {w} / 2", MW)
    clip = lambda c: "case when {" + c + "} is not null then least(greatest(({" + c + "} - q1_{f}) / (q2_{f} - q1_{f}), 0.0), 1.0) end"
    o["norm_robust"] = _projected("iv_dirty", clip("lo"), clip("up"), RQ)
    for n in ("inv_minmax", "inv_zscore", "inv_midwidth"):
        o[n] = _projected("iv_user", "{lo}", "{up}")
    back = lambda c: "least(greatest({" + c + "}, q1_{f}), q2_{f})"
    o["inv_robust"] = _projected("iv_user", back("lo"), back("up"), RQ)

    v = "iv_dirty"
    feats = list(zip(FEATURES[v], _cols(v)))
    o["inverted_details"] = _with(v, ("l", _long(v)), final="select row_id as row, feature, feature || '_lower' as lower_column, feature || '_upper' as upper_column, round(lower, 6) + 0.0 as lower_value, round(upper, 6) + 0.0 as upper_value, round(lower - upper, 6) + 0.0 as difference from l where lower > upper + 1e-10")
    o["inverted_by_feature"] = _with(v, ("l", _long(v)), final="select feature, (count(*) filter (where lower > upper + 1e-10))::bigint as n_inverted from l group by feature")
    bad = " or ".join(f"coalesce({lo} > {up} + 1e-10, false)" for _, (lo, up) in feats)
    o["inverted_rows"] = _with(v, final=f"select row_id as row from iv_dirty where {bad}")
    inv = "coalesce({lo} > {up} + 1e-10, false)"
    o["fix_swap"] = _projected(v, "case when " + inv + " then {up} else {lo} end", "case when " + inv + " then {lo} else {up} end")
    o["fix_remove"] = _projected(v, "{lo}", "{up}", extra=f"where not ({bad})")
    o["fix_set_nan"] = _projected(v, "case when not " + inv + " then {lo} end", "case when not " + inv + " then {up} end")
    o["missing_details"] = _with(v, ("l", _long(v)), final="select row_id as row, feature, lower is null as lower_missing, upper is null as upper_missing, case when lower is null and upper is null then 'both' when lower is null then 'lower' else 'upper' end as missing_type from l where lower is null or upper is null")
    o["missing_by_feature"] = _with(v, ("l", _long(v)), final="select feature, (count(*) filter (where lower is null or upper is null))::bigint as n_missing from l group by feature")
    o["drop_rows"] = _projected(v, "{lo}", "{up}", extra="where " + " and ".join(f"{c} is not null" for _, p in feats for c in p))
    for n, s in (("fill_mean", "avg({c})"), ("fill_median", "quantile_cont({c}, 0.5)")):
        o[n] = _projected(v, "coalesce({lo}, a_{f})", "coalesce({up}, b_{f})", (("a", s.replace("{c}", "{lo}")), ("b", s.replace("{c}", "{up}"))))
    mode = "(select {c} from iv_dirty where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
    o["fill_mode"] = _projected(v, "coalesce({lo}, " + mode.replace("{c}", "{lo}") + ")", "coalesce({up}, " + mode.replace("{c}", "{up}") + ")")
    o["fill_forward"] = _projected(v, "last_value({lo} ignore nulls) over (order by row_id rows between unbounded preceding and current row)", "last_value({up} ignore nulls) over (order by row_id rows between unbounded preceding and current row)")
    o["fill_backward"] = _projected(v, "first_value({lo} ignore nulls) over (order by row_id rows between current row and unbounded following)", "first_value({up} ignore nulls) over (order by row_id rows between current row and unbounded following)")
    o["fill_custom"] = _projected(v, "coalesce({lo}, 1.5)", "coalesce({up}, 1.5)")
    for n, s in (("mean", "avg({c})"), ("median", "quantile_cont({c}, 0.5)")):
        st = (("m", s.replace("{c}", "({lo} + {up}) / 2")), ("w", s.replace("{c}", "{up} - {lo}")))
        o[f"impute_joint_{n}"] = _projected(
            v,
            "case when {lo} is null and {up} is null then m_{f} - w_{f} / 2 when {lo} is null then {up} - w_{f} else {lo} end",
            "case when {lo} is null and {up} is null then m_{f} + w_{f} / 2 when {up} is null then {lo} + w_{f} else {up} end",
            st,
        )

    o["to_long"] = _with("iv_part", ("l", _long("iv_part")), final="select row_id, dim, feature, round(lower, 6) + 0.0 as lower, round(upper, 6) + 0.0 as upper from l")
    o["nested"] = _with("iv_supplier", final="select row_id, 3::bigint as n, round(price_upper, 6) + 0.0 as second_upper from iv_supplier")
    o["midpoints"] = _with("iv_part", final="select row_id, " + ", ".join(f"{r6(f'({f}_lower + {f}_upper) / 2', f + '_mid')}, {r6(f'{f}_upper - {f}_lower', f + '_width')}" for f in FEATURES["iv_part"]) + " from iv_part")
    stat = lambda c: f"select '{c}' as bound, count({c}) as n, round(avg({c}), 4) + 0.0 as mean, round(stddev_samp({c}), 4) + 0.0 as std, round(min({c}), 4) + 0.0 as min, " + ", ".join(f"round(quantile_cont({c}, {q}), 4) + 0.0 as q{int(100 * q)}" for q in (0.25, 0.5, 0.75)) + f", round(max({c}), 4) + 0.0 as max from iv_user"
    o["describe"] = _with("iv_user", final=" union all ".join(stat(c) for p in _cols("iv_user") for c in p))

    o["csv_round_trip"] = _projected("iv_part", "{lo}", "{up}")
    o["parquet_round_trip"] = o["ignored"] = _projected(v, "{lo}", "{up}")
    o["frame_facts"] = _with("iv_user", final="select count(*) as n_rows, 5::bigint as n_columns, 2::bigint as n_features, count(*) as n_copied from iv_user")
    o["damage"] = _with(
        v, ("l", _long(v)),
        ("x", "select row_id, lower > upper + 1e-10 as bad, lower is null or upper is null as gone from l"),
        final="select bool_or(coalesce(bad, false)) as has_inverted, (count(*) filter (where bad))::bigint as total_inverted, (count(distinct row_id) filter (where bad))::bigint as inverted_rows, bool_or(gone) as has_missing, (count(*) filter (where gone))::bigint as total_missing, (count(*) filter (where gone))::bigint as missing_rows from x",
    )
    whole = "where " + " and ".join(f"{c} is not null" for _, p in feats for c in p)
    o["repaired"] = _projected(v, "case when {lo} > {up} + 1e-10 then {up} else {lo} end", "case when {lo} > {up} + 1e-10 then {lo} else {up} end", extra=whole)
    o["impute_joint_remove"] = _projected(v, "{lo}", "{up}", extra=whole)
    o["indexed"] = _with(v, final=f"select row_id, {r6('price_upper', 'price_upper')} from iv_dirty where qty_lower > 10")
    params = lambda *cols: _with("iv_user", final=" union all ".join(f"select '{f}' as feature, " + ", ".join(r6(x.format(lo=lo, up=up), n) for n, x in cols) + " from iv_user" for f, (lo, up) in zip(FEATURES["iv_user"], _cols("iv_user"))))
    o["params_minmax"] = params(("minimum", MM[0][1]), ("maximum", MM[1][1]))
    o["params_zscore"] = params(("mean", ZS[0][1]), ("std", ZS[1][1]))
    o["params_midwidth"] = params(*zip(("mid_min", "mid_max", "width_min", "width_max"), (x for _, x in MW)))
    o["params_robust"] = params(("low", RQ[0][1]), ("high", RQ[1][1]))
    o["similarity_distance"] = _pairs("iv_nation", f"1 - ({similarity('jaccard', nat)})")
    o["condensed_dice"] = _pairs("iv_nation", f"1 - ({similarity('dice', nat)})")
    o["custom_metric"] = _pairs("iv_nation", " + ".join(f"abs((a.{lo} + a.{up}) / 2 - (b.{lo} + b.{up}) / 2)" for lo, up in nat))
    cell = f"case when a.row_id = b.row_id then 1.0 else {similarity('jaccard', nat)} end"
    o["heat_map"] = _with("iv_nation", final="select a.row_id as i, " + ", ".join(r6(f"max(case when b.row_id = {j} then {cell} end)", f'"{j}"') for j in range(25)) + " from iv_nation a, iv_nation b group by a.row_id")

    for steps in (0, 1, 3):
        view, cols, flat, ctes = _lloyd(steps)
        o["assign_nearest" if steps == 0 else f"lloyd_{steps}"] = _with(view, *ctes, final=f"select row_id, cluster from a{steps}")
    view, cols, flat, ctes = _lloyd(3)
    o["kmeans_summary"] = _with(view, *ctes, final=f"select cluster, {', '.join(r6(f'avg(x.{c})', c) for c in flat)}, count(*) as n from x join a3 using (row_id) group by cluster")
    view, cols, flat, ctes = _lloyd(1)
    o["inertia"] = _with(view, *ctes, final=f"select round(sum(pow({distance('euclidean', cols, a='x', b='c')}, 2)), 6) + 0.0 as inertia from x join a1 using (row_id) join c1 c using (cluster)")

    view, flat, ctes = _fuzzy()
    o["fcm_membership"] = _with(view, *ctes, final="select row_id, round(max(u) filter (where cluster = 0), 6) + 0.0 as u0, round(max(u) filter (where cluster = 1), 6) + 0.0 as u1 from u group by row_id")
    centre = ", ".join(f"round(sum(u * u * x.{c}) filter (where cluster = {k}) / (sum(u * u) filter (where cluster = {k}) + 1e-16), 6) + 0.0 as c{k}_{j}" for k in (0, 1) for j, c in enumerate(flat))
    o["fcm_centres_1"] = _with(view, *ctes, final=f"select {centre} from u join x using (row_id)")
    logs = [f"ln(sum(u * u * d{j} * d{j}) + 1e-16)" for j in (0, 1)]
    o["fcm_adaptive_weights"] = _with(view, *ctes, ("g", f"select cluster, {logs[0]} as l0, {logs[1]} as l1 from u group by cluster"), final=" union all ".join(f"select cluster::int as cluster, {j} as dim, round(least(1e6, greatest(1e-6, exp((l0 + l1) / 2 - l{j}))), 6) + 0.0 as weight from g" for j in (0, 1)))
    o["fcm_objective"] = _with(view, *ctes, final="select round(sum(u * u * (d0 * d0 + d1 * d1)), 6) + 0.0 as objective from u")

    o["fcm_from_start"], o["fcm_from_start_adaptive"] = _fuzzy_rounds(3, False), _fuzzy_rounds(3, True)

    view, cols, flat, ctes = _labelled()
    own = ("own", f"select l.cluster, {distance('euclidean', cols, a='l', b='c', eps=True)} as d from l join c using (cluster)")
    pairs = ("p", f"select a.row_id as i, a.cluster as ca, b.cluster as cb, {distance('euclidean', cols, eps=True)} as d from l a join l b on a.row_id <> b.row_id")
    o["distortion"] = _with(view, *ctes, own, final="select round(sum(d * d) / count(*), 6) + 0.0 as value from own")
    o["silhouette"] = _with(
        view, *ctes, pairs,
        ("per", "select i, ca, cb, avg(d) filter (where d > 0) as near, avg(d) as far from p group by i, ca, cb"),
        ("ab", "select i, coalesce(max(near) filter (where ca = cb), 0.0) as a, coalesce(min(far) filter (where ca <> cb), 0.0) as b from per group by i"),
        final="select round(avg(case when greatest(a, b) > 1e-15 then (b - a) / greatest(a, b) else 0.0 end), 6) + 0.0 as value from ab",
    )
    o["calinski"] = _with(
        view, *ctes, own,
        ("g", "select " + ", ".join(f"avg({c}) as {c}" for c in flat) + " from l"),
        ("b", f"select sum(c.n * pow({distance('euclidean', cols, a='c', b='g', eps=True)}, 2)) as b, count(*) as k from c, g"),
        ("w", "select sum(d * d) as w, count(*) as n from own"),
        final="select round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 as value from b, w",
    )
    o["davies_bouldin"] = _with(
        view, *ctes, own, ("spread", "select cluster, avg(d) as s from own group by cluster"), ("cs", "select c.*, spread.s from c join spread using (cluster)"),
        ("r", f"select a.cluster, max((a.s + b.s) / {distance('euclidean', cols, eps=True)}) as r from cs a join cs b on a.cluster <> b.cluster group by a.cluster"),
        final="select round(avg(r), 6) + 0.0 as value from r",
    )
    o["dunn"] = _with(view, *ctes, pairs, final="select round(min(d) filter (where ca <> cb) / max(d) filter (where ca = cb), 6) + 0.0 as value from p")

    named = [f"select '{name}' as name, value from ({o[q]})" for name, q in (("inertia", "distortion"), ("ch_index", "calinski"), ("db_index", "davies_bouldin"))]
    o["indices"] = " union all ".join(named)

    for linkage in ("single", "complete", "average", "ward"):
        o[f"agglo_{linkage}"] = _merged(linkage, "select r as row_id, c as first_row from m where step = (select max(step) from m)", 3)
    # A cut into k clusters is the state with k labels; clusters are numbered by their first rows.
    o["agglo_cuts"] = _merged("average", "select (select count(*) from x)::int - step as k, r as row_id, (dense_rank() over (partition by step order by c) - 1)::int as cluster from m where (select count(*) from x) - step between 2 and 4", 2)

    # Nodes as in linkage matrices: rows by rank, then merges in order.
    o["agglo_tree"] = _merged(
        "average",
        "select t.step::int - 1 as merge_id, least(l.node, r.node)::int as left, greatest(l.node, r.node)::int as right, round(t.height, 6) + 0.0 as height, t.size::int as size "
        "from (select p.*, (select avg(d.d) from m a, m b, d where a.step = p.step - 1 and b.step = p.step - 1 and a.c = p.ca and b.c = p.cb and d.i = a.r and d.j = b.r) as height, "
        "(select count(*) from m a where a.step = p.step and a.c = p.ca) as size from p) t "
        "join node l on l.step = t.step and l.c = t.ca join node r on r.step = t.step and r.c = t.cb",
        1,
    ).replace("\nselect t.step", ",\np as (select distinct b.step, b.c as ca, a.c as cb from m a join m b on a.r = b.r and b.step = a.step + 1 where a.c <> b.c),\n"
        "node as (select s.step, x.c, coalesce((select max(q.step) - 1 + (select count(*) from iv_nation) from p q where q.ca = x.c and q.step < s.step), (select count(*) from iv_nation v where v.row_id < x.c)) as node from p s, (select row_id as c from iv_nation) x)\nselect t.step")  # fmt: skip

    k = "select * from (values " + ", ".join(f"({k}, {v}::double)" for k, v in K_SERIES) + ") as t(k, value)"
    grad = lambda x: f"case when lag({x}) over (order by k) is null then lead({x}) over (order by k) - {x} when lead({x}) over (order by k) is null then {x} - lag({x}) over (order by k) else (lead({x}) over (order by k) - lag({x}) over (order by k)) / 2 end"
    o["elbow_curvature"] = f"with t as ({k}), a as (select k, {grad('value')} as d1 from t), b as (select k, d1, {grad('d1')} as d2 from a) select k from b order by abs(d2) / pow(1 + d1 * d1, 1.5) desc, k limit 1"
    o["elbow_second"] = f"with t as ({k}), s as (select k, (lead(value) over (order by k) - value) / (lead(k) over (order by k) - k) as s from t), b as (select k, s - lag(s) over (order by k) as bend from s) select k from b where bend is not null order by bend desc, k limit 1"
    side = lambda cond: f"(select regr_slope(value, k) as m, regr_intercept(value, k) as b, count(*) as n from t where {cond})"
    rmse = lambda cond, s: f"sqrt((select avg(pow(value - {s}.m * k - {s}.b, 2)) from t where {cond}))"
    def knee(name: str, source: str) -> list[tuple[str, str]]:
        """The best split of ``source`` (k, value): a lone point on the right is met exactly."""
        side = lambda cond: f"(select coalesce(regr_slope(value, k), 0) as m, coalesce(regr_intercept(value, k), avg(value)) as b, count(*) as n from {source} where {cond})"
        rmse = lambda cond, s: f"sqrt((select avg(pow(value - {s}.m * k - {s}.b, 2)) from {source} where {cond}))"
        splits = f"select k as c from (select k, row_number() over (order by k) as i, count(*) over () as n from {source}) where i between 2 and n - 1"
        cost = f"(l.n * {rmse('k <= c', 'l')} + r.n * {rmse('k > c', 'r')}) / (l.n + r.n)"
        return [(f"{name}_c", splits), (name, f"select c as k from {name}_c, lateral {side('k <= c')} l, lateral {side('k > c')} r order by {cost}, c limit 1")]

    chain = lambda ctes, final: "with " + ", ".join(f"{n} as ({q})" for n, q in ctes) + " " + final
    o["lmethod"] = chain([("t", k), *knee("k1", "t")], "select k from k1")
    # Each step looks at the points up to twice the last knee, five at least, until the knee stops falling.
    steps = [("t", k), *knee("k1", "t")]
    for i in (2, 3, 4, 5):
        steps.append((f"t{i}", f"select k, value from (select t.*, row_number() over (order by k) as i from t) where i <= greatest(5, (select count(*) from t, k{i - 1} where t.k <= 2 * k{i - 1}.k))"))
        steps += knee(f"k{i}", f"t{i}")
    ended = "(select k from k5)"
    for i in (5, 4, 3, 2):
        now, before = f"(select k from k{i})", f"(select k from k{i - 1})"
        ended = f"case when {now} >= {before} or {now} <= 2 then least({now}, {before}) else {ended} end"
    o["lmethod_iterative"] = chain(steps, f"select {ended} as k")
    gaps = [(k_, g) for (k_, _), g in zip(K_SERIES, (0.1, 0.2, 0.35, 0.4, 0.41, 0.43, 0.44, 0.45, 0.46))]
    o["gap_select"] = (
        "with g as (select * from (values " + ", ".join(f"({k_}, {g}::double)" for k_, g in gaps) + ") as t(k, gap)), "
        "d as (select k, gap, gap - lag(gap) over (order by k) as jump, lead(gap) over (order by k) as next from g), "
        "m as (select avg(jump) + stddev_pop(jump) as high from d) "
        "select coalesce((select min(k) from d, m where jump > high), (select min(k) from d where gap >= next - 0.02 * sqrt(1.1)), (select max(k) from g)) as k"
    )
    o["bezier"] = (
        "with s(id, x0, y0, x1, y1, target) as (values (1, 0.0::double, 0.5::double, 1.0::double, 0.5::double, 0.8::double), (2, 0.0, 0.1, 1.0, 0.9, 0.2)), "
        "c as (select *, (x0 + x1) / 2 as mx, 0.2 * (y0 + y1) / 2 + 0.8 * target as my, (x1 - x0) / 6 as run from s), "
        "h as (select id, 0 as half, x0 as ax, x0 + run as bx, mx - run as cx, mx as dx, y0 as ay, my as dy from c "
        "union all select id, 1, mx, mx + run, x1 - run, x1, my, y1 from c), "
        "p as (select h.*, i::int as point, i / 49.0::double as t from h, range(50) as r(i)) "
        "select id, half, point, round(pow(1 - t, 3) * ax + 3 * pow(1 - t, 2) * t * bx + 3 * (1 - t) * t * t * cx + pow(t, 3) * dx, 6) + 0.0 as x, "
        "round(pow(1 - t, 3) * ay + 3 * pow(1 - t, 2) * t * ay + 3 * (1 - t) * t * t * dy + pow(t, 3) * dy, 6) + 0.0 as y from p"
    )
    o["maxmin"] = f"with t as ({k}) select k from t order by value desc, k limit 1"

    view, cols, flat, ctes = _labelled()
    rng = []
    for f, (lo, up) in zip(FEATURES[view], cols):
        low, high = f"least((select min({lo}) from l), (select min({lo}) from c))", f"greatest((select max({up}) from l), (select max({up}) from c))"
        rng.append(f"select '{f}' as feature, round({low} - 0.1 * ({high} - {low}), 6) + 0.0 as low, round({high} + 0.1 * ({high} - {low}), 6) + 0.0 as high")
    o["feature_bounds"] = _with(view, *ctes, final=" union all ".join(rng))
    o["unit_scale"] = _with(view, ("l", _long(view)), final="select row_id, dim::bigint as dim, round(((lower + upper) / 2 - min(lower) over (partition by dim)) / (max(upper) over (partition by dim) - min(lower) over (partition by dim)), 6) + 0.0 as y from l")
    (xl, xu), (yl, yu) = cols[:2]
    o["rectangles"] = _with(view, *ctes, final=f"select row_id, cluster::int as cluster, {r6(xl, 'x')}, {r6(yl, 'y')}, {r6(f'{xu} - {xl}', 'width')}, {r6(f'{yu} - {yl}', 'height')} from l")
    from spanforge.operators.plotdata import FACES

    corners = " union all ".join(f"select row_id, {f} as face, {c} as corner, " + ", ".join(r6(cols[d][at], n) for d, (n, at) in enumerate(zip("xyz", corner))) + " from iv_supplier" for f, face in enumerate(FACES) for c, corner in enumerate(face))
    o["cuboid_faces"] = _with(view, final=corners)
    lng = ("g", " union all ".join(f"select row_id, cluster, '{f}' as feature, {lo} as lower, {up} as upper from l" for f, (lo, up) in zip(FEATURES[view], cols)))
    o["cluster_listing"] = _with(view, *ctes, lng, final="select cluster::int as cluster, cluster::int as place, count(*) over (partition by cluster, feature) as cluster_size, feature, row_number() over (partition by cluster, feature order by upper - lower, row_id)::int as position, row_id, round(lower, 6) + 0.0 as lower, round(upper, 6) + 0.0 as upper from g")
    y = ", ".join(f"(({lo} + {up}) / 2 - (select min({lo}) from l)) / ((select max({up}) from l) - (select min({lo}) from l)) as y{i}" for i, (lo, up) in enumerate(cols))
    seg = " union all ".join(f"select {i} as segment, cluster, avg((y{i} + y{i + 1}) / 2) as m from y group by cluster" for i in range(len(cols) - 1))
    o["bundling"] = _with(view, *ctes, ("y", f"select cluster, {y} from l"), ("b", seg), final="select segment, cluster::int as cluster, round(0.1 + 0.8 * (row_number() over (partition by segment order by m, cluster) - 1) / (count(*) over (partition by segment) - 1), 6) + 0.0 as y from b")
    turn = ("r", "select row_id, dim as step, feature, dim * 2 * pi() / 3 as angle, (lower - min(lower) over w) / (max(upper) over w - min(lower) over w) as lower, (upper - min(lower) over w) / (max(upper) over w - min(lower) over w) as upper from g window w as (partition by dim)")
    o["radar"] = _with(view, ("g", _long(view)), turn, ("q", "select * from r union all select row_id, 3, feature, angle, lower, upper from r where step = 0"), final="select row_id, step::int as step, feature, round(angle, 6) + 0.0 as angle, round(lower, 6) + 0.0 as lower, round(upper, 6) + 0.0 as upper from q")
    return o
