"""DuckDB SQL for the engine queries: the same results by lists and bit strings, without packed words."""

from __future__ import annotations

import re
from collections.abc import Sequence

from bitloom.functions import bits as B
from bitloom.operators import transforms as T
from bitloom.operators.hashes import DECIMALS as HASH_DECIMALS, cosine_matrix
from bitloom.plans import workload as W

_N = W.BITS


def _affine(t: T.Affine) -> str:
    cells = []
    for i, src in enumerate(t.sources):
        x = "0.0::DOUBLE" if not src else f"px[{src[0] + 1}]" if len(src) == 1 else "(" + " + ".join(f"px[{j + 1}]" for j in src) + f") / {len(src)}.0::DOUBLE"
        y = f"({x}) * {t.scale[i]!r}::DOUBLE + {t.offset[i]!r}::DOUBLE"
        cells.append(y + f" + list_sum(px) / {len(t.scale)}.0 * {t.mean_share[i]!r}::DOUBLE" if t.mean_share and t.mean_share[i] else y)
    return "[" + ", ".join(cells) + "]"


def _variants(transforms: Sequence[str]) -> str:
    parts = ["SELECT file_id, 'orig' AS transform, px FROM img"]
    parts += [f"SELECT file_id, '{W.GRID[t].name}' AS transform, {_affine(W.GRID[t])} AS px FROM img" for t in transforms]
    return f"""img AS (SELECT vec_id AS file_id, list_transform(embedding, lambda x: x::DOUBLE) AS px FROM embeddings),
variants AS ({" UNION ALL ".join(parts)})"""


_D = HASH_DECIMALS
_MEDIAN = f"(list_sort(z)[{_N // 2}] + list_sort(z)[{_N // 2 + 1}]) / 2.0"


def _hash(algo: str) -> str:
    """SELECT file_id, transform, algo, h (boolean list) FROM variants."""
    head = f"SELECT file_id, transform, '{algo}' AS algo, "
    cmp = lambda bound, inner: head + f"list_transform(z, lambda x: x > m) AS h FROM (SELECT *, {bound} AS m FROM ({inner}))"
    if algo == "sign":
        return head + "list_transform(px, lambda x: x >= 0) AS h FROM variants"
    if algo == "average":
        return cmp(f"round(list_sum(z) / {_N}.0, {_D})", f"SELECT *, list_transform(px, lambda x: round(x, {_D})) AS z FROM variants")
    if algo in ("dhash", "dhash_vertical"):
        nxt = (lambda y, x: (y + 1) % 8 * 8 + x) if algo == "dhash_vertical" else (lambda y, x: y * 8 + (x + 1) % 8)
        bits = ", ".join(f"round(px[{nxt(y, x) + 1}], {_D}) > round(px[{y * 8 + x + 1}], {_D})" for y in range(8) for x in range(8))
        return head + f"[{bits}] AS h FROM variants"
    if algo == "phash":
        rows = ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in r) + "]" for r in cosine_matrix())
        return cmp(_MEDIAN, f"SELECT file_id, transform, list_transform(mat, lambda r: round(list_inner_product(r, px), {_D})) AS z FROM variants, (SELECT [{rows}] AS mat)")
    if algo == "wave":
        return cmp(_MEDIAN, f"SELECT *, list_transform(px, lambda x: round(x - a, {_D})) AS z FROM (SELECT *, round(list_sum(px) / {_N}.0, {_D}) AS a FROM variants)")
    raise ValueError(algo)


_BITS = "array_to_string(list_transform(h, lambda b: CASE WHEN b THEN '1' ELSE '0' END), '')"


def hashes(transforms: Sequence[str], algos: Sequence[str]) -> str:
    union = " UNION ALL ".join(_hash(a) for a in algos)
    return f"""{_variants(transforms)},
every AS (SELECT file_id, transform, algo, {_BITS} AS bits FROM ({union})),
hashes AS (SELECT * FROM every WHERE file_id NOT IN (SELECT file_id FROM every WHERE bits NOT LIKE '%1%'))"""


_SAMPLE = """n_inter AS (SELECT (1 + CAST(floor(sqrt(1 + 8 * count(DISTINCT file_id))) AS BIGINT)) // 2 + 1 AS n FROM hashes),
picked AS (SELECT file_id FROM (SELECT file_id, row_number() OVER (ORDER BY md5('42:' || file_id), file_id) AS rn FROM (SELECT DISTINCT file_id FROM hashes)), n_inter WHERE rn <= n)"""


def _mask(bits: Sequence[int]) -> str:
    s = set(bits)
    return "'" + "".join("1" if i in s else "0" for i in range(_N)) + "'::BIT"


def _sum(word: str, weights: Sequence[float] | None) -> str:
    if weights is None:
        return f"bit_count({word})::DOUBLE"
    groups: dict[float, list[int]] = {}
    for i, w in enumerate(weights):
        groups.setdefault(float(w), []).append(i)
    return "(" + " + ".join(f"{w!r}::DOUBLE * bit_count(({word}) & {_mask(b)})" for w, b in sorted(groups.items()) if w) + ")"


def _counts(weights: Sequence[float] | None = None) -> dict[str, str]:
    c = {"n11": _sum("u & v", weights), "n10": _sum("u & ~v", weights), "n01": _sum("v & ~u", weights), "r": _sum("xor(u, v)", weights), "su": _sum("u", weights), "sv": _sum("v", weights)}
    return c | {"n": f"{float(_N if weights is None else sum(weights))!r}::DOUBLE"}


def _cosine(c: dict[str, str]) -> str:
    return "CASE WHEN {su} * {sv} = 0 THEN NULL ELSE 1 - {n11} / sqrt({su} * {sv}) END".format(**c)


def _hatched(distance: str, whole: bool) -> str:
    def line(cells: list[int]) -> str:
        c = _counts([1.0 if i in set(cells) else 0.0 for i in range(_N)])
        return f"{c['r']} / {float(len(cells))!r}" if distance == "hamming" else f"({_cosine(c)})"

    part = {k: line([i for x in lines for i in x]) if whole else "(" + " + ".join(line(x) for x in lines) + f") / {float(len(lines))!r}" for k, lines in B.line_masks(_N).items()}
    # least() skips nulls here as well.
    return f"(least({part['er']}, {part['or']}) + least({part['ec']}, {part['oc']})) / 2"


def distance(metric: str, kwargs: dict, weights: Sequence[float] | None) -> str:
    """SQL of a distance between the bit strings u and v."""
    c = _counts(weights)
    f = lambda s: s.format(**c)
    safe = lambda a, b: f(f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b}) END")
    n00 = "({n} - {n11} - {r})"
    forms = {
        "hamming": lambda: f("{r} / {n}"), "cosine": lambda: _cosine(c), "jaccard": lambda: safe("{r}", "({n11} + {r})"),
        "dice": lambda: safe("{r}", "(2 * {n11} + {r})"), "braycurtis": lambda: safe("{r}", "(2 * {n11} + {r})"),
        "rogerstanimoto": lambda: f("2 * {r} / ({n} + {r})"), "sokalmichener": lambda: f("2 * {r} / ({n} + {r})"),
        "russellrao": lambda: f("({n} - {n11}) / {n}"), "sokalsneath": lambda: safe("2 * {r}", "({n11} + 2 * {r})"),
        "yule": lambda: f("CASE WHEN {n10} * {n01} = 0 THEN 0 ELSE 2 * {n10} * {n01} / ({n11} * " + n00 + " + {n10} * {n01}) END"),
        "kulczynski1": lambda: f("CASE WHEN {r} = 0 THEN NULL ELSE {n11} / {r} END"),
        "cityblock": lambda: c["r"], "sqeuclidean": lambda: c["r"], "canberra": lambda: c["r"], "euclidean": lambda: f("sqrt({r})"),
        "minkowski": lambda: f("pow({r}, " + repr(1.0 / kwargs.get("p", 2.0)) + ")"), "chebyshev": lambda: f("CASE WHEN {r} > 0 THEN 1.0 ELSE 0.0 END"),
        "correlation": lambda: f("CASE WHEN {su} * ({n} - {su}) * {sv} * ({n} - {sv}) = 0 THEN NULL ELSE 1 - ({n} * {n11} - {su} * {sv}) / sqrt({su} * ({n} - {su}) * {sv} * ({n} - {sv})) END"),
        "jensenshannon": lambda: f("sqrt(greatest(0, ({n11} * (ln(1 / {su}) / {su} + ln(1 / {sv}) / {sv} - (1 / {su} + 1 / {sv}) * ln((1 / {su} + 1 / {sv}) / 2)) + {n10} * ln(2) / {su} + {n01} * ln(2) / {sv}) / 2))"),
        "seuclidean": lambda: "sqrt(" + _sum("xor(u, v)", [1.0 / x for x in kwargs["V"]]) + ")",
    }
    if metric in forms:
        return forms[metric]()
    if metric == "ngram_cosine_distance":
        return f"round_even({_cosine(_counts(B.window_coverage(_N, kwargs.get('ngram_size', 2))))}, 4)"
    if metric == "convolution_distance":
        mass = B.filter_mass(_N, kwargs.get("filter") or [[1.0] * 3] * 3)
        d = f"{_sum('xor(u, v)', mass)} / {sum(mass)!r}"
        return f"round_even({d if kwargs.get('mode') != 'sum_similar' else f'({sum(mass)!r} - {_sum("xor(u, v)", mass)}) / {sum(mass)!r}'}, 4)"
    whole = metric != "hatched_matrix"
    d = _hatched(kwargs.get("distance", "hamming" if metric == "hatched_matrix_fast" else "cosine"), whole)
    return d if metric == "hatched_matrix_fast" else f"round_even({d}, 4)"


def _pairs() -> str:
    """pairs(file_a, file_b, algo, class, transform, u, v) of hashes, both classes."""
    return f"""{_SAMPLE},
pairs AS (
  SELECT o.file_id AS file_a, o.file_id AS file_b, o.algo, 1 AS class, h.transform, o.bits::BIT AS u, h.bits::BIT AS v FROM hashes o JOIN hashes h ON o.file_id = h.file_id AND o.algo = h.algo WHERE o.transform = 'orig'
  UNION ALL
  SELECT a.file_id, b.file_id, a.algo, 0, a.transform, a.bits::BIT, b.bits::BIT FROM hashes a JOIN hashes b ON a.algo = b.algo AND a.transform = b.transform AND a.file_id < b.file_id
  WHERE a.file_id IN (SELECT file_id FROM picked) AND b.file_id IN (SELECT file_id FROM picked))"""


def _distances(transforms=W.EVAL_TRANSFORMS, algos=W.ALGOS, spec=None) -> str:
    spec = W.EVAL_METRICS if spec is None else spec
    parts = []
    for label, value in spec.items():
        metric, kwargs = value if isinstance(value, tuple) else (value, {})
        parts.append(f"SELECT file_a, file_b, algo, class, transform, '{label}' AS metric, 1.0 - ({distance(metric, kwargs, None)}) AS similarity FROM pairs")
    return f"{hashes(transforms, algos)},\n{_pairs()},\ndistances AS ({' UNION ALL '.join(parts)})"


_K = "algo, transform, metric"


def _curve(source: str = "distances", k: str = _K, score: str = "round_even(similarity, 12)") -> str:
    """hist, points (with the infinite one) and segments of a table of scores."""
    return f"""hist AS (SELECT {k}, {score} AS s, sum(CASE WHEN class = 1 THEN 1 ELSE 0 END)::BIGINT AS p, sum(CASE WHEN class = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM {source} WHERE transform <> 'orig' AND similarity IS NOT NULL GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY {k}) AS p_all, sum(n) OVER (PARTITION BY {k}) AS n_all FROM hist WINDOW w AS (PARTITION BY {k} ORDER BY s DESC)),
bent AS (SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bt, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bf FROM cum WINDOW w AS (PARTITION BY {k} ORDER BY s DESC)),
points AS (
  SELECT {k}, s AS threshold, (fp / n_all)::DOUBLE AS fpr, (tp / p_all)::DOUBLE AS tpr FROM bent WHERE p_all > 0 AND n_all > 0 AND (bt IS NULL OR bf IS NULL OR bt <> 0 OR bf <> 0)
  UNION ALL SELECT DISTINCT {k}, 'inf'::DOUBLE, 0.0, 0.0 FROM bent WHERE p_all > 0 AND n_all > 0),
segments AS (SELECT *, min(threshold) OVER (PARTITION BY {k}, fpr) AS low, lag(fpr) OVER w AS fpr0, lag(tpr) OVER w AS tpr0, lag(threshold) OVER w AS threshold0 FROM points WINDOW w AS (PARTITION BY {k} ORDER BY threshold DESC)),
aucs AS (SELECT {k}, sum((fpr - fpr0) * (tpr + tpr0) / 2) AS auc FROM segments WHERE fpr0 IS NOT NULL GROUP BY ALL),
eers AS (SELECT {k}, fpr0 + (fpr - fpr0) * t AS eer, CASE WHEN g1 = 0 OR fpr = fpr0 THEN low WHEN threshold0 = 'inf'::DOUBLE THEN threshold ELSE threshold0 + (threshold - threshold0) * t END AS eer_threshold
  FROM (SELECT *, g0 / (g0 - g1) AS t FROM (SELECT *, 1 - fpr0 - tpr0 AS g0, 1 - fpr - tpr AS g1 FROM segments WHERE fpr0 IS NOT NULL) WHERE g0 > 0 AND g1 <= 0))"""


def _metrics(decision: str = "e.eer_threshold", join: str = "") -> str:
    j = "USING (algo, transform, metric)"
    return f"""chosen AS (SELECT a.*, e.eer, e.eer_threshold, {decision} AS decision_threshold FROM aucs a LEFT JOIN eers e {j} {join}),
cm AS (SELECT {_K}, sum(CASE WHEN s < decision_threshold THEN n ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN s >= decision_threshold THEN n ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN s < decision_threshold THEN p ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN s >= decision_threshold THEN p ELSE 0 END)::DOUBLE AS tp FROM hist JOIN chosen {j} GROUP BY ALL),
metrics AS (SELECT {_K}, auc, eer, eer_threshold, tn / (tn + fp) AS tn, fp / (tn + fp) AS fp, fn / (fn + tp) AS fn, tp / (fn + tp) AS tp, decision_threshold FROM chosen LEFT JOIN cm {j})"""


def _again(ctes: str, prefix: str) -> str:
    """The tables of a curve and its metrics under other names."""
    return re.sub(r"\b(hist|cum|bent|points|segments|aucs|eers|chosen|cm|metrics)\b(?! FROM)", prefix + r"\1", ctes)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _round(columns: Sequence[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


def oracle_sql() -> dict[str, str]:
    names = [W.GRID[t].name for t in W.EVAL_TRANSFORMS]
    dist, curve = _distances(), f"{_distances()},\n{_curve()}"
    full = f"{curve},\n{_metrics()}"
    mcols = ["auc", "eer", "eer_threshold", "tn", "fp", "fn", "tp", "decision_threshold"]
    out: dict[str, str] = {}
    for a in ("sign", "average", "dhash", "dhash_vertical", "phash", "wave"):
        out[f"hash_{a}"] = _with(hashes([], [a]), "SELECT file_id, bits FROM every")
    for t, spec in W.GRID.items():
        out[f"transform_{t}"] = _with(_variants([t]), f"SELECT file_id, transform, i::INTEGER AS cell, round(px[i + 1], 6) AS value FROM variants, range({_N}) r(i) WHERE transform = '{spec.name}'")
    for name, (metric, kwargs, weights) in W.DISTANCES.items():
        out[f"dist_{name}"] = _with(f"{hashes(['crop'], ['sign'])},\n{_pairs()}", f"SELECT file_a, file_b, transform, class, round(1.0 - (1.0 - ({distance(metric, kwargs, weights)})), 6) AS distance FROM pairs WHERE class = 0 OR transform <> 'orig'")
    cm = "SELECT algo, transform, metric, {} FROM (SELECT algo, transform, metric, sum(CASE WHEN s < eer_threshold THEN n ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN s >= eer_threshold THEN n ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN s < eer_threshold THEN p ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN s >= eer_threshold THEN p ELSE 0 END)::DOUBLE AS tp FROM hist JOIN eers USING (algo, transform, metric) GROUP BY ALL)"
    agg = 'round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std, round(avg(eer), 6) AS eer_mean, round(stddev_samp(eer), 6) AS eer_std'
    triple = "(SELECT unnest([{}]) AS algo), (SELECT unnest([{}]) AS transform), (SELECT unnest([{}]) AS metric)".format(*(", ".join(f"'{x}'" for x in xs) for xs in (W.ALGOS, names, W.EVAL_METRICS)))
    preset = " UNION ALL ".join(f"SELECT '{a}' AS algo, '{m}' AS metric, {t!r}::DOUBLE AS preset" for (a, m), t in W.PRESET.items())
    freq = f"""marked AS (SELECT d.*, CASE WHEN class = 1 THEN 'orig' ELSE d.transform END AS t_a, CASE WHEN class = 1 THEN CASE WHEN round_even(similarity, 12) >= eer_threshold THEN 'TP' ELSE 'FN' END ELSE CASE WHEN round_even(similarity, 12) >= eer_threshold THEN 'FP' ELSE 'TN' END END AS quadrant FROM distances d JOIN eers e ON d.algo = e.algo AND d.transform = e.transform AND d.metric = e.metric),
flips AS (SELECT m.algo, m.transform, m.metric, quadrant, i AS bit, CASE WHEN (substr(a.bits, i + 1, 1) = substr(b.bits, i + 1, 1)) = (class = 1) THEN 1.0 ELSE 0.0 END AS x FROM marked m JOIN hashes a ON a.file_id = m.file_a AND a.algo = m.algo AND a.transform = m.t_a JOIN hashes b ON b.file_id = m.file_b AND b.algo = m.algo AND b.transform = m.transform, range({_N}) r(i)),
freq AS (SELECT g.algo, g.transform, g.metric, g.quadrant, g.bit::INTEGER AS bit, coalesce(f.freq, CASE WHEN g.quadrant IN ('TP', 'TN') THEN 0.0 ELSE 1.0 END) AS freq FROM (SELECT algo, transform, metric, quadrant, bit FROM eers, (SELECT unnest(['TP', 'FN', 'FP', 'TN']) AS quadrant), (SELECT i AS bit FROM range({_N}) r(i))) g
 LEFT JOIN (SELECT algo, transform, metric, quadrant, bit, avg(x) AS freq FROM flips GROUP BY ALL) f ON f.algo = g.algo AND f.transform = g.transform AND f.metric = g.metric AND f.quadrant = g.quadrant AND f.bit = g.bit)"""
    weights = lambda f: f"SELECT algo, metric, bit, round({f}(w), 6) AS weight FROM (SELECT algo, transform, metric, bit, {f}(freq) AS w FROM freq GROUP BY ALL) GROUP BY algo, metric, bit"
    out |= {
        "hash_bitstring": _with(hashes([], ["sign"]), f"SELECT file_id, {_N} AS n_bits, length(replace(bits, '0', ''))::INTEGER AS popcount, bits FROM every"),
        "hash_popcount_bad": _with(hashes(["border", "rotate15"], W.ALGOS), "SELECT algo, count(DISTINCT CASE WHEN bits NOT LIKE '%1%' THEN file_id END) AS bad_files FROM every GROUP BY algo"),
        "hash_long_all": _with(hashes(W.EVAL_TRANSFORMS, W.ALGOS), "SELECT file_id, transform, algo, bits FROM hashes"),
        "hash_wide_pivot": _with(hashes(["crop"], W.ALGOS), "SELECT file_id, transform, " + ", ".join(f"max(CASE WHEN algo = '{a}' THEN bits END) AS {a}" for a in W.ALGOS) + " FROM hashes GROUP BY file_id, transform"),
        "label_dims": _with(hashes(W.EVAL_TRANSFORMS, W.ALGOS), " UNION ALL ".join(f"SELECT '{d}' AS dim, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS code, label FROM (SELECT DISTINCT {c}::VARCHAR AS label FROM hashes)" for d, c in (("f", "file_id"), ("t", "transform"), ("a", "algo"))) + " UNION ALL SELECT 'c', 0, 'Inter (0)' UNION ALL SELECT 'c', 1, 'Intra (1)'"),
        "transform_file_join": _with(hashes(["crop"], ["sign"]), "SELECT 'img_' || file_id || '.png' AS filename, CASE WHEN transform = 'orig' THEN 'orig' ELSE 'from_disk' END AS transform, bits FROM hashes"),
        "pairs_intra": _with(_distances(spec={"hamming": "hamming"}), "SELECT file_a, file_b, algo, class, transform, metric, round(similarity, 6) AS similarity FROM distances WHERE class = 1"),
        "pairs_inter_sampled": _with(_distances(spec={"hamming": "hamming"}), "SELECT file_a, file_b, algo, class, transform, metric, round(similarity, 6) AS similarity FROM distances WHERE class = 0"),
        "distances_union": _with(dist, "SELECT file_a, file_b, algo, class, transform, metric, round(similarity, 6) AS similarity FROM distances"),
        "distances_wide": _with(dist, "SELECT file_a, file_b, algo, metric, class, " + ", ".join(f"round(max(CASE WHEN transform = '{t}' THEN similarity END), 6) AS \"{t}\"" for t in ["orig", *names]) + " FROM distances WHERE metric = 'hamming' GROUP BY file_a, file_b, algo, metric, class"),
        "triplets": f"SELECT algo, transform, metric FROM {triple}",
        "roc_points": _with(curve, f"SELECT {_K}, {_round(['threshold', 'fpr', 'tpr'])} FROM points WHERE threshold < 2"),
        "auc": _with(curve, f"SELECT {_K}, round(auc, 6) AS auc FROM aucs"),
        "eer": _with(curve, f"SELECT {_K}, {_round(['eer', 'eer_threshold'])} FROM eers"),
        "fpr_threshold": _with(curve, f"SELECT {_K}, round(arg_max(t, -fpr), 6) AS threshold FROM (SELECT *, CASE WHEN threshold0 = 'inf'::DOUBLE THEN threshold ELSE threshold0 + (threshold - threshold0) * ((0.05::DOUBLE - fpr0) / (fpr - fpr0)) END AS t FROM segments WHERE fpr > fpr0 AND fpr0 <= 0.05 AND fpr >= 0.05) GROUP BY {_K}"),
        "cm_rates": _with(curve, cm.format("round(tn / (tn + fp), 6) AS tn, round(fp / (tn + fp), 6) AS fp, round(fn / (fn + tp), 6) AS fn, round(tp / (fn + tp), 6) AS tp")),
        "cm_counts": _with(curve, cm.format("tn, fp, fn, tp")),
        "cm_weighted": _with(curve, cm.format(", ".join(f"round({x} * ((tn + fp + fn + tp) / (2 * ({y}))), 6) AS {x}" for x, y in (("tn", "tn + fp"), ("fp", "tn + fp"), ("fn", "fn + tp"), ("tp", "fn + tp"))))),
        "metrics_triplet": _with(full, f"SELECT {_K}, {_round(mcols)} FROM metrics"),
        "metrics_preset_threshold": _with(f"{curve},\n{_metrics('coalesce(p.preset, e.eer_threshold)', f'LEFT JOIN ({preset}) p ON p.algo = a.algo AND p.metric = a.metric')}", f"SELECT {_K}, {_round(mcols)} FROM metrics"),
        "bit_freq": _with(f"{curve},\n{freq}", f"SELECT {_K}, quadrant, bit, round(freq, 6) AS freq FROM freq"),
        "bit_weights": _with(f"{curve},\n{freq}", weights("median")),
        "bit_weights_mean": _with(f"{curve},\n{freq}", weights("avg")),
        "dist_stats": _with(dist, "SELECT algo, metric, count(similarity) AS n, round(avg(similarity), 6) AS mean, round(stddev_samp(similarity), 6) AS std, round(min(similarity), 6) AS min, round(quantile_cont(similarity, 0.25), 6) AS p25, round(quantile_cont(similarity, 0.5), 6) AS p50, round(quantile_cont(similarity, 0.75), 6) AS p75, round(max(similarity), 6) AS max FROM distances GROUP BY algo, metric"),
        "inter_summary": _with(dist, "SELECT algo, metric, round_even(avg(similarity), 4) AS mean, round_even(median(similarity), 4) AS median, round_even(stddev_pop(similarity), 4) AS std FROM distances WHERE class = 0 AND transform = 'orig' GROUP BY algo, metric"),
        "auc_by_algo": _with(full, f"SELECT algo, {agg} FROM metrics GROUP BY algo"),
        "auc_grouping_sets": _with(full, "SELECT algo, metric, transform, round(avg(auc), 6) AS auc_mean, round(avg(eer), 6) AS eer_mean FROM metrics GROUP BY GROUPING SETS ((algo), (algo, metric), (algo, metric, transform))"),
        "auc_overall": _with(full, f"SELECT {agg} FROM metrics"),
        "auc_pivot": _with(full, "SELECT metric, algo, " + ", ".join(f"round(avg(CASE WHEN transform = '{t}' THEN auc END), 6) AS \"{t}\"" for t in names) + " FROM metrics GROUP BY metric, algo"),
        "auc_vs_baseline": _with(full, "SELECT m.algo, m.transform, m.metric, round_even((round(m.auc, 6) - round(b.auc, 6)) * 100, 3) AS change FROM metrics m JOIN metrics b ON m.algo = b.algo AND m.transform = b.transform AND b.metric = 'hamming' WHERE m.metric <> 'hamming'"),
        "hist_bins": _with(dist, "SELECT algo, metric, class, bin, n, round(n / sum(n) OVER (PARTITION BY algo, metric, class), 6) AS share FROM (SELECT algo, metric, class, least(greatest(floor(round_even(similarity, 12) * 25), 0), 24)::INTEGER AS bin, count(*) AS n FROM distances WHERE similarity IS NOT NULL GROUP BY ALL)"),
        "kde_grid": _with(dist, """SELECT algo, metric, class, x, round(sum(exp(-((x - s) / bw) * ((x - s) / bw) / 2)) / (any_value(n) * any_value(bw) * 2.5066282746310002), 4) AS density FROM (SELECT algo, metric, class, round_even(similarity, 12) AS s FROM distances WHERE metric = 'hamming')
JOIN (SELECT algo, metric, class, count(*) AS n, stddev_samp(round_even(similarity, 12)) * pow(count(*), -0.2) AS bw FROM distances WHERE metric = 'hamming' GROUP BY ALL) USING (algo, metric, class), (SELECT round(i / 20.0::DOUBLE, 4) AS x FROM range(21) r(i)) WHERE bw > 1e-12 GROUP BY algo, metric, class, x"""),
        "eer_curve": _with(curve, f"SELECT {_K}, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(1 - tpr, 6) AS fnr FROM points WHERE threshold <> 'inf'::DOUBLE"),
        "label_roc": _with(f"""few AS (SELECT vec_id AS file_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')::BIT AS b FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
labelled AS (SELECT 'sign' AS algo, 'label' AS transform, 'hamming' AS metric, CASE WHEN x.label = y.label THEN 1 ELSE 0 END AS class, 1 - bit_count(xor(x.b, y.b)) / 64.0::DOUBLE AS similarity FROM few x JOIN few y ON x.file_id < y.file_id),
{_curve('labelled', score='similarity')}""", f"SELECT algo, {_round(['auc', 'eer', 'eer_threshold'])} FROM aucs JOIN eers USING (algo, transform, metric)"),
    }
    weighted = f"""{full},
{freq},
wt AS (SELECT algo, bit, median(w) AS weight FROM (SELECT algo, transform, metric, bit, median(freq) AS w FROM freq WHERE metric = 'hamming' GROUP BY ALL) GROUP BY algo, bit),
wd AS (SELECT p.file_a, p.file_b, p.algo, p.class, p.transform, 'hamming' AS metric, 1.0 - sum(CASE WHEN get_bit(xor(p.u, p.v), w.bit::INTEGER) = 1 THEN w.weight ELSE 0 END) / sum(w.weight) AS similarity FROM pairs p JOIN wt w ON p.algo = w.algo GROUP BY p.file_a, p.file_b, p.algo, p.class, p.transform),
{_again(_curve("wd"), "w_")},
{_again(_metrics(), "w_")}"""
    out["metrics_weighted"] = _with(weighted, f"SELECT {_K}, {_round(mcols)} FROM w_metrics")
    out["auc_improvement"] = _with(weighted, f"SELECT {_K}, round(m.auc, 6) AS auc_plain, round(w.auc, 6) AS auc_weighted, round(w.auc - m.auc, 6) AS improvement FROM metrics m JOIN w_metrics w USING (algo, transform, metric)")
    return out
