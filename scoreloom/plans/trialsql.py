"""One synthetic trial in DuckDB's SQL: drawn, mixed, tuned and tested."""

from __future__ import annotations

import math

from scoreloom.operators import synthetic as Y

TUNE, TEST, SEED, TUNED_AT = 1000, 2000, 11, 0.25
#: Sources of the three sets of documents, with the seeds' offsets.
SETS = {"human": ("human", 0), "llm": ("llm", 1), "other": ("human", 2)}
EPS = "CAST(1e-12 AS DOUBLE)"


def state(*keys: object) -> str:
    out = "88172645"
    for i, k in enumerate(keys):
        out = f"((xor({out} + CAST({Y.DRAWS.get(k, k)} AS BIGINT), CAST({Y.MASKS[i % 3]} AS BIGINT)) * {Y.FACTORS[i % 3]}) % {Y.MODULI[i % 3]})"
    return out


def uniform(*keys: object) -> str:
    return f"(({state(*keys, *Y.STIR)} + CAST(0.5 AS DOUBLE)) / CAST({max(Y.MODULI)} AS DOUBLE))"


def normal(*keys: object) -> str:
    return f"(sqrt(-2 * ln({uniform(*keys, 1)})) * cos(CAST({2 * math.pi!r} AS DOUBLE) * {uniform(*keys, 2)}))"


def power_law(alpha: float, scale: float, *keys: object) -> str:
    return f"(CAST({scale} AS DOUBLE) * (pow(1 - {uniform(*keys)}, CAST({-1 / alpha!r} AS DOUBLE)) - 1))"


def _documents() -> list[str]:
    out = [f"dd AS (SELECT test, doc FROM (SELECT 0 AS test, unnest(range({TUNE})) AS doc UNION ALL SELECT 1, unnest(range({TEST}))))"]
    for name, (source, offset) in SETS.items():
        seed = f"(CASE WHEN test = 1 THEN {SEED + 10 + offset} ELSE {SEED + offset} END)"
        span = Y.MAX_TOKENS - Y.MIN_TOKENS + 1
        out.append(f"w_{name} AS MATERIALIZED (SELECT test, doc, {state(seed, source, 0, 'doc')} AS w FROM dd)")
        noise = ", ".join(f"CAST({k} AS DOUBLE) * {normal('w', n)} AS {c}" for k, n, c in ((Y.STYLE, "style", "s"), (Y.STYLE_RANK, "rank", "r"), (Y.STYLE_XENT, "xent", "x"), (Y.STYLE_B, "b", "b")))
        out.append(f"d_{name} AS MATERIALIZED (SELECT test, doc, w, CAST(floor({uniform('w', 'length')} * {span}) + {Y.MIN_TOKENS} AS BIGINT) AS n, {noise} FROM w_{name})")

        def draw(feature: str, source: str = source) -> str:
            start, alpha, scale = Y.TAILS[source][feature]
            return f"CAST({start} AS DOUBLE) + {power_law(alpha, scale, 'w', 'i', feature)}"

        entropy = f"CAST({Y.ENTROPY_BASE} AS DOUBLE) + CAST(0.5 AS DOUBLE) * {power_law(Y.ENTROPY_TAIL, Y.ENTROPY_SCALE, 'w', 'i', 'entropy')} + CAST({Y.ENTROPY_STYLE} AS DOUBLE) * s + CAST({Y.ENTROPY_NOISE} AS DOUBLE) * {normal('w', 'i', 'noise')}"
        out.append(
            f"t_{name} AS MATERIALIZED (SELECT test, doc, i, n, least(-({draw('nll_a')} + s), -{EPS}) AS pa, least(-({draw('nll_b')} + CAST({Y.SHARED} AS DOUBLE) * s + b), -{EPS}) AS pb, greatest({draw('logrank_a')} + r, {EPS}) AS ra, "
            f"greatest({draw('xent_ab')} + x, {EPS}) AS xe, greatest({entropy}, {EPS}) AS en FROM d_{name} CROSS JOIN (SELECT unnest(range({Y.N_TOKENS})) AS i))"
        )
    return out


VALUES = ("pa", "pb", "ra", "xe", "en")


def _tuning() -> list[str]:
    mix = uniform(f"(CASE WHEN test = 1 THEN {SEED + 1} ELSE {SEED} END)", "mix", 0, "doc", "i")
    harm = "o.pa - o.ra - greatest(o.pb - o.pa, 0)"
    pairs = (
        "pr AS MATERIALIZED (SELECT test, doc, i, l.n AS n, " + ", ".join(f"l.{v} AS l_{v}, o.{v} AS o_{v}" for v in VALUES)
        + f", {mix} AS mix, row_number() OVER (PARTITION BY test, doc ORDER BY {harm}, i) - 1 AS place FROM t_llm l JOIN t_other o USING (test, doc, i) WHERE i < l.n)"
    )

    def hit(mode: str, share: str) -> str:
        return f"(mix < {share})" if mode == "random" else f"(place < round_even(n * {share}, 0))"

    at = f"CAST({TUNED_AT} AS DOUBLE)"
    kinds = ["SELECT 'h' AS kind, doc, n, " + ", ".join(VALUES) + " FROM t_human WHERE test = 0 AND i < n", "SELECT 'c', doc, n, " + ", ".join(f"l_{v}" for v in VALUES) + " FROM pr WHERE test = 0"]
    kinds += [f"SELECT '{m}', doc, n, " + ", ".join(f"CASE WHEN {hit(m, at)} THEN o_{v} ELSE l_{v} END" for v in VALUES) + " FROM pr WHERE test = 0" for m in ("random", "tail")]
    tokens = f"tt AS MATERIALIZED ({' UNION ALL '.join(kinds)})"

    def bounds(name: str, value: str, qs: tuple[float, ...]) -> str:
        each = " UNION ALL ".join(f"SELECT {i + 1} AS c, quantile_cont({value}, {q}) AS b FROM tt WHERE kind IN ('h', 'c')" for i, q in enumerate(qs))
        return f"b_{name} AS MATERIALIZED (SELECT 0 AS c, CAST(NULL AS DOUBLE) AS b UNION ALL {each})"

    own = [bounds("p", "pa", Y.LOW), bounds("r", "ra", Y.HIGH), bounds("l", "pa - pb", Y.LOW), bounds("n", "-pa", Y.HIGH)]
    sums = [
        f"s_{k} AS MATERIALIZED (SELECT kind, doc, max(n) AS n, c, sum({fn}(CAST({v} AS DOUBLE), b)) AS x, sum(xe) AS xe, sum(en) AS en FROM tt CROSS JOIN b_{k} GROUP BY kind, doc, c)"
        for k, fn, v in (("p", "greatest", "pa"), ("r", "least", "ra"), ("l", "greatest", "pa - pb"), ("n", "least", "-pa"))
    ]
    scores = [
        f"SELECT kind, 'log_likelihood' AS method, c AS cand, x / (n + {EPS}) AS v FROM s_p", f"SELECT kind, 'log_rank', c, x / (n + {EPS}) FROM s_r", f"SELECT kind, 'likelihood_ratio', c, x / (n + {EPS}) FROM s_l",
        f"SELECT kind, 'binoculars', c, (x / (n + {EPS})) / (xe / (n + {EPS}) + {EPS}) FROM s_n", f"SELECT kind, 'entropy_gap', c, (x - en) / (n + {EPS}) FROM s_n",
        f"SELECT a.kind, 'lrr_both', a.c * {len(Y.HIGH) + 1} + b.c, -a.x / (b.x + {EPS}) FROM s_p a JOIN s_r b ON a.kind = b.kind AND a.doc = b.doc",
    ]
    turned = [
        f"sc AS MATERIALIZED ({' UNION ALL '.join(scores)})",
        "turn AS (SELECT method, cand, CASE WHEN avg(v) FILTER (kind = 'c') >= avg(v) FILTER (kind = 'h') THEN 1 ELSE -1 END AS d FROM sc GROUP BY method, cand)",
        "o AS MATERIALIZED (SELECT kind, method, cand, v * d AS v FROM sc JOIN turn USING (method, cand))",
        "lim AS (SELECT method, cand, quantile_cont(v, 0.95) AS t FROM o WHERE kind = 'h' GROUP BY method, cand)",
        "both_o AS (SELECT k.kind AS k, method, cand, v, CASE WHEN o.kind = 'h' THEN 1 ELSE 0 END AS h FROM o JOIN (VALUES ('c'), ('random'), ('tail')) AS k(kind) ON o.kind IN ('h', k.kind))",
        "area AS (SELECT k, method, cand, sum(CASE WHEN h = 0 THEN upto - same_h / 2.0 END) / (max(nh) * CAST(count(*) FILTER (h = 0) AS DOUBLE)) AS auc FROM (SELECT *, sum(h) OVER (PARTITION BY k, method, cand ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, "
        "sum(h) OVER (PARTITION BY k, method, cand, v) AS same_h, sum(h) OVER (PARTITION BY k, method, cand) AS nh FROM both_o) GROUP BY k, method, cand)",
        "tpr AS (SELECT kind AS k, method, cand, avg(CASE WHEN v >= t THEN 1.0 ELSE 0.0 END) AS tpr FROM o JOIN lim USING (method, cand) GROUP BY kind, method, cand)",
        f"worth AS (SELECT a.k AS mode, method, cand, round({Y.WEIGHTS[0]} * tpr + CAST({Y.WEIGHTS[1]} AS DOUBLE) * a.auc + CAST({Y.WEIGHTS[2]} AS DOUBLE) * c.auc, 12) AS worth FROM area a JOIN tpr USING (k, method, cand) JOIN (SELECT * FROM area WHERE k = 'c') c USING (method, cand) WHERE a.k <> 'c')",
        "best AS (SELECT mode, method, cand FROM worth QUALIFY row_number() OVER (PARTITION BY mode, method ORDER BY worth DESC, cand) = 1)",
    ]

    def chosen(method: str, table: str, c: str = "cand") -> str:
        return f"(SELECT b FROM best JOIN b_{table} ON c = {c} WHERE best.mode = m.mode AND method = '{method}')"

    wide = len(Y.HIGH) + 1
    picks = {"ll": chosen("log_likelihood", "p"), "lr": chosen("log_rank", "r"), "lp": chosen("lrr_both", "p", f"cand // {wide}"), "lq": chosen("lrr_both", "r", f"cand % {wide}"), "lt": chosen("likelihood_ratio", "l"), "bi": chosen("binoculars", "n"), "eg": chosen("entropy_gap", "n")}
    spec = "spec AS MATERIALIZED (SELECT mode, 1 AS clipped, " + ", ".join(f"{q} AS {k}" for k, q in picks.items()) + " FROM (VALUES ('random'), ('tail')) AS m(mode) UNION ALL SELECT mode, 0, " + ", ".join("NULL" for _ in picks) + " FROM (VALUES ('random'), ('tail')) AS m(mode))"
    return [pairs, tokens, *own, *sums, *turned, spec]


def _testing() -> list[str]:
    shares = "sh(share) AS (VALUES " + ", ".join(f"(CAST({x} AS DOUBLE))" for x in Y.SHARES) + ")"
    hit = "CASE WHEN mode = 'random' THEN mix < share ELSE place < round_even(n * share, 0) END"
    mixed = "mx AS (SELECT mode, share, doc, n, " + ", ".join(f"CASE WHEN hit THEN o_{v} ELSE l_{v} END AS {v}" for v in VALUES) + f" FROM (SELECT *, {hit} AS hit FROM pr CROSS JOIN sh CROSS JOIN (VALUES ('random'), ('tail')) AS m(mode) WHERE test = 1))"
    people = "hu AS (SELECT mode, CAST(-1 AS DOUBLE) AS share, doc, n, " + ", ".join(VALUES) + " FROM t_human CROSS JOIN (VALUES ('random'), ('tail')) AS m(mode) WHERE test = 1 AND i < n)"
    n = f"(max(n) + {EPS})"
    columns = {
        "log_likelihood": f"sum(greatest(pa, ll)) / {n}", "log_rank": f"sum(least(ra, lr)) / {n}", "lrr_both": f"-sum(greatest(pa, lp)) / (sum(least(ra, lq)) + {EPS})", "likelihood_ratio": f"sum(greatest(pa - pb, lt)) / {n}",
        "binoculars": f"(sum(least(-pa, bi)) / {n}) / (sum(xe) / {n} + {EPS})", "entropy_gap": f"(sum(least(-pa, eg)) - sum(en)) / {n}",
    }
    wide = "wide AS MATERIALIZED (SELECT mode, clipped, share, doc, " + ", ".join(f"{x} AS {m}" for m, x in columns.items()) + " FROM (SELECT * FROM mx UNION ALL SELECT * FROM hu) JOIN spec USING (mode) GROUP BY mode, clipped, share, doc)"
    return [
        shares, mixed, people, wide, f"vs AS MATERIALIZED (SELECT mode, clipped, share, doc, method, v FROM wide UNPIVOT (v FOR method IN ({', '.join(columns)})))",
        "td AS (SELECT mode, clipped, method, CASE WHEN avg(v) FILTER (share = 0) >= avg(v) FILTER (share = -1) THEN 1 ELSE -1 END AS d FROM vs GROUP BY mode, clipped, method)",
        "tv AS MATERIALIZED (SELECT mode, clipped, method, share, round(v * d, 9) AS v FROM vs JOIN td USING (mode, clipped, method))",
        "tl AS (" + " UNION ALL ".join(f"SELECT mode, clipped, method, CAST({f} AS DOUBLE) AS fpr, round(quantile_cont(v, {1.0 - f!r}), 9) AS t FROM tv WHERE share = -1 GROUP BY mode, clipped, method" for f in Y.FPRS) + ")",
        "tb AS (SELECT mode, clipped, method, s.share AS share, v, CASE WHEN tv.share = -1 THEN 1 ELSE 0 END AS h FROM tv JOIN sh s ON tv.share IN (-1, s.share))",
        "ta AS (SELECT mode, clipped, method, share, round(sum(CASE WHEN h = 0 THEN upto - same_h / 2.0 END) / (max(nh) * CAST(count(*) FILTER (h = 0) AS DOUBLE)), 9) AS auroc FROM (SELECT *, sum(h) OVER (PARTITION BY mode, clipped, method, share ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, "
        "sum(h) OVER (PARTITION BY mode, clipped, method, share, v) AS same_h, sum(h) OVER (PARTITION BY mode, clipped, method, share) AS nh FROM tb) GROUP BY mode, clipped, method, share)",
        "tr AS (SELECT mode, clipped, method, share, fpr, avg(CASE WHEN v >= t THEN 1.0 ELSE 0.0 END) AS tpr FROM tv JOIN tl USING (mode, clipped, method) WHERE share >= 0 GROUP BY mode, clipped, method, share, fpr)",
    ]


def first_trial() -> str:
    return f"WITH {', '.join([*_documents(), *_tuning(), *_testing()])} SELECT mode, method, clipped = 1 AS clipped, share, fpr, round(tpr, 6) AS tpr, round(auroc, 6) AS auroc FROM tr JOIN ta USING (mode, clipped, method, share)"
