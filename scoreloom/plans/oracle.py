"""The pipeline's queries in DuckDB's SQL."""

from __future__ import annotations

from scoreloom.functions.text import WHITE
from scoreloom.operators.evaluate import LOWER, UPPER, WEIGHTS
from scoreloom.operators.ngram import ALPHA
from scoreloom.operators.prepare import CONTINUATION_TOKENS, MODES, PROMPT_TOKENS, RATIOS
from scoreloom.operators.scores import METHODS, SINGLE
from scoreloom.plans.queries import FIXED, SINGLE_BOUND
from scoreloom.plans.trialsql import first_trial
from scoreloom.sources.records import CORPORA
from scoreloom.sources.reports import RATES

WS = WHITE.replace(r"\x85\xA0", r"\x{85}\x{A0}")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"(CASE WHEN {strip(x)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex({strip(x)}, '[{WS}]+') END)"


def sentences(x: str) -> str:
    pieces = f"string_split(regexp_replace({strip(x)}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({pieces}, lambda p: {strip('p')}), lambda p: p <> '')"


def order_of(key: str, seed: int = 0) -> str:
    """The hash of functions.names.stable_hash for keys that aren't negative."""
    return f"((((({key}) % 2147483647) + 1) * 1103515245 + {12345 + 7919 * seed}) % 2147483647)"


def numbers(name: str, of: str = "token_features") -> str:
    return f"CAST({of}.{name} AS DOUBLE[])"


def finite(x: str) -> str:
    return f"list_filter({x}, lambda v: v IS NOT NULL AND isfinite(v))"


def mean(x: str) -> str:
    return f"(CASE WHEN len({finite(x)}) > 0 THEN list_sum({finite(x)}) / len({finite(x)}) END)"


def clip(x: str, lower: object = None, upper: object = None) -> str:
    value = "v" if lower is None else f"greatest(v, CAST({lower} AS DOUBLE))"
    value = value if upper is None else f"least({value}, CAST({upper} AS DOUBLE))"
    return f"list_transform({x}, lambda v: CASE WHEN v IS NOT NULL AND isfinite(v) THEN {value} END)"


def times(x: str, d: object) -> str:
    return f"list_transform({x}, lambda v: v * {d})"


def minus(a: str, b: str) -> str:
    return f"list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: ({a})[i] - ({b})[i])"


def score(method: str, d: object = 1, spec: dict | None = None, of: str = "token_features") -> str:
    spec = spec or {}
    nll, up = times(numbers("logp_a", of), -1), spec.get("nll_upper")
    if method in SINGLE:
        return mean(clip(times(numbers(SINGLE[method], of), d), lower=spec.get("lower")))
    if method == "entropy_gap":
        return f"{d} * {mean(minus(clip(nll, upper=up), numbers('entropy_a', of)))}"
    if method == "lrr":
        return f"{d} * {mean(clip(nll, upper=up))} / ({mean(clip(numbers('logrank_a', of), upper=spec.get('logrank_upper')))} + 1e-12)"
    if method == "binoculars":
        return f"{d} * {mean(clip(nll, upper=up))} / ({mean(numbers('cross_entropy_ba', of))} + 1e-12)"
    return mean(minus(numbers("logp_a", of), numbers("logp_b", of)))


def shown(x: str) -> str:
    return f"floor(({x}) * CAST(1e6 AS DOUBLE) + CAST(0.500001 AS DOUBLE)) / CAST(1e6 AS DOUBLE)"


DATASET = r"regexp_replace(lower(dataset), '[\s_\-]+', '', 'g')"
RATIO = "round(coalesce(contamination_ratio, 0), 6)"
SCORED = f"s AS (SELECT *, {RATIO} AS ratio, {DATASET} AS dataset_key, CASE WHEN scoring_reference_model IS NULL THEN 'primary' ELSE 'binoculars' END AS score_source FROM score_real_text)"
LONG = (
    "l AS ("
    + " UNION ALL ".join(
        f"SELECT label, contamination_mode, ratio, dataset_key, '{m}' AS method, round({score(m)}, 10) AS score FROM s WHERE score_source = '{'binoculars' if m == 'binoculars' else 'primary'}'"
        for m in METHODS
    )
    + "), raw AS (SELECT * FROM l WHERE score IS NOT NULL AND NOT isnan(score))"
)
# False-positive rates of the curve.
CURVE = (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005, 0.003, 0.001)
HUMAN, LLM = "label = 'human' AND contamination_mode = 'none'", "label = 'llm' AND contamination_mode = 'none'"
TURN = (
    f"turn AS (SELECT method, mean_human, mean_llm, CASE WHEN mean_llm >= mean_human THEN 1 ELSE -1 END AS direction FROM (SELECT method, round(avg(score) FILTER ({HUMAN}), 9) AS mean_human, "
    f"round(avg(score) FILTER ({LLM}), 9) AS mean_llm FROM raw GROUP BY method))"
)
ORIENTED = f"{SCORED}, {LONG}, {TURN}, o AS (SELECT raw.* REPLACE (score * direction AS score) FROM raw JOIN turn USING (method))"


def _rates(human: str, llm: str, by: str, more: str, fprs: tuple[float, ...]) -> str:
    limits = " UNION ALL ".join(f"SELECT {by}, CAST({f} AS DOUBLE) AS fpr, count(*) AS n_human, round(quantile_cont(score, {round(1 - f, 12)}), 9) AS threshold FROM {human} GROUP BY {by}" for f in fprs)
    return (
        f"SELECT {by}{more}, fpr, threshold, n_human, round(avg(CASE WHEN round(score, 9) >= threshold THEN 1.0 ELSE 0.0 END), 9) AS tpr, count(*) AS n_llm "
        f"FROM {llm} JOIN ({limits}) USING ({by}) GROUP BY {by}{more}, fpr, threshold, n_human"
    )


def _auroc(source: str, by: str, value: str, positive: str) -> str:
    return (
        f"SELECT {by}, round(sum(CASE WHEN p THEN below + (same_h) / 2.0 END) / (max(nh) * max(nm)), 9) AS auroc, max(nh) AS n_human, max(nm) AS n_llm FROM ("
        f"SELECT {by}, {positive} AS p, sum(CASE WHEN {positive} THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY {value} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(CASE WHEN {positive} THEN 0 ELSE 1 END) OVER (PARTITION BY {by}, {value}) AS below, "
        f"sum(CASE WHEN {positive} THEN 0 ELSE 1 END) OVER (PARTITION BY {by}, {value}) AS same_h, sum(CASE WHEN {positive} THEN 0 ELSE 1 END) OVER (PARTITION BY {by}) AS nh, sum(CASE WHEN {positive} THEN 1 ELSE 0 END) OVER (PARTITION BY {by}) AS nm FROM {source}) GROUP BY {by}"
    )


EXAMPLES = (
    "own AS (SELECT * FROM clean WHERE contamination_mode = 'none' AND text IS NOT NULL AND sample_id IS NOT NULL AND label IN ('human', 'llm') QUALIFY row_number() OVER (PARTITION BY sample_id, label ORDER BY row_id) = 1), "
    "ex AS (SELECT h.sample_id, h.dataset, h.example_id, h.prompt, h.text AS human_continuation, m.text AS llm_continuation FROM own h JOIN own m ON h.sample_id = m.sample_id AND h.label = 'human' AND m.label = 'llm')"
)
CELLS = "cells(ratio_index, ratio) AS (VALUES " + ", ".join(f"({i}, CAST({r} AS DOUBLE))" for i, r in enumerate(RATIOS)) + ")"
SIZED = f"g AS (SELECT *, {sentences('llm_continuation')} AS ls, {sentences('human_continuation')} AS hs FROM ex CROSS JOIN cells)"
K = "least(len(ls), greatest(1, CAST(round_even(len(ls) * ratio, 0) AS INTEGER)))"
OFF = "(len(ls) = 0 OR len(hs) = 0 OR ratio <= 0)"


def _split(source: str) -> str:
    return (
        f"ids AS (SELECT DISTINCT sample_id FROM {source} WHERE contamination_mode = 'none' AND sample_id IS NOT NULL), "
        f"pos AS (SELECT sample_id, row_number() OVER (ORDER BY {order_of('sample_id')}, sample_id) AS p, count(*) OVER () AS a FROM ids), "
        "split AS (SELECT sample_id, 'tune' AS split FROM pos WHERE p <= greatest(1, a // 2) UNION ALL SELECT sample_id, 'test' FROM pos WHERE a = 1 OR p > greatest(1, a // 2))"
    )


def _tune_parts(methods: tuple[str, ...], rows: str = "s") -> str:
    """CTEs up to ``obj``, the objective of every candidate of the methods on the tuning half of the rows."""
    pooled, tries = [], []
    for m in methods:
        src = "binoculars" if m == "binoculars" else "primary"
        own = f"FROM t, turn2 WHERE score_source = '{src}' AND label IN ('human', 'llm') AND contamination_mode = 'none'"

        def of(name: str, d: str, qs: tuple[float, ...], own: str = own, m: str = m) -> str:
            return " UNION ALL ".join(f"SELECT {i} AS i, round(quantile_cont(x, {q}), 9) AS b FROM (SELECT unnest({times(numbers(name), d)}) AS x {own} AND turn2.method = '{m}') WHERE x IS NOT NULL AND isfinite(x)" for i, q in enumerate(qs))

        if m in SINGLE:
            pooled.append(f"b_{m} AS (SELECT 0 AS cand, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS b2 UNION ALL SELECT i + 1, b, NULL FROM ({of(SINGLE[m], 'direction', LOWER)}))")
            spec = {"lower": "b"}
        elif m == "lrr":
            pooled.append(
                f"b_{m} AS (SELECT 0 AS cand, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS b2 UNION ALL SELECT x.i * {len(UPPER)} + y.i + 1, x.b, y.b FROM ({of('logp_a', '-1', UPPER)}) x, ({of('logrank_a', '1', UPPER)}) y)"
            )
            spec = {"nll_upper": "b", "logrank_upper": "b2"}
        else:
            pooled.append(f"b_{m} AS (SELECT 0 AS cand, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS b2 UNION ALL SELECT i + 1, b, NULL FROM ({of('logp_a', '-1', UPPER)}))")
            spec = {"nll_upper": "b"}
        # greatest and least pass over nulls, so the first candidate clips nothing.
        tries.append(
            f"SELECT label, contamination_mode, ratio, '{m}' AS method, cand, round({score(m, 'direction', spec)}, 10) AS score FROM t, b_{m}, (SELECT direction FROM turn2 WHERE method = '{m}') WHERE score_source = '{src}'"
        )
    raws = " UNION ALL ".join(f"SELECT label, contamination_mode, '{m}' AS method, round({score(m)}, 10) AS score FROM t WHERE score_source = '{'binoculars' if m == 'binoculars' else 'primary'}'" for m in methods)
    turn2 = f"turn2 AS (SELECT method, CASE WHEN round(avg(score) FILTER ({LLM}), 9) >= round(avg(score) FILTER ({HUMAN}), 9) THEN 1 ELSE -1 END AS direction FROM ({raws}) WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY method)"
    modes = "modes AS (SELECT contamination_mode AS mode, CASE WHEN list_contains(rs, 0.25) THEN 0.25 ELSE rs[len(rs) // 2 + 1] END AS r FROM (SELECT contamination_mode, list_sort(list(DISTINCT ratio)) AS rs FROM t WHERE contamination_mode <> 'none' GROUP BY contamination_mode))"
    lim = f"lim AS (SELECT method, cand, round(quantile_cont(score, 0.95), 9) AS t5, round(quantile_cont(score, 0.99), 9) AS t1 FROM sc WHERE {HUMAN} GROUP BY method, cand)"

    def hit(t: str) -> str:
        return f"round(avg(CASE WHEN round(score, 9) >= {t} THEN 1.0 ELSE 0.0 END), 9)"

    clean = f"cl AS (SELECT method, cand, {hit('t5')} AS c5 FROM sc JOIN lim USING (method, cand) WHERE {LLM} GROUP BY method, cand)"
    dirty = f"di AS (SELECT method, cand, mode, {hit('t5')} AS d5, {hit('t1')} AS d1, count(*) AS n FROM sc JOIN lim USING (method, cand) JOIN modes ON contamination_mode = mode AND abs(ratio - r) < 1e-12 GROUP BY method, cand, mode)"
    w5, w1, wc = WEIGHTS
    return (
        f"{_split(rows)}, t AS (SELECT {rows}.* FROM {rows} JOIN split USING (sample_id) WHERE split = 'tune'), {turn2}, {', '.join(pooled)}, "
        f"sc AS (SELECT * FROM ({' UNION ALL '.join(tries)}) WHERE score IS NOT NULL AND NOT isnan(score)), {modes}, {lim}, {clean}, {dirty} "
        f", obj AS (SELECT method, mode, cand, round(CAST(0 AS DOUBLE) + coalesce(d5, 0) * CAST({w5} AS DOUBLE) + coalesce(d1, 0) * CAST({w1} AS DOUBLE) + coalesce(c5, 0) * CAST({wc} AS DOUBLE), 9) AS objective, coalesce(n, 0) AS n_contaminated "
        "FROM (SELECT method, cand, mode FROM lim, modes) LEFT JOIN cl USING (method, cand) LEFT JOIN di USING (method, cand, mode))"
    )


def _tune(methods: tuple[str, ...]) -> str:
    return f"WITH {SCORED}, {_tune_parts(methods)} SELECT * FROM obj"


def _evaluate() -> str:
    """The best candidate of each method and mode, and its rates beside the raw ones on the other half; the last scoring of each row counts."""
    last = "r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY row_id, scoring_observer_model, scoring_reference_model ORDER BY scored_at DESC NULLS LAST, score_id DESC) = 1)"
    chosen = "ch AS (SELECT method, mode, cand FROM obj WHERE n_contaminated > 0 QUALIFY row_number() OVER (PARTITION BY method, mode ORDER BY objective DESC, cand) = 1)"
    scores, specs = [], []
    for m in METHODS:
        src = "binoculars" if m == "binoculars" else "primary"
        spec = {"lower": "b"} if m in SINGLE else {"nll_upper": "b", "logrank_upper": "b2"} if m == "lrr" else {"nll_upper": "b"}
        text = " || ', ' || ".join(f"'\"{k}\": ' || CAST({c} AS VARCHAR)" for k, c in spec.items())
        specs.append(f"SELECT '{m}' AS method, mode, b, b2, CASE WHEN cand = 0 THEN '{{}}' ELSE '{{' || {text} || '}}' END AS clip_spec, '{src}' AS score_source FROM ch JOIN b_{m} USING (cand) WHERE method = '{m}'")
        own = f"(SELECT mode, b, b2 FROM spec WHERE method = '{m}' UNION ALL SELECT '', NULL, NULL)"
        scores.append(
            f"SELECT label, contamination_mode, ratio, '{m}' AS method, mode, round({score(m, 'direction', spec)}, 10) AS score FROM e, {own}, (SELECT direction FROM turn2 WHERE method = '{m}') "
            f"WHERE score_source = '{src}' AND (contamination_mode = 'none' OR mode IN ('', contamination_mode))"
        )
    lim = f"tl AS (SELECT method, mode, count(*) AS n_human, round(quantile_cont(score, 0.95), 9) AS t5, round(quantile_cont(score, 0.99), 9) AS t1 FROM ts WHERE {HUMAN} GROUP BY method, mode)"
    hit = lambda t: f"round(avg(CASE WHEN round(score, 9) >= {t} THEN 1.0 ELSE 0.0 END), 9)"
    rates = f"ra AS (SELECT contamination_mode, ratio, method, mode, max(n_human) AS n_human, count(*) AS n_llm, {hit('t1')} AS r1, {hit('t5')} AS r5 FROM ts JOIN tl USING (method, mode) WHERE contamination_mode <> 'none' GROUP BY contamination_mode, ratio, method, mode)"
    return (
        f"WITH {SCORED}, {last}, {_tune_parts(METHODS, 'r')}, e AS (SELECT r.* FROM r JOIN split USING (sample_id) WHERE split = 'test'), {chosen}, spec AS ({' UNION ALL '.join(specs)}), "
        f"ts AS (SELECT * FROM ({' UNION ALL '.join(scores)}) WHERE score IS NOT NULL AND NOT isnan(score)), {lim}, {rates} "
        "SELECT a.contamination_mode AS mode, a.method, a.ratio, direction, spec.score_source, clip_spec, a.r1 AS raw_tpr_at_1_fpr, b.r1 AS clipped_tpr_at_1_fpr, a.r5 AS raw_tpr_at_5_fpr, b.r5 AS clipped_tpr_at_5_fpr, a.n_human AS n_test_human, a.n_llm AS n_test_llm "
        "FROM ra a LEFT JOIN ra b ON a.method = b.method AND a.contamination_mode = b.contamination_mode AND a.ratio = b.ratio AND b.mode = a.contamination_mode "
        "JOIN spec ON spec.method = a.method AND spec.mode = a.contamination_mode JOIN turn2 ON turn2.method = a.method WHERE a.mode = ''"
    )


def _ngram() -> str:
    tok = f"tok AS (SELECT row_id, label, unnest(w) AS word, unnest(range(len(w))) AS pos, w FROM (SELECT row_id, label, {words('text')} AS w FROM clean WHERE text IS NOT NULL AND label IN ('human', 'llm')))"
    ctx = "tc AS (SELECT row_id, label, pos, word, CASE WHEN pos = 0 THEN '' ELSE lower(w[pos][1]) END AS ctx FROM tok)"
    both = "both_n AS (SELECT ctx, word, count(*) FILTER (label = 'llm') AS na, count(*) FILTER (label = 'human') AS nb FROM tc GROUP BY ctx, word)"
    tot = "tot AS (SELECT ctx, sum(na) AS ta, sum(nb) AS tb, count(*) AS seen, (SELECT count(DISTINCT word) FROM both_n) AS v FROM both_n GROUP BY ctx)"
    p = f"p AS (SELECT ctx, word, (na + {ALPHA}::DOUBLE) / (ta + {ALPHA}::DOUBLE * v) AS pa, (nb + {ALPHA}::DOUBLE) / (tb + {ALPHA}::DOUBLE * v) AS pb, rank() OVER (PARTITION BY ctx ORDER BY na DESC) AS rank_a, ta, tb, seen, v FROM both_n JOIN tot USING (ctx))"
    za, zb = f"({ALPHA}::DOUBLE / (ta + {ALPHA}::DOUBLE * v))", f"({ALPHA}::DOUBLE / (tb + {ALPHA}::DOUBLE * v))"
    con = f"con AS (SELECT ctx, -(sum(pa * ln(pa)) + (v - seen) * {za} * ln({za})) AS ent, -(sum(pb * ln(pa)) + (v - seen) * {zb} * ln({za})) AS x FROM p GROUP BY ctx, ta, tb, seen, v)"
    return (
        f"WITH {tok}, {ctx}, {both}, {tot}, {p}, {con} SELECT row_id, count(*) AS num_scored_tokens, round(avg(ln(pa)), 6) AS log_likelihood, round(avg(rank_a), 6) AS rank, round(avg(ln(rank_a)), 6) AS log_rank, "
        "round(avg(-ln(pa)) / (avg(ln(rank_a)) + 1e-12), 6) AS lrr, round(avg(ent), 6) AS entropy, round(avg(-ln(pa) - ent), 6) AS entropy_gap, round(avg(-ln(pa)) / (avg(x) + 1e-12), 6) AS binoculars "
        "FROM tc JOIN p USING (ctx, word) JOIN con USING (ctx) GROUP BY row_id"
    )


METRICS = "m AS (SELECT DISTINCT * FROM metric_rows), e AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN CAST({c} AS VARCHAR) = 'nan' THEN NULL ELSE {c} END AS {c}" for c in RATES) + ") FROM m)"


def oracle_sql() -> dict[str, str]:
    kept = ("log_likelihood", "rank", "log_rank", "entropy", "entropy_gap", "binoculars")
    features = [*SINGLE.values(), "cross_entropy_ba"]
    qs = sorted({*LOWER, *UPPER})
    mixed = f"list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN list_contains(chosen, i - 1) THEN hs[{order_of('sample_id * 99991 + ratio_index * 997 + i - 1', 1)} % len(hs) + 1] ELSE ls[i] END)"
    places = f"list_transform(list_sort(list_transform(range(0, len(ls)), lambda i: {{'h': {order_of('sample_id * 100003 + ratio_index * 1009 + i')}, 'i': i}}))[1:k], lambda x: x.i)"
    tail_mixed = "list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN list_contains(spot, i - 1) THEN hs[top[list_position(spot, i - 1)] + 1] ELSE ls[i] END)"
    labels = "CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"log_likelihood": "LogLik", "rank": "Rank", "log_rank": "LogRank", "lrr": "LRR", "entropy": "Entropy", "entropy_gap": "Entropy-gap", "binoculars": "Binoculars"}.items()) + " ELSE method END"
    return {
        "first_text_field": f"SELECT row_id, CASE WHEN len({words('prompt')}) >= 80 THEN 'prompt' ELSE 'text' END AS field, CASE WHEN len({words('prompt')}) >= 80 THEN len({words('prompt')}) ELSE len({words('text')}) END AS n_words "
        f"FROM clean WHERE len({words('prompt')}) >= 80 OR len({words('text')}) >= 80",
        "dedupe_prefix": f"SELECT row_id, {order_of('row_id')} AS \"order\" FROM clean WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {strip(f"regexp_replace(substring(text, 1, 500), '[{WS}]+', ' ', 'g')")} ORDER BY {order_of('row_id')}, row_id) = 1",
        "sentence_counts": f"SELECT row_id, len(s) AS n_sentences, s[1] AS first_sentence, length(array_to_string(s, ' ')) AS joined_chars FROM (SELECT row_id, {sentences('text')} AS s FROM clean WHERE text IS NOT NULL)",
        "prompt_continuation": f"SELECT doc_id, prompt, continuation FROM (SELECT doc_id, {strip(f"array_to_string(t[1:{PROMPT_TOKENS}], ' ')")} AS prompt, {strip(f"array_to_string(t[{PROMPT_TOKENS + 1}:{PROMPT_TOKENS + CONTINUATION_TOKENS}], ' ')")} AS continuation "
        f"FROM (SELECT doc_id, {words('text')} AS t FROM documents WHERE text IS NOT NULL) WHERE len(t) >= {PROMPT_TOKENS + max(40, CONTINUATION_TOKENS // 2)}) WHERE len({sentences('continuation')}) >= 2",
        "pair_unpivot": f"WITH {EXAMPLES} SELECT sample_id, dataset, example_id, prompt, 'human' AS label, human_continuation AS text, 'human_clean' AS source, 'none' AS contamination_mode, CAST(0 AS DOUBLE) AS contamination_ratio FROM ex "
        "UNION ALL SELECT sample_id, dataset, example_id, prompt, 'llm', llm_continuation, 'llm_clean', 'none', 0 FROM ex",
        "expand_grid": f"WITH {EXAMPLES}, {CELLS}, {SIZED} SELECT sample_id, mode, ratio, len(ls) AS n_sentences, CASE WHEN len(ls) = 0 OR ratio <= 0 THEN 0 ELSE {K} END AS k FROM g CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in MODES)}) AS md(mode)",
        "contaminate_random_sentences": f"WITH {EXAMPLES}, {CELLS}, {SIZED}, gk AS (SELECT *, CASE WHEN {OFF} THEN 0 ELSE {K} END AS k FROM g), ga AS (SELECT *, {places} AS chosen FROM gk) "
        f"SELECT sample_id, ratio, k, len(ls) AS n_sentences, CASE WHEN k = 0 THEN llm_continuation ELSE array_to_string({mixed}, ' ') END AS text FROM ga",
        "contaminate_tail_sentences": f"WITH {EXAMPLES}, {CELLS}, {SIZED}, wc AS (SELECT word, round(-ln(count(*) / (sum(count(*)) OVER ())), 9) AS cost FROM (SELECT unnest({words('text')}) AS word FROM clean WHERE text IS NOT NULL) GROUP BY word), "
        f"hw AS (SELECT sample_id, idx, unnest({words('s')}) AS word FROM (SELECT sample_id, unnest(hs) AS s, unnest(range(len(hs))) AS idx FROM (SELECT sample_id, {sentences('human_continuation')} AS hs FROM ex))), "
        "hc AS (SELECT sample_id, idx, round(CAST(sum(CAST(cost AS DECIMAL(20,9))) AS DOUBLE) / count(*), 9) AS cost FROM hw JOIN wc USING (word) GROUP BY sample_id, idx), "
        "rk AS (SELECT sample_id, list(idx ORDER BY cost DESC, idx DESC) AS ranked FROM hc GROUP BY sample_id), "
        f"gk AS (SELECT *, CASE WHEN {OFF} THEN 0 ELSE least(len(hs), {K}) END AS k FROM g LEFT JOIN rk USING (sample_id)), "
        "ga AS (SELECT *, ranked[1:k] AS top, list_transform(range(0, k), lambda j: least(len(ls) - 1, CAST(floor((j + CAST(0.5 AS DOUBLE)) * len(ls) / k) AS BIGINT))) AS spot FROM gk) "
        f"SELECT sample_id, ratio, k, len(ls) AS n_sentences, CASE WHEN k = 0 THEN llm_continuation ELSE array_to_string({tail_mixed}, ' ') END AS text FROM ga",
        "ngram_scores": _ngram(),
        "doc_scores_raw": "SELECT score_id, " + ", ".join(f"{shown(score(m))} AS {m}" for m in (*METHODS, "likelihood_ratio")) + " FROM score_real_text",
        "doc_scores_clipped": "SELECT score_id, " + ", ".join(f"{shown(score(m, d, spec))} AS {m}" for m, (d, spec) in FIXED.items()) + " FROM score_real_text",
        "stored_scores": "SELECT method, count(stored) AS n_stored, count(score) AS n_scored, count(*) FILTER (abs(stored - score) > 0.01) AS n_differ FROM ("
        + " UNION ALL ".join(f"SELECT '{m}' AS method, doc_scores.{m} AS stored, round({score(m)}, 10) AS score FROM score_real_text" for m in kept) + ") GROUP BY method",
        "stale_counts": f"SELECT {DATASET} AS dataset_key, count(*) AS n_rows, count(len(token_features.logp_a)) AS n_with_tokens, count(*) FILTER (len(token_features.logp_a) <> num_scored_tokens) AS n_stale FROM score_real_text GROUP BY 1",
        "last_scored": f"WITH {SCORED} SELECT score_id, row_id, score_source FROM s QUALIFY row_number() OVER (PARTITION BY row_id, scoring_observer_model, scoring_reference_model ORDER BY scored_at DESC NULLS LAST, score_id DESC) = 1",
        "method_sources": f"WITH {SCORED} SELECT method, score_source, count(*) AS n_rows FROM s JOIN (VALUES " + ", ".join(f"('{m}', '{'binoculars' if m == 'binoculars' else 'primary'}')" for m in METHODS) + ") AS v(method, src) ON score_source = src GROUP BY method, score_source",
        "split_half": f"WITH {SCORED}, {_split('s')} SELECT * FROM split",
        "orientation": f"WITH {SCORED}, {LONG}, {TURN} SELECT * FROM turn",
        "pooled_quantiles": f"WITH {SCORED}, c AS (SELECT * FROM s WHERE label IN ('human', 'llm') AND contamination_mode = 'none'), x AS ("
        + " UNION ALL ".join(f"SELECT dataset_key, '{f}' AS feature, unnest({numbers(f)}) + CAST(0 AS DOUBLE) AS x FROM c" for f in features)
        + "), y AS (SELECT * FROM x WHERE x IS NOT NULL AND isfinite(x)) " + " UNION ALL ".join(f"SELECT dataset_key, feature, CAST({q} AS DOUBLE) AS q, count(*) AS n, round(quantile_cont(x, {q}), 9) + CAST(0 AS DOUBLE) AS quantile FROM y GROUP BY dataset_key, feature" for q in qs),
        "tpr_at_fpr": f"WITH {ORIENTED}, h AS (SELECT * FROM o WHERE {HUMAN}), d AS (SELECT * FROM o WHERE contamination_mode <> 'none') " + _rates("h", "d", "method", ", contamination_mode, ratio", (0.01, 0.05)),
        "tpr_curve": f"WITH {ORIENTED}, h AS (SELECT * FROM o WHERE {HUMAN}), d AS (SELECT * FROM o WHERE {LLM}) " + _rates("h", "d", "method", "", CURVE),
        "auroc": f"WITH {ORIENTED}, b AS (SELECT * FROM o WHERE ({HUMAN}) OR ({LLM})) " + _auroc("b", "method, dataset_key", "score", "(label = 'llm')"),
        "subset_counts": f"SELECT contamination_mode AS mode, {RATIO} AS ratio, count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples FROM contaminated WHERE contamination_mode IN ('random', 'tail') AND {RATIO} IN ({', '.join(map(str, RATIOS))}) GROUP BY 1, 2",
        "ratio_fallback": f"SELECT contamination_mode, CASE WHEN list_contains(rs, 0.25) THEN CAST(0.25 AS DOUBLE) ELSE rs[len(rs) // 2 + 1] END AS tuning_ratio FROM (SELECT contamination_mode, list_sort(list(DISTINCT {RATIO})) AS rs FROM contaminated WHERE contamination_mode <> 'none' GROUP BY 1)",
        "key_differences": f"WITH {SCORED}, a AS (SELECT DISTINCT sample_id, label, contamination_mode, ratio FROM s WHERE score_source = 'primary'), b AS (SELECT DISTINCT sample_id, label, contamination_mode, ratio FROM s WHERE score_source = 'binoculars') "
        "SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'extra', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
        "tune_single_bound": _tune(SINGLE_BOUND),
        "tune_lrr_grid": _tune(("lrr",)),
        "evaluate_grid": _evaluate(),
        "first_trial": first_trial(),
        "trial_report": "SELECT mode, method, " + ", ".join(f"round(avg(auroc) FILTER ({'' if c else 'NOT '}clipped), 6) AS {n}_auroc" for n, c in (("raw", False), ("clipped", True))) + ", "
        + ", ".join(f"round(max(tpr) FILTER ({'' if c else 'NOT '}clipped AND fpr = {f}), 6) AS {n}_tpr_at_{p}_fpr" for f, p in ((0.05, 5), (0.01, 1)) for n, c in (("raw", False), ("clipped", True)))
        + f", {labels} AS label FROM ({first_trial()}) WHERE share = 0.25 GROUP BY mode, method",
        "array_clip_mean": f"SELECT vec_id, label, round({mean('CAST(embedding AS DOUBLE[])')}, 9) AS raw_mean, round({mean(clip('CAST(embedding AS DOUBLE[])', lower=-0.05))}, 9) AS clipped_mean FROM embeddings",
        "price_quantiles": " UNION ALL ".join(f"SELECT l_returnflag, CAST({q} AS DOUBLE) AS q, count(*) AS n, round(quantile_cont(l_extendedprice, {q}), 6) AS quantile FROM lineitem GROUP BY l_returnflag" for q in (0.01, 0.05, 0.5, 0.95, 0.99)),
        "event_auroc": _auroc("(SELECT * REPLACE (round(value, 10) AS value) FROM events WHERE value IS NOT NULL AND NOT isnan(value))", "event_type", "value", "(user_id % 2 = 1)"),
        "job_matrix": "SELECT dataset, model, 'out/' || dataset || '/' || replace(model, '/', '__') AS path FROM (VALUES " + ", ".join(f"('{c}')" for c in sorted(CORPORA)) + ") AS d(dataset) CROSS JOIN (SELECT DISTINCT generator_model AS model FROM clean WHERE generator_model IS NOT NULL)",
        "metric_mean_rates": f"WITH {METRICS} SELECT dataset, generator_model, mode, method, count(*) AS n_rows, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in RATES) + " FROM e GROUP BY dataset, generator_model, mode, method",
        "metric_clipping_gain": f"WITH {METRICS} SELECT mode, method, round(ratio, 6) AS ratio, count(*) AS n_rows, " + ", ".join(f"round(avg(clipped_tpr_at_{p}_fpr - raw_tpr_at_{p}_fpr), 6) AS gain_at_{p}" for p in (1, 5)) + " FROM e GROUP BY mode, method, round(ratio, 6)",
        "metric_broken_rows": f"WITH {METRICS} SELECT dataset, generator_model, mode, method, ratio, reason FROM (SELECT *, CASE WHEN raw_tpr_at_5_fpr < raw_tpr_at_1_fpr OR clipped_tpr_at_5_fpr < clipped_tpr_at_1_fpr THEN 'order' WHEN clip_spec = '{{}}' AND (raw_tpr_at_1_fpr <> clipped_tpr_at_1_fpr OR raw_tpr_at_5_fpr <> clipped_tpr_at_5_fpr) THEN 'unclipped' END AS reason FROM e) WHERE reason IS NOT NULL",
        "metric_console_table": f"WITH {METRICS} SELECT method, {labels} AS label, round(avg(clipped_tpr_at_5_fpr) FILTER (mode = 'random'), 6) AS random, round(avg(clipped_tpr_at_5_fpr) FILTER (mode = 'tail'), 6) AS tail FROM e GROUP BY method",
    }
