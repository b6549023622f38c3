"""SQL of the operators for training data that DuckDB can express on whole tables."""

from __future__ import annotations

from scoreloom.llm.quantiles import FEATURES
from scoreloom.plans.trialsql import uniform

WORDS = r"regexp_extract_all(lower(nfc_normalize(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
OUTER = r"[\s\x00-\x1f\x{FEFF}\x{200B}\x{A0}\x{2000}-\x{200A}\x{3000}]+"
DATASET = r"regexp_replace(lower(dataset), '[\s_\-\x{A0}]+', '', 'g')"


def _words(x: str) -> str:
    return WORDS.format(x)


def _reach(edges: str) -> str:
    """Smallest node that each node reaches, of an edge list (u, v)."""
    return f"both_e AS (SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}), reach AS (SELECT u AS a, u AS b FROM both_e UNION SELECT r.a, e.v FROM reach r JOIN both_e e ON r.b = e.u), grp AS (SELECT a AS node, min(b) AS comp FROM reach GROUP BY a)"


REPEATED = (
    f"w AS (SELECT row_id, generator_model, {_words('text')} AS ws FROM clean), "
    "g AS (SELECT row_id, i, array_to_string(ws[i:i + 3], ' ') AS gram FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)), "
    "later AS (SELECT row_id, i FROM g QUALIFY row_number() OVER (PARTITION BY row_id, gram ORDER BY i) > 1), "
    "hit AS (SELECT row_id, count(DISTINCT i + k) AS n FROM later CROSS JOIN (VALUES (0), (1), (2), (3)) AS s(k) GROUP BY row_id), "
    "rep AS (SELECT row_id, generator_model, len(ws) AS n_words, coalesce(n, 0) AS repeated_words, coalesce(n, 0) / greatest(len(ws), 1) AS repeated_share FROM w LEFT JOIN hit USING (row_id))"
)
LEAKS = (
    f"iw AS (SELECT item_id, {_words('text')} AS ws FROM eval_items WHERE text IS NOT NULL), "
    "ig AS (SELECT item_id, i, len(ws) AS n, array_to_string(ws[i:i + 5], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 4)) AS i FROM iw WHERE len(ws) >= 6)), "
    f"dw AS (SELECT doc_id, {_words('text')} AS ws FROM documents WHERE text IS NOT NULL), "
    "dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 5], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 4)) AS i FROM dw WHERE len(ws) >= 6)), "
    "lk AS (SELECT doc_id, item_id, n, count(DISTINCT i + k) AS shared FROM dg JOIN ig USING (gram) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS s(k) GROUP BY doc_id, item_id, n), "
    "found AS (SELECT * FROM lk WHERE shared >= 0.4 * n)"
)
ARTICLES = (
    f"bare AS (SELECT sample_id, {DATASET} AS d, lower(regexp_replace(example_id, '^{OUTER}|{OUTER}$', '', 'g')) AS e0 FROM clean WHERE sample_id IS NOT NULL AND dataset IS NOT NULL AND example_id IS NOT NULL), "
    # A leading name is one whose letters, up to a separator, are the dataset's.
    r"art AS (SELECT DISTINCT sample_id, d, coalesce(list_extract(list_filter(list_transform(range(1, 41), lambda i: CASE WHEN regexp_replace(left(e0, i), '[\s_\-]+', '', 'g') = d AND regexp_matches(substring(e0, i + 1, 1), '[:/_\-]') AND NOT regexp_matches(substring(e0, i + 2, 1), '[\s_\-:/]') THEN substring(e0, i + 2) END), lambda x: x IS NOT NULL), 1), e0) AS e FROM bare), "
    "star AS (SELECT sample_id AS u, min(sample_id) OVER (PARTITION BY d, e) AS v FROM art WHERE e <> ''), edges AS (SELECT DISTINCT u, v FROM star WHERE u <> v)"
)
ALIKE = (
    f"w AS (SELECT row_id, {DATASET} AS d, {_words('text')} AS ws FROM clean WHERE dataset IS NOT NULL AND text IS NOT NULL), "
    "g AS (SELECT DISTINCT row_id, d, array_to_string(ws[i:i + 2], ' ') AS gram FROM (SELECT row_id, d, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)), "
    "n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id HAVING count(*) >= 40), "
    "common AS (SELECT a.row_id AS u, b.row_id AS v, count(*) AS c FROM g a JOIN g b ON a.d = b.d AND a.gram = b.gram AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id), "
    "edges AS (SELECT u, v FROM common JOIN n x ON u = x.row_id JOIN n y ON v = y.row_id WHERE 2 * c >= x.n + y.n - c)"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH RECURSIVE {ARTICLES}, {_reach('edges')} SELECT comp AS group_sample_id, node AS sample_id FROM grp WHERE node <> comp",
        "p2_splits": f"WITH RECURSIVE {ARTICLES}, {_reach('edges')}, tied AS (SELECT row_id, sample_id, coalesce(comp, sample_id) AS group_sample_id, round(coalesce(CASE WHEN NOT isnan(contamination_ratio) THEN contamination_ratio END, 0), 6) AS contamination_ratio FROM clean LEFT JOIN grp ON sample_id = node), "
        f"placed AS (SELECT *, {uniform(0, '(group_sample_id % 2147483647)')} AS place FROM tied) SELECT row_id, sample_id, group_sample_id, contamination_ratio, CASE WHEN place < 0.8 THEN 'train' WHEN place < 0.9 THEN 'validation' ELSE 'test' END AS split FROM placed",
        "p5_errors": "SELECT dataset, feature, count(*) AS n, 0 AS n_beyond FROM (" + " UNION ALL ".join(f"SELECT {DATASET} AS dataset, '{f}' AS feature, unnest(CAST(token_features.{f} AS DOUBLE[])) AS x FROM score_real_text" for f in FEATURES) + ") WHERE x IS NOT NULL AND isfinite(x) GROUP BY dataset, feature",
        "p6_round_trip": "SELECT count(*) AS n_docs, count(*) AS n_same FROM documents",
        "p3_found": f"WITH {REPEATED} SELECT row_id FROM rep WHERE n_words >= 30 AND repeated_words >= 0.4 * n_words",
        "p3_repetition": f"WITH {REPEATED} SELECT row_id, n_words, repeated_words, repeated_share FROM rep",
        "p3_generators": f"WITH {REPEATED} SELECT generator_model, count(*) AS n_rows, round(avg(repeated_share), 9) AS mean_repeated_share, count(*) FILTER (n_words >= 30 AND repeated_words >= 0.4 * n_words) AS repetitive_rows FROM rep GROUP BY generator_model",
        "p4_found": f"WITH RECURSIVE {ALIKE}, {_reach('edges')} SELECT a.node AS row_id_a, b.node AS row_id_b FROM grp a JOIN grp b ON a.comp = b.comp AND a.node < b.node",
        "p4_groups": f"WITH RECURSIVE {ALIKE}, {_reach('edges')} SELECT node AS row_id, comp AS group_row_id, count(*) OVER (PARTITION BY comp) AS group_rows FROM grp",
        "p7_found": f"WITH {LEAKS} SELECT doc_id, item_id FROM found",
        "p7_items": f"WITH {LEAKS} SELECT item_id, count(DISTINCT doc_id) AS n_docs, round(max(shared / n), 6) AS max_share FROM found GROUP BY item_id",
    }
