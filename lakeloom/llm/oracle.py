"""DuckDB SQL of operators 11 to 13, built from the operators' parameters."""

from __future__ import annotations

import math

from .rules import COUNTS, MAX_REPEAT_PERCENT, MIN_WORDS, RULES, WINDOW


def floor_div(s: str, n: str) -> str:
    """floor(s / n) of whole numbers, n > 0."""
    return f"CAST(({s} - ((({s}) % {n}) + {n}) % {n}) // {n} AS BIGINT)"


def integer_vectors(scale: int, dims: int) -> str:
    return f"""
 SELECT *, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"""


_SQUARE = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def centroid_clustering(dims: int, scale: int, k: int, rounds: int) -> str:
    ctes = [f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, v FROM ({integer_vectors(scale, dims)}))",
            f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS e FROM kept
 ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS b
 FROM (SELECT r, vec_id, v, c, CAST({_SQUARE.format(a='v', b='e')} AS BIGINT) AS d FROM kept, c{i}) GROUP BY r)""")
        if i < rounds:
            ctes.append(f"""n{i} AS (SELECT c, list({floor_div('s', 'n')} ORDER BY p) AS e FROM (SELECT b.c AS c, p, sum(v[p]) AS s, count(*) AS n
 FROM a{i}, range(1, {dims + 1}) AS g(p) GROUP BY ALL) GROUP BY c),
 c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN n{i} USING (c))""")
    return "WITH " + ",\n ".join(ctes) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
 CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(e, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON b.c = c"""


def vector_codes(dims: int, parts: int, scale: int, k: int, rounds: int) -> str:
    m = dims // parts
    ctes = [f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, v FROM ({integer_vectors(scale, dims)}))",
            f"""parts AS MATERIALIZED (SELECT r, p, v[p * {m} + 1:(p + 1) * {m}] AS x FROM kept, range({parts}) AS g(p))""",
            f"""firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS j FROM kept ORDER BY vec_id, v LIMIT {k})""",
            "c0 AS MATERIALIZED (SELECT p, j, x AS e FROM firsts JOIN parts USING (r))"]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(struct_pack(d := d, j := j)) AS b
 FROM (SELECT r, p, x, j, CAST({_SQUARE.format(a='x', b='e')} AS BIGINT) AS d FROM parts JOIN c{i} USING (p)) GROUP BY r, p)""")
        if i < rounds:
            ctes.append(f"""n{i} AS (SELECT p, j, list({floor_div('s', 'n')} ORDER BY q) AS e FROM (SELECT p, b.j AS j, q, sum(x[q]) AS s, count(*) AS n
 FROM a{i}, range(1, {m + 1}) AS g(q) GROUP BY ALL) GROUP BY p, j),
 c{i + 1} AS MATERIALIZED (SELECT p, j, coalesce(n{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN n{i} USING (p, j))""")
    return "WITH " + ",\n ".join(ctes) + f""",
 coded AS (SELECT r, string_agg(printf('%02x', b.j), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
 book AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), book"""


def quality_rules(risk: float, level: float) -> str:
    values = {r: f"{up} / greatest({low}, 1)" for r, (up, low, _) in RULES.items()}
    levels = " UNION ALL ".join(
        f"SELECT *, {i} AS rule, len(list_filter({cuts}, lambda c: c < {values[r]})) AS hits FROM {{rows}}"
        for i, (r, (_, _, cuts)) in enumerate(RULES.items()))
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(lang AS VARCHAR), '') AS stratum, coalesce(text, '') AS t FROM documents),
 w AS MATERIALIZED (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
 win AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
 rep AS (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
 cov AS (SELECT r, count(DISTINCT p) AS k FROM rep GROUP BY r),
 stats AS MATERIALIZED (SELECT r, doc_id, stratum, md5(t) AS h, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
   len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
   coalesce(k, 0) AS n_repeat_words, len(list_filter(w, lambda x: NOT regexp_matches(x, '\\p{{L}}'))) AS n_letterless
   FROM docs JOIN w USING (r) LEFT JOIN cov USING (r)),
 based AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM stats),
 levels AS MATERIALIZED ({levels.format(rows='based')}),
 marks AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
 known AS MATERIALIZED (SELECT stratum, h, min(r) AS r, max(q) = 1 AS good FROM based JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY stratum, h),
 scored AS (SELECT rule, c, count(*) FILTER (NOT good) AS bad, count(*) FILTER (good) AS good
   FROM (SELECT known.good, rule, unnest(range(0, hits)) AS c FROM known JOIN levels USING (r) WHERE known.h < '8') GROUP BY rule, c),
 ranked AS MATERIALIZED (SELECT rule, c, row_number() OVER (ORDER BY -bad / (good + 1), rule, c) AS t FROM scored WHERE bad > 0),
 first AS MATERIALIZED (SELECT r, min(t) AS t FROM levels JOIN ranked ON levels.rule = ranked.rule AND ranked.c < levels.hits GROUP BY r),
 gain AS (SELECT t, sum(sum(CASE WHEN good THEN -1 ELSE 1 END)) OVER (ORDER BY t) AS g FROM known JOIN first USING (r) WHERE known.h < '8' GROUP BY t),
 pairs AS MATERIALIZED (SELECT * FROM ranked WHERE t <= (SELECT coalesce(min(t), 0) FROM gain WHERE g > 0 AND g = (SELECT max(g) FROM gain))),
 steps AS MATERIALIZED (SELECT based.r, coalesce(first.t, (SELECT count(*) FROM ranked) + 1) AS step FROM based LEFT JOIN first USING (r)),
 hold AS MATERIALIZED (SELECT stratum, step FROM known JOIN steps USING (r) WHERE good AND NOT h < '8'),
 size AS (SELECT stratum, count(*) AS n FROM hold GROUP BY stratum),
 tested AS (SELECT stratum, n, t, (SELECT count(*) FROM hold WHERE hold.stratum = size.stratum AND step <= t) AS x
   FROM size, range(0, (SELECT count(*) + 1 FROM pairs)) AS g(t)),
 p AS (SELECT stratum, t, CASE WHEN x >= n * {risk} THEN 1 ELSE list_sum(list_transform(range(0, x + 1), lambda i:
   exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(risk)!r} + (n - i) * {math.log1p(-risk)!r}))) END AS p FROM tested),
 ends AS (SELECT stratum, greatest(0, coalesce(min(t) FILTER (p > {level} / (SELECT count(*) FROM size)) - 1, max(t))) AS last FROM p GROUP BY stratum)
SELECT doc_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTS if c not in ('n_lines', 'n_letterless'))}, base_failed,
 NOT base_failed AND step > coalesce(last, 0) AS kept
FROM based JOIN steps USING (r) LEFT JOIN ends USING (stratum)"""
