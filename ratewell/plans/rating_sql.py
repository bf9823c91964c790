"""The Bradley-Terry-Davidson fixed point as a recursive query for DuckDB: a step updates one strength of every group.

A round updates the strengths in label order, each with those before it already new; its last step scales them, gives the
tie parameter and says whether the round moved anything.
"""

from __future__ import annotations

ROUNDS, TOLERANCE = 1000, "1e-6"

#: fit_pairs must be a table of g (the group), model_lo, model_hi, win_lo, win_hi and ties; fitted gets g, model, rating, turns and done.
FITTED = f"""
fit_names AS MATERIALIZED (SELECT g, list(m ORDER BY m) AS names FROM (SELECT g, model_lo AS m FROM fit_pairs UNION SELECT g, model_hi FROM fit_pairs) x GROUP BY g),
fit_cells AS MATERIALIZED (SELECT c.g, list_position(names, a) AS i, list_position(names, b) AS j, len(names) AS n, w, l, t FROM (
    SELECT g, model_lo AS a, model_hi AS b, win_lo AS w, win_hi AS l, ties AS t FROM fit_pairs UNION ALL SELECT g, model_hi, model_lo, win_hi, win_lo, ties FROM fit_pairs) c JOIN fit_names f ON f.g = c.g),
fit_rows AS MATERIALIZED (SELECT g, i, sum(w + t / 2) AS won, list(j ORDER BY j) AS js, list(w + l + t ORDER BY j) AS met FROM fit_cells GROUP BY g, i),
fit_start AS MATERIALIZED (SELECT g, n, list(i ORDER BY i, j) FILTER (i < j) AS pi, list(j ORDER BY i, j) FILTER (i < j) AS pj, list(w + l + t ORDER BY i, j) FILTER (i < j) AS pm,
    sum(t) FILTER (i < j) AS ties, sum(w) AS decided FROM fit_cells GROUP BY g, n),
fit AS (
    SELECT g, n, 1 AS turn, 1 AS i, list_transform(range(n), lambda k: 1.0::DOUBLE) AS x, CASE WHEN ties > 0 THEN 1 + 2 * ties / (decided + ties) ELSE 1.5::DOUBLE END AS theta,
        list_transform(range(n), lambda k: 1.0::DOUBLE) AS old_x, CASE WHEN ties > 0 THEN 1 + 2 * ties / (decided + ties) ELSE 1.5::DOUBLE END AS old_theta, FALSE AS done FROM fit_start
    UNION ALL
    SELECT g, n, CASE WHEN i > n THEN turn + 1 ELSE turn END, CASE WHEN i > n THEN 1 ELSE i + 1 END, new_x, new_theta, CASE WHEN i > n THEN new_x ELSE old_x END, CASE WHEN i > n THEN new_theta ELSE old_theta END,
        i > n AND list_max(list_transform(range(1, n + 1), lambda k: abs(new_x[k] - old_x[k]))) < {TOLERANCE} AND abs(new_theta - old_theta) < {TOLERANCE}
    FROM (SELECT *, CASE WHEN i > n THEN CASE WHEN shared > 0 THEN greatest(1e-4::DOUBLE, ties / shared) ELSE theta END ELSE theta END AS new_theta FROM (
        SELECT *, CASE WHEN i > n THEN coalesce(list_sum(list_transform(range(1, len(pi) + 1), lambda k: pm[k] * 2 * sqrt(new_x[pi[k]] * new_x[pj[k]]) / (new_x[pi[k]] + theta * new_x[pj[k]] + theta * new_x[pi[k]] + new_x[pj[k]]))), 0) END AS shared FROM (
        SELECT *, list_transform(range(1, n + 1), lambda k: CASE WHEN i > n THEN x[k] / level WHEN k = i AND due > 0 THEN greatest(won / due, 1e-4::DOUBLE) ELSE x[k] END) AS new_x FROM (
        SELECT s.*, r.won, p.pi, p.pj, p.pm, p.ties, CASE WHEN s.i > s.n THEN exp(list_avg(list_transform(x, lambda v: ln(v + 1e-15)))) END AS level,
            list_sum(list_transform(range(1, len(js) + 1), lambda k: met[k] * (theta * x[js[k]] / (x[s.i] + theta * x[js[k]]) + x[js[k]] / (theta * x[s.i] + x[js[k]])))) / 2 AS due
        FROM fit s JOIN fit_start p ON p.g = s.g LEFT JOIN fit_rows r ON r.g = s.g AND r.i = s.i WHERE NOT s.done AND s.turn <= {ROUNDS}) a) b) c) d),
fit_last AS MATERIALIZED (SELECT g, arg_max(x, turn) AS x, max(turn) - 1 AS turns, bool_or(done) AS done FROM fit WHERE i = 1 GROUP BY g),
fitted AS MATERIALIZED (SELECT l.g, names[k] AS model, (ln(x[k] + 1e-15) - list_avg(list_transform(x, lambda v: ln(v + 1e-15)))) * 400 / ln(10) + 1500 AS rating, turns, done
    FROM fit_last l JOIN fit_names f ON f.g = l.g, range(1, 200) z(k) WHERE k <= len(names))
"""

#: The sums of each pair, from a table fit_matches of g, model_a, model_b, score and consistent.
PAIRS = """
fit_turned AS (SELECT g, least(model_a, model_b) AS model_lo, greatest(model_a, model_b) AS model_hi, CASE WHEN model_a < model_b THEN score ELSE 1 - score END AS s, consistent FROM fit_matches WHERE model_a <> model_b),
fit_pairs AS MATERIALIZED (SELECT g, model_lo, model_hi, sum(greatest(s - 0.5, 0) * 2)::DOUBLE AS win_lo, sum(greatest(0.5 - s, 0) * 2)::DOUBLE AS win_hi, sum(1 - abs(s - 0.5) * 2)::DOUBLE AS ties,
    count(*) AS n, count(*) FILTER (s > 0.5) AS n_lo, count(*) FILTER (s < 0.5) AS n_hi, count(*) FILTER (consistent) AS n_consistent FROM fit_turned GROUP BY g, model_lo, model_hi)"""

#: The leaderboard of each group: fit_board with g, model, rating, turns, done, win, loss, tie, n_observations, win_rate, position_consistency and rank.
BOARD = """
fit_met AS (SELECT g, model_lo AS model, n_lo AS w, n_hi AS l, n FROM fit_pairs UNION ALL SELECT g, model_hi, n_hi, n_lo, n FROM fit_pairs),
fit_counts AS (SELECT g, model, CAST(sum(w) AS BIGINT) AS win, CAST(sum(l) AS BIGINT) AS loss, CAST(sum(n) AS BIGINT) AS n_observations FROM fit_met GROUP BY g, model),
fit_shares AS (SELECT g, sum(n_consistent)::DOUBLE / sum(n) AS position_consistency FROM fit_pairs GROUP BY g),
fit_board AS MATERIALIZED (SELECT f.g, f.model, rating, turns, done, win, loss, n_observations - win - loss AS tie, n_observations, win::DOUBLE / n_observations AS win_rate, position_consistency,
    CAST(row_number() OVER (PARTITION BY f.g ORDER BY rating DESC, f.model) AS INTEGER) AS rank FROM fitted f JOIN fit_counts c ON c.g = f.g AND c.model = f.model JOIN fit_shares s ON s.g = f.g)
"""


def boards(tables: str, matches: str) -> str:
    """A WITH clause that ends in fit_board. tables: the clause that defines what matches, a SELECT for fit_matches, reads."""
    return "WITH RECURSIVE" + tables.removeprefix("WITH").rstrip() + f",\nfit_matches AS ({matches}),{PAIRS},{FITTED},{BOARD}"
