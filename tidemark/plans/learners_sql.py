"""SQL for learners whose fit is a handful of sums: Gaussian naive Bayes, and a tree that has a leaf for each cell of its columns."""

from __future__ import annotations

from collections.abc import Sequence


def bayes(train: str, test: str, features: Sequence[str], thresholds: Sequence[float] = (), weight: str = "") -> str:
    """Common table expressions up to `pr`: k, key, c (class), p (probability), and `best`: k, key, prediction.

    train: a query of k (split), y, the features and the weight, if there is one; test: of k, key and the features. Classes weigh by their
    rows; a billionth of the largest variance of all rows is added to variances."""
    avg = lambda x: f"(sum({weight} * {x}) / sum({weight}))" if weight else f"avg({x})"
    var = lambda f: f"{avg(f'{f} * {f}')} - {avg(f)} * {avg(f)}"
    n = f"sum({weight})" if weight else "count(*)"
    own = ", ".join(f"{avg(f)} AS m_{f}, {var(f)} AS v_{f}" for f in features)
    far = " + ".join(f"pow(te.{f} - m_{f}, 2) / (v_{f} + e) + ln(v_{f} + e)" for f in features)
    share = "p" if not thresholds else "p / CASE c " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(thresholds)) + " END"
    return f"""WITH tr AS ({train}), te AS ({test}),
st AS (SELECT k, y AS c, {n} AS n, {own} FROM tr GROUP BY k, y),
al AS (SELECT k, {n} AS total, 1e-9 * greatest({', '.join(map(var, features))}) AS e FROM tr GROUP BY k),
sc AS (SELECT te.k, te.key, st.c, ln(st.n) - ln(total) - 0.5 * ({far}) AS lp FROM te JOIN st ON te.k = st.k JOIN al ON te.k = al.k),
ex AS (SELECT k, key, c, exp(lp - max(lp) OVER (PARTITION BY k, key)) AS x FROM sc),
pr AS (SELECT k, key, c, x / sum(x) OVER (PARTITION BY k, key) AS p FROM ex),
best AS (SELECT k, key, CAST(arg_max(c, {share}) AS DOUBLE) AS prediction FROM pr GROUP BY k, key)
"""


def cells(train: str, test: str, columns: Sequence[str]) -> str:
    """Expressions up to `best`: k, key, prediction: the more frequent of the classes 0 and 1 in the cell of the columns."""
    same = " AND ".join(f"te.{c} = ce.{c}" for c in columns)
    return f"""WITH tr AS ({train}), te AS ({test}),
ce AS (SELECT k, {', '.join(columns)}, CASE WHEN 2 * sum(y) > count(*) THEN 1.0 ELSE 0.0 END AS v FROM tr GROUP BY ALL),
best AS (SELECT te.k, te.key, CAST(v AS DOUBLE) AS prediction FROM te JOIN ce ON te.k = ce.k AND {same})
"""


def segment_trees(rows: str, segments: Sequence[str], bins: Sequence[str], depth: int, least: int, folds: int) -> str:
    """Expressions up to `best`: key, learner, prediction of the rows that aren't for training, by segment the more accurate on folds of
    the most frequent class and a tree of binned columns. rows: a query of key, fold, is_train, y (0 or 1), the segments and bins."""
    s = ", ".join(segments)
    by, own = f"k, {s}, node", lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ("k", *segments, "node"))
    each = lambda t: " UNION ALL ".join(f"SELECT {by}, y, {i} AS f, {b} AS bin FROM {t}" for i, b in enumerate(bins))
    bin_at = "CASE f " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(bins)) + " END"
    out = [f"b AS ({rows})", f"r0 AS (SELECT b.*, k, 1 AS node FROM b CROSS JOIN (SELECT unnest([-1, {', '.join(map(str, range(folds)))}]) AS k) z WHERE is_train AND k <> fold)", "q0 AS (SELECT *, CASE WHEN is_train THEN fold ELSE -1 END AS k, 1 AS node FROM b)"]
    for i in range(depth + 1):
        out.append(f"o{i} AS (SELECT {by}, sum(y) AS p, count(*) AS n, CASE WHEN 2 * sum(y) > count(*) THEN 1.0 ELSE 0.0 END AS answer FROM r{i} GROUP BY {by})")
        if i == depth:
            break
        out += [
            f"h{i} AS (SELECT {by}, f, bin, sum(y) AS p, count(*) AS n FROM ({each(f'r{i}')}) e GROUP BY {by}, f, bin)",
            f"u{i} AS (SELECT {by}, f, bin, sum(p) OVER w AS pl, sum(n) OVER w AS nl FROM h{i} WINDOW w AS (PARTITION BY {by}, f ORDER BY bin ROWS UNBOUNDED PRECEDING))",
            f"c{i} AS (SELECT u.*, round((nl - ((nl - pl) * (nl - pl) + pl * pl) / CAST(nl AS DOUBLE)) + (n - nl - ((n - nl - p + pl) * (n - nl - p + pl) + (p - pl) * (p - pl)) / CAST(nullif(n - nl, 0) AS DOUBLE)), 9) AS cost, round(n - ((n - p) * (n - p) + p * p) / CAST(n AS DOUBLE), 9) AS whole FROM u{i} u JOIN o{i} o ON {own('u', 'o')} WHERE nl >= {least} AND n - nl >= {least})",
            f"d{i} AS (SELECT {by}, f, bin AS cut FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cost, f, bin) AS place FROM c{i} WHERE cost < whole) x WHERE place = 1)",
        ]
        for t in "rq":  # rows that train move to children; those that ask stay where there are none
            node = f"2 * {t}.node + CASE WHEN {bin_at} > cut THEN 1 ELSE 0 END"
            columns = f"{t}.key, {t}.fold, {t}.is_train, {t}.y, {', '.join(f'{t}.{c}' for c in (*segments, *bins))}, {t}.k"
            out.append(f"{t}{i + 1} AS (SELECT {columns}, {node if t == 'r' else f'coalesce({node}, {t}.node)'} AS node FROM {t}{i} {t} {'' if t == 'r' else 'LEFT '}JOIN d{i} d ON {own(t, 'd')})")
    leaves = " UNION ALL ".join(f"SELECT {by}, answer FROM o{i}" for i in range(depth + 1))
    at = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in segments)
    out += [
        f"lv AS ({leaves})",
        f"an AS (SELECT q.*, o.answer AS common, lv.answer AS tree FROM q{depth} q LEFT JOIN o0 o ON {at('q', 'o')} AND q.k = o.k LEFT JOIN lv ON {own('q', 'lv')})",
        f"ch AS (SELECT {s}, CASE WHEN sum(CASE WHEN tree = y THEN 1 ELSE 0 END) > sum(CASE WHEN common = y THEN 1 ELSE 0 END) THEN 'tree' ELSE 'common' END AS learner FROM an WHERE is_train GROUP BY {s})",
        "al AS (SELECT CASE WHEN 2 * sum(y) > count(*) THEN 1.0 ELSE 0.0 END AS v FROM b WHERE is_train)",
        f"best AS (SELECT key, learner, CAST(coalesce(CASE learner WHEN 'tree' THEN tree ELSE common END, al.v) AS DOUBLE) AS prediction FROM an CROSS JOIN al LEFT JOIN ch ON {at('an', 'ch')} WHERE NOT is_train)",
    ]
    return "WITH " + ",\n".join(out) + "\n"
