"""The same questions as plain SQL over the supplied tables, for an independent check."""

from __future__ import annotations

import re

from kinweave.functions.expressions import AGE_GAP_REST, AGE_GAPS, CLEAR, UNCLEAR

GAP_1, GAP_5, GAP_10 = (label for label, _ in AGE_GAPS)


def r(value: str, digits: int = 6) -> str:
    """Round half up on decimals, with summation noise taken out first."""
    return f"CAST(round(CAST({value} AS DECIMAL(30, 9)), {digits}) AS DOUBLE)"


def once(value: str, digits: int) -> str:
    """Round half up, once, on the decimal digits that a double stands for."""
    return f"CAST(round(CAST({value} AS DECIMAL(38, 15)), {digits}) AS DOUBLE)"


def _edges_by_gap(gap: int) -> str:
    return f"""
        SELECT a.o_custkey AS user_id, b.o_custkey AS friend_id,
            CAST(a.o_orderdate AS DATE) AS since, a.o_orderkey AS k
        FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + {gap}"""


def _pairs(gap: int) -> str:
    return f"""
        SELECT DISTINCT user_id AS user_a, friend_id AS user_b
        FROM ({_edges_by_gap(gap)}) WHERE user_id <> friend_id"""


def _paths(step: str, pairs: str = "path_pairs") -> str:
    return f"""
        SELECT user_a, user_b, path, CAST(len(path) - 1 AS INTEGER) AS depth FROM (
            WITH one AS (
                SELECT user_a, user_b, [user_a, user_b] AS path
                FROM {pairs} JOIN {step} s ON s.src = user_a AND s.dst = user_b
            ), left1 AS (
                SELECT * FROM {pairs} p WHERE NOT EXISTS (
                    SELECT 1 FROM one o WHERE o.user_a = p.user_a AND o.user_b = p.user_b)
            ), two AS (
                SELECT user_a, user_b, min([user_a, s.dst, user_b]) AS path
                FROM left1 JOIN {step} s ON s.src = user_a
                JOIN {step} t ON t.src = s.dst AND t.dst = user_b GROUP BY ALL
            ), left2 AS (
                SELECT * FROM left1 p WHERE NOT EXISTS (
                    SELECT 1 FROM two o WHERE o.user_a = p.user_a AND o.user_b = p.user_b)
            ), three AS (
                SELECT user_a, user_b, min([user_a, s.dst, t.dst, user_b]) AS path
                FROM left2 JOIN {step} s ON s.src = user_a JOIN {step} t ON t.src = s.dst
                JOIN {step} u ON u.src = t.dst AND u.dst = user_b GROUP BY ALL
            ), left3 AS (
                SELECT * FROM left2 p WHERE NOT EXISTS (
                    SELECT 1 FROM three o WHERE o.user_a = p.user_a AND o.user_b = p.user_b)
            ), four AS (
                SELECT user_a, user_b, min([user_a, s.dst, t.dst, u.dst, user_b]) AS path
                FROM left3 JOIN {step} s ON s.src = user_a JOIN {step} t ON t.src = s.dst
                JOIN {step} u ON u.src = t.dst
                JOIN {step} v ON v.src = u.dst AND v.dst = user_b GROUP BY ALL
            )
            SELECT * FROM one UNION ALL SELECT * FROM two
            UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four)"""


VIEWS = {
    "raw_edges": f"SELECT user_id, friend_id, since FROM ({_edges_by_gap(1)})",
    "dangling_edges": f"""
        SELECT user_id,
            friend_id + CASE WHEN k % 100 = 1 THEN 1000000 ELSE 0 END AS friend_id, since
        FROM ({_edges_by_gap(1)})""",
    "friendships": """
        SELECT least(user_id, friend_id) AS user_id, greatest(user_id, friend_id) AS friend_id,
            min(since) AS since
        FROM raw_edges WHERE user_id <> friend_id
        GROUP BY least(user_id, friend_id), greatest(user_id, friend_id)""",
    "adj": """
        SELECT user_id AS src, friend_id AS dst, since FROM friendships
        UNION ALL SELECT friend_id, user_id, since FROM friendships""",
    "outward": "SELECT user_id AS src, friend_id AS dst FROM friendships",
    "users": """
        SELECT c_custkey AS user_id, c_name AS name,
            CASE WHEN c_custkey % 50 = 49 THEN NULL
                ELSE CAST(18 + (c_custkey * 7) % 52 AS INTEGER) END AS age,
            n_name AS city,
            make_date(CAST(1995 + c_custkey % 6 AS INTEGER),
                CAST(1 + CAST(floor(c_custkey / 6) AS BIGINT) % 12 AS INTEGER),
                CAST(1 + CAST(floor(c_custkey / 72) AS BIGINT) % 27 AS INTEGER))
                AS registration_date
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "pairs": _pairs(2),
    "path_pairs": _pairs(5),
    "common": """
        SELECT a.src AS seed, b.dst AS cand, count(*) AS common_friends
        FROM adj a JOIN adj b ON b.src = a.dst
        WHERE b.dst <> a.src AND NOT EXISTS (
            SELECT 1 FROM adj d WHERE d.src = a.src AND d.dst = b.dst)
        GROUP BY a.src, b.dst""",
    "skewed_friendships": f"""
        SELECT least(user_id, friend_id) AS user_id, greatest(user_id, friend_id) AS friend_id
        FROM (SELECT user_id, friend_id FROM ({_edges_by_gap(1)})
            UNION ALL SELECT o_custkey, l_suppkey % 2 + 1 FROM lineitem
            JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 7 AND l_quantity < 10)
        WHERE user_id <> friend_id GROUP BY 1, 2""",
    "skewed_adj": """
        SELECT user_id AS src, friend_id AS dst FROM skewed_friendships
        UNION ALL SELECT friend_id, user_id FROM skewed_friendships""",
    "skewed_pairs": f"""
        {_pairs(2)} UNION SELECT h.id, c_custkey FROM customer, (VALUES (1), (2)) h(id)
        WHERE h.id <> c_custkey""",
    "skewed_path_pairs": f"""
        {_pairs(5)} UNION SELECT h.id, c_custkey FROM customer, (VALUES (1), (2)) h(id)
        WHERE h.id <> c_custkey""",
    "skewed_common": """
        SELECT a.src AS seed, b.dst AS cand, count(*) AS common_friends
        FROM skewed_adj a JOIN skewed_adj b ON b.src = a.dst
        LEFT JOIN skewed_adj d ON d.src = a.src AND d.dst = b.dst
        WHERE b.dst <> a.src AND d.src IS NULL GROUP BY a.src, b.dst""",
    "busiest": """
        SELECT src AS seed FROM adj GROUP BY src ORDER BY count(*) DESC, src LIMIT 1""",
    "as_of": "SELECT max(since) AS today FROM friendships",
    "runs": """
        SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS engine, event_type AS query,
            CAST(event_id % 5 AS INTEGER) AS size_idx,
            CASE event_id % 5 WHEN 0 THEN 'super-tiny' WHEN 1 THEN 'tiny' WHEN 2 THEN 'very-small'
                WHEN 3 THEN 'small' ELSE 'x-large' END AS size,
            CAST(CASE event_id % 5 WHEN 0 THEN 5000 WHEN 1 THEN 10000 WHEN 2 THEN 20000
                WHEN 3 THEN 50000 ELSE 500000 END AS BIGINT) AS users_n,
            CAST(1 + CAST(floor(event_id / 5) AS BIGINT) % 3 AS INTEGER) AS iteration,
            event_id AS run_no,
            CAST(floor(event_id / 500) AS BIGINT) AS source,
            'p' || CAST(1 + CAST(floor(event_id / 5) AS BIGINT) % 3 AS VARCHAR) AS profile,
            CAST(user_id AS INTEGER) AS results_count,
            value * CASE WHEN user_id % 2 = 0 THEN power(4.0, event_id % 5)
                ELSE 8 * power(2.0, event_id % 5) END AS t
        FROM events""",
    "pooled": """
        SELECT engine, query, count(*) AS n_runs, min(t) AS min_time, max(t) AS max_time,
            avg(t) AS avg_time, coalesce(stddev_samp(t), 0) AS std_time,
            arg_max(results_count, run_no) AS results_count
        FROM runs GROUP BY engine, query""",
    "experiment_stats": """
        SELECT profile, size, size_idx, source, engine, query, avg(t) AS avg_time,
            coalesce(stddev_samp(t), 0) AS std_time,
            arg_max(results_count, run_no) AS results_count
        FROM runs GROUP BY ALL""",
    "ratios": f"""
        SELECT a.profile, a.size, a.size_idx, a.source, a.query,
            {once("a.avg_time / b.avg_time", 2)} AS efficiency_coefficient,
            {once("a.avg_time / b.avg_time", 1)} AS b_faster_times,
            {once("(a.avg_time - b.avg_time) / a.avg_time * 100", 1)} AS improvement_percentage,
            {once("a.avg_time * 1000", 2)} AS a_time_ms, {once("b.avg_time * 1000", 2)} AS b_time_ms,
            CASE WHEN abs(a.avg_time - b.avg_time) > a.std_time + b.std_time
                THEN '{CLEAR}' ELSE '{UNCLEAR}' END AS significance,
            a.results_count AS result_count_a, b.results_count AS result_count_b
        FROM experiment_stats a JOIN experiment_stats b USING (profile, size, size_idx, source, query)
        WHERE a.engine = 'a' AND b.engine = 'b' AND a.avg_time > 0 AND b.avg_time > 0""",
    "summaries": f"""
        SELECT profile, size, size_idx, source,
            {r("avg(efficiency_coefficient)", 2)} AS average_efficiency,
            {r("median(efficiency_coefficient)", 2)} AS median_efficiency,
            max(efficiency_coefficient) AS max_efficiency,
            min(efficiency_coefficient) AS min_efficiency,
            count(*) FILTER (efficiency_coefficient < 1) AS a_wins_count,
            count(*) FILTER (efficiency_coefficient > 1) AS b_wins_count,
            count(*) AS total_comparisons,
            CASE WHEN round(avg(efficiency_coefficient), 9) > 1 THEN 'b' ELSE 'a' END
                AS overall_winner,
            CAST(round(CAST(abs(round(avg(efficiency_coefficient), 9) - 1) * 100
                AS DECIMAL(30, 9)), 1) AS DECIMAL(30, 1)) || '%' AS performance_advantage
        FROM ratios GROUP BY ALL""",
    "trials": """
        SELECT e.*, (CAST(size_idx AS BIGINT) << 40) + source AS seq,
            CASE WHEN average_efficiency IS NULL THEN 'load_failed' ELSE 'completed' END AS status,
            average_efficiency, overall_winner, a_wins_count, b_wins_count
        FROM (SELECT DISTINCT profile, size, size_idx, source FROM runs) e
        LEFT JOIN summaries USING (profile, size, size_idx, source)""",
    "histories": """
        SELECT *, row_number() OVER (PARTITION BY profile, current_size ORDER BY seq) - 1 AS place,
            count(*) OVER (PARTITION BY profile, current_size) AS n
        FROM trials JOIN (VALUES (1, 'tiny'), (2, 'very-small'), (3, 'small'), (4, 'x-large'),
            (5, 'end')) AS later(next_idx, current_size) ON next_idx > size_idx
        WHERE average_efficiency IS NOT NULL""",
    "fits": """
        SELECT profile, current_size, count(*) AS n,
            CASE WHEN min(average_efficiency) = max(average_efficiency) THEN 0
                ELSE regr_slope(average_efficiency, place) END AS slope,
            CASE WHEN min(average_efficiency) = max(average_efficiency) THEN 0
                ELSE regr_r2(average_efficiency, place) END AS r2,
            stddev_pop(average_efficiency) / avg(average_efficiency) AS volatility,
            min(average_efficiency) AS low, max(average_efficiency) AS high,
            arg_max(average_efficiency, place) AS newest,
            arg_max(a_wins_count, place) > arg_min(a_wins_count, place) AS a_up,
            arg_max(b_wins_count, place) > arg_min(b_wins_count, place) AS b_up
        FROM histories GROUP BY profile, current_size HAVING count(*) >= 2""",
    # Student's t by the cosine series, the product of each term taken by logarithms.
    "angles": """
        SELECT *, n - 2 AS nu, atan(sqrt(r2 / nullif(1 - r2, 0))) AS theta FROM fits WHERE n > 2""",
    "factors": """
        SELECT profile, current_size, j, ln(CASE WHEN nu % 2 = 1 THEN
                CASE WHEN j = 1 THEN cos(theta) ELSE cos(theta) ^ 2 * (2 * j - 2.0) / (2 * j - 1) END
            ELSE CASE WHEN j = 1 THEN 1 ELSE cos(theta) ^ 2 * (2 * j - 3.0) / (2 * j - 2) END
            END) AS log_factor
        FROM angles, range(1, 1 + nu // 2) AS g(j)""",
    "series": """
        SELECT profile, current_size, sum(term) AS total FROM (
            SELECT profile, current_size, exp(sum(log_factor) OVER (
                PARTITION BY profile, current_size ORDER BY j)) AS term FROM factors)
        GROUP BY profile, current_size""",
    "p_values": """
        SELECT profile, current_size, greatest(0, 1 - CASE WHEN nu % 2 = 1
                THEN 2 / pi() * (theta + sin(theta) * coalesce(total, 0))
                ELSE sin(theta) * coalesce(total, 0) END) AS p
        FROM angles LEFT JOIN series USING (profile, current_size)""",
    "trend": """
        SELECT f.*, CASE WHEN low = high THEN 1.0 WHEN n = 2 OR r2 = 1 THEN 0.0 ELSE p END
            AS p_value
        FROM fits f LEFT JOIN p_values USING (profile, current_size)""",
    "size_means": """
        SELECT size, users_n, engine, query, avg(file_mean) AS mean_time FROM (
            SELECT size, users_n, engine, query, source, avg(t) AS file_mean
            FROM runs GROUP BY ALL)
        GROUP BY ALL""",
    "points": """
        SELECT a.query, a.users_n, a.mean_time AS a, b.mean_time AS b
        FROM size_means a JOIN size_means b USING (query, users_n)
        WHERE a.engine = 'a' AND b.engine = 'b'""",
    "sides": """
        SELECT query, users_n::DOUBLE AS x, 'a' AS engine, a AS y FROM points
        UNION ALL SELECT query, users_n::DOUBLE, 'b', b FROM points""",
    "secants": """
        SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY query, engine) AS n,
            lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s
        FROM sides WINDOW w AS (PARTITION BY query, engine ORDER BY x)""",
    "neighbours": """
        SELECT *, lag(h) OVER w AS hp, lag(s) OVER w AS sp, lag(h, 2) OVER w AS hpp,
            lag(s, 2) OVER w AS spp, lead(h) OVER w AS hn, lead(s) OVER w AS sn
        FROM secants WINDOW w AS (PARTITION BY query, engine ORDER BY x)""",
    "raw_slopes": """
        SELECT *, CASE
            WHEN n = 2 THEN coalesce(s, sp)
            WHEN k = 1 THEN ((2 * h + hn) * s - h * sn) / (h + hn)
            WHEN k = n THEN ((2 * hp + hpp) * sp - hp * spp) / (hp + hpp)
            WHEN sign(sp) <> sign(s) OR s = 0 OR sp = 0 THEN 0
            ELSE 3 * (h + hp) / ((2 * h + hp) / sp + (h + 2 * hp) / s) END AS d0,
            CASE WHEN k = 1 THEN s ELSE sp END AS e0, CASE WHEN k = 1 THEN sn ELSE spp END AS e1
        FROM neighbours""",
    "slopes": """
        SELECT *, CASE WHEN n > 2 AND (k = 1 OR k = n) THEN
            CASE WHEN sign(d0) <> sign(e0) THEN 0
                WHEN sign(e0) <> sign(e1) AND abs(d0) > 3 * abs(e0) THEN 3 * e0
                ELSE d0 END ELSE d0 END AS d
        FROM raw_slopes""",
    "pieces": """
        SELECT query, engine, k, n, x, h, y, d, lead(x) OVER w AS x1, lead(y) OVER w AS y1,
            lead(d) OVER w AS d1
        FROM slopes WINDOW w AS (PARTITION BY query, engine ORDER BY x)""",
    "grid": """
        SELECT query, i, power(10.0, lo + i * ((hi - lo) / 1999)) AS gx FROM (
            SELECT query, log10(min(x)) AS lo, log10(max(x)) AS hi FROM sides GROUP BY query
            HAVING count(DISTINCT x) > 1), range(2000) AS g(i)""",
    "values_": """
        SELECT query, engine, i, gx AS x,
            (1 + 2 * u) * (1 - u) * (1 - u) * y + u * (1 - u) * (1 - u) * h * d
            + u * u * (3 - 2 * u) * y1 + u * u * (u - 1) * h * d1 AS y
        FROM (SELECT g.query, g.i, g.gx, p.* EXCLUDE (query, x), (g.gx - p.x) / p.h AS u
            FROM grid g JOIN pieces p ON g.query = p.query AND p.k < p.n
                AND (g.gx >= p.x OR p.k = 1) AND (g.gx < p.x1 OR p.k = p.n - 1))""",
    "curve": """
        SELECT a.query, CAST(a.i AS INTEGER) AS i, a.x, a.y AS a, b.y AS b
        FROM values_ a JOIN values_ b ON a.query = b.query AND a.i = b.i
        WHERE a.engine = 'a' AND b.engine = 'b'""",
    "crossing": """
        SELECT DISTINCT query, root FROM (
            SELECT query, coalesce(x - d * (x1 - x) / nullif(d1 - d, 0), (x + x1) / 2) AS root
            FROM (SELECT query, x, a - b AS d, lead(x) OVER w AS x1, lead(a - b) OVER w AS d1
                FROM curve WINDOW w AS (PARTITION BY query ORDER BY i))
            WHERE sign(d) <> sign(d1)
            UNION ALL SELECT query, x FROM curve WHERE abs(a - b) <= 1e-12)""",
    "crossover": """
        SELECT query, coalesce(n_crossings, 0) AS n_crossings, critical, "initial", "final" FROM (
            SELECT query,
                CASE sign(arg_min(a - b, i)) WHEN -1 THEN 'a' WHEN 1 THEN 'b' ELSE 'equal' END
                    AS "initial",
                CASE sign(arg_max(a - b, i)) WHEN -1 THEN 'a' WHEN 1 THEN 'b' ELSE 'equal' END
                    AS "final"
            FROM curve GROUP BY query)
        LEFT JOIN (SELECT query, count(*) AS n_crossings, min(root) AS critical
            FROM crossing GROUP BY query) USING (query)""",
}


def _ctes(body: str) -> str:
    """Put the views a statement needs, and those they need, in front of it."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|SELECT 1 FROM)\s+{name}\b", text):
                needed.add(name)
                collect(VIEWS[name])
            elif name not in needed and re.search(rf",\s+{name}\s", text):
                needed.add(name)
                collect(VIEWS[name])

    collect(body)
    if not needed:
        return body
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH {views}\n{body}"


def _cohorts(edges: str, end: str) -> str:
    return f"""
        SELECT CAST(year(registration_date) AS INTEGER) AS cohort_year,
            CAST(month(since) AS INTEGER) AS friendship_month,
            count(DISTINCT u.user_id) AS users_count, count(*) AS friendships_count
        FROM users u JOIN {edges} e ON u.user_id = e.{end}
        WHERE year(since) = year(registration_date) GROUP BY 1, 2"""


def _cities(edges: str, one: str, two: str) -> str:
    return f"""
        SELECT u1.city, count(*) AS connections_count, count(DISTINCT u2.city) AS unique_cities
        FROM {edges} e JOIN users u1 ON e.{one} = u1.user_id JOIN users u2 ON e.{two} = u2.user_id
        WHERE u1.city <> u2.city GROUP BY u1.city
        ORDER BY connections_count DESC, u1.city LIMIT 5"""


def _age_gaps(edges: str, one: str, two: str) -> str:
    return f"""
        SELECT CASE WHEN abs(u1.age - u2.age) <= 1 THEN '{GAP_1}'
                WHEN abs(u1.age - u2.age) <= 5 THEN '{GAP_5}'
                WHEN abs(u1.age - u2.age) <= 10 THEN '{GAP_10}'
                ELSE '{AGE_GAP_REST}' END AS age_category, count(*) AS count
        FROM {edges} e JOIN users u1 ON e.{one} = u1.user_id JOIN users u2 ON e.{two} = u2.user_id
        WHERE u1.age IS NOT NULL AND u2.age IS NOT NULL GROUP BY 1"""


def _growth(edges: str, since: str) -> str:
    return f"""
        SELECT CAST(year(since) AS INTEGER) AS year, CAST(month(since) AS INTEGER) AS month,
            count(*) AS new_friendships
        FROM {edges} e WHERE {since} GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 12"""


BODIES = {
    "simple_friends": "SELECT src AS seed, dst AS friend_id FROM adj",
    "simple_friends_stored": "SELECT src AS seed, dst AS friend_id FROM adj",
    "friends_of_friends_stored": "SELECT seed, cand AS fof FROM common",
    "friends_of_friends": "SELECT seed, cand AS fof FROM common",
    "mutual_friends": """
        SELECT user_a, user_b, x.dst AS mutual FROM pairs JOIN adj x ON x.src = user_a
        JOIN adj y ON y.src = user_b AND y.dst = x.dst""",
    "friend_recommendations": """
        SELECT cand, common_friends FROM common JOIN busiest USING (seed)
        ORDER BY common_friends DESC, cand LIMIT 10""",
    "friend_recommendations_batch": """
        SELECT seed, cand, common_friends, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY seed ORDER BY common_friends DESC, cand)
                AS rank FROM common)
        WHERE rank <= 10""",
    "friends_of_friends_skewed": "SELECT seed, cand AS fof FROM skewed_common",
    "mutual_friends_skewed": """
        SELECT user_a, user_b, x.dst AS mutual FROM skewed_pairs
        JOIN skewed_adj x ON x.src = user_a
        JOIN skewed_adj y ON y.src = user_b AND y.dst = x.dst""",
    "friend_recommendations_skewed": """
        SELECT seed, cand, common_friends, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY seed ORDER BY common_friends DESC, cand)
                AS rank FROM skewed_common)
        WHERE rank <= 10""",
    "shortest_path": f"""
        SELECT user_a, user_b, '[' || array_to_string(path, ',') || ']' AS path, depth
        FROM ({_paths("adj")})""",
    "shortest_path_directed": f"""
        SELECT user_a, user_b, '[' || array_to_string(path, ',') || ']' AS path, depth
        FROM ({_paths("outward")})""",
    "shortest_path_skewed": f"""
        SELECT user_a, user_b, '[' || array_to_string(path, ',') || ']' AS path, depth
        FROM ({_paths("skewed_adj", "skewed_path_pairs")})""",
    "cohort_analysis": _cohorts("friendships", "user_id"),
    "cohort_analysis_both": _cohorts("adj", "src"),
    "social_cities": _cities("friendships", "user_id", "friend_id"),
    "social_cities_both": _cities("adj", "src", "dst"),
    "age_gap_analysis": _age_gaps("friendships", "user_id", "friend_id"),
    "age_gap_analysis_both": _age_gaps("adj", "src", "dst"),
    "network_growth": _growth(
        "friendships", "since >= (SELECT today FROM as_of) - INTERVAL 2 YEAR"
    ),
    "network_growth_both": _growth("adj", "year(since) >= (SELECT year(today) FROM as_of) - 2"),
    "network_growth_as_of": _growth("friendships", "since >= DATE '2001-03-15' - INTERVAL 2 YEAR"),
    "age_clustering": f"""
        SELECT CAST(floor(age / 10) * 10 AS INTEGER) AS age_group, count(*) AS users_count,
            {r("avg(CASE WHEN degree >= 2 THEN 1.0 * (degree - 1) / degree ELSE 0 END)")}
                AS clustering_estimate
        FROM (SELECT u.user_id, u.age, count(DISTINCT f.friend_id) AS degree
            FROM users u LEFT JOIN friendships f ON u.user_id = f.user_id
            WHERE u.age IS NOT NULL GROUP BY u.user_id, u.age)
        GROUP BY 1 HAVING count(*) >= 2""",
    "age_clustering_both": f"""
        SELECT CAST(floor(age / 10) * 10 AS INTEGER) AS age_group, count(*) AS users_count,
            {r("avg(1.0 * (degree - 1) / degree)")} AS clustering_estimate
        FROM (SELECT u.user_id, u.age, count(f.dst) AS degree
            FROM users u LEFT JOIN adj f ON u.user_id = f.src
            WHERE u.age IS NOT NULL GROUP BY u.user_id, u.age)
        WHERE degree >= 2 GROUP BY 1""",
    "db_metrics_counts": """
        SELECT (SELECT count(*) FROM users) AS users_count,
            (SELECT count(*) FROM friendships) AS friendships_count""",
    "db_metrics_degree_out": f"""
        SELECT count(DISTINCT user_id) AS users_with_friends,
            count(DISTINCT friend_id) AS unique_friends, {r("avg(n)")} AS avg_friends_per_user
        FROM (SELECT user_id, friend_id, count(*) AS n FROM friendships GROUP BY 1, 2)""",
    "db_metrics_degree_both": f"""
        SELECT count(*) AS users_with_friends, {r("avg(degree)")} AS avg_degree,
            min(degree) AS min_degree, max(degree) AS max_degree
        FROM (SELECT src, count(*) AS degree FROM adj GROUP BY src)""",
    "age_distribution": f"""
        SELECT min(age) AS min_age, max(age) AS max_age, {r("avg(age)")} AS avg_age,
            {r("quantile_cont(age, 0.5)")} AS median_age
        FROM users""",
    "graph_counts": """
        SELECT kind, name, n FROM (
            SELECT 1 AS part, count(*) AS n FROM users
            UNION ALL SELECT 2, count(*) FROM friendships)
        JOIN (VALUES (1, 'table', 'users'), (1, 'nodes_total', 'all'),
            (1, 'nodes_by_label', 'User'), (2, 'table', 'friendships'),
            (2, 'relationships_total', 'all'), (2, 'relationships_by_type', 'FRIENDS_WITH'))
            AS v(part, kind, name) USING (part)""",
    "graph_metadata": f"""
        SELECT *, {r("2.0 * num_friendships / num_users")} AS avg_degree FROM (
            SELECT (SELECT count(*) FROM users) AS num_users,
                (SELECT count(*) FROM friendships) AS num_friendships)""",
    "pick_pair": """
        SELECT user_a, (SELECT user_id FROM users
            WHERE user_id <> user_a AND user_id NOT IN (
                SELECT friend_id FROM friendships WHERE friendships.user_id = user_a
                UNION SELECT friendships.user_id FROM friendships WHERE friend_id = user_a)
            ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 1) AS user_b
        FROM (SELECT user_id AS user_a FROM users
            WHERE user_id IN (SELECT user_id FROM friendships UNION SELECT friend_id FROM friendships)
            ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 1)""",
    "nth_candidate": """
        SELECT (SELECT count(DISTINCT src) FROM adj) AS n_rows,
            (SELECT DISTINCT src FROM adj ORDER BY src LIMIT 1 OFFSET 100) AS node""",
    "nth_candidate_repeated": """
        SELECT (SELECT count(*) FROM users) AS n_rows,
            (SELECT age FROM users WHERE age IS NOT NULL ORDER BY age LIMIT 1 OFFSET 700) AS age""",
    "runs_from_json": f"""
        SELECT profile, size, users_n, engine, query,
            CAST(arg_max(results_count, run_no) OVER (
                PARTITION BY source, size, profile, engine, query) AS INTEGER) AS results_count,
            CAST(row_number() OVER (PARTITION BY source, size, profile, engine, query
                ORDER BY iteration, run_no) AS INTEGER) AS iteration,
            {r("t")} AS t
        FROM runs""",
    "run_stats": f"""
        SELECT engine, query, n_runs, {r("min_time")} AS min_time, {r("max_time")} AS max_time,
            {r("avg_time")} AS avg_time, {r("std_time")} AS std_time, results_count
        FROM pooled""",
    "run_stats_warm": f"""
        SELECT engine, query, count(*) AS n_runs, {r("min(t)")} AS min_time,
            {r("max(t)")} AS max_time, {r("avg(t)")} AS avg_time,
            {r("coalesce(stddev_samp(t), 0)")} AS std_time
        FROM runs WHERE iteration > 2 GROUP BY engine, query""",
    "dataset_means": f"""
        SELECT size, users_n, engine, query, {r("mean_time")} AS mean_time FROM size_means""",
    "run_counts": """
        SELECT size, count(*) FILTER (engine = 'a') AS a, count(*) FILTER (engine = 'b') AS b
        FROM (SELECT DISTINCT size, engine, query, source FROM runs) GROUP BY size""",
    "efficiency": "SELECT * FROM ratios",
    "efficiency_summary": "SELECT * FROM summaries",
    "efficiency_from_json": """
        SELECT profile, size, query, efficiency_coefficient, improvement_percentage, a_time_ms, b_time_ms, significance FROM ratios
        UNION ALL
        SELECT profile, size, '_summary', average_efficiency, NULL, NULL, NULL, overall_winner FROM summaries""",
    "complete_documents": """
        SELECT profile, size, status, users_count, documents, n_times, sum_times, n_ratios
        FROM (SELECT profile, size, status, count(*) AS documents FROM trials GROUP BY ALL)
        JOIN (SELECT profile, size, count(*) AS n_times, round(sum(t), 3) AS sum_times
            FROM runs GROUP BY ALL) USING (profile, size)
        LEFT JOIN (SELECT profile, size, count(*) AS n_ratios FROM ratios GROUP BY ALL)
            USING (profile, size)
        CROSS JOIN (SELECT count(*) AS users_count FROM users)""",
    "size_documents": """
        SELECT profile, size, (row_number() OVER (PARTITION BY profile, size ORDER BY seq) - 1) // 3 AS page,
            count(*) OVER (PARTITION BY profile, size) AS iterations,
            count(*) FILTER (status = 'completed') OVER (PARTITION BY profile, size) AS successful_iterations,
            seq, status, average_efficiency
        FROM trials""",
    "efficiency_by_class": f"""
        SELECT profile, size, size_idx, source,
            CASE WHEN query IN ('click', 'view') THEN 'graph' ELSE 'analytical' END AS class,
            {r("avg(efficiency_coefficient)")} AS avg_efficiency,
            count(*) FILTER (efficiency_coefficient > 1) AS b_wins_count,
            count(*) AS total_comparisons
        FROM ratios GROUP BY ALL""",
    "fastest_queries": f"""
        SELECT query, c AS efficiency_coefficient,
            CASE WHEN c > 1 THEN 'b' WHEN c > 0 THEN 'a' END AS faster,
            CASE WHEN c > 1 THEN {once("c", 1)} WHEN c > 0 THEN {once("1 / greatest(c, 0.01)", 1)} END
                AS times
        FROM (SELECT query, {once("a.avg_time / b.avg_time", 2)} AS c
            FROM pooled a JOIN pooled b USING (query) WHERE a.engine = 'a' AND b.engine = 'b')
        ORDER BY c DESC, query LIMIT 5""",
    "engine_ratio": f"""
        SELECT query, {once("a.avg_time * 1000", 2)} AS a_ms, {once("b.avg_time * 1000", 2)} AS b_ms,
            {once("a.avg_time / nullif(b.avg_time, 0)", 2)} AS ratio
        FROM (SELECT * FROM pooled WHERE engine = 'a') a
        LEFT JOIN (SELECT * FROM pooled WHERE engine = 'b') b USING (query)""",
    "wins_by_size": """
        SELECT query, users_n, CASE WHEN a < b THEN 'a' ELSE 'b' END AS winner
        FROM points WHERE a <> b""",
    "degradations": f"""
        SELECT query, engine, CAST(x AS BIGINT) AS users_n, {r("y / prev")} AS growth FROM (
            SELECT *, lag(y) OVER (PARTITION BY query, engine ORDER BY x) AS prev FROM sides)
        WHERE prev > 0 AND y / prev >= 4""",
    "pchip_curve": f"""
        SELECT query, i, {r("x")} AS x, {r("a")} AS a, {r("b")} AS b FROM curve""",
    "crossovers": f"""
        SELECT query, n_crossings, {r("critical")} AS critical, "initial", "final"
        FROM crossover""",
    "max_gap": f"""
        SELECT query, {r("rel")} AS max_rel_pct, CASE WHEN a < b THEN 'a' ELSE 'b' END
            AS winner_at_max, {r("x")} AS x_at_max
        FROM (SELECT *, abs(a - b) / greatest(a, b) * 100 AS rel FROM curve)
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY rel DESC, i) = 1""",
    "global_threshold": """
        SELECT CAST(floor(median(critical)) AS BIGINT) AS global_threshold
        FROM crossover WHERE critical > 0""",
    "trend_regression": f"""
        SELECT profile, current_size, p_value < 0.1 AS has_trend,
            CASE WHEN abs(slope) < 0.05 THEN 'stable' WHEN slope > 0.1 THEN 'b_improving'
                WHEN slope > 0 THEN 'b_slightly_improving' WHEN slope < -0.1 THEN 'a_improving'
                ELSE 'a_slightly_improving' END AS trend,
            {r("slope")} AS slope, {r("r2")} AS r_squared, {r("p_value")} AS p_value,
            {r("volatility")} AS volatility, low AS efficiency_min, high AS efficiency_max,
            newest AS current_efficiency,
            CASE WHEN b_up THEN 'increasing' ELSE 'decreasing' END AS b_wins_trend,
            CASE WHEN a_up THEN 'increasing' ELSE 'decreasing' END AS a_wins_trend,
            n AS data_points
        FROM trend""",
    "trend_halves": f"""
        SELECT profile, current_size, n >= 3 AS has_trend,
            CASE WHEN n < 3 THEN 'insufficient_data' WHEN slope > 0.05 THEN 'b_improving'
                WHEN slope < -0.05 THEN 'a_improving' ELSE 'stable' END AS trend,
            CASE WHEN n >= 3 THEN {r("slope")} END AS slope,
            CASE WHEN n >= 3 THEN {r("volatility")} END AS volatility,
            CASE WHEN n >= 3 THEN low END AS efficiency_min,
            CASE WHEN n >= 3 THEN high END AS efficiency_max,
            CASE WHEN n >= 3 THEN newest END AS current_efficiency, n AS data_points
        FROM (SELECT profile, current_size, count(*) AS n,
                (avg(average_efficiency) FILTER (place >= n // 2)
                - avg(average_efficiency) FILTER (place < n // 2)) / nullif(max(n) // 2, 0) AS slope,
                stddev_pop(average_efficiency) / avg(average_efficiency) AS volatility,
                min(average_efficiency) AS low, max(average_efficiency) AS high,
                arg_max(average_efficiency, place) AS newest
            FROM histories GROUP BY profile, current_size)""",
    "stop_rules": """
        SELECT profile, current_size, p_value < 0.1 AS has_trend, rule,
            rule IS NOT NULL AS should_stop
        FROM (SELECT *, CASE WHEN p_value >= 0.1 THEN NULL
                WHEN newest < 0.5 AND slope < -lim AND volatility < 0.2 THEN '1'
                WHEN newest > 2.0 AND slope > lim AND volatility < 0.2 THEN '2'
                WHEN volatility < 0.1 AND abs(slope) < lim AND newest < 0.7 THEN '3a'
                WHEN volatility < 0.1 AND abs(slope) < lim AND newest > 1.5 THEN '3b'
                WHEN abs(slope) > 0.3 AND volatility > 0.3 THEN '4' END AS rule
            FROM (SELECT *, CASE WHEN current_size LIKE '%large%' THEN 0.1 ELSE 0.15 END AS lim
                FROM trend))""",
    "run_budget": """
        SELECT profile, query, b AS base_runs,
            CAST(CASE WHEN last_seq IS NULL THEN 0 WHEN eff < 0.3 AND clear THEN 1 WHEN eff < 0.6 THEN 2
                WHEN eff > 2 AND clear THEN 3 WHEN eff > 1.3 THEN 4
                WHEN change > 300 AND vol > 0.4 THEN 5 WHEN rising AND eff > 0.8 THEN 6
                WHEN vol < 0.2 AND change < 100 THEN 7 ELSE 0 END AS INTEGER) AS rule,
            CAST(CASE WHEN last_seq IS NULL THEN b WHEN eff < 0.3 AND clear THEN greatest(2, b // 6)
                WHEN eff < 0.6 THEN greatest(3, b // 3)
                WHEN eff > 2 AND clear THEN least(100, 2 * b)
                WHEN eff > 1.3 THEN least(80, floor(b * 1.5))
                WHEN change > 300 AND vol > 0.4 THEN least(60, floor(b * 1.3))
                WHEN rising AND eff > 0.8 THEN least(70, floor(b * 1.4))
                WHEN vol < 0.2 AND change < 100 THEN greatest(5, floor(b * 0.8))
                ELSE b END AS INTEGER) AS new_runs
        FROM (SELECT base.profile, base.query, b, last_seq,
                coalesce(now.efficiency_coefficient, 1.0) AS eff,
                coalesce(now.significance = '"""
    + CLEAR
    + """', false) AS clear, abs(coalesce(now.improvement_percentage, 0.0)) AS change,
                coalesce(h.newest > h.before, false) AS rising, coalesce(h.vol, 0) AS vol
            FROM (SELECT profile, query, CAST(count(*) // 10 + 1 AS INTEGER) AS b
                FROM runs GROUP BY ALL) base
            LEFT JOIN (SELECT profile, max(source) AS last_seq FROM ratios
                WHERE size = 'small' GROUP BY profile) seen ON seen.profile = base.profile
            LEFT JOIN ratios now ON now.profile = base.profile AND now.query = base.query
                AND now.size = 'small' AND now.source = last_seq
            LEFT JOIN (
                SELECT profile, query, max(efficiency_coefficient) FILTER (age = 1) AS newest,
                    max(efficiency_coefficient) FILTER (age = 2) AS before,
                    CASE WHEN count(*) >= 2
                        THEN stddev_pop(efficiency_coefficient) / avg(efficiency_coefficient)
                        END AS vol
                FROM (SELECT *, row_number() OVER (PARTITION BY profile, query
                    ORDER BY size_idx DESC, source DESC) AS age FROM ratios)
                WHERE age <= 3 GROUP BY profile, query
            ) h ON h.profile = base.profile AND h.query = base.query)""",
    "config_comparison": """
        SELECT profile, count(DISTINCT size) AS sizes_completed,
            count(*) FILTER (status = 'completed') AS successful_iterations,
            count(*) FILTER (status <> 'completed') AS failed_iterations,
            arg_max(average_efficiency, seq) FILTER (status = 'completed') AS final_efficiency,
            arg_max(overall_winner, seq) FILTER (status = 'completed') AS final_winner
        FROM trials GROUP BY profile""",
    "size_summary": f"""
        SELECT profile, size, count(*) FILTER (status = 'completed') AS successful,
            count(*) AS total, {r("avg(average_efficiency)")} AS avg_efficiency,
            {r("median(average_efficiency)")} AS median_efficiency,
            min(average_efficiency) AS min_efficiency, max(average_efficiency) AS max_efficiency
        FROM trials GROUP BY profile, size""",
    "canonical_edges": "SELECT user_id, friend_id, since FROM friendships",
    "is_canonical": "SELECT bool_and(user_id < friend_id) AS is_canonical FROM friendships",
    "adjacency": "SELECT src, dst, since FROM adj",
    "ingest_users": "SELECT user_id, name, age, city, registration_date FROM users",
    "ingest_friendships": "SELECT user_id, friend_id, since FROM friendships",
    "resolved_edges": """
        SELECT user_id, friend_id, since FROM dangling_edges
        WHERE user_id IN (SELECT user_id FROM users)
            AND friend_id IN (SELECT user_id FROM users)""",
    "integrity_report": """
        SELECT 'duplicate_user_id' AS "check", (SELECT count(*) FROM (
            SELECT user_id FROM users GROUP BY user_id HAVING count(*) > 1)) AS n_violations
        UNION ALL SELECT 'duplicate_pair', (SELECT count(*) FROM (
            SELECT 1 FROM dangling_edges GROUP BY user_id, friend_id HAVING count(*) > 1))
        UNION ALL SELECT 'self_loop',
            (SELECT count(*) FROM dangling_edges WHERE user_id = friend_id)
        UNION ALL SELECT 'missing_friendship_field', (SELECT count(*) FROM dangling_edges
            WHERE user_id IS NULL OR friend_id IS NULL OR since IS NULL)
        UNION ALL SELECT 'missing_user_field', (SELECT count(*) FROM users
            WHERE user_id IS NULL OR name IS NULL OR registration_date IS NULL)
        UNION ALL SELECT 'dangling_user_id', (SELECT count(*) FROM dangling_edges
            WHERE user_id NOT IN (SELECT user_id FROM users))
        UNION ALL SELECT 'dangling_friend_id', (SELECT count(*) FROM dangling_edges
            WHERE friend_id NOT IN (SELECT user_id FROM users))""",
    "accepted_edges": """
        SELECT user_id, friend_id, min(since) AS since FROM dangling_edges
        WHERE user_id <> friend_id AND since IS NOT NULL
            AND user_id IN (SELECT user_id FROM users)
            AND friend_id IN (SELECT user_id FROM users)
        GROUP BY user_id, friend_id""",
    "rejected_rows": """
        SELECT user_id, friend_id, since, reason, count(*) AS n_rows FROM (
            SELECT *, CASE
                WHEN user_id IS NULL OR friend_id IS NULL OR since IS NULL THEN 'missing_field'
                WHEN user_id = friend_id THEN 'self_loop'
                WHEN user_id NOT IN (SELECT user_id FROM users) THEN 'unknown_user'
                WHEN friend_id NOT IN (SELECT user_id FROM users) THEN 'unknown_friend'
                WHEN row_number() OVER (PARTITION BY user_id, friend_id ORDER BY since) > 1
                    THEN 'duplicate_pair' END AS reason
            FROM dangling_edges) WHERE reason IS NOT NULL GROUP BY ALL""",
}

ORACLE = {name: _ctes(body) for name, body in BODIES.items()}
