"""Building blocks of the check SQL: every job once more, as plain relational rounds.

The SQL forms all pairs and repeats every claim; it shares no shortcut with the Spark jobs.
Each function returns a list of (name, query) pairs for one WITH clause.
"""

from __future__ import annotations

import random
import re

# Position that random.Random(10).choice picks in a sorted list of each size: no item has more
# tied values than there are sources, 25 nations.
SEEDED_PICK = {size: random.Random(10).choice(range(size)) for size in range(1, 26)}

PROPERTIES = ["returnflag", "linestatus", "discount", "tax", "shipyear"]


def statement(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED (\n{query}\n)" for name, query in ctes)
    return f"WITH {body}\n{final}"


def r6(expr: str) -> str:
    """Six places; adding zero turns a negative zero into zero."""
    return f"round({expr}, 6) + 0.0::DOUBLE"


WIDE = ("wide", """SELECT l_partkey::VARCHAR AS object, s_nationkey::VARCHAR AS source,
       l_shipdate, l_orderkey, l_linenumber,
       l_returnflag AS returnflag, l_linestatus AS linestatus,
       l_discount::DECIMAL(4,2)::VARCHAR AS discount, l_tax::DECIMAL(4,2)::VARCHAR AS tax,
       year(l_shipdate)::VARCHAR AS shipyear
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")

LONG = ("long", "\nUNION ALL\n".join(
    f"SELECT object, '{p}' AS property, {p} AS value, source, l_shipdate, l_orderkey, l_linenumber FROM wide "
    f"WHERE {p} IS NOT NULL" for p in PROPERTIES))

CLAIMS = ("claims", """SELECT object, property, value, source FROM long
QUALIFY row_number() OVER (PARTITION BY object, property, source
                           ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, value DESC) = 1""")

BASE = [WIDE, LONG, CLAIMS]

VOTES = ("votes", "SELECT object, property, value, count(*) AS votes FROM claims GROUP BY ALL")
VOTED = ("voted", """SELECT object, property, value, votes FROM votes
QUALIFY row_number() OVER (PARTITION BY object, property ORDER BY votes DESC, value) = 1""")

# An arbitrary but fixed truth: the claim with the smallest hash of its item and source.
TRUTH = ("truth", """SELECT object, property, value FROM claims
QUALIFY row_number() OVER (PARTITION BY object, property
                           ORDER BY md5(object || '|' || property || '|' || source), source) = 1""")

ONE_BLOCK = ("claims_b", "SELECT 0 AS block_id, * FROM claims")


def char_similarity() -> list[tuple[str, str]]:
    """``vsim``: cosine of character counts for each pair of distinct values of a property."""
    return [
        ("distinct_values", "SELECT DISTINCT property, value FROM claims"),
        ("chars", """SELECT property, value, ch, count(*)::DOUBLE AS n
FROM (SELECT property, value, unnest(string_split(value, '')) AS ch FROM distinct_values) WHERE ch <> '' GROUP BY ALL"""),
        ("norms", "SELECT property, value, sqrt(sum(n * n)) AS norm FROM chars GROUP BY ALL"),
        ("dots", """SELECT a.property, a.value AS v1, b.value AS v2, sum(a.n * b.n) AS dot
FROM chars a JOIN chars b ON a.property = b.property AND a.ch = b.ch WHERE a.value <> b.value GROUP BY ALL"""),
        ("vsim", """SELECT x.property, x.value AS v1, y.value AS v2,
       coalesce(d.dot / (nx.norm * ny.norm), 0) AS sim
FROM distinct_values x JOIN distinct_values y ON x.property = y.property AND x.value <> y.value
LEFT JOIN dots d ON d.property = x.property AND d.v1 = x.value AND d.v2 = y.value
LEFT JOIN norms nx ON nx.property = x.property AND nx.value = x.value
LEFT JOIN norms ny ON ny.property = y.property AND ny.value = y.value"""),
    ]


def numeric_similarity() -> list[tuple[str, str]]:
    gap = "abs(try_cast(x.value AS DOUBLE) - try_cast(y.value AS DOUBLE))"
    return [
        ("distinct_values", "SELECT DISTINCT property, value FROM claims"),
        ("vsim", f"""SELECT x.property, x.value AS v1, y.value AS v2,
       CASE WHEN {gap} IS NULL THEN 0.0::DOUBLE WHEN {gap} = 0 THEN 1.0::DOUBLE ELSE 1 / {gap} END AS sim
FROM distinct_values x JOIN distinct_values y ON x.property = y.property AND x.value <> y.value"""),
    ]


def boost(name: str, scored: str, rho: float) -> tuple[str, str]:
    """``scored`` (block, item, value, score) plus rho times its similar competitors."""
    return (name, f"""SELECT a.block_id, a.object, a.property, a.value,
       any_value(a.score) + {rho}::DOUBLE * coalesce(sum(b.score * s.sim), 0) AS score
FROM {scored} a
LEFT JOIN {scored} b ON a.block_id = b.block_id AND a.object = b.object AND a.property = b.property AND a.value <> b.value
LEFT JOIN vsim s ON s.property = a.property AND s.v1 = a.value AND s.v2 = b.value
GROUP BY a.block_id, a.object, a.property, a.value""")


def clamp(expr: str) -> str:
    return f"CASE WHEN {expr} >= 1 THEN 0.9999::DOUBLE WHEN {expr} <= 0 THEN 0.0001::DOUBLE ELSE {expr} END"


def start_trust(trust: float = 0.8) -> tuple[str, str]:
    return ("trust_0", f"SELECT DISTINCT block_id, source, {trust}::DOUBLE AS trust, {trust}::DOUBLE AS old_trust FROM claims_b")


def truthfinder_rounds(rounds: int, rho: float = 0.5, theta: float = 0.1) -> list[tuple[str, str]]:
    """``conf_r`` and ``trust_r`` for r = 1..rounds; needs claims_b and vsim."""
    ctes = [start_trust()]
    for r in range(1, rounds + 1):
        ctes += [
            (f"score_{r}", f"""SELECT c.block_id, object, property, value, sum(-ln(1 - t.trust)) AS score
FROM claims_b c JOIN trust_{r - 1} t USING (block_id, source) GROUP BY ALL"""),
            boost(f"adjusted_{r}", f"score_{r}", rho),
            (f"conf_{r}", f"""SELECT block_id, object, property, value,
       1 / (1 + exp(-{theta}::DOUBLE * score)) AS conf FROM adjusted_{r}"""),
            (f"raw_{r}", f"""SELECT c.block_id, c.source, avg(f.conf) AS raw
FROM claims_b c JOIN conf_{r} f USING (block_id, object, property, value) GROUP BY ALL"""),
            (f"trust_{r}", f"""SELECT block_id, source, {clamp('raw')} AS trust, t.trust AS old_trust
FROM raw_{r} JOIN trust_{r - 1} t USING (block_id, source)"""),
        ]
    return ctes


def common_items() -> list[tuple[str, str]]:
    """``met``: every ordered pair of sources on every item they share."""
    return [("met", """SELECT a.block_id, a.source AS s1, b.source AS s2, a.object, a.property,
       a.value AS v1, b.value AS v2
FROM claims_b a JOIN claims_b b ON a.block_id = b.block_id AND a.object = b.object AND a.property = b.property
 AND a.source <> b.source""")]


def dependence_of(r: int, truths: str, c: float = 0.3, n: float = 100, alpha: float = 0.5) -> list[tuple[str, str]]:
    """``agree_r`` and ``dep_r`` from truths (block, item, value) and trust_r."""
    return [
        (f"agree_{r}", f"""SELECT m.block_id, s1, s2,
       (count(*) FILTER (v1 = v2 AND v1 = t.value))::BIGINT AS kt,
       (count(*) FILTER (v1 = v2 AND v1 <> t.value))::BIGINT AS kf,
       (count(*) FILTER (v1 <> v2))::BIGINT AS kd
FROM met m JOIN {truths} t USING (block_id, object, property) GROUP BY ALL"""),
        (f"dep_{r}", f"""SELECT block_id, s1, s2, kt, kf, kd, 1 / (1 + exp(least(700.0::DOUBLE,
       ln((1 - {alpha}::DOUBLE) / {alpha}::DOUBLE)
       + kt * ln((1 - e) / (1 - e + {c}::DOUBLE * e))
       + kf * ln(e / ({c}::DOUBLE * {n}::DOUBLE + e - {c}::DOUBLE * e))
       - kd * ln(1 - {c}::DOUBLE)))) AS dep
FROM (SELECT a.*, 1 - t.trust AS e FROM agree_{r} a JOIN trust_{r} t ON t.block_id = a.block_id AND t.source = a.s1)"""),
        (f"most_{r}", f"SELECT block_id, s1 AS source, max(dep) AS max_dep FROM dep_{r} GROUP BY ALL"),
    ]


def winners(rows: str, score: str, tie: str) -> str:
    """The best value per item of ``rows`` (block, item, value, score)."""
    item = "PARTITION BY block_id, object, property"
    if tie == "min":
        return f"SELECT * FROM {rows} QUALIFY row_number() OVER ({item} ORDER BY {score} DESC, value) = 1"
    picks = " ".join(f"WHEN {size} THEN {place}" for size, place in SEEDED_PICK.items())
    return f"""SELECT * EXCLUDE (top, n_tied, place) FROM (
  SELECT *, count(*) OVER ({item}) AS n_tied, row_number() OVER ({item} ORDER BY value) - 1 AS place
  FROM (SELECT *, max({score}) OVER ({item}) AS top FROM {rows}) WHERE {score} = top)
WHERE place = CASE n_tied {picks} END"""


def stopping(rounds: int, threshold: float, stop: str = "cosine") -> list[tuple[str, str]]:
    """``last_round`` (block, round): the first round whose change is below the threshold, else the last."""
    cosine = "sum(trust * old_trust) / (sqrt(sum(trust * trust)) * sqrt(sum(old_trust * old_trust)))"
    each = "\nUNION ALL\n".join(
        f"SELECT block_id, {r} AS round, {cosine} AS cosine, max(abs(trust - old_trust)) AS delta FROM trust_{r} GROUP BY block_id"
        for r in range(1, rounds + 1))
    change = "delta" if stop == "max_abs_delta" else (
        "abs(coalesce(lag(cosine) OVER (PARTITION BY block_id ORDER BY round), 1.0::DOUBLE) - cosine)")
    return [
        ("moves", each),
        ("changes", f"SELECT block_id, round, {change} AS change FROM moves"),
        ("last_round", f"SELECT block_id, coalesce(min(round) FILTER (change < {threshold}::DOUBLE), {rounds}) AS round FROM changes GROUP BY block_id"),
    ]


def frozen(name: str, each: str, rounds: int) -> tuple[str, str]:
    """Rows of the table ``each`` (one per round) of the round in which a block stopped."""
    return (name, "\nUNION ALL\n".join(
        f"SELECT t.* FROM {each}_{r} t JOIN last_round l ON l.block_id = t.block_id AND l.round = {r}" for r in range(1, rounds + 1)))


def renamed(ctes: list[tuple[str, str]], suffix: str) -> list[tuple[str, str]]:
    """The same tables once more under other names."""
    own = {name for name, _ in ctes}

    def other(match: re.Match) -> str:
        word, name, alias = match.groups()
        return f"{word} {name}{suffix} {alias or name}" if name in own else match[0]

    return [(name + suffix, re.sub(r"(FROM|JOIN)\s+(\w+)(?:[ \t]+([a-z]\w*))?", other, query)) for name, query in ctes]


def accuracy_rounds(algo: str, rounds: int, rho: float = 0.5, c: float = 0.3, n: float = 100,
                    order: str = "dependence", tie: str = "min") -> list[tuple[str, str]]:
    """``conf_r``, ``truth_r``, ``trust_r`` for r = 1..rounds; needs claims_b and met."""
    ctes = [
        start_trust(),
        ("votes_b", "SELECT block_id, object, property, value, count(*) AS votes FROM claims_b GROUP BY ALL"),
        ("truth_0", winners("votes_b", "votes", tie)),
        *dependence_of(0, "truth_0", c, n),
    ]
    if order == "name":
        first = "d.s2 < d.s1"
    else:
        first = """(round(m2.max_dep, 9) > round(m1.max_dep, 9)
      OR (round(m2.max_dep, 9) = round(m1.max_dep, 9) AND d.s2 < d.s1))"""
    for r in range(1, rounds + 1):
        p = r - 1
        weight = "1.0::DOUBLE" if algo == "DEPEN" else (
            f"ln({n}::DOUBLE * (CASE WHEN t.trust <= 0 THEN 0.001::DOUBLE ELSE t.trust END)"
            f" / (1 - (CASE WHEN t.trust <= 0 THEN 0.001::DOUBLE ELSE t.trust END)))")
        ctes += [
            (f"before_{r}", f"""SELECT d.block_id, d.s1, d.s2, d.dep FROM dep_{p} d
JOIN most_{p} m1 ON m1.block_id = d.block_id AND m1.source = d.s1
JOIN most_{p} m2 ON m2.block_id = d.block_id AND m2.source = d.s2
WHERE {first}"""),
            (f"indep_{r}", f"""SELECT m.block_id, m.object, m.property, m.v1 AS value, m.s1 AS source,
       product(1 - {c}::DOUBLE * b.dep) AS indep
FROM met m JOIN before_{r} b ON b.block_id = m.block_id AND b.s1 = m.s1 AND b.s2 = m.s2
WHERE m.v1 = m.v2 GROUP BY ALL"""),
            (f"score_{r}", f"""SELECT c.block_id, c.object, c.property, c.value,
       sum({weight} * coalesce(i.indep, 1)) AS score
FROM claims_b c JOIN trust_{p} t USING (block_id, source)
LEFT JOIN indep_{r} i USING (block_id, object, property, value, source)
GROUP BY ALL"""),
        ]
        if algo == "ACCUSIM":
            ctes.append(boost(f"conf_{r}", f"score_{r}", rho))
        else:
            ctes.append((f"conf_{r}", f"SELECT * FROM score_{r}"))
        ctes += [
            (f"prob_{r}", f"""SELECT *, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY block_id, object, property) AS prob
FROM (SELECT *, max(score) OVER (PARTITION BY block_id, object, property) AS top FROM conf_{r})"""),
            (f"best_{r}", winners(f"conf_{r}", "round(score, 9)", tie)),
            (f"truth_{r}", f"SELECT block_id, object, property, value, score FROM best_{r}"),
            (f"raw_{r}", f"""SELECT c.block_id, c.source, avg(f.prob) AS raw
FROM claims_b c JOIN prob_{r} f USING (block_id, object, property, value) GROUP BY ALL"""),
            (f"trust_{r}", f"""SELECT block_id, source, {clamp('raw')} AS trust, t.trust AS old_trust
FROM raw_{r} JOIN trust_{p} t USING (block_id, source)"""),
        ]
        if r < rounds:
            ctes += dependence_of(r, f"truth_{r}", c, n)
    return ctes


def confusion(votes: str, truth: str, found: str, by: str = "") -> str:
    """Per-claim confusion counts of the claims behind ``votes``."""
    lead = f"{by}, " if by else ""
    def total(condition: str) -> str:
        return f"coalesce(sum(v.votes) FILTER ({condition}), 0)::BIGINT"
    known = "t.value IS NOT NULL AND f.value IS NOT NULL"
    return f"""SELECT {lead}{total(f"{known} AND v.value = f.value AND v.value = t.value")} AS tp,
  {total(f"{known} AND v.value = f.value AND v.value <> t.value")} AS fp,
  {total(f"{known} AND v.value <> f.value AND v.value = t.value")} AS fn,
  {total(f"{known} AND v.value <> f.value AND v.value <> t.value")} AS tn,
  {total(f"NOT ({known})")} AS n_unmatched
FROM {votes} v LEFT JOIN {truth} t USING (object, property) LEFT JOIN {found} f USING (object, property)
{'GROUP BY ' + by if by else ''}"""


def ratio_columns() -> str:
    def ratio(over: str, under: str) -> str:
        return r6(f"coalesce(({over})::DOUBLE / nullif(({under})::DOUBLE, 0), 0)")
    return f"""{ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall,
  {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1_score"""


def distances() -> list[tuple[str, str]]:
    """``cells`` and ``d2`` from the majority truths."""
    return [
        ("cells", "SELECT c.property, c.object, c.source FROM claims c JOIN voted v USING (object, property, value)"),
        ("names", "SELECT DISTINCT property FROM claims"),
        ("ones", "SELECT n.property, count(c.object) AS ones FROM names n LEFT JOIN cells c USING (property) GROUP BY ALL"),
        ("shared", """SELECT a.property AS p, b.property AS q, count(*) AS n
FROM cells a JOIN cells b ON a.object = b.object AND a.source = b.source AND a.property <> b.property GROUP BY ALL"""),
        ("d2", """SELECT x.property AS p, y.property AS q,
       CASE WHEN x.property = y.property THEN 0 ELSE x.ones + y.ones - 2 * coalesce(b.n, 0) END::DOUBLE AS d2
FROM ones x CROSS JOIN ones y LEFT JOIN shared b ON b.p = x.property AND b.q = y.property"""),
    ]


def kmeans(k_max: int = len(PROPERTIES) - 1, max_iter: int = 20) -> list[tuple[str, str]]:
    """``labels`` (k, property, cluster) for k = 2..k_max, from d2; an error if they still move."""
    ctes = [("seed_0", "SELECT 0 AS cluster, min(property) AS q FROM names")]
    for j in range(1, k_max):
        ctes.append((f"seed_{j}", f"""SELECT * FROM seed_{j - 1} UNION ALL
(SELECT {j}, p FROM (SELECT p, min(d2) AS d2 FROM d2 JOIN seed_{j - 1} USING (q)
  WHERE p NOT IN (SELECT q FROM seed_{j - 1}) GROUP BY p) ORDER BY d2 DESC, p LIMIT 1)"""))
    ctes.append(("labels_0", f"""SELECT k, p AS property, cluster
FROM (SELECT unnest(range(2, {k_max + 1}))::INT AS k) JOIN (SELECT d2.*, s.cluster FROM d2 JOIN seed_{k_max - 1} s USING (q)) ON cluster < k
QUALIFY row_number() OVER (PARTITION BY k, p ORDER BY d2, cluster) = 1"""))
    for r in range(1, max_iter + 1):
        ctes += [
            (f"mean_{r}", f"""SELECT l.k, d.p, l.cluster, avg(d.d2) AS mean
FROM labels_{r - 1} l JOIN d2 d ON d.q = l.property GROUP BY ALL"""),
            (f"inner_{r}", f"""SELECT m.k, m.cluster, avg(m.mean) AS inner_mean
FROM mean_{r} m JOIN labels_{r - 1} l ON l.k = m.k AND l.property = m.p AND l.cluster = m.cluster GROUP BY ALL"""),
            (f"labels_{r}", f"""SELECT m.k, m.p AS property, m.cluster FROM mean_{r} m JOIN inner_{r} i USING (k, cluster)
QUALIFY row_number() OVER (PARTITION BY m.k, m.p ORDER BY round(m.mean - i.inner_mean / 2, 9), m.cluster) = 1"""),
        ]
    moved = f"SELECT count(*) FROM (SELECT * FROM labels_{max_iter} EXCEPT SELECT * FROM labels_{max_iter - 1})"
    ctes.append(("labels", f"SELECT k, property, CASE WHEN ({moved}) > 0 THEN error('points still move')::INT ELSE cluster END AS cluster FROM labels_{max_iter}"))
    return ctes


def kmeans_drawn(starts: int = 10, seed: str = "10", rounds: int = 10, k_max: int = len(PROPERTIES) - 1) -> list[tuple[str, str]]:
    """``drawn_labels`` (start, k, property, cluster) and ``drawn_best`` (k, start, inertia); seeds by weighted hash draws."""
    def u(cluster: int, point: str) -> str:
        return f"(('0x' || substr(md5('{seed}|' || start::VARCHAR || '|{cluster}|' || {point}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"

    ctes = [
        ("begun", f"SELECT unnest(range(0, {starts}))::INT AS start"),
        ("drawn_0", f"""SELECT start, 0 AS cluster, property AS q FROM begun CROSS JOIN names
QUALIFY row_number() OVER (PARTITION BY start ORDER BY {u(0, 'property')}, property) = 1"""),
    ]
    for j in range(1, k_max):
        ctes.append((f"drawn_{j}", f"""SELECT * FROM drawn_{j - 1} UNION ALL
(SELECT start, {j}, p FROM (SELECT s.start, d.p, min(d2) AS w FROM d2 d JOIN drawn_{j - 1} s USING (q)
  WHERE NOT EXISTS (SELECT 1 FROM drawn_{j - 1} o WHERE o.start = s.start AND o.q = d.p) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY start ORDER BY CASE WHEN w > 0 THEN -ln({u(j, 'p')}) / w ELSE 'inf'::DOUBLE END, p) = 1)"""))
    ctes.append(("placed_0", f"""SELECT s.start, k, d.p AS property, s.cluster
FROM (SELECT unnest(range(2, {k_max + 1}))::INT AS k) JOIN (SELECT d.p, d.d2, s.start, s.cluster FROM d2 d JOIN drawn_{k_max - 1} s USING (q)) d
  ON cluster < k JOIN drawn_{k_max - 1} s ON s.start = d.start AND s.cluster = d.cluster
QUALIFY row_number() OVER (PARTITION BY s.start, k, d.p ORDER BY d.d2, s.cluster) = 1"""))

    def centres(r: int) -> list[tuple[str, str]]:
        return [
            (f"mean_d{r}", f"""SELECT l.start, l.k, d.p, l.cluster, avg(d.d2) AS mean
FROM placed_{r} l JOIN d2 d ON d.q = l.property GROUP BY ALL"""),
            (f"inner_d{r}", f"""SELECT m.start, m.k, m.cluster, avg(m.mean) AS inner_mean FROM mean_d{r} m
JOIN placed_{r} l ON l.start = m.start AND l.k = m.k AND l.property = m.p AND l.cluster = m.cluster GROUP BY ALL"""),
        ]

    for r in range(rounds):
        ctes += [*centres(r), (f"placed_{r + 1}", f"""SELECT m.start, m.k, m.p AS property, m.cluster
FROM mean_d{r} m JOIN inner_d{r} i USING (start, k, cluster)
QUALIFY row_number() OVER (PARTITION BY m.start, m.k, m.p ORDER BY round(m.mean - i.inner_mean / 2, 9), m.cluster) = 1""")]
    return ctes + [
        *centres(rounds),
        ("inertias", f"""SELECT m.start, m.k, sum(m.mean - i.inner_mean / 2) AS inertia
FROM mean_d{rounds} m JOIN inner_d{rounds} i USING (start, k, cluster)
JOIN placed_{rounds} l ON l.start = m.start AND l.k = m.k AND l.property = m.p AND l.cluster = m.cluster GROUP BY ALL"""),
        ("drawn_best", "SELECT k, start, inertia FROM inertias QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(inertia, 9), start) = 1"),
        ("drawn_labels", f"SELECT * FROM placed_{rounds}"),
    ]


def silhouettes() -> list[tuple[str, str]]:
    """``sil`` (k, silhouette), ``best`` (k) and ``blocks`` (block_id, property)."""
    return [
        ("apart", """SELECT a.k, d.p, a.cluster AS own, b.cluster AS other, avg(sqrt(d.d2)) AS d
FROM d2 d JOIN labels a ON a.property = d.p JOIN labels b ON b.property = d.q AND b.k = a.k
WHERE d.p <> d.q GROUP BY ALL"""),
        ("sides", """SELECT k, p, max(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM apart GROUP BY ALL"""),
        ("sil", """SELECT k, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0::DOUBLE
                ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS silhouette FROM sides GROUP BY k"""),
        ("best", "SELECT k FROM sil ORDER BY round(silhouette, 9) DESC, k LIMIT 1"),
        ("blocks", """SELECT min(property) OVER (PARTITION BY cluster) AS block_id, property
FROM labels WHERE k = (SELECT k FROM best)"""),
    ]
