"""One check statement per registered query."""

from __future__ import annotations

from oracle.parts import (
    BASE, CLAIMS, LONG, ONE_BLOCK, PROPERTIES, SEEDED_PICK, TRUTH, VOTED, VOTES, WIDE,
    accuracy_rounds, char_similarity, common_items, confusion, dependence_of, distances, frozen,
    kmeans, kmeans_drawn, numeric_similarity, r6, ratio_columns, renamed, silhouettes, start_trust, statement, stopping,
    truthfinder_rounds,
)

ROUNDS, THRESHOLD = 5, 1e-6  # of all models, unless a query says otherwise
COSINE_STOP, DELTA_STOP = 1e-4, 2e-2

TRUST = f"SELECT source, {r6('trust')} AS trust FROM"
FOUND = f"SELECT object, property, value, {r6('score')} AS confidence FROM"


def draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


def uniform(low: str, high: str, *parts: str) -> str:
    return f"({low} + ({high} - {low}) * ({draw(*parts)} / 4294967296.0::DOUBLE))"


def generated() -> list[tuple[str, str]]:
    """Parts as objects, nations as sources, six properties."""
    names = [f"Property{i}" for i in range(1, 7)]
    listed = ", ".join(f"('{n}')" for n in names)
    zero = "'0'"
    return [
        ("names", f"SELECT * FROM (VALUES {listed}) v(property)"),
        ("drawn", f"""SELECT p_partkey::VARCHAR AS object, p_partkey AS object_idx, property,
  (100000 + {draw(zero, "'true'", "p_partkey::VARCHAR", "property")} % 399999)::VARCHAR AS value,
  {draw(zero, "'start'", "p_partkey::VARCHAR", "property")} % 499999 AS start,
  1 + {draw(zero, "'stride'", "p_partkey::VARCHAR", "property")} % 499998 AS stride
FROM part CROSS JOIN names"""),
        ("gen_truth", """SELECT object, object_idx, property, value,
  list_transform(range(0, 20), lambda j: (500000 + (start + j * stride) % 499999)::VARCHAR) AS false_values FROM drawn"""),
        ("dealt", f"""SELECT property, row_number() OVER (ORDER BY {draw(zero, "'deal'", 'property')}, property) - 1 AS rank,
  2 + {draw(zero, "'groups'")} % 4 AS n_groups FROM names"""),
        ("gen_groups", """SELECT property, rank % n_groups AS group_id, rank // n_groups AS place,
  count(*) OVER (PARTITION BY rank % n_groups) AS group_size, n_groups FROM dealt"""),
        ("gen_sources", """SELECT n_name AS source, n_nationkey::BIGINT AS source_idx,
  n_nationkey % n_groups AS source_group, n_nationkey < n_groups AS is_lead
FROM nation CROSS JOIN (SELECT DISTINCT n_groups FROM gen_groups)"""),
        ("based", f"""SELECT g.*, s.*, CASE WHEN group_id = source_group
  THEN {uniform('0.8::DOUBLE', '1.0::DOUBLE', zero, "'base'", 'group_id::VARCHAR', 'source_group::VARCHAR')}
  ELSE {uniform('0.0::DOUBLE', '0.3::DOUBLE', zero, "'base'", 'group_id::VARCHAR', 'source_group::VARCHAR')} END AS base
FROM gen_groups g CROSS JOIN gen_sources s"""),
        ("gen_plan", f"""SELECT *, group_size * (SELECT count(*) FROM part) AS n_items,
  {uniform('(base - 0.5::DOUBLE)', 'base', zero, "'own'", 'group_id::VARCHAR', 'source')} AS own,
  {uniform('0.8::DOUBLE', '1.0::DOUBLE', zero, "'scale'", 'group_id::VARCHAR', 'source')} AS scale FROM based"""),
        ("claims", f"""SELECT t.object, t.property, CASE WHEN t.object_idx * p.group_size + p.place <
       CASE WHEN is_lead THEN n_items * base ELSE scale * n_items * own END THEN t.value
  ELSE false_values[({draw(zero, "'wrong'", 't.object', 't.property', 'p.source')} % 20 + 1)::INT] END AS value, p.source
FROM gen_truth t JOIN gen_plan p USING (property)"""),
    ]


def partition_tables() -> list[tuple[str, str]]:
    """``parted`` (partition_id, property, label), ``part_blocks`` (partition_id, label, block_id)."""
    names = sorted(PROPERTIES)
    ctes = [("grown_1", "SELECT [0] AS labels")]
    for i in range(2, len(names) + 1):
        ctes.append((f"grown_{i}", f"""SELECT list_append(labels, next) AS labels
FROM (SELECT labels, unnest(range(0, list_max(labels) + 2)) AS next FROM grown_{i - 1})"""))
    numbered = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    return ctes + [
        ("numbered", f"SELECT * FROM (VALUES {numbered}) v(property, idx)"),
        ("parted", f"""SELECT array_to_string(labels, '') AS partition_id, property, labels[idx + 1]::INT AS label, idx
FROM grown_{len(names)} CROSS JOIN numbered"""),
        ("part_blocks", """SELECT partition_id, label, sum(1 << idx)::INT AS block_id,
  string_agg(property, ',' ORDER BY property) AS block FROM parted GROUP BY ALL"""),
    ]


def clustered_passes(passes: int = 5) -> list[tuple[str, str]]:
    """``found`` (block, item, value, score): the loop over partitions, stopped by its own rule."""
    ctes = [*BASE, VOTES, VOTED]
    for number in range(passes):
        before = "voted" if number == 0 else f"found_p{number - 1}"
        own = [
            ("voted_now", f"SELECT object, property, value FROM {before}"),
            *[(name, query.replace("voted", "voted_now")) for name, query in distances()],
            *kmeans(), *silhouettes(),
            ("claims_b", "SELECT b.block_id, c.* FROM claims c JOIN blocks b USING (property)"),
            *common_items(), *accuracy_rounds("ACCU", ROUNDS), *stopping(ROUNDS, THRESHOLD), frozen("found", "truth", ROUNDS),
        ]
        ctes += renamed(own, f"_p{number}")
    # pass i ends the loop when its partition is that of pass i - 1, or when its matrix is close to the first one
    rules = " UNION ALL ".join(f"""SELECT {i} AS pass,
  (SELECT count(*) FROM ((SELECT * FROM blocks_p{i} EXCEPT SELECT * FROM blocks_p{i - 1}) UNION ALL (SELECT * FROM blocks_p{i - 1} EXCEPT SELECT * FROM blocks_p{i}))) = 0
  OR 1 - (SELECT count(*) FROM cells_p{i} JOIN cells_p0 USING (property, object, source))
    / (sqrt((SELECT count(*) FROM cells_p{i})) * sqrt((SELECT count(*) FROM cells_p0))) < {THRESHOLD}::DOUBLE AS stops""" for i in range(1, passes))
    chosen = " UNION ALL ".join(f"SELECT * FROM found_p{i} WHERE (SELECT pass FROM ended) = {i}" for i in range(passes))
    return [*ctes, ("rules", rules), ("ended", f"SELECT coalesce(min(pass) FILTER (stops) - 1, {passes - 1}) AS pass FROM rules"), ("found", chosen)]


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    long_columns = "SELECT object, property, value, source FROM"
    out["claims_unpivot"] = statement([WIDE, LONG], f"{long_columns} long")
    out["claims_dedupe"] = statement(BASE, f"{long_columns} claims")
    out["claims_csv_roundtrip"] = statement(BASE, f"""{long_columns} claims
UNION ALL SELECT doc_id::VARCHAR, 'text', ' ' || text || ' ', source FROM documents WHERE text IS NOT NULL
UNION ALL SELECT doc_id::VARCHAR, 'blank', '', source FROM documents""")
    out["truth_csv_roundtrip"] = statement([*BASE, TRUTH], "SELECT object, property, value FROM truth")

    out["truth_false_roundtrip"] = statement([*BASE, TRUTH], """SELECT object, property, t.value,
  coalesce((SELECT string_agg(DISTINCT c.value, chr(31) ORDER BY c.value) FROM claims c
    WHERE c.object = t.object AND c.property = t.property AND c.value <> t.value), '') AS false_values FROM truth t
UNION ALL SELECT doc_id::VARCHAR, 'text', lang, text || chr(31) || source || chr(31) FROM documents WHERE text IS NOT NULL""")

    out["vote_counts"] = statement([*BASE, VOTES], "SELECT * FROM votes")
    out["majority_vote"] = statement([*BASE, VOTES, VOTED], "SELECT * FROM voted")
    ties = ("ties", """SELECT object, property, value, votes, count(*) OVER (PARTITION BY object, property) AS n_tied,
  row_number() OVER (PARTITION BY object, property ORDER BY value) - 1 AS place
FROM (SELECT *, max(votes) OVER (PARTITION BY object, property) AS top FROM votes) WHERE votes = top""")
    out["majority_vote_ties"] = statement([*BASE, VOTES, ties], "SELECT object, property, value, votes, n_tied FROM ties")
    picks = " ".join(f"WHEN {size} THEN {place}" for size, place in SEEDED_PICK.items())
    out["majority_vote_seeded"] = statement(
        [*BASE, VOTES, ties], f"SELECT object, property, value, votes FROM ties WHERE place = CASE n_tied {picks} END")
    out["property_subset_vote"] = statement(
        [*BASE, VOTES, VOTED], "SELECT * FROM voted WHERE property IN ('discount', 'tax')")
    out["source_claim_stats"] = statement(
        BASE, "SELECT source, count(*) AS n_claims, count(DISTINCT object) AS n_objects FROM claims GROUP BY source")
    out["coverage"] = statement(BASE, f"""SELECT count(*) AS n_objects, sum(n)::BIGINT AS n_claims,
  sum(s * p)::BIGINT AS n_slots, {r6('1 - (sum(s * p) - sum(n))::DOUBLE / sum(s * p)')} AS coverage
FROM (SELECT object, count(DISTINCT source) AS s, count(DISTINCT property) AS p, count(*) AS n FROM claims GROUP BY object)""")

    pairs = """SELECT a.object, a.property, a.value AS v1, b.value AS v2, {sim} AS sim
FROM votes a JOIN votes b ON a.object = b.object AND a.property = b.property AND a.value <> b.value
JOIN vsim s ON s.property = a.property AND s.v1 = a.value AND s.v2 = b.value{where}"""
    out["similarity_char"] = statement([*BASE, VOTES, *char_similarity()], pairs.format(sim=r6("s.sim"), where=""))
    out["similarity_numeric"] = statement(
        [*BASE, VOTES, *numeric_similarity()],
        pairs.format(sim=r6("s.sim"), where=""))

    finder = [*BASE, ONE_BLOCK, *char_similarity()]
    confidence = f"SELECT object, property, value, {r6('conf')} AS confidence FROM"
    best_conf = "QUALIFY row_number() OVER (PARTITION BY object, property ORDER BY round(conf, 9) DESC, value) = 1"
    out["truthfinder_confidence_r1"] = statement([*finder, *truthfinder_rounds(1)], f"{confidence} conf_1")
    out["truthfinder_trust_r1"] = statement([*finder, *truthfinder_rounds(1)], f"{TRUST} trust_1")
    out["truthfinder_r2"] = statement([*finder, *truthfinder_rounds(2)], f"{confidence} conf_2 {best_conf}")
    out["truthfinder_trust_r2"] = statement([*finder, *truthfinder_rounds(2)], f"{TRUST} trust_2")
    out["truthfinder_numeric_trust_r2"] = statement(
        [*BASE, ONE_BLOCK, *numeric_similarity(), *truthfinder_rounds(2)], f"{TRUST} trust_2")
    cosine = "sum(trust * old_trust) / (sqrt(sum(trust * trust)) * sqrt(sum(old_trust * old_trust)))"
    out["convergence"] = statement([*finder, *truthfinder_rounds(2)], f"""SELECT round, {r6('cosine')} AS cosine,
  {r6('abs(coalesce(lag(cosine) OVER (ORDER BY round), 1.0) - cosine)')} AS change, {r6('delta')} AS max_abs_delta
FROM (SELECT 1 AS round, {cosine} AS cosine, max(abs(trust - old_trust)) AS delta FROM trust_1
      UNION ALL SELECT 2, {cosine}, max(abs(trust - old_trust)) FROM trust_2)""")
    out["trust_summary"] = statement([*finder, *truthfinder_rounds(2)], f"""SELECT {r6('max(trust)')} AS max_trust,
  {r6('avg(trust)')} AS mean_trust, count(*) AS n_sources FROM trust_2""")

    first_truth = ("truth_0", "SELECT 0 AS block_id, object, property, value FROM voted")
    judged = [*BASE, VOTES, VOTED, ONE_BLOCK, *common_items(), start_trust(), first_truth, *dependence_of(0, "truth_0")]
    out["agreement_counts"] = statement(judged, "SELECT s1, s2, kt, kf, kd FROM agree_0 WHERE s1 < s2")
    out["dependence"] = statement(judged, f"SELECT s1, s2, kt, kf, kd, {r6('dep')} AS dep FROM dep_0")
    out["max_dependence"] = statement(judged, f"SELECT source, {r6('max_dep')} AS max_dep FROM most_0")
    out["source_order"] = statement(judged, f"""SELECT source, {r6('max_dep')} AS max_dep,
  row_number() OVER (ORDER BY round(max_dep, 9) DESC, source) AS position FROM most_0""")

    def accuracy(algo: str, rounds: int, **options) -> list[tuple[str, str]]:
        similar = char_similarity() if algo == "ACCUSIM" else []
        return [*BASE, ONE_BLOCK, *similar, *common_items(), *accuracy_rounds(algo, rounds, **options)]

    for algo in ("DEPEN", "ACCU", "ACCUSIM"):
        name = algo.lower()
        out[f"{name}_r1"] = statement(accuracy(algo, 1), f"{FOUND} truth_1")
        out[f"{name}_r2"] = statement(accuracy(algo, 2), f"{FOUND} truth_2")
        out[f"{name}_trust_r2"] = statement(accuracy(algo, 2), f"{TRUST} trust_2")
    out["accu_confidence_r1"] = statement(accuracy("ACCU", 1), f"{FOUND} conf_1")
    out["accu_name_order_trust_r2"] = statement(accuracy("ACCU", 2, order="name"), f"{TRUST} trust_2")
    out["accu_seeded_r1"] = statement(accuracy("ACCU", 1, tie="seeded"), f"{FOUND} truth_1")
    counts = "tp, fp, fn, tn, n_unmatched"
    stops = stopping(ROUNDS, THRESHOLD)
    found_finder = [
        *finder, *truthfinder_rounds(ROUNDS), *stops, frozen("last_conf", "conf", ROUNDS),
        ("found", f"SELECT object, property, value, conf FROM last_conf {best_conf}")]
    out["truthfinder_full"] = statement(found_finder, f"{confidence} found")
    early = [*finder, *truthfinder_rounds(ROUNDS), *stopping(ROUNDS, 1e-3), frozen("found", "trust", ROUNDS)]
    out["truthfinder_stop"] = statement(early, f"{TRUST} found")
    judge = [VOTES, TRUTH, ("counts", confusion("votes", "truth", "found"))]
    out["evaluate_truthfinder"] = statement([*found_finder, *judge], f"SELECT {counts}, {ratio_columns()} FROM counts")
    for algo in ("DEPEN", "ACCU", "ACCUSIM"):
        run = [*accuracy(algo, ROUNDS), *stops, frozen("found", "truth", ROUNDS)]
        out[f"{algo.lower()}_full"] = statement(run, f"{FOUND} found")
        out[f"evaluate_{algo.lower()}"] = statement([*run, *judge], f"SELECT {counts}, {ratio_columns()} FROM counts")
    three = ("claims_b", """SELECT CASE WHEN property IN ('returnflag', 'linestatus') THEN 1 WHEN property IN ('discount', 'tax') THEN 2
  ELSE 3 END AS block_id, * FROM claims""")
    for stop, threshold in (("cosine", COSINE_STOP), ("max_abs_delta", DELTA_STOP)):
        run = [*BASE, three, *common_items(), *accuracy_rounds("ACCU", ROUNDS), *stopping(ROUNDS, threshold, stop), frozen("found", "trust", ROUNDS)]
        out[f"blocks_stop_{stop.split('_')[-1]}"] = statement(run, f"SELECT block_id, source, {r6('trust')} AS trust FROM found")

    out["evaluate_vote"] = statement(
        [*BASE, VOTES, VOTED, TRUTH, ("counts", confusion("votes", "truth", "voted"))],
        f"SELECT {counts}, {ratio_columns()} FROM counts")
    out["gen_truth"] = statement(
        generated(), "SELECT object, property, value, array_to_string(false_values, ',') AS false_values FROM gen_truth")
    out["gen_sources"] = statement(generated(), "SELECT * FROM gen_sources")
    out["gen_claims"] = statement(generated(), f"{long_columns} claims")
    out["gen_evaluate_vote"] = statement(
        [*generated(), VOTES, VOTED, ("counts", confusion("votes", "gen_truth", "voted"))],
        f"SELECT {counts}, {ratio_columns()} FROM counts")
    out["gen_accu_trust_r2"] = statement(
        [*generated(), ONE_BLOCK, *common_items(), *accuracy_rounds("ACCU", 2)], f"{TRUST} trust_2")

    matrix = [*BASE, VOTES, VOTED, *distances()]
    out["truth_matrix"] = statement(matrix, "SELECT property, object, source FROM cells")
    out["property_distance"] = statement(matrix, "SELECT p, q, d2 FROM d2")
    clustered = [*matrix, *kmeans(), *silhouettes()]
    out["kmeans_sweep"] = statement(clustered, "SELECT k, property, cluster FROM labels")
    out["kmeans_starts"] = statement([*matrix, *kmeans_drawn()], f"""SELECT k, property, cluster, start, {r6('inertia')} AS inertia
FROM drawn_labels JOIN drawn_best USING (k, start)""")
    out["kmeans_partitions"] = statement([*matrix, *kmeans(len(PROPERTIES))], """SELECT k, string_agg(block, ';' ORDER BY block) AS partition
FROM (SELECT k, cluster, string_agg(property, ',' ORDER BY property) AS block FROM labels GROUP BY ALL) GROUP BY k""")
    out["silhouette_by_k"] = statement(clustered, f"SELECT k, {r6('silhouette')} AS silhouette FROM sil")
    out["best_partition"] = statement(clustered, "SELECT block_id, property FROM blocks")
    by_block = ("claims_b", "SELECT b.block_id, c.* FROM claims c JOIN blocks b USING (property)")
    passes = clustered_passes()
    out["clustered_truth"] = statement(passes, f"SELECT block_id, object, property, value, {r6('score')} AS confidence FROM found")
    out["evaluate_clustered"] = statement([*passes, TRUTH, ("counts", confusion("votes", "truth", "found"))],
                                          f"SELECT {counts}, {ratio_columns()} FROM counts")

    all_blocks = ("blocks", """SELECT DISTINCT b.block_id, p.property
FROM part_blocks b JOIN parted p USING (partition_id, label)""")
    report = [
        *BASE, VOTES, TRUTH, *partition_tables(), all_blocks, by_block, *common_items(), *accuracy_rounds("DEPEN", ROUNDS), *stops,
        frozen("found", "truth", ROUNDS), frozen("last_trust", "trust", ROUNDS),
        ("block_trust", "SELECT block_id, avg(trust) AS mean_trust FROM last_trust GROUP BY ALL"),
        ("block_counts", confusion("votes", "truth", "found", "block_id")),
        ("summed", """SELECT partition_id, string_agg(block, ';' ORDER BY block) AS partition, count(*) AS n_blocks,
  max(mean_trust) AS best_trust, avg(mean_trust) AS mean_trust, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
  sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(n_unmatched)::BIGINT AS n_unmatched
FROM part_blocks JOIN block_trust USING (block_id) JOIN block_counts USING (block_id) GROUP BY partition_id"""),
    ]
    columns = f"""SELECT partition_id, partition, n_blocks, {r6('best_trust')} AS accuracy_max,
  {r6('mean_trust')} AS accuracy_avg, {counts}, {ratio_columns()} FROM summed"""
    out["partition_report"] = statement(report, columns)
    out["partition_report_first_ten"] = statement(report, f"{columns} ORDER BY partition_id LIMIT 10")
    out["partition_report_resumed"] = statement(report, columns)
    aims = {"accuracy_avg": "mean_trust", "accuracy_max": "best_trust", "accuracy": "coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0)"}
    ranked = "\nUNION ALL\n".join(
        f"(SELECT '{aim}' AS aim, * FROM summed ORDER BY round({key}, 9) DESC, partition_id LIMIT 1)" for aim, key in aims.items())
    best = ("best_rows", ranked)
    out["partition_best"] = statement([*report, best], columns.replace("SELECT partition_id", "SELECT aim, partition_id").replace("FROM summed", "FROM best_rows"))
    quote = "chr(39)"
    listed = (f"replace(replace(partition, ',', {quote} || ', ' || {quote}), ';', {quote} || '], [' || {quote})")
    out["partition_report_file"] = statement(report, f"""SELECT '[[' || {quote} || {listed} || {quote} || ']]' AS partition,
  {r6('best_trust')} AS accuracy_max, {r6('mean_trust')} AS accuracy_avg, {ratio_columns()},
  {r6('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS accuracy_oracle FROM summed""")
    return out
