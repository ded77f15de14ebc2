
from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle import statements
from oracle.statements import COSINE_STOP, DELTA_STOP
from truthloom import (
    accuracy_model, claims_from_wide, coverage, dedupe_claims, evaluate, majority_vote, truth_finder,
    value_similarity, vote_counts,
)
from truthloom.operators.cluster import (
    best_blocks, kmeans_starts, kmeans_sweep, labels_to_partition, silhouette_by_k,
)
from truthloom.operators.dependence import agreement, dependence, max_dependence, ranked_before
from truthloom.operators.matrix import property_distance, property_table, truth_matrix
from truthloom.operators.quality import source_stats
from truthloom.operators.skew import busy_keys, use_all_cores
from truthloom.operators.votes import best_values, restrict_properties, tied_values
from truthloom.plans.accuracy import majority_sets
from truthloom.plans.claimbase import BLOCK, ClaimBase
from truthloom.plans.clustered import clustered_truth
from truthloom.plans.exhaustive import best_partitions, continue_report, partition_report
from truthloom.plans.packed import smallest_hashes
from truthloom.plans.rounds import convergence
from truthloom.plans.workspace import Workspace
from truthloom.schema import CLAIM, FACT, ITEM
from truthloom.sources import (
    assign_sources, generate_claims, generate_truth, read_claims, read_truth, split_properties,
    write_claims, write_partition_report, write_truth,
)
from truthloom.sources.generate import Accuracy, item_tasks

try:  # the training-data operators are optional; nothing else needs them
    import corpus_pipeline
    from truthloom.llm import registry as llm
except ImportError:
    corpus_pipeline = llm = None

SMOKE_DIR = "/root/testdata/sf0.001"
NEWEST = ["l_shipdate", "l_orderkey", "l_linenumber"]
LINES_PER_TASK = 250_000  # where lines are dealt by part
GEN_PROPERTIES = [f"Property{i}" for i in range(1, 7)]
GEN_ACCURACY = Accuracy(m1=0.8, m2=0.3, m3=0.8)
BLOCKS = {"returnflag": 1, "linestatus": 1, "discount": 2, "tax": 2, "shipyear": 3}


# --- claims from the given tables -------------------------------------------------------

def wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ["l_partkey", "l_suppkey", *NEWEST, "l_returnflag", "l_linestatus", "l_discount", "l_tax"]
    lines = use_all_cores(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*used), "l_orderkey", "l_linenumber")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))


def line_properties() -> dict:
    return {
        "returnflag": F.col("l_returnflag"),
        "linestatus": F.col("l_linestatus"),
        "discount": F.col("l_discount").cast("decimal(4,2)"),
        "tax": F.col("l_tax").cast("decimal(4,2)"),
        "shipyear": F.year("l_shipdate"),
    }


def claims_of(spark: SparkSession, sf_dir: str, **dealt) -> DataFrame:
    """Nations claim properties of parts; the newest line per (part, nation) counts. ``dealt``: see ``dealing``."""
    return claims_from_wide(wide_lines(spark, sf_dir), "l_partkey", "s_nationkey", line_properties(), NEWEST, **dealt)


def dealing(spark: SparkSession, sf_dir: str, work: Workspace) -> dict:
    """Tasks that lines are dealt to by part, in whole waves and none with more lines than it can sort, and parts with very many lines."""
    parts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").cast("string").alias("object"))
    rows, cores = parts.count(), spark.sparkContext.defaultParallelism
    return {"tasks": cores * max(1, -(-rows // (cores * LINES_PER_TASK))), "hot": busy_keys(parts, "object", rows, work)}


def prepared(spark: SparkSession, sf_dir: str) -> ClaimBase:
    work = Workspace(spark)
    return ClaimBase(work.keep(claims_of(spark, sf_dir), "claims"), work)


def chosen_truth(claims: DataFrame, **also: Column) -> DataFrame:
    """A fixed arbitrary truth: the claim with the smallest hash of its item and source; ``also`` are further sums over its item."""
    # as bytes: half as much to shuffle as the digits, in the same order
    key = F.unhex(F.md5(F.concat_ws("|", "object", "property", "source")))
    first = F.min(F.struct(key.alias("key"), "source", "value")).alias("first")
    sums = [total.alias(name) for name, total in also.items()]
    return claims.groupBy(*ITEM).agg(first, *sums).select(*ITEM, F.col("first.value").alias("value"), *also)


def truth_of(base: ClaimBase) -> DataFrame:
    """The same truth; where facts are packed it is picked in their groups, so claims are not sorted and shuffled for it."""
    groups = base.packed()
    if groups is None:
        return chosen_truth(base.claims)
    columns = groups.groups.select("names", "item_names", "starts", "at", "masks", "objects", "values")
    return columns.mapInArrow(smallest_hashes(base.source_names), "object string, property string, value string")


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def ratios6(df: DataFrame) -> DataFrame:
    return r6(df, "precision", "recall", "accuracy", "f1_score")


# --- queries ----------------------------------------------------------------------------

def claims_unpivot(spark, sf_dir):
    return claims_from_wide(wide_lines(spark, sf_dir), "l_partkey", "s_nationkey", line_properties())


def claims_dedupe(spark, sf_dir):
    """The long way round: unpivot every line first, then keep the newest claim."""
    ordered = wide_lines(spark, sf_dir)
    parts = [expr.cast("string").alias(name) for name, expr in line_properties().items()]
    long = ordered.select(
        F.col("l_partkey").cast("string").alias("object"), F.col("s_nationkey").cast("string").alias("source"),
        *NEWEST, *parts,
    ).unpivot(["object", "source", *NEWEST], list(line_properties()), "property", "value")
    return dedupe_claims(long.where(F.col("value").isNotNull()), NEWEST)


def claims_csv_roundtrip(spark, sf_dir):
    """All claims, and all texts as claims: these hold line breaks, quotes, blanks and separators."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = F.col("doc_id").cast("string").alias("object"), F.col("source")
    texts = docs.select(*names, F.lit("text").alias("property"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("value"))
    blanks = docs.select(*names, F.lit("blank").alias("property"), F.lit("").alias("value"))
    path = f"{Workspace(spark).path}/claims-csv"
    write_claims(claims_of(spark, sf_dir).unionByName(texts.where("value IS NOT NULL")).unionByName(blanks), path)
    return read_claims(spark, path).select(*CLAIM)


def truth_csv_roundtrip(spark, sf_dir):
    path = f"{Workspace(spark).path}/truth-csv"
    write_truth(chosen_truth(claims_of(spark, sf_dir)), path)
    return read_truth(spark, path).select(*FACT)


def truth_false_roundtrip(spark, sf_dir):
    """Truth with wrong values: those that other sources claim, and whole texts as textual wrong values."""
    work = Workspace(spark)
    claims = claims_of(spark, sf_dir, **dealing(spark, sf_dir, work))
    truth = chosen_truth(claims, claimed=F.array_sort(F.collect_set("value")))
    items = truth.select(*FACT, F.array_remove("claimed", F.col("value")).alias("false_values"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("string").alias("object"), F.lit("text").alias("property"), F.col("lang").alias("value"),
                        F.array("text", "source", F.lit("")).alias("false_values"))
    path = f"{work.path}/truth-csv"
    write_truth(items.unionByName(texts), path)
    back = read_truth(spark, path, with_false=True)
    return back.select(*FACT, F.array_join("false_values", "\x1f").alias("false_values"))


def vote_counts_query(spark, sf_dir):
    return vote_counts(claims_of(spark, sf_dir))


def majority_vote_query(spark, sf_dir, tie="min"):
    return majority_vote(claims_of(spark, sf_dir), tie).select(*FACT, "votes")


def majority_vote_ties(spark, sf_dir):
    return tied_values(vote_counts(claims_of(spark, sf_dir)))


def property_subset_vote(spark, sf_dir):
    return majority_vote(restrict_properties(claims_of(spark, sf_dir), ["discount", "tax"])).select(*FACT, "votes")


def source_claim_stats(spark, sf_dir):
    return source_stats(claims_of(spark, sf_dir))


def coverage_query(spark, sf_dir):
    return r6(coverage(claims_of(spark, sf_dir)), "coverage")


def similarity_char(spark, sf_dir):
    return r6(value_similarity(claims_of(spark, sf_dir), "char"), "sim")


def similarity_numeric(spark, sf_dir):
    return r6(value_similarity(claims_of(spark, sf_dir), "numeric"), "sim")


def finder(spark, sf_dir, rounds, **options):
    return truth_finder(prepared(spark, sf_dir), max_iterations=rounds, threshold=0.0, **options)


def truths_of(result) -> DataFrame:
    return r6(result.truths.select(*FACT, "confidence"), "confidence")


def trust_of(result) -> DataFrame:
    return r6(result.trust.select("source", "trust"), "trust")


def confidence_of(result) -> DataFrame:
    return r6(result.confidence.select(*FACT, "confidence"), "confidence")


def convergence_query(spark, sf_dir):
    result = finder(spark, sf_dir, 2)
    rows = [
        convergence(trust, []).select(F.lit(number).alias("round"), "cosine", "max_abs_delta")
        for number, trust in enumerate(result.history, 1)
    ]
    rounds = result.work.keep(reduce(DataFrame.unionByName, rows), "convergence")
    before = rounds.select((F.col("round") + 1).alias("round"), F.col("cosine").alias("before"))
    change = F.abs(F.coalesce("before", F.lit(1.0)) - F.col("cosine"))
    joined = rounds.join(before, "round", "left").select("round", "cosine", change.alias("change"), "max_abs_delta")
    return r6(joined, "cosine", "change", "max_abs_delta")


def trust_summary_query(spark, sf_dir):
    return r6(finder(spark, sf_dir, 2).summary(), "max_trust", "mean_trust")


def first_counts(base: ClaimBase) -> DataFrame:
    return agreement(base.pairs, base.true_pairs(majority_sets(base)), BLOCK).drop(*BLOCK)


def first_dependence(base: ClaimBase) -> DataFrame:
    trust = base.initial_trust(0.8).drop(*BLOCK)
    return base.work.keep(dependence(first_counts(base), trust, []), "dependence")


def agreement_counts(spark, sf_dir):
    return first_counts(prepared(spark, sf_dir))


def dependence_query(spark, sf_dir):
    return r6(first_dependence(prepared(spark, sf_dir)), "dep")


def max_dependence_query(spark, sf_dir):
    return r6(max_dependence(first_dependence(prepared(spark, sf_dir))), "max_dep")


def source_order(spark, sf_dir):
    dep = first_dependence(prepared(spark, sf_dir))
    before = ranked_before(dep, [], "dependence").groupBy(F.col("s1").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    ranked = max_dependence(dep).join(before, "source", "left")
    return r6(ranked.select("source", "max_dep", (F.coalesce("n", F.lit(0)) + 1).alias("position")), "max_dep")


def accuracy(spark, sf_dir, algo, rounds, **options):
    return accuracy_model(prepared(spark, sf_dir), algo, max_iterations=rounds, threshold=0.0, **options)


def full(spark, sf_dir, algo, **options):
    """A model with its own number of rounds and stop rule."""
    base = prepared(spark, sf_dir)
    return base, truth_finder(base, **options) if algo == "TF" else accuracy_model(base, algo, **options)


def full_truths(spark, sf_dir, algo):
    return truths_of(full(spark, sf_dir, algo)[1])


def blocks_stop(spark, sf_dir, stop, threshold):
    """Three blocks of properties in one job, each of which stops when it has settled."""
    names = F.array(*[F.struct(F.lit(b).alias("block_id"), F.lit(p).alias("property")) for p, b in BLOCKS.items()])
    base = prepared(spark, sf_dir).with_blocks(spark.range(1).select(F.inline(names)))
    result = accuracy_model(base, "ACCU", stop=stop, threshold=threshold)
    return r6(result.trust.select("block_id", "source", "trust"), "trust")


def judged(base: ClaimBase, found: DataFrame) -> DataFrame:
    return ratios6(evaluate(base.votes_per_value(), chosen_truth(base.claims), found))


def evaluate_vote(spark, sf_dir):
    base = prepared(spark, sf_dir)
    return judged(base, best_values(base.votes_per_value()))


def evaluate_model(spark, sf_dir, algo):
    base, result = full(spark, sf_dir, algo)
    return judged(base, result.truths)


def evaluate_clustered(spark, sf_dir):
    base = prepared(spark, sf_dir)
    return judged(base, clustered_truth(base, partial(accuracy_model, algo="ACCU")).truths)


def gen_tables(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    objects = parts.select(F.col("p_partkey").cast("string").alias("object"), F.col("p_partkey").alias("object_idx"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sources = nations.select(F.col("n_name").alias("source"), F.col("n_nationkey").cast("bigint").alias("source_idx"))
    return objects, sources, split_properties(spark, GEN_PROPERTIES)


def gen_truth(spark, sf_dir):
    objects, _, _ = gen_tables(spark, sf_dir)
    truth = generate_truth(objects, GEN_PROPERTIES)
    return truth.select(*FACT, F.array_join("false_values", ",").alias("false_values"))


def gen_sources(spark, sf_dir):
    _, sources, groups = gen_tables(spark, sf_dir)
    n_groups = groups.first().n_groups
    return assign_sources(sources, n_groups)


def gen_both(spark, sf_dir):
    objects, sources, groups = gen_tables(spark, sf_dir)
    n_objects = objects.count()
    truth = generate_truth(objects, GEN_PROPERTIES, n_objects=n_objects)
    return truth, generate_claims(truth, groups, sources, n_objects, GEN_ACCURACY)


def gen_claims(spark, sf_dir):
    return gen_both(spark, sf_dir)[1]


def gen_evaluate_vote(spark, sf_dir):
    truth, claims = gen_both(spark, sf_dir)
    # in as many buckets as items ask for: a task reads no more of them when there are more, and Spark knows their size
    work, tasks = Workspace(spark), item_tasks(spark, truth.count())
    truth = work.keep_bucketed(truth.select(*FACT), "truth", tasks, *ITEM)
    votes = work.keep_bucketed(vote_counts(claims), "votes", tasks, *ITEM)
    return ratios6(evaluate(votes, truth, best_values(votes)))


def gen_accu_trust(spark, sf_dir):
    work = Workspace(spark)
    base = ClaimBase(work.keep(gen_both(spark, sf_dir)[1], "claims"), work)
    return trust_of(accuracy_model(base, "ACCU", max_iterations=2, threshold=0.0))


def truth_matrix_query(spark, sf_dir):
    base = prepared(spark, sf_dir)
    return truth_matrix(base.claims, best_values(base.votes_per_value()), base.hot_facts)


def distances_of(spark, sf_dir):
    base = prepared(spark, sf_dir)
    names = base.work.keep(property_table(base.facts), "names")
    matrix = truth_matrix(base.claims, best_values(base.votes_per_value()), base.hot_facts)
    return base.work.keep(property_distance(matrix, names, base.work), "distances"), names, base.work


def property_distance_query(spark, sf_dir):
    return distances_of(spark, sf_dir)[0]


def kmeans_query(spark, sf_dir):
    return kmeans_sweep(*distances_of(spark, sf_dir))


def kmeans_starts_query(spark, sf_dir):
    """Ten drawn starts of every k in ten rounds each, the best one of them."""
    return r6(kmeans_starts(*distances_of(spark, sf_dir), max_iter=10), "inertia")


def kmeans_partitions(spark, sf_dir):
    distances, names, work = distances_of(spark, sf_dir)
    lists = labels_to_partition(kmeans_sweep(distances, names, work, k_max=names.count()))
    text = F.array_join(F.transform("partition", lambda block: F.array_join(block, ",")), ";")
    return lists.select("k", text.alias("partition"))


def silhouette_query(spark, sf_dir):
    distances, names, work = distances_of(spark, sf_dir)
    return r6(silhouette_by_k(kmeans_sweep(distances, names, work), distances), "silhouette")


def best_partition(spark, sf_dir):
    return best_blocks(*distances_of(spark, sf_dir))


def clustered_truth_query(spark, sf_dir):
    found = clustered_truth(prepared(spark, sf_dir), partial(accuracy_model, algo="ACCU"))
    return r6(found.truths.select("block_id", *FACT, "confidence"), "confidence")


def report_of(spark, sf_dir, limit=None):
    base = prepared(spark, sf_dir)
    return partition_report(base, truth_of(base), limit=limit), base.work


def partition_report_file(spark, sf_dir):
    """The report as written to its file, read back."""
    report, work = report_of(spark, sf_dir)
    write_partition_report(report, f"{work.path}/report")
    names = ["accuracy_max", "accuracy_avg", "accuracy_oracle", "precision", "recall", "accuracy", "f1_score"]
    schema = ", ".join(["partition string", *[f"{n} double" for n in names]])
    return r6(spark.read.schema(schema).option("sep", ";").csv(f"{work.path}/report"), *names)


def partition_report_query(spark, sf_dir, limit=None):
    report, _ = report_of(spark, sf_dir, limit)
    text = F.array_join(F.transform("partition", lambda block: F.array_join(block, ",")), ";")
    return r6(ratios6(report.withColumn("partition", text)), "accuracy_max", "accuracy_avg")


def partition_best(spark, sf_dir):
    """The best row of the report by each aim, found without the report."""
    base = prepared(spark, sf_dir)
    best = best_partitions(base, truth_of(base), aims=("accuracy_avg", "accuracy_max", "accuracy"))
    text = F.array_join(F.transform("partition", lambda block: F.array_join(block, ",")), ";")
    return r6(ratios6(best.withColumn("partition", text)), "accuracy_max", "accuracy_avg")


def partition_report_resumed(spark, sf_dir):
    """The report in two shares: the second takes up the folder of the first."""
    base = prepared(spark, sf_dir)
    folder = f"{base.work.path}/resumed"
    continue_report(base, folder, truth_of(base), share=20)
    report = continue_report(base, folder, truth_of(base))
    text = F.array_join(F.transform("partition", lambda block: F.array_join(block, ",")), ";")
    return r6(ratios6(report.withColumn("partition", text)), "accuracy_max", "accuracy_avg")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every job and operator, over the whole tables of ``sf_dir``."""
    found = {
        "claims_unpivot": claims_unpivot,
        "claims_dedupe": claims_dedupe,
        "claims_csv_roundtrip": claims_csv_roundtrip,
        "truth_csv_roundtrip": truth_csv_roundtrip,
        "truth_false_roundtrip": truth_false_roundtrip,
        "vote_counts": vote_counts_query,
        "majority_vote": majority_vote_query,
        "majority_vote_ties": majority_vote_ties,
        "majority_vote_seeded": partial(majority_vote_query, tie="seeded"),
        "property_subset_vote": property_subset_vote,
        "source_claim_stats": source_claim_stats,
        "coverage": coverage_query,
        "similarity_char": similarity_char,
        "similarity_numeric": similarity_numeric,
        "truthfinder_confidence_r1": lambda s, d: confidence_of(finder(s, d, 1)),
        "truthfinder_trust_r1": lambda s, d: trust_of(finder(s, d, 1)),
        "truthfinder_r2": lambda s, d: truths_of(finder(s, d, 2)),
        "truthfinder_trust_r2": lambda s, d: trust_of(finder(s, d, 2)),
        "truthfinder_numeric_trust_r2": lambda s, d: trust_of(finder(s, d, 2, similarity="numeric")),
        "convergence": convergence_query,
        "trust_summary": trust_summary_query,
        "agreement_counts": agreement_counts,
        "dependence": dependence_query,
        "max_dependence": max_dependence_query,
        "source_order": source_order,
        "accu_confidence_r1": lambda s, d: confidence_of(accuracy(s, d, "ACCU", 1)),
        "accu_name_order_trust_r2": lambda s, d: trust_of(accuracy(s, d, "ACCU", 2, order="name")),
        "accu_seeded_r1": lambda s, d: truths_of(accuracy(s, d, "ACCU", 1, tie="seeded")),
        "truthfinder_full": partial(full_truths, algo="TF"),
        "truthfinder_stop": lambda s, d: trust_of(full(s, d, "TF", threshold=1e-3)[1]),
        "blocks_stop_cosine": partial(blocks_stop, stop="cosine", threshold=COSINE_STOP),
        "blocks_stop_delta": partial(blocks_stop, stop="max_abs_delta", threshold=DELTA_STOP),
        "evaluate_vote": evaluate_vote,
        "evaluate_truthfinder": partial(evaluate_model, algo="TF"),
        "evaluate_clustered": evaluate_clustered,
        "gen_truth": gen_truth,
        "gen_sources": gen_sources,
        "gen_claims": gen_claims,
        "gen_evaluate_vote": gen_evaluate_vote,
        "gen_accu_trust_r2": gen_accu_trust,
        "truth_matrix": truth_matrix_query,
        "property_distance": property_distance_query,
        "kmeans_sweep": kmeans_query,
        "kmeans_starts": kmeans_starts_query,
        "kmeans_partitions": kmeans_partitions,
        "silhouette_by_k": silhouette_query,
        "best_partition": best_partition,
        "clustered_truth": clustered_truth_query,
        "partition_report": partition_report_query,
        "partition_report_first_ten": partial(partition_report_query, limit=10),
        "partition_report_file": partition_report_file,
        "partition_report_resumed": partition_report_resumed,
        "partition_best": partition_best,
    }
    for algo in ("DEPEN", "ACCU", "ACCUSIM"):
        name = algo.lower()
        found[f"{name}_r1"] = lambda s, d, a=algo: truths_of(accuracy(s, d, a, 1))
        found[f"{name}_r2"] = lambda s, d, a=algo: truths_of(accuracy(s, d, a, 2))
        found[f"{name}_full"] = partial(full_truths, algo=algo)
        found[f"evaluate_{name}"] = partial(evaluate_model, algo=algo)
        found[f"{name}_trust_r2"] = lambda s, d, a=algo: trust_of(accuracy(s, d, a, 2))
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    found = statements()
    if llm:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def entry(spark: SparkSession) -> DataFrame:
    """ACCU, two rounds, on the smallest data set."""
    return queries()["accu_r2"](spark, SMOKE_DIR)
