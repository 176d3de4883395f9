"""Queries over the given tables and the SQL that must agree with them.

Customers stand in for junctions: their names have one length, and nation and
market segment group them. Parts give short strings with many copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import kinset as k
from kinset.functions.records import to_int
from kinset.operators.linkage import agglomerate
from kinset.plans.jobs import compare_counts

try:  # The llm package and its pipeline can be left out.
    from kinset.llm.queries import QUERIES as LLM_QUERIES
    from kinset.llm.queries import SQL as LLM_SQL
except ModuleNotFoundError as error:
    if not (error.name or "").startswith("kinset.llm"):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
if LLM_QUERIES:
    try:
        import corpus_pipeline
    except ModuleNotFoundError as error:
        if error.name != "corpus_pipeline":
            raise
    else:
        LLM_QUERIES = LLM_QUERIES | {"pipeline": corpus_pipeline.run}
        if corpus_pipeline.ORACLE_SQL:
            LLM_SQL = LLM_SQL | {"pipeline": corpus_pipeline.ORACLE_SQL}

LG = ["v_call", "j_call", "junction_length"]
BRAND = ["p_brand"]
TIGHT, WIDE = 0.06, 0.14
LEVELS = (TIGHT, WIDE, 0.25)
LABEL_CUTS = (0.03, 0.06, 0.09, 0.12, 0.15)


def junctions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_nationkey").alias("v_call"),
        F.col("c_mktsegment").alias("j_call"),
        F.length("c_name").alias("junction_length"),
        F.col("c_custkey").cast("bigint").alias("id"),
        F.col("c_name").alias("seq"),
    )


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(
        "p_brand", F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("seq")
    )


def _leads(df: DataFrame, group: list[str]) -> DataFrame:
    """Each record beside the record with the smallest id of its group."""
    first = df.groupBy(*group).agg(F.min(F.struct("id", "seq")).alias("_first"))
    return df.join(first, group).select(
        *group, "id", F.col("_first.id").alias("first_id"), "seq", F.col("_first.seq").alias("lead")
    )


def _group_lists(spark, sf):
    lists = k.collect_group_columns(
        junctions(spark, sf), LG, {"id": "ids", "seq": "junc_seqs"}, list_rows=10
    )
    return lists.select(
        *LG, "part",
        F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"),
        F.array_join("junc_seqs", ",").alias("junc_seqs"),
    )


def _group_records(spark, sf):
    lists = k.collect_groups(junctions(spark, sf), LG, ["id", "seq"], list_rows=10)
    return lists.select(
        *LG, "part",
        F.size("SeqList").cast("bigint").alias("records"),
        F.array_join(
            F.transform("SeqList", lambda r: F.concat_ws(":", r["id"].cast("string"), r["seq"])), ";"
        ).alias("seq_list"),
    )


def _records(spark, sf):
    """Struct to bracketed text and back, and text to numbers."""
    table = k.with_record(junctions(spark, sf), ["id", "j_call", "seq"])
    text = F.concat(F.lit("["), F.concat_ws(",", "Seq.id", "Seq.j_call", "Seq.seq"), F.lit("]"))
    parsed = table.select(k.parse_record(text).alias("r"), F.col("id").cast("string").alias("t"))
    return parsed.select(
        "r.id", "r.label", "r.seq", k.sequence_length("r.seq").cast("bigint").alias("n"),
        to_int(F.col("t")).alias("number"),
        k.same_sequence("r.seq", "r.label").alias("same"),
    )


def _json(spark, sf):
    text = junctions(spark, sf).select(k.to_json_records(label="j_call").alias("js"))
    return text.select("js", k.from_json_records("js").alias("r")).select(
        "js", "r.id", "r.label", "r.seq"
    )


def _distances(spark, sf):
    lead = _leads(junctions(spark, sf), LG)
    return lead.select(
        "id", "first_id",
        k.hamming_norm("seq", "lead").alias("hamming"), k.edit_dist("seq", "lead").alias("edit"),
    )


def _edit_distances(spark, sf):
    lead = _leads(parts(spark, sf), BRAND)
    return lead.select("id", "first_id", k.distance("edit", "seq", "lead").alias("dist"))


def _near(metric, thres, strategy):
    def run(spark, sf):
        if metric == "hamming":
            return k.near_pairs(junctions(spark, sf), LG, metric, thres, strategy)
        return k.near_pairs(parts(spark, sf), BRAND, metric, thres, strategy)

    return run


def _single(spark, sf):
    return k.single_linkage(junctions(spark, sf), LG, "hamming", WIDE)


def _forest(spark, sf):
    forest = k.mst_edges(junctions(spark, sf), LG, "hamming", 0.25)
    return forest.groupBy(F.round(F.col("dist") * 18).cast("bigint").alias("mismatches")).agg(
        F.count(F.lit(1)).alias("edges")
    )


def _radius(spark, sf):
    df = junctions(spark, sf)
    members = k.leader_clusters(df, LG, "hamming", WIDE)
    return k.cluster_radius(df, members, LG, "hamming")


def _summaries(spark, sf):
    df = parts(spark, sf)
    members = k.condense(df, BRAND, "edit", 3)
    return k.summaries(df, BRAND, "edit", members)


OPTIONS = {"condense": {"inner": TIGHT}, "two_stage": {"inner": TIGHT, "cut": TIGHT}}


def _compare(spark, sf):
    members = k.compare_methods(
        junctions(spark, sf), LG, "hamming", WIDE, 10,
        ("mst", "leader", "condense", "two_stage"), OPTIONS,
    )
    return compare_counts(members, LG)


def _route(spark, sf):
    """A method for each group by a column of the table, the market segment."""
    how = F.when(F.col("j_call") == "BUILDING", "leader").when(F.col("j_call") == "MACHINERY", "two_stage")
    routed = junctions(spark, sf).withColumn("how", how.otherwise("linkage"))
    return k.route_groups(
        routed, LG, "hamming", WIDE, "how", ["leader", "linkage", "two_stage"], OPTIONS
    )


def padded(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys as strings of one length, all in one group: dense, and far above a bucket."""
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.lit(0).alias("g"), F.col("o_orderkey").cast("bigint").alias("id"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("seq"),
    )


def _lines(spark, sf):
    """Grouped lines with quotes, tabs and repeated headers made of customers, and read back."""
    header = "gid\trecord"
    record = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_mktsegment", "c_name")
    line = F.concat(F.col("c_nationkey").cast("string"), F.lit('\t"'), record, F.lit('"'))
    also = F.when(F.col("c_custkey") % 100 == 0, F.array(F.lit(header), line)).otherwise(F.array(line))
    lines = spark.read.parquet(f"{sf}/customer.parquet").select(F.explode(also).alias("value"))
    return k.parse_grouped(lines, header)


def _fasta(spark, sf):
    """FASTA records with wrapped lines made of customers, and read back."""
    name = F.col("c_name")
    text = F.concat(F.lit(">"), "c_mktsegment", F.lit("\n"), F.substring(name, 1, 9), F.lit("\r\n"), F.substring(name, 10, 99))
    chunks = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", text.alias("value"))
    return k.parse_fasta(chunks, ["c_custkey"])


def _tree_cut(spark, sf):
    df = junctions(spark, sf)
    return k.cut(df, LG, k.mst_edges(df, LG, "hamming", 0.25), WIDE)


def _to_ten(spark, sf):
    df = junctions(spark, sf)
    return k.cut_merges(df, LG, k.linkage_merges(df, LG, "hamming", "average"), k=10)


def _summary_levels(spark, sf):
    """Summaries of the junctions at three levels."""
    return k.summary_levels(junctions(spark, sf), LG, "hamming", LEVELS).withColumn("radius", F.round("radius", 9))


def _similarities(spark, sf):
    """The whole similarity table of each group."""
    pairs = k.distance_pairs(junctions(spark, sf), LG, "hamming")
    return pairs.withColumn("dist", 1 - F.col("dist"))


def _agglomerate(spark, sf):
    """Average linkage over all similarities of the junctions of a group."""
    merges = agglomerate(_similarities(spark, sf), LG, "average", 0.5, "similarity")
    # Sums taken in another order differ in the last digits.
    return merges.withColumn("height", F.round("height", 9))


def _similar_to_ten(spark, sf):
    """Average linkage over all similarities down to ten clusters a group."""
    return k.cut_merges(junctions(spark, sf), LG, agglomerate(_similarities(spark, sf), LG, "average", None, "similarity"), k=10)


def _dendrogram(spark, sf):
    """Nodes of the single-linkage trees, children and leaf intervals."""
    merges = k.tree_merges(k.mst_edges(junctions(spark, sf), LG, "hamming", 0.25), LG)
    return k.dendrogram(merges, LG).withColumn("height", F.round("height", 9))


def _node_leaves(spark, sf):
    """The records below every node of the single-linkage trees of parts, as numbers and sums."""
    df = parts(spark, sf)
    merges = k.tree_merges(k.mst_edges(df, BRAND, "edit", 4.0), BRAND)
    merges = merges.withColumn("height", F.col("height"))
    found = k.node_leaves(k.dendrogram(merges, BRAND), k.leaves(df, BRAND, merges), BRAND)
    return found.groupBy(*BRAND, "node").agg(F.count(F.lit(1)).alias("records"), F.sum("id").alias("ids"), F.min("id").alias("first_id"))


def _sweep_labels(linkage):
    def run(spark, sf):
        found = k.sweep_members(junctions(spark, sf), LG, "hamming", LABEL_CUTS, linkage)
        return found.select(*LG, "id", "thres", "cluster_id")

    return run


def _distance_table(spark, sf):
    """The distance table of each group in both directions."""
    return k.distance_pairs(parts(spark, sf), BRAND, "edit", symmetric=True)


def _annotated_file(spark, sf):
    """Customers as a header TSV file, written and read back."""
    path = k.shared_path(spark, "annotated")
    table = junctions(spark, sf).select(
        F.col("id").alias("Index"), F.concat(F.lit("s"), "id").alias("ID"), F.col("v_call").alias("V_CALL"),
        F.col("j_call").alias("J_CALL"), F.col("junction_length").alias("JUNCTION_LENGTH"), F.col("seq").alias("JUNCTION"),
    )
    table.write.csv(path, sep="\t", header=True)
    return k.as_sequences(k.read_annotated(spark, path, {"ID": "SEQUENCE_ID"}))


def _grouped_file(spark, sf):
    """Customers as a text file of groups under a header, written and read back."""
    path = k.shared_path(spark, "grouped")
    record = F.concat_ws(",", F.col("id").cast("string"), "j_call", "seq")
    line = F.concat(F.col("v_call").cast("string"), F.lit('\t"'), record, F.lit('"'))
    lines = junctions(spark, sf).select(F.col("id"), line.alias("value"))
    head = spark.createDataFrame([(None, "gid\trecord")], lines.schema)
    # The header comes first, in the first file.
    lines = head.unionByName(lines).repartitionByRange("id").sortWithinPartitions("id")
    lines.select("value").write.text(path)
    return k.read_grouped(spark, path, p=4)


def _fasta_file(spark, sf):
    """Customers as FASTA files, written and read back; ids follow the order of the files."""
    path = k.shared_path(spark, "fasta")
    text = F.concat(F.lit(">"), "j_call", F.lit("\n"), F.substring("seq", 1, 9), F.lit("\n"), F.substring("seq", 10, 99))
    lines = junctions(spark, sf).select("id", text.alias("value")).repartitionByRange("id").sortWithinPartitions("id")
    lines.select("value").write.text(path)
    return k.read_fasta(spark, path)


def _cluster_files(spark, sf):
    """Cluster lists, a line for each group or part of one, written and read back."""
    df = junctions(spark, sf)
    path = k.shared_path(spark, "clusters")
    lists = k.cluster_lists(df, _single(spark, sf), LG, "hamming", list_rows=10)
    k.write_cluster_lists(lists, LG, path)
    return k.read_cluster_lists(spark, path, "v_call int, j_call string, junction_length int")


def _label_files(spark, sf):
    """Label files for each method and group in record order, written and read back."""
    df = junctions(spark, sf)
    path = k.shared_path(spark, "labels")
    by = ["method", *LG]
    found = [
        members.select(F.lit(name).alias("method"), *LG, "id", "cluster_id")
        for name, members in (("mst", _single(spark, sf)), ("leader", k.leader_clusters(df, LG, "hamming", WIDE)))
    ]
    k.write_group_labels(k.group_labels(found[0].unionByName(found[1]), by), by, path)
    return k.read_group_labels(spark, path, "method string, v_call int, j_call string, junction_length int")


def _linkage(linkage):
    return lambda spark, sf: k.linkage_clusters(junctions(spark, sf), LG, "hamming", WIDE, linkage)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    jn = junctions
    return {
        "group_sizes": lambda s, d: k.group_sizes(jn(s, d), LG),
        "top_groups": lambda s, d: k.top_groups(jn(s, d), LG, 10),
        "collect_group_columns": _group_lists,
        "collect_groups": _group_records,
        "parse_records": _records,
        "json_roundtrip": _json,
        "distances_to_first": _distances,
        "edit_to_first": _edit_distances,
        "near_pairs_block": _near("hamming", WIDE, "block"),
        "near_pairs_pivot": _near("hamming", WIDE, "pivot"),
        "near_pairs_segment": _near("edit", 3.0, "segment"),
        "near_pairs_edit_pivot": _near("edit", 3.0, "pivot"),
        "nearest_hamming": lambda s, d: k.nearest(jn(s, d), LG, "hamming"),
        "nearest_edit": lambda s, d: k.nearest(parts(s, d), BRAND, "edit", 2),
        "single_linkage": _single,
        "single_linkage_edit": lambda s, d: k.single_linkage(parts(s, d), BRAND, "edit", 3.0),
        "cluster_counts": lambda s, d: k.cluster_counts(_single(s, d), LG),
        "cluster_sizes": lambda s, d: k.cluster_sizes(_single(s, d), LG),
        "dense_labels": lambda s, d: k.dense_labels(_single(s, d), LG),
        "threshold_sweep": lambda s, d: k.threshold_sweep(
            jn(s, d), LG, "hamming", (0.03, 0.06, 0.12, 0.17)
        ),
        "condense_sweep": lambda s, d: k.threshold_sweep(
            jn(s, d), LG, "hamming", (0.03, 0.06, 0.12, 0.15), "condense", 0.06
        ),
        "mst_weights": _forest,
        "leader_clusters": lambda s, d: k.leader_clusters(jn(s, d), LG, "hamming", WIDE),
        "leader_clusters_edit": lambda s, d: k.leader_clusters(parts(s, d), BRAND, "edit", 3.0),
        "cluster_radius": _radius,
        "condense": lambda s, d: k.condense(jn(s, d), LG, "hamming", TIGHT, WIDE),
        "condense_summaries": _summaries,
        "two_stage": lambda s, d: k.two_stage(jn(s, d), LG, "hamming", WIDE, TIGHT, TIGHT),
        "route_by_segment": _route,
        "tree_cut": _tree_cut,
        "single_linkage_dense": lambda s, d: k.single_linkage(padded(s, d), ["g"], "hamming", 0.2),
        "cluster_groups_mst": lambda s, d: k.cluster_groups(jn(s, d), LG, 1, "hamming", WIDE),
        "cluster_groups_two_stage": lambda s, d: k.cluster_groups(
            jn(s, d), LG, 3, "hamming", WIDE, OPTIONS
        ),
        "condense_records": lambda s, d: k.condense(jn(s, d), LG, "hamming", 0.0, WIDE),
        "sequence_members": lambda s, d: k.sequence_members(parts(s, d), BRAND, "edit"),
        "parse_grouped": _lines,
        "parse_fasta": _fasta,
        "average_to_ten": _to_ten,
        "cluster_groups": lambda s, d: k.cluster_groups(jn(s, d), LG, 2, "hamming", WIDE),
        "compare_methods": _compare,
        "linkage_complete": _linkage("complete"),
        "linkage_average": _linkage("average"),
        "agglomerate_average": _agglomerate,
        "similar_to_ten": _similar_to_ten,
        "summary_levels": _summary_levels,
        "dendrogram": _dendrogram,
        "node_leaves": _node_leaves,
        "sweep_labels_average": _sweep_labels("average"),
        "sweep_labels_complete": _sweep_labels("complete"),
        "linkage_average_edit": lambda s, d: k.linkage_clusters(parts(s, d), BRAND, "edit", 3.0, "average"),
        "distance_table": _distance_table,
        "annotated_file": _annotated_file,
        "grouped_file": _grouped_file,
        "fasta_file": _fasta_file,
        "cluster_files": _cluster_files,
        "label_files": _label_files,
    } | LLM_QUERIES


def entry(spark: SparkSession) -> DataFrame:
    """Single-linkage clusters per group of the smallest tables."""
    return k.cluster_counts(_single(spark, "/root/testdata/sf0.001"), LG)


_J = """j as (select c_nationkey as v_call, c_mktsegment as j_call, length(c_name) as junction_length,
         c_custkey::bigint as id, c_name as seq from customer)"""
_P = "j as (select p_brand, p_partkey::bigint as id, p_name as seq from part)"
_G = "v_call, j_call, junction_length"
_HAM = "hamming({a}, {b})::double / length({a})"
_LEV = "levenshtein({a}, {b})::double"


def _dist(metric: str, a: str, b: str) -> str:
    return (_HAM if metric == "hamming" else _LEV).format(a=a, b=b)


def _table(metric: str) -> tuple[str, str]:
    return (_J, _G) if metric == "hamming" else (_P, "p_brand")


def _sql_pairs(metric: str, t: float) -> str:
    table, g = _table(metric)
    return f"""with {table},
      u as (select {g}, seq, min(id) as id, count(*) as copies from j group by all)
      select {g}, a.id as src, b.id as dst, {_dist(metric, 'a.seq', 'b.seq')} as dist,
             a.copies as src_copies, b.copies as dst_copies
      from u a join u b using ({g}) where a.id < b.id and {_dist(metric, 'a.seq', 'b.seq')} < {t}"""


def _sql_nearest(metric: str, n: int) -> str:
    table, g = _table(metric)
    return f"""with {table},
      d as (select {g}, a.id, b.id as nearest, {_dist(metric, 'a.seq', 'b.seq')} as dist
            from j a join j b using ({g}) where a.id <> b.id),
      r as (select *, row_number() over (partition by id order by dist, nearest)::integer as rank from d)
      select {g}, id, rank, nearest, dist from r where rank <= {n}"""


def _single_cte(metric: str, t: float, source: str = "j", tag: str = "sl") -> str:
    """Components of ``source``: table ``tag`` with id and cluster_id."""
    g = _table(metric)[1]
    return f"""{tag}_e as (select a.id as src, b.id as dst from {source} a join {source} b using ({g})
          where a.id <> b.id and {_dist(metric, 'a.seq', 'b.seq')} < {t}),
      {tag}_r as (select id, id as root from {source}
          union select e.dst, r.root from {tag}_r r join {tag}_e e on e.src = r.id),
      {tag} as (select {g}, x.id, y.cluster_id from {source} x
          join (select id, min(root) as cluster_id from {tag}_r group by id) y on x.id = y.id)"""


def _leader_cte(metric: str, t: float, source: str = "j", tag: str = "ld") -> str:
    """Leader clusters of ``source`` in id order: table ``tag``."""
    g = _table(metric)[1]
    near = f"list_filter(s.ls, lambda l: {_dist(metric, 'l.seq', 'o.seq')} < {t})"
    return f"""{tag}_o as (select *, row_number() over (partition by {g} order by id) as rn from {source}),
      {tag} as (
        select {g}, rn, id, seq, id as cluster_id, [struct_pack(id := id, seq := seq)] as ls
        from {tag}_o where rn = 1
        union all
        select {", ".join("o." + c for c in g.split(", "))}, o.rn, o.id, o.seq,
               coalesce({near}[1].id, o.id),
               case when len({near}) = 0
                    then list_append(s.ls, struct_pack(id := o.id, seq := o.seq)) else s.ls end
        from {tag} s join {tag}_o o on ({", ".join("o." + c for c in g.split(", "))}, o.rn)
          = ({", ".join("s." + c for c in g.split(", "))}, s.rn + 1))"""


def _centres(led: str, tag: str, source: str = "j") -> str:
    return f"{tag} as (select * from {source} where id in (select cluster_id from {led}))"


def _sql_single(metric: str, t: float, select: str = "") -> str:
    table, g = _table(metric)
    return f"with recursive {table}, {_single_cte(metric, t)} " + (
        select or f"select {g}, id, cluster_id from sl"
    )


def _sql_leader(metric: str, t: float, select: str = "") -> str:
    table, g = _table(metric)
    return f"with recursive {table}, {_leader_cte(metric, t)} " + (
        select or f"select {g}, id, cluster_id from ld"
    )


# Two stages: leaders at TIGHT, their single-linkage clusters at WIDE.
_TWO = f"""{_leader_cte('hamming', TIGHT, tag='l1')}, {_centres('l1', 'c1')},
  {_single_cte('hamming', WIDE, 'c1', 's1')},
  two as (select l1.v_call, l1.j_call, l1.junction_length, l1.id, s1.cluster_id
          from l1 join s1 on s1.id = l1.cluster_id)"""
# Condensed: leaders at TIGHT, the leaders among them at WIDE.
_CONDENSED = f"""{_leader_cte('hamming', TIGHT, tag='k1')}, {_centres('k1', 'kc')},
  {_leader_cte('hamming', WIDE, 'kc', 'k2')},
  cond as (select k1.v_call, k1.j_call, k1.junction_length, k1.id, k2.cluster_id
           from k1 join k2 on k2.id = k1.cluster_id)"""
_ALL = f"{_single_cte('hamming', WIDE)}, {_leader_cte('hamming', WIDE)}"
_N = f"n as (select {_G}, count(*) as n from j group by all)"


def _sql_sweep(cuts: tuple[float, ...]) -> str:
    ctes = ", ".join(_single_cte("hamming", t, "j", f"w{i}") for i, t in enumerate(cuts))
    parts = " union all ".join(
        f"select {t}::double as thres, count(distinct cluster_id) as clusters from w{i}"
        for i, t in enumerate(cuts)
    )
    return f"with recursive {_J}, {ctes} {parts}"


def _sql_condense_sweep(cuts: tuple[float, ...], inner: float) -> str:
    ctes = [_leader_cte("hamming", inner, tag="l0"), _centres("l0", "c0")]
    parts = []
    for i, t in enumerate(cuts):
        ctes.append(_leader_cte("hamming", max(t, inner), "c0", f"w{i}"))
        parts.append(
            f"select {t}::double as thres, count(distinct cluster_id) as clusters from w{i}"
        )
    return f"with recursive {_J}, {', '.join(ctes)} " + " union all ".join(parts)


def _sql_forest(t: float) -> str:
    """Edges of weight w: components below w minus components up to w."""
    table = _J
    ctes, counts = [], []
    for m in range(0, 5):
        bound = (m + 0.5) / 18
        ctes.append(_single_cte("hamming", bound, "j", f"w{m}"))
        counts.append(f"select {m} as m, count(distinct cluster_id) as c from w{m}")
    return f"""with recursive {table}, {', '.join(ctes)}, c as ({' union all '.join(counts)})
      select a.m::bigint as mismatches, (b.c - a.c)::bigint as edges
      from c a join c b on b.m = a.m - 1 where b.c > a.c"""


def _sql_linkage(
    height: str, t: float | None, k: int | None = None, cuts: tuple[float, ...] | None = None, metric: str = "hamming"
) -> str:
    """Rounds of mutual first choices by (height, smaller id, larger id) below ``t``; with ``k`` only
    the lowest n - k merges of each group count, with ``cuts`` the merges below each of them. Names
    have 18 letters."""
    below = "true" if t is None else f"h < {t}"
    table, g = _table(metric)
    m = "hamming(a.seq, b.seq)" if metric == "hamming" else "levenshtein(a.seq, b.seq)"
    rounds = f"""with recursive {table},
      d as (select a.id as x, b.id as y, {m} as m
            from j a join j b using ({g}) where a.id <> b.id),
      st as (select 0 as it, id, id as cl, id as was, 0::double as h, true as moved from j union all (
        with cur as (select id, cl from st where it < 200 and moved),
        e as (select p.cl as a, q.cl as b, {height} as h
              from d join cur p on p.id = d.x join cur q on q.id = d.y where p.cl <> q.cl group by 1, 2),
        best as (select a, min(row(h, least(a, b), greatest(a, b))) as k from e where {below} group by a),
        mv as (select k[1] as h, k[2] as keep, k[3] as gone from (select k from best group by k having count(*) = 2))
        select (select max(it) from st) + 1, cur.id, coalesce(mv.keep, cur.cl), cur.cl, mv.h,
               (select count(*) from mv) > 0
        from cur left join mv on mv.gone = cur.cl))"""
    if cuts:
        steps = ", ".join(f"({t}::double)" for t in cuts)
        return f"""{rounds},
          mg as (select distinct it, cl as keep, was as gone, h from st where cl <> was),
          cuts(thres) as (values {steps}),
          up as (select thres, id, id as root from j, cuts
                 union select thres, up.id, mg.keep from up join mg on mg.gone = up.root and mg.h < thres)
          select {g}, id, thres, min(root) as cluster_id from up join j using (id) group by all"""
    if k is None:
        return f"""{rounds} select {g}, id, cl as cluster_id from st join j using (id)
          where it = (select max(it) from st)"""
    return f"""{rounds},
      mg as (select distinct it, cl as keep, was as gone, h from st where cl <> was),
      o as (select {_G}, keep, gone, row_number() over (partition by {_G} order by round(h, 12), it, keep, gone) as step
            from mg join j on j.id = keep),
      sz as (select {_G}, count(*) as n from j group by all),
      kept as (select keep, gone from o join sz using ({_G}) where step <= n - {k}),
      up as (select id, id as root from j union select up.id, kept.keep from up join kept on kept.gone = up.root)
      select {_G}, id, min(root) as cluster_id from up join j using (id) group by all"""


def _sql_similar(thres: float | None, k: int | None = None) -> str:
    """Average similarity: rounds of mutual first choices by (height, larger id, smaller id), the largest
    first; merges above ``thres`` numbered by height, or the clusters when ``k`` are left in a group."""
    above = "true" if thres is None else f"h > {thres}"
    rounds = f"""with recursive {_J},
      d as (select a.id as x, b.id as y, 1 - hamming(a.seq, b.seq)::double / 18 as m
            from j a join j b using ({_G}) where a.id <> b.id),
      st as (select 0 as it, id, id as cl, id as was, 0::double as h, true as moved from j union all (
        with cur as (select id, cl from st where it < 200 and moved),
        e as (select p.cl as a, q.cl as b, sum(m) / count(*) as h
              from d join cur p on p.id = d.x join cur q on q.id = d.y where p.cl <> q.cl group by 1, 2),
        best as (select a, min(row(-round(h, 12), -greatest(a, b), -least(a, b))) as k from e where {above} group by a),
        mv as (select -k[1] as h, -k[3] as keep, -k[2] as gone from (select k from best group by k having count(*) = 2))
        select (select max(it) from st) + 1, cur.id, coalesce(mv.keep, cur.cl), cur.cl, mv.h,
               (select count(*) from mv) > 0
        from cur left join mv on mv.gone = cur.cl)),
      n as (select it, cl, count(*) as size from st group by all),
      mg as (select distinct st.it, cl as left_id, was as right_id, h from st where cl <> was),
      o as (select {_G}, row_number() over (partition by {_G} order by -round(h, 12), mg.it, -right_id, -left_id) - 1 as step,
          left_id, right_id, round(h, 9) as height, size
        from mg join n on n.it = mg.it and n.cl = mg.left_id join j on j.id = left_id)"""
    if k is None:
        return f"{rounds} select {_G}, step, left_id, right_id, height, size from o"
    return f"""{rounds},
      sz as (select {_G}, count(*) as n from j group by all),
      kept as (select left_id, right_id from o join sz using ({_G}) where step < n - {k}),
      up as (select id, id as root from j union select up.id, left_id from up join kept on right_id = up.root)
      select {_G}, id, min(root) as cluster_id from up join j using (id) group by all"""


def _sql_levels(cuts: tuple[float, ...]) -> str:
    """Leaders of the leaders before: weights add up, radii by the triangle inequality."""
    ctes, parts = ["c0 as (select * from j)", f"s0 as (select {_G}, id, 1 as weight, 0::double as radius from j)"], []
    for i, t in enumerate(cuts, 1):
        far = _dist("hamming", "c.seq", "x.seq")
        ctes += [
            _leader_cte("hamming", t, f"c{i - 1}", f"l{i}"), _centres(f"l{i}", f"c{i}", f"c{i - 1}"),
            f"""s{i} as (select {_G}, l{i}.cluster_id as id, sum(s.weight) as weight, max({far} + s.radius) as radius
                from l{i} join s{i - 1} s using ({_G}, id) join j c using ({_G}, id) join j x on x.id = l{i}.cluster_id
                group by {_G}, l{i}.cluster_id)""",
        ]
        up = f"left join l{i + 1} p on p.id = s.id" if i < len(cuts) else ""
        parent = "p.cluster_id" if i < len(cuts) else "null::bigint"
        g = ", ".join("s." + c for c in _G.split(", "))
        parts.append(f"""select {g}, {i - 1} as level, {t}::double as thres, s.id as center_id, {parent} as parent_id,
            s.weight::bigint as weight, round(s.radius, 9) as radius from s{i} s {up}""")
    return f"with recursive {_J}, {', '.join(ctes)} " + " union all ".join(parts)


def _tree_cte(metric: str, t: float) -> str:
    """Single-linkage merges one at a time in each group, by (distance, smaller id, larger id): table mg
    (step, left_id, right_id, h, size, off), off being the size of the left side before."""
    table, g = _table(metric)
    return f"""{table},
      d as (select {g}, a.id as x, b.id as y, {_dist(metric, 'a.seq', 'b.seq')} as dist
            from j a join j b using ({g}) where a.id < b.id and {_dist(metric, 'a.seq', 'b.seq')} < {t}),
      st as (select 0 as it, id, id as cl, id as was, 0::double as h, true as moved from j union all (
        with cur as (select id, cl from st where it < 900 and moved),
        e as (select {g}, min(row(dist, x, y)) as k from d join cur p on p.id = x join cur q on q.id = y
              where p.cl <> q.cl group by {g}),
        mv as (select k[1] as h, least(p.cl, q.cl) as keep, greatest(p.cl, q.cl) as gone
               from e join cur p on p.id = k[2] join cur q on q.id = k[3])
        select (select max(it) from st) + 1, cur.id, coalesce(mv.keep, cur.cl), cur.cl, mv.h,
               (select count(*) from mv) > 0
        from cur left join mv on mv.gone = cur.cl)),
      n as (select it, cl, count(*) as size from st group by all),
      ms as (select distinct it, cl as left_id, was as right_id, h from st where cl <> was),
      mg as (select {g}, row_number() over (partition by {g} order by ms.it) - 1 as step, ms.it, left_id, right_id, h,
               a.size, a.size - b.size as off
             from ms join n a on a.it = ms.it and a.cl = left_id join n b on b.it = ms.it - 1 and b.cl = right_id
             join j on j.id = left_id),
      pos as (select id, id as tree, 0::bigint as pos from j where id not in (select right_id from mg)
              union all select m.right_id, p.tree, p.pos + m.off from pos p join mg m on m.left_id = p.id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "group_sizes": f"with {_J} select {_G}, count(*) as n from j group by all",
        "top_groups": f"""with {_J} select {_G}, count(*) as n from j group by all
            order by n desc, {_G} limit 10""",
        "collect_group_columns": f"""with {_J}, o as (select *, (row_number() over
              (partition by {_G} order by id) - 1) // 10 as part from j)
            select {_G}, part::bigint as part, string_agg(id::varchar, ',' order by id) as ids,
                   string_agg(seq, ',' order by id) as junc_seqs from o group by all""",
        "collect_groups": f"""with {_J}, o as (select *, (row_number() over
              (partition by {_G} order by id) - 1) // 10 as part from j)
            select {_G}, part::bigint as part, count(*) as records,
                   string_agg(id::varchar || ':' || seq, ';' order by id) as seq_list
            from o group by all""",
        "parse_records": f"""with {_J} select id, j_call as label, seq, length(seq)::bigint as n,
            id as number, seq = j_call as same from j""",
        "json_roundtrip": f"""with {_J} select '{{"id":' || id || ',"label":"' || j_call
            || '","seq":"' || seq || '"}}' as js, id, j_call as label, seq from j""",
        "distances_to_first": f"""with {_J}, f as (select {_G}, min(id) as first_id from j group by all)
            select j.id, first_id, {_dist('hamming', 'j.seq', 'x.seq')} as hamming,
                   {_dist('edit', 'j.seq', 'x.seq')} as edit
            from j join f using ({_G}) join j x on x.id = first_id""",
        "edit_to_first": f"""with {_P}, f as (select p_brand, min(id) as first_id from j group by all)
            select j.id, first_id, {_dist('edit', 'j.seq', 'x.seq')} as dist
            from j join f using (p_brand) join j x on x.id = first_id""",
        "near_pairs_block": _sql_pairs("hamming", WIDE),
        "near_pairs_pivot": _sql_pairs("hamming", WIDE),
        "near_pairs_segment": _sql_pairs("edit", 3.0),
        "near_pairs_edit_pivot": _sql_pairs("edit", 3.0),
        "nearest_hamming": _sql_nearest("hamming", 1),
        "nearest_edit": _sql_nearest("edit", 2),
        "single_linkage": _sql_single("hamming", WIDE),
        "single_linkage_edit": _sql_single("edit", 3.0),
        "cluster_counts": _sql_single(
            "hamming", WIDE,
            f"select {_G}, count(distinct cluster_id) as clusters, count(*) as records from sl group by all",
        ),
        "cluster_sizes": _sql_single(
            "hamming", WIDE, f"select {_G}, cluster_id, count(*) as size from sl group by all"
        ),
        "dense_labels": _sql_single(
            "hamming", WIDE,
            f"select id, dense_rank() over (order by {_G}, cluster_id) - 1 as label from sl",
        ),
        "threshold_sweep": _sql_sweep((0.03, 0.06, 0.12, 0.17)),
        "condense_sweep": _sql_condense_sweep((0.03, 0.06, 0.12, 0.15), 0.06),
        "mst_weights": _sql_forest(0.25),
        "leader_clusters": _sql_leader("hamming", WIDE),
        "leader_clusters_edit": _sql_leader("edit", 3.0),
        "cluster_radius": _sql_leader(
            "hamming", WIDE,
            f"""select {_G}, cluster_id, max({_dist('hamming', 'ld.seq', 'x.seq')}) as radius,
                count(*) as size from ld join (select id as cid, seq from j) x on x.cid = cluster_id
                group by all""",
        ),
        "condense": f"with recursive {_J}, {_CONDENSED} select {_G}, id, cluster_id from cond",
        "condense_summaries": _sql_leader(
            "edit", 3.0,
            f"""select p_brand, cluster_id as center_id, count(*) as weight,
                max({_dist('edit', 'ld.seq', 'x.seq')}) as radius
                from ld join (select id as cid, seq from j) x on x.cid = cluster_id group by all""",
        ),
        "two_stage": f"with recursive {_J}, {_TWO} select {_G}, id, cluster_id from two",
        "route_by_segment": f"""with recursive {_J}, {_ALL}, {_TWO}
            select {_G}, id, cluster_id from ld where j_call = 'BUILDING'
            union all select {_G}, id, cluster_id from two where j_call = 'MACHINERY'
            union all select {_G}, id, cluster_id from sl where j_call not in ('BUILDING', 'MACHINERY')""",
        "cluster_groups": _sql_single("hamming", WIDE),
        "cluster_groups_mst": _sql_single("hamming", WIDE),
        "cluster_groups_two_stage": f"with recursive {_J}, {_TWO} select {_G}, id, cluster_id from two",
        "tree_cut": _sql_single("hamming", WIDE),
        # Two keys of 10 digits are closer than 0.2 if they differ in one place only: then they agree
        # on the other nine.
        "single_linkage_dense": """with recursive j as (select o_orderkey::bigint as id, lpad(o_orderkey::varchar, 10, '0') as seq from orders),
            b as (select id, i, seq[:i - 1] || '_' || seq[i + 1:] as k from j, range(1, 11) t(i)),
            f as (select k, min(id) as head from b group by k),
            e as (select distinct b.id as src, head as dst from b join f using (k) where head <> id),
            u as (select src, dst from e union select dst, src from e),
            lab as (select 0 as it, id, id as c, true as moved from j union all (
              with cur as (select id, c from lab where it < 200 and moved),
              n as (select u.src as id, min(cur.c) as c from u join cur on cur.id = u.dst group by 1),
              nx as (select cur.id, least(cur.c, coalesce(n.c, cur.c)) as c, cur.c as old from cur left join n using (id))
              select (select max(it) from lab) + 1, id, c, (select bool_or(c <> old) from nx) from nx))
            select 0 as g, id, c as cluster_id from lab where it = (select max(it) from lab)""",
        "agglomerate_average": _sql_similar(0.5),
        "similar_to_ten": _sql_similar(None, 10),
        "summary_levels": _sql_levels(LEVELS),
        "dendrogram": f"""with recursive {_tree_cte('hamming', 0.25)}
            select {_G}, step as node, left_id, right_id,
              (select max(x.step) from mg x where x.left_id = mg.left_id and x.it < mg.it) as left_node,
              (select max(x.step) from mg x where x.left_id = mg.right_id) as right_node,
              round(h, 9) as height, size, tree, pos as lo, pos + size - 1 as hi
            from mg join pos on pos.id = left_id""",
        "node_leaves": f"""with recursive {_tree_cte('edit', 4.0)}
            select p_brand, step as node, count(*) as records, sum(st.id)::bigint as ids, min(st.id) as first_id
            from mg join st on st.it = mg.it and st.cl = mg.left_id group by all""",
        "sweep_labels_average": _sql_linkage("sum(m)::double / (18 * count(*))", LABEL_CUTS[-1], cuts=LABEL_CUTS),
        "sweep_labels_complete": _sql_linkage("max(m)::double / 18", LABEL_CUTS[-1], cuts=LABEL_CUTS),
        "linkage_average_edit": _sql_linkage("sum(m)::double / count(*)", 3.0, metric="edit"),
        "distance_table": f"""with {_P}, u as (select p_brand, seq, min(id) as id, count(*) as copies from j group by all)
            select p_brand, a.id as src, b.id as dst, {_dist('edit', 'a.seq', 'b.seq')} as dist,
              a.copies as src_copies, b.copies as dst_copies from u a join u b using (p_brand) where a.id <> b.id""",
        "annotated_file": """select c_nationkey::varchar as "V_CALL", c_mktsegment as "J_CALL", length(c_name)::integer as "JUNCTION_LENGTH",
            c_custkey::bigint as id, 's' || c_custkey as label, c_name as seq from customer""",
        "grouped_file": """select c_nationkey::integer as gid, c_custkey::bigint as id, c_mktsegment as label, c_name as seq
            from customer""",
        "fasta_file": """select row_number() over (order by c_custkey) - 1 as id, c_mktsegment as label, c_name as seq
            from customer""",
        "cluster_files": _sql_single(
            "hamming", WIDE,
            f"""select {_G}, ((row_number() over (partition by {_G} order by cluster_id, id) - 1) // 10)::bigint as part,
                cluster_id as center, max(d) over (partition by cluster_id) as radius,
                count(*) over (partition by cluster_id) as size, id, seq
                from (select sl.*, j.seq, {_dist('hamming', 'j.seq', 'x.seq')} as d
                      from sl join j using ({_G}, id) join j x on x.id = cluster_id)""",
        ),
        "label_files": f"""with recursive {_J}, {_ALL},
            m as (select 'mst' as method, {_G}, id, cluster_id from sl
                  union all select 'leader', {_G}, id, cluster_id from ld)
            select method, {_G}, row_number() over (partition by method, {_G} order by id) - 1 as line,
              dense_rank() over (partition by method, {_G} order by cluster_id) - 1 as label from m""",
        "condense_records": _sql_leader("hamming", WIDE),
        "sequence_members": f"""with {_P} select p_brand, id, min(id) over (partition by p_brand, seq) as seq_id from j""",
        "parse_grouped": """select c_nationkey::integer as gid, c_custkey::bigint as id, c_mktsegment as label, c_name as seq
            from customer""",
        "parse_fasta": """select row_number() over (order by c_custkey) - 1 as id, c_mktsegment as label, c_name as seq
            from customer""",
        "linkage_complete": _sql_linkage("max(m)::double / 18", WIDE),
        "linkage_average": _sql_linkage("sum(m)::double / (18 * count(*))", WIDE),
        "average_to_ten": _sql_linkage("sum(m)::double / (18 * count(*))", None, 10),
        "compare_methods": f"""with recursive {_J}, {_N}, {_ALL}, {_TWO}, {_CONDENSED},
            top as (select {_G} from n order by n desc, {_G} limit 10),
            m as (select {_G}, 'mst' as method, id, cluster_id from sl
                  union all select {_G}, 'leader', id, cluster_id from ld
                  union all select {_G}, 'condense', id, cluster_id from cond
                  union all select {_G}, 'two_stage', id, cluster_id from two)
            select method, {_G}, count(distinct cluster_id) as clusters, count(*) as records
            from m join top using ({_G}) group by all""",
    } | LLM_SQL
