"""kinset: families of near-identical sequences, as PySpark DataFrame jobs."""

from kinset.functions.distance import (
    distance,
    edit_dist,
    hamming_count,
    hamming_norm,
    same_sequence,
    sequence_length,
)
from kinset.functions.records import (
    from_json_records,
    parse_record,
    to_json_records,
    with_record,
)
from kinset.operators.components import components, single_linkage
from kinset.operators.condense import condense, summaries, summary_levels, two_stage
from kinset.operators.dendrogram import (
    dendrogram,
    labels_at,
    leaf_order,
    leaves,
    node_leaves,
    sweep_members,
    tree_merges,
)
from kinset.operators.groups import (
    collect_group_columns,
    collect_groups,
    group_sizes,
    top_groups,
    with_ordinal,
)
from kinset.operators.labels import (
    cluster_counts,
    cluster_radius,
    cluster_sizes,
    dense_labels,
    labels,
)
from kinset.operators.leader import leader_clusters
from kinset.operators.linkage import agglomerate, cut_merges, linkage_clusters, linkage_merges
from kinset.operators.mst import cut, mst_edges
from kinset.operators.near import distance_pairs, expand_copies, near_pairs, nearest, sequence_members
from kinset.plans.jobs import (
    cluster_groups,
    compare_methods,
    route_groups,
    threshold_sweep,
)
from kinset.plans.session import build_session, shared_path
from kinset.sources.readers import (
    as_sequences,
    parse_fasta,
    parse_grouped,
    read_annotated,
    read_fasta,
    read_grouped,
    split_rejects,
)
from kinset.sources.writers import (
    cluster_lists,
    group_labels,
    read_cluster_lists,
    read_group_labels,
    write_cluster_lists,
    write_clusters,
    write_group_labels,
    write_labels,
)

__all__ = [name for name in dir() if not name.startswith("_")]
