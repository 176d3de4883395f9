"""Sizes at which an operator switches to its way for large inputs.

They steer cost only: on both sides of each of them the result is the same.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Limits:
    # Distinct sequences that may meet under one join key before it is refined.
    bucket_rows: int = 2_000
    # Masks that hide the places of mismatches, up to which they are used as keys.
    masks: int = 64
    # Candidate pairs per row before dense regions are condensed first.
    pairs_per_row: int = 1_000
    # Candidate pairs per row before a spanning tree is built from smaller radii first.
    edges_per_row: int = 50
    # Rows below which a join is left to Spark's own skew handling.
    plain_join_rows: int = 2_000_000
    # Edges of a tree, and cells of a distance matrix, that one task works on as a whole.
    tree_edges: int = 20_000
    matrix_cells: int = 1_000_000
    # Cells of a distance matrix that one task fills from packed pairs, and pairs that are packed together.
    dense_cells: int = 64_000_000
    packed_pairs: int = 2_000_000
    # Fewest pairs of one group, side by side, that are packed.
    packed_least: int = 2_000
    # Sequences, and letter counts, of a piece that one task merges without a matrix.
    profile_rows: int = 50_000
    profile_cells: int = 16_000_000
    # Close pairs of a piece that one task merges without a matrix.
    piece_edges: int = 2_000_000
    # Sequences of a component whose distances are all measured, without bounds.
    measured_whole: int = 200
    # Rows above which a table is not broadcast, whatever the size of its files.
    broadcast_rows: int = 100_000
    # A key is hot above 1/hot_share of the rows, so at most hot_share are.
    hot_share: int = 1_000


LIMITS = Limits()
