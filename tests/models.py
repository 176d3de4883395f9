"""Plain-Python definitions the operators are checked against."""

import itertools
import random
from collections import defaultdict


def hamming(a, b):
    if len(a) != len(b):
        raise ValueError
    return sum(x != y for x, y in zip(a, b)) / len(a) if a else float("nan")


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return float(row[-1])


DIST = {"hamming": hamming, "edit": edit}


def by_group(rows):
    groups = defaultdict(list)
    for g, i, s in rows:
        groups[g].append((i, s))
    return groups


def distinct(rows):
    """(group, seq) -> (smallest id, copies)."""
    seen = {}
    for g, i, s in rows:
        low, n = seen.get((g, s), (i, 0))
        seen[g, s] = (min(low, i), n + 1)
    return seen


def pairs(rows, metric):
    """Pairs of distinct sequences: (group, src, dst) -> dist."""
    out = {}
    for g, items in by_group([(g, i, s) for (g, s), (i, _) in distinct(rows).items()]).items():
        for (i, s), (j, t) in itertools.combinations(sorted(items), 2):
            out[g, i, j] = DIST[metric](s, t)
    return out


def leader(rows, metric, thres):
    out = {}
    for items in by_group(rows).values():
        leaders = []
        for i, s in sorted(items):
            for j, t in leaders:
                if DIST[metric](s, t) < thres:
                    out[i] = j
                    break
            else:
                leaders.append((i, s))
                out[i] = i
    return out


def components(ids, edges):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def record_edges(rows, metric):
    for items in by_group(rows).values():
        for (i, s), (j, t) in itertools.combinations(sorted(items), 2):
            yield DIST[metric](s, t), i, j


def single(rows, metric, thres):
    close = [(i, j) for d, i, j in record_edges(rows, metric) if d < thres]
    return components([i for _, i, _ in rows], close)


def kruskal(rows, metric, thres=None):
    root = {i: i for _, i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    out = []
    for d, i, j in sorted(record_edges(rows, metric)):
        if (thres is None or d < thres) and find(i) != find(j):
            root[find(i)] = find(j)
            out.append((i, j, round(d, 9)))
    return sorted(out)


def greedy_merges(items, dist, linkage, weights=None, thres=None):
    """One closest pair at a time, for ``items`` ids with ``dist[i, j]``, i < j."""
    weights = weights or {i: 1 for i in items}
    clusters = {i: [i] for i in items}
    merges = []

    def between(a, b):
        every = [
            (dist[min(x, y), max(x, y)], weights[x] * weights[y])
            for x in clusters[a]
            for y in clusters[b]
        ]
        if linkage == "complete":
            return max(d for d, _ in every)
        if linkage == "single":
            return min(d for d, _ in every)
        return sum(d * w for d, w in every) / sum(w for _, w in every)

    while len(clusters) > 1:
        h, a, b = min(
            (round(between(a, b), 12), a, b) for a, b in itertools.combinations(sorted(clusters), 2)
        )
        if thres is not None and h >= thres:
            break
        clusters[a] += clusters.pop(b)
        merges.append((a, b, h))
    return merges


def mutual_rounds(items, dist, linkage, weights=None, thres=None):
    """The same by rounds of mutual first choices under (height, a, b)."""
    weights = weights or {i: 1 for i in items}
    clusters = {i: [i] for i in items}
    merges = []

    def between(a, b):
        every = [
            (dist[min(x, y), max(x, y)], weights[x] * weights[y])
            for x in clusters[a]
            for y in clusters[b]
        ]
        if linkage == "complete":
            return max(d for d, _ in every)
        return sum(d * w for d, w in every) / sum(w for _, w in every)

    while len(clusters) > 1:
        scored = [
            (round(between(a, b), 12), a, b) for a, b in itertools.combinations(sorted(clusters), 2)
        ]
        scored = [e for e in scored if thres is None or e[0] < thres]
        if not scored:
            break
        first = {}
        for e in sorted(scored, reverse=True):
            first[e[1]] = first[e[2]] = e
        chosen = [e for e in set(first.values()) if first[e[1]] == e == first[e[2]]]
        for h, a, b in sorted(chosen):
            clusters[a] += clusters.pop(b)
            merges.append((a, b, h))
    return merges


def random_rows(seed, n=40, groups=3, length=8, alphabet="ACG", spread=None, copies=True):
    """Rows (group, id, seq); ``spread`` varies the length. A third of the rows
    of the first group are near one sequence."""
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(10 * n), n):
        g = rng.randrange(groups)
        size = length + (rng.randrange(spread + 1) if spread else 0)
        if g == 0 and rng.random() < 0.6:
            base = list("A" * size)
            for _ in range(rng.randrange(3)):
                base[rng.randrange(size)] = rng.choice(alphabet)
            seq = "".join(base)
        else:
            seq = "".join(rng.choice(alphabet) for _ in range(size))
        if copies and rows and rng.random() < 0.15:
            g, _, seq = rng.choice(rows)
        rows.append((g, i, seq))
    return rows
