"""Plain computation of trees, cuts, groups and names, to hold the library's jobs against."""

import numpy as np


def ward_tree(vectors: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of Ward's linkage by chains of nearest neighbours."""
    n = len(vectors)
    centres = {i: (vectors[i].astype(float), 1) for i in range(n)}
    merges, chain = [], []
    label = n
    while len(centres) > 1:
        if not chain:
            chain = [min(centres)]
        a = chain[-1]
        ca, na = centres[a]
        best, near = np.inf, -1
        for b, (cb, nb) in centres.items():
            if b != a:
                d = na * nb / (na + nb) * float(((ca - cb) ** 2).sum())
                if d < best or (d == best and len(chain) > 1 and b == chain[-2]):
                    best, near = d, b
        if len(chain) > 1 and near == chain[-2]:
            chain = chain[:-2]
            cb, nb = centres[near]
            del centres[a], centres[near]
            centres[label] = ((na * ca + nb * cb) / (na + nb), na + nb)
            merges.append((min(a, near), max(a, near), float(np.sqrt(2 * best)), na + nb))
            label += 1
        else:
            chain.append(near)
    return merges


def cut_tree(merges: list[tuple[int, int, float, int]], n: int, k: int) -> list[int]:
    """Clade of each leaf when the tree is cut into k: the n - k lowest merges hold."""
    parent = list(range(n + len(merges)))
    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    for i in order[: max(0, n - k)]:
        for child in merges[i][:2]:
            parent[child] = n + i

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    names: dict[int, int] = {}
    return [names.setdefault(root(i), len(names)) for i in range(n)]


def average_linkage(centres: np.ndarray, threshold: float) -> list[int]:
    """Group of each centre: the two groups with the least mean distance merge while it is below the threshold."""
    groups = [[i] for i in range(len(centres))]
    d = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    while len(groups) > 1:
        best, at = np.inf, (0, 1)
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                m = d[np.ix_(groups[i], groups[j])].mean()
                if m < best:
                    best, at = m, (i, j)
        if best > threshold:
            break
        groups[at[0]] += groups.pop(at[1])
    out = [0] * len(centres)
    for k, g in enumerate(groups):
        for i in g:
            out[i] = k
    return out


def unique_names(wanted: list[tuple[float, list[str]]]) -> list[str | None]:
    """Names from each one's list of wishes, the largest first, none given twice."""
    taken: set[str] = set()
    out: list[str | None] = [None] * len(wanted)
    for i in sorted(range(len(wanted)), key=lambda k: -wanted[k][0]):
        out[i] = next((w for w in wanted[i][1] if w not in taken), None)
        taken.add(out[i])
    return out
