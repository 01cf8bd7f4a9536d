"""Trees within slices of sorted rows: what can be folded without the rows of other slices.

Rows (id, up, ...) come sorted by id, a slice of some thousands at a time.  Where
parents have ids near those of their children, as in documents, a slice holds
most of its nodes' paths, and little is left for joins; where they have not,
rows pass as they are.  Rings stay as they are, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a slice.
ROWS = 1 << 17

_BOTH = {"sum": lambda a, b: a + b, "all": lambda a, b: a and b, "min": min, "max": max, "xor": lambda a, b: a ^ b}
_INDEXED = {"nearest", "topmost", "last"}


def _both(kind: str):
    """Two values as one, where a null is nothing."""
    both = _BOTH[kind]
    return lambda a, b: b if a is None else a if b is None else both(a, b)


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, pa.Array]]:
    def whole():
        table = pa.Table.from_batches(held).combine_chunks()
        return {name: table.column(name).chunk(0) for name in table.column_names}

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield whole()
            held, n = [], 0
    if n:
        yield whole()


def _parents(columns: dict[str, pa.Array]) -> list[int]:
    """The row of each row's parent, -1 where it has none in this slice."""
    keys = lambda c: zip(*[f.to_pylist() for f in c.flatten()])
    at = {k: i for i, k in enumerate(keys(columns["id"]))}
    return [at.get(k, -1) if known else -1 for k, known in zip(keys(columns["up"]), columns["up"].is_valid().to_pylist())]


def climbed(batches: Iterator[pa.RecordBatch], carried: dict[str, str], rows: int) -> Iterator[pa.RecordBatch]:
    """(id, up, *carried): each row with the parent that its path leaves the slice by, and what it carries up to there."""
    for columns in _slices(batches, rows):
        up = _parents(columns)
        under: list[list[int]] = [[] for _ in up]
        for i, p in enumerate(up):
            if p >= 0:
                under[p].append(i)
        order = [i for i, p in enumerate(up) if p < 0]
        for i in order:  # grows: parents before children, nothing of rings
            order.extend(under[i])
        last = list(range(len(up)))
        for i in order:
            if up[i] >= 0:
                last[i] = last[up[i]]
        out = {"id": columns["id"], "up": columns["up"].take(pa.array(last))}
        for name, kind in carried.items():
            if kind in _INDEXED:
                known, pick = columns[name].is_valid().to_pylist(), list(range(len(up)))
                for i in order:
                    if up[i] >= 0:
                        above = pick[up[i]]
                        pick[i] = above if kind == "last" or (known[above] if kind == "topmost" else not known[i]) else i
                out[name] = columns[name].take(pa.array(pick))
            else:
                both, values = _both(kind), columns[name].to_pylist()
                for i in order:
                    if up[i] >= 0:
                        values[i] = both(values[i], values[up[i]])
                out[name] = pa.array(values, columns[name].type)
        yield pa.RecordBatch.from_pydict(out)


def folded(batches: Iterator[pa.RecordBatch], kinds: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, up, kids, v0, ...) folded upwards, as (part, id, up, kids, v0, ..., e0, ...).

    ``kids`` counts children in all slices.  Parts: ``done``, nodes with all
    below them in the slice, and their values; ``told``, what such a node adds
    to a parent elsewhere; ``alive``, nodes that wait for children elsewhere or
    for several here, ``up`` being the next such node and ``e`` the values of those between;
    ``chain``, the nodes between, ``up`` being the next one below that waits,
    and their values down to it.
    """
    boths = [_both(k) for k in kinds]
    for columns in _slices(batches, rows):
        up, left = _parents(columns), columns["kids"].to_pylist()
        values = [columns[f"v{i}"].to_pylist() for i in range(len(kinds))]
        done = [i for i, n in enumerate(left) if not n]
        for i in done:  # grows
            p = up[i]
            if p >= 0:
                for x, both in zip(values, boths):
                    x[p] = both(x[p], x[i])
                left[p] -= 1
                if not left[p]:
                    done.append(p)
        waits = [i for i, n in enumerate(left) if n]
        here = {up[i] for i in waits}
        single = {i for i in waits if left[i] == 1 and i in here}
        ends, edges, chain, below, sums = [], [], [], [], []
        for b in waits:
            if b in single:
                continue
            top, between, p = b, [None] * len(kinds), up[b]
            while p in single:
                between = [both(a, x[p]) for both, a, x in zip(boths, between, values)]
                chain.append(p)
                below.append(b)
                sums.append(between)
                top, p = p, up[p]
            ends.append((b, top))
            edges.append(between)
        ringed = single.difference(chain)
        ends += [(i, i) for i in ringed]
        edges += [[None] * len(kinds) for _ in ringed]
        elsewhere = columns["up"].is_valid().to_pylist()
        told = [i for i in done if up[i] < 0 and elsewhere[i]]
        alive = [i for i, _ in ends]

        def batch(part, ids, ups, kids, vs, es):
            n = len(kids)
            out = {"part": pa.array([part] * n, pa.string()), "id": ids, "up": ups, "kids": pa.array(kids, pa.int64())}
            for name, lists in (("v", vs), ("e", es)):
                for k in range(len(kinds)):
                    kind = columns[f"v{k}"].type  # noqa: B023
                    out[f"{name}{k}"] = pa.array([x[k] for x in lists], kind) if lists is not None else pa.nulls(n, kind)
            return pa.RecordBatch.from_pydict(out)

        take = lambda c, places: columns[c].take(pa.array(places, pa.int64()))  # noqa: B023, E731
        of = lambda places: [[x[i] for x in values] for i in places]  # noqa: B023, E731
        nobody = [None] * len(done)
        yield batch("done", take("id", done), take("up", nobody), [0] * len(done), of(done), None)
        yield batch("told", take("up", told), take("up", nobody[: len(told)]), [-1] * len(told), of(told), None)
        yield batch("alive", take("id", alive), take("up", [i for _, i in ends]), [left[i] for i in alive], of(alive), edges)
        yield batch("chain", take("id", chain), take("id", below), [0] * len(chain), sums, None)
