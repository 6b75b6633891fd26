"""Relationships as joins, and their normal form."""

from __future__ import annotations

from functools import reduce
from operator import and_, eq, ge, gt, le, lt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import between_join
from ..sources.dictionary import Relationship, parse_join

_COMPARE = {"=": eq, "<": lt, "<=": le, ">": gt, ">=": ge}


def join_tables(text: str, frames: dict[str, DataFrame], aliases: dict[str, str] | None = None, how: str = "inner") -> DataFrame:
    """The join that a relationship describes; columns are reached by ``name.column``.

    The conjunction stays declarative: equalities become the join's keys, the
    rest its residual condition. An inner join without an equality, in which a
    column of one side lies between two of the other, is joined by ranges of
    that column's own type (:mod:`pactum.operators.ranges`), since Spark would
    compare all pairs.
    """
    pairs, aliases = parse_join(text), aliases or {}
    names = list(dict.fromkeys(n for a, _, b in pairs for n in (a[0], b[0])))
    if len(names) != 2:
        raise ValueError("a join is between two names")
    left, right = (frames[aliases.get(n, n)].alias(n) for n in names)
    column = lambda side: F.col(f"`{side[0]}`.`{side[1]}`")
    if how == "inner" and all(op != "=" for _, op, _ in pairs):
        found = between(pairs)
        if found is not None:
            point, low, high = found
            one, two = (left, right) if point[0] == names[0] else (right, left)
            return between_join(one, column(point), two, column(low), column(high), [_COMPARE[op](column(a), column(b)) for a, op, b in pairs])
    return left.join(right, reduce(and_, [_COMPARE[op](column(a), column(b)) for a, op, b in pairs]), how)


def between(pairs: list) -> tuple | None:
    """The column that has a lower and an upper bound on the other side, and these bounds; None if there is none."""
    lower: dict = {}
    upper: dict = {}
    for a, op, b in pairs:
        for x, y, below in ((a, b, op in (">", ">=")), (b, a, op in ("<", "<="))):
            (lower if below else upper).setdefault(x, y)
    return next(((x, lower[x], upper[x]) for x in lower if x in upper), None)


def normalized(r: Relationship) -> dict:
    """Pairs with the many side on the left."""
    swap = r.cardinality == "one-to-many"
    ref = lambda side: {"table": side[0], "column": side[1]}
    first = r.resolved()[0][0] if r.pairs else None
    anchor = r.pairs[0][0][0] if r.pairs else None
    pairs = []
    for (a, _, b), (x, _, y) in zip(r.resolved(), r.pairs, strict=True):
        if x[0] != anchor and y[0] == anchor:  # all pairs read in the first one's direction
            a, b = b, a
        pairs.append({"left": ref(b), "right": ref(a)} if swap else {"left": ref(a), "right": ref(b)})
    out = {"cardinality": "many-to-one" if swap else r.cardinality, "declared_cardinality": r.cardinality, "pairs": pairs, "join": r.join}
    if first is not None and r.aliases:
        out["aliases"] = [{"name": k, "table": v} for k, v in r.aliases.items()]
    if r.conflicts:
        out["conflicts"] = list(r.conflicts)
    return out
