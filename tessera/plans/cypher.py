"""A read-only subset of Cypher over the node and edge frames: one node or one hop, WHERE, RETURN, ORDER BY, SKIP, LIMIT.

    MATCH (a:class)-[r:CALLS|REFERENCES]->(b) WHERE a.repo = $repo AND b.kind <> 'file' RETURN a.id, count(b) AS n ORDER BY n DESC LIMIT 10
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUERY = re.compile(r"^\s*MATCH\s+(?P<match>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<ret>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+SKIP\s+(?P<skip>\d+))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$", re.I | re.S)
_NODE = r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*\)"
_HOP = re.compile(rf"^{_NODE}\s*(<)?-\[\s*(\w+)?\s*(?::\s*([\w|]+))?\s*\]-(>)?\s*{_NODE}$")
_ONE = re.compile(rf"^{_NODE}$")
MAX_ROWS = 1000


def cypher(nodes: DataFrame, edges: DataFrame, text: str, params: dict | None = None, limit: int = MAX_ROWS) -> DataFrame:
    """Runs a query of the subset; anything else raises ValueError. Values are given as literals or as $parameters, which are never pasted unquoted."""
    m = _QUERY.match(text)
    if not m:
        raise ValueError("only MATCH ... [WHERE] RETURN [ORDER BY] [SKIP] [LIMIT] is known")
    frame, names = _match(nodes, edges, m["match"].strip())
    value = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def expression(part: str) -> str:
        pieces = re.split(r"('(?:[^'\\]|\\.)*')", part)
        for i in range(0, len(pieces), 2):
            p = re.sub(r"\$(\w+)", lambda x: "(" + ", ".join(map(value, v)) + ")" if isinstance(v := (params or {})[x[1]], list | tuple) else value(v), pieces[i])
            p = re.sub(r"\b(\w+)\.(\w+)\b", lambda x: f"{x[1]}.`{x[2]}`" if x[1] in names else x[0], p)
            pieces[i] = re.sub(r"\bcount\s*\(\s*(\w+)\s*\)", lambda x: "count(*)" if x[1] in names else x[0], p, flags=re.I)
        return "".join(pieces)

    if m["where"]:
        frame = frame.where(F.expr(expression(m["where"])))
    items = []
    for raw in re.split(r",(?![^()]*\))", m["ret"]):
        body, _, alias = re.match(r"(?is)^\s*(.+?)(\s+AS\s+(\w+))?\s*$", raw).groups()
        items.append((expression(body), alias or body.strip(), bool(re.match(r"(?i)(count|min|max|sum|avg)\s*\(", body.strip()))))
    if any(agg for *_, agg in items):
        keys = [F.expr(e).alias(a) for e, a, agg in items if not agg]
        frame = frame.groupBy(*keys).agg(*[F.expr(e).alias(a) for e, a, agg in items if agg]).select(*[f"`{a}`" for _, a, _ in items])
    else:
        frame = frame.select(*[F.expr(e).alias(a) for e, a, _ in items])
    frame = frame.distinct() if m["distinct"] else frame
    if m["order"]:
        by = [re.match(r"(?is)^\s*(.+?)(?:\s+(ASC|DESC))?\s*$", o).groups() for o in m["order"].split(",")]
        frame = frame.orderBy(*[F.col(f"`{c.strip()}`").desc() if (d or "").upper() == "DESC" else F.col(f"`{c.strip()}`") for c, d in by])
    frame = frame.offset(int(m["skip"])) if m["skip"] else frame
    return frame.limit(min(limit, MAX_ROWS, int(m["limit"]) if m["limit"] else MAX_ROWS))


def _match(nodes: DataFrame, edges: DataFrame, pattern: str) -> tuple[DataFrame, set[str]]:
    of = lambda kind: nodes if not kind or kind == "Symbol" else nodes.where(F.col("kind") == kind)
    packed = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    if m := _ONE.match(pattern):
        name = m[1] or "_a"
        return packed(of(m[2]), name), {name}
    if not (m := _HOP.match(pattern)):
        raise ValueError(f"pattern not known: {pattern}")
    a, ak, back, r, kinds, forth, b, bk = m.groups()
    if bool(back) == bool(forth):
        raise ValueError("a hop needs one direction")
    a, b, r = a or "_a", b or "_b", r or "_r"
    e = packed(edges.where(F.col("kind").isin(*kinds.split("|"))) if kinds else edges, r)
    near, far = (f"{r}.dst_id", f"{r}.src_id") if back else (f"{r}.src_id", f"{r}.dst_id")
    return e.join(packed(of(ak), a), F.col(near) == F.col(f"{a}.id")).join(packed(of(bk), b), F.col(far) == F.col(f"{b}.id")), {a, b, r}
