"""The driver's tables seen as a property graph, an event log and a token table.

The same definitions, as DataFrames and as a prefix of common table expressions for SQL.

Nodes: regions and nations are namespaces, brands classes, part types type aliases, customers and suppliers functions,
orders methods, parts fields. A node's repo is its region, a part's its brand's first seven characters.
Edges: CONTAINS down the geography, CALLS customer to order, REFERENCES order to part (count: lines), CONSTRUCTS supplier
to part, EXTENDS part to brand, TYPE_OF part to type, READS_FIELD, WRITES_FIELD and RAISES supplier to part by return flag A, N, R.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dealing import dealt, tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, col: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(col).cast("string"))


def _node(df: DataFrame, prefix: str, key: str, kind: str, repo, name: str, ast=None) -> DataFrame:
    s = F.lit(None).cast("string")
    return df.select(
        _id(prefix, key).alias("id"), F.lit(kind).alias("kind"), repo.alias("repo"), F.concat(repo, F.lit("::"), F.col(name).cast("string")).alias("qualified_name"),
        F.col(name).cast("string").alias("short_name"), F.concat(repo, F.lit("/"), F.lit(kind)).alias("file"), (ast if ast is not None else s).alias("ast_hash"),
    )


def nodes(spark: SparkSession, d: str, prefixes: str = "RNCUOPBT") -> DataFrame:
    """prefixes: the kinds of nodes that are wanted; the tables of the others aren't read."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    part = table(spark, d, "part")
    customer = table(spark, d, "customer").join(F.broadcast(home), F.col("c_nationkey") == F.col("n_nationkey"))  # nations: 25 rows
    supplier = table(spark, d, "supplier").join(F.broadcast(home), F.col("s_nationkey") == F.col("n_nationkey"))
    orders = table(spark, d, "orders").join(customer.select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    brand, own = F.substring("p_brand", 1, 7), F.col("r_name")
    order_hash = F.md5(F.concat(F.col("o_orderstatus"), F.lit("|"), F.col("o_orderpriority")).cast("binary"))
    parts = [
        _node(region, "R", "r_regionkey", "namespace", own, "r_name"),
        _node(home, "N", "n_nationkey", "namespace", own, "n_name"),
        _node(customer, "C", "c_custkey", "function", own, "c_name"),
        _node(supplier, "U", "s_suppkey", "function", own, "s_name"),
        _node(orders, "O", "o_orderkey", "method", own, "o_orderkey", order_hash),
        _node(part, "P", "p_partkey", "field", brand, "p_partkey"),
        _node(part.select("p_brand").distinct(), "B", "p_brand", "class", brand, "p_brand"),
        _node(part.select("p_type").distinct(), "T", "p_type", "type_alias", F.lit("TYPES"), "p_type"),
    ]
    wanted = [p for letter, p in zip("RNCUOPBT", parts, strict=True) if letter in prefixes]
    out = wanted[0]
    for p in wanted[1:]:
        out = out.unionByName(p)
    return out


#: The kinds of nodes at the two ends of edges.
ENDS = ("RN", "NC", "NU", "CO", "OP", "UP", "PB", "PT")


def beside(node: str) -> str:
    """Kinds of nodes that can be next to this one, and its own."""
    return "".join(sorted({k for pair in ENDS if node[0] in pair for k in pair}))


#: The kinds of edges.
KINDS = ("CALLS", "CONSTRUCTS", "CONTAINS", "EXTENDS", "RAISES", "READS_FIELD", "REFERENCES", "TYPE_OF", "WRITES_FIELD")


def edge_sets(spark: SparkSession, d: str) -> DataFrame:
    """src_id, dst_id, kinds, count: all edges between two nodes in one row; count is that of each of them."""
    return edges(spark, d, sets=True)


def edge_sets_at_dst(spark: SparkSession, d: str) -> DataFrame:
    """src_id, dst_id, kinds: edge_sets without count, where all rows with a dst_id are in one task. Lines are shuffled once, for both kinds of pairs that they make."""
    frames = {t: table(spark, d, t) for t in ("nation", "customer", "supplier", "orders", "lineitem", "part")}
    n = tasks(*frames.values(), frames["part"])

    def edge(t: str, a: str, ak: str, b: str, bk: str, kind: str) -> DataFrame:
        return frames[t].select(ak, bk).repartition(n, _id(b, bk)).select(_id(a, ak).alias("src_id"), _id(b, bk).alias("dst_id"), F.array(F.lit(kind)).alias("kinds"))

    bit = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    line = frames["lineitem"].select("l_orderkey", "l_suppkey", "l_partkey", bit.alias("bit")).repartition(n, _id("P", "l_partkey"))
    ends = F.array(F.struct(_id("O", "l_orderkey").alias("src_id"), F.lit(16).alias("bit")), F.struct(_id("U", "l_suppkey").alias("src_id"), (F.col("bit") + 8).alias("bit")))
    met = line.select(_id("P", "l_partkey").alias("dst_id"), F.inline(ends)).groupBy("src_id", "dst_id").agg(F.bit_or("bit").alias("bits"))
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(b) > 0, k) for b, k in ((8, "CONSTRUCTS"), (1, "READS_FIELD"), (2, "WRITES_FIELD"), (4, "RAISES"), (16, "REFERENCES"))]))
    out = met.select("src_id", "dst_id", kinds.alias("kinds"))
    for part in (
        edge("nation", "R", "n_regionkey", "N", "n_nationkey", "CONTAINS"),
        edge("customer", "N", "c_nationkey", "C", "c_custkey", "CONTAINS"),
        edge("supplier", "N", "s_nationkey", "U", "s_suppkey", "CONTAINS"),
        edge("orders", "C", "o_custkey", "O", "o_orderkey", "CALLS"),
        edge("part", "P", "p_partkey", "B", "p_brand", "EXTENDS"),
        edge("part", "P", "p_partkey", "T", "p_type", "TYPE_OF"),
    ):
        out = out.unionByName(part)
    return out


def edges(spark: SparkSession, d: str, touching: str | None = None, sets: bool = False) -> DataFrame:
    """touching: only edges with this node at an end; its key is compared in the tables before ids are made, so that the scans can skip what isn't wanted."""
    nation, part, line = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "lineitem")

    prefix, _, key = (touching or "").partition(":")

    def at_end(df: DataFrame, a: str, ak: str, b: str, bk: str) -> DataFrame:
        if touching is None:
            return df
        mine = [F.col(k) == (key if dict(df.dtypes)[k] == "string" else int(key)) for p, k in ((a, ak), (b, bk)) if p == prefix]
        return df.where(mine[0] if len(mine) == 1 else mine[0] | mine[1]) if mine else df.limit(0)

    def edge(df: DataFrame, a: str, ak: str, b: str, bk: str, kind, count=None) -> DataFrame:
        one = F.array(F.lit(kind)) if sets else F.lit(kind)
        return at_end(df, a, ak, b, bk).select(_id(a, ak).alias("src_id"), _id(b, bk).alias("dst_id"), (one if isinstance(kind, str) else kind).alias("kinds" if sets else "kind"), (count if count is not None else F.lit(None).cast("long")).alias("count"))

    def by(df: DataFrame, *keys: str):
        return (dealt(df, *keys) if touching is None else df).groupBy(*keys)  # nearly every line is its own group: what a task holds follows its lines

    # all kinds between a supplier and a part come from one aggregate: a bit for each
    bit = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    supplied = by(at_end(line, "U", "l_suppkey", "P", "l_partkey").select("l_suppkey", "l_partkey", "l_returnflag"), "l_suppkey", "l_partkey").agg(F.bit_or(bit).alias("bits"))
    kinds = F.array(F.lit("CONSTRUCTS"), *[F.when(F.col("bits").bitwiseAND(b) > 0, k) for b, k in ((1, "READS_FIELD"), (2, "WRITES_FIELD"), (4, "RAISES"))])
    kinds = F.array_compact(kinds)
    supplied = supplied.select("l_suppkey", "l_partkey", (kinds if sets else F.explode(kinds)).alias("kind"))
    parts = [
        edge(nation, "R", "n_regionkey", "N", "n_nationkey", "CONTAINS"),
        edge(table(spark, d, "customer"), "N", "c_nationkey", "C", "c_custkey", "CONTAINS"),
        edge(table(spark, d, "supplier"), "N", "s_nationkey", "U", "s_suppkey", "CONTAINS"),
        edge(table(spark, d, "orders"), "C", "o_custkey", "O", "o_orderkey", "CALLS", F.lit(1).cast("long")),
        edge(by(at_end(line, "O", "l_orderkey", "P", "l_partkey").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").agg(F.count("*").alias("n")), "O", "l_orderkey", "P", "l_partkey", "REFERENCES", F.col("n")),
        edge(supplied, "U", "l_suppkey", "P", "l_partkey", F.col("kind")),
        edge(part, "P", "p_partkey", "B", "p_brand", "EXTENDS"),
        edge(part, "P", "p_partkey", "T", "p_type", "TYPE_OF"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents: text, kind (by source), repo (language), symbol_id, position."""
    docs = table(spark, d, "documents")
    word = docs.select(F.concat(F.lit("D:"), F.col("doc_id").cast("string")).alias("symbol_id"), F.col("lang").alias("repo"), F.when(F.col("source") == "src0", "comment").otherwise("literal").alias("kind"), F.posexplode(F.split(F.lower("text"), "[^a-z]+", -1)).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    return word.where(F.col("text") != "")


def events(spark: SparkSession, d: str) -> DataFrame:
    """key, t, hlc, kind, value, status: signup resets, purchase adds, error subtracts; clicks mark done, the rest is pending."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "purchase", "increment").when(F.col("event_type") == "error", "decrement").otherwise("note")
    status = F.when(F.col("event_type") == "view", "pending").otherwise("done")
    hlc = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("physical"), F.col("event_id").alias("logical"), F.col("user_id").cast("string").alias("replica"))
    return e.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), hlc.alias("hlc"), kind.alias("kind"), F.round(F.col("value") * 100).cast("long").alias("value"), status.alias("status"), "event_id", "event_type")


#: The same as the frames above, for SQL: symbols g_nodes, g_edges, g_tokens, g_events. Goes after WITH RECURSIVE.
SQL = r"""
home AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, c_name, r_name FROM customer JOIN home ON c_nationkey = n_nationkey),
raw_nodes AS (
  SELECT 'R:' || r_regionkey AS id, 'namespace' AS kind, r_name AS repo, r_name AS short_name, NULL AS ast_hash FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'namespace', r_name, n_name, NULL FROM home
  UNION ALL SELECT 'C:' || c_custkey, 'function', r_name, c_name, NULL FROM cust
  UNION ALL SELECT 'U:' || s_suppkey, 'function', r_name, s_name, NULL FROM supplier JOIN home ON s_nationkey = n_nationkey
  UNION ALL SELECT 'O:' || o_orderkey, 'method', r_name, o_orderkey::VARCHAR, md5(o_orderstatus || '|' || o_orderpriority) FROM orders JOIN cust ON o_custkey = c_custkey
  UNION ALL SELECT 'P:' || p_partkey, 'field', substr(p_brand, 1, 7), p_partkey::VARCHAR, NULL FROM part
  UNION ALL SELECT DISTINCT 'B:' || p_brand, 'class', substr(p_brand, 1, 7), p_brand, NULL FROM part
  UNION ALL SELECT DISTINCT 'T:' || p_type, 'type_alias', 'TYPES', p_type, NULL FROM part
),
g_nodes AS (SELECT id, kind, repo, repo || '::' || short_name AS qualified_name, short_name, repo || '/' || kind AS file, ast_hash FROM raw_nodes),
g_edges AS (
  SELECT 'R:' || n_regionkey AS src_id, 'N:' || n_nationkey AS dst_id, 'CONTAINS' AS kind, NULL::BIGINT AS "count" FROM nation
  UNION ALL SELECT 'N:' || c_nationkey, 'C:' || c_custkey, 'CONTAINS', NULL FROM customer
  UNION ALL SELECT 'N:' || s_nationkey, 'U:' || s_suppkey, 'CONTAINS', NULL FROM supplier
  UNION ALL SELECT 'C:' || o_custkey, 'O:' || o_orderkey, 'CALLS', 1 FROM orders
  UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'REFERENCES', count(*) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'U:' || l_suppkey, 'P:' || l_partkey, 'CONSTRUCTS', NULL::BIGINT FROM lineitem
  UNION ALL SELECT 'P:' || p_partkey, 'B:' || p_brand, 'EXTENDS', NULL FROM part
  UNION ALL SELECT 'P:' || p_partkey, 'T:' || p_type, 'TYPE_OF', NULL FROM part
  UNION ALL SELECT DISTINCT 'U:' || l_suppkey, 'P:' || l_partkey, CASE l_returnflag WHEN 'A' THEN 'READS_FIELD' WHEN 'N' THEN 'WRITES_FIELD' ELSE 'RAISES' END, NULL::BIGINT FROM lineitem
),
g_tokens AS (
  SELECT 'D:' || doc_id AS symbol_id, lang AS repo, CASE WHEN source = 'src0' THEN 'comment' ELSE 'literal' END AS kind, pos - 1 AS pos, w AS text FROM (
    SELECT doc_id, lang, source, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z]+') AS ws FROM documents)
  ) WHERE w <> ''
),
g_events AS (
  SELECT user_id AS "key", epoch_us(ts) AS t, event_id, event_type, round(value * 100)::BIGINT AS value, CASE WHEN event_type = 'view' THEN 'pending' ELSE 'done' END AS status,
    CASE event_type WHEN 'signup' THEN 'reset' WHEN 'purchase' THEN 'increment' WHEN 'error' THEN 'decrement' ELSE 'note' END AS kind FROM events
)
"""
