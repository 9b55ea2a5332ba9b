"""Projection of the verification tables onto the graph tables.

One SQL text serves Spark and the oracle. It keeps to what both dialects share;
lists are kept as joined text and split where arrays are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.session import materialize, path_exists, read_table

ITEMS = """
    SELECT p.p_partkey AS k, p.p_name, p.p_size, p.p_brand,
           CASE WHEN e.p_partkey IS NOT NULL THEN 'EnumVariant'
                WHEN p.p_type = 'ECONOMY' THEN 'Function' WHEN p.p_type = 'LARGE' THEN 'Method'
                WHEN p.p_type = 'MEDIUM' THEN 'Enum' WHEN p.p_type = 'SMALL' THEN 'Trait'
                WHEN p.p_type = 'PROMO' AND p.p_size % 7 = 0 THEN 'Static'
                WHEN p.p_type = 'PROMO' THEN 'Struct' ELSE 'TypeAlias' END AS item_kind,
           CASE WHEN e.p_partkey IS NOT NULL THEN 'I' || CAST(e.p_partkey AS STRING) ELSE 'M' || CAST(s.s_suppkey AS STRING) END AS parent_id,
           'M' || CAST(s.s_suppkey AS STRING) AS home, s.s_name, n.n_nationkey, n.n_name
    FROM {part} p
    JOIN {supplier} s ON s.s_suppkey = p.p_partkey % (SELECT count(*) FROM {supplier})
    JOIN {nation} n ON n.n_nationkey = s.s_nationkey
    LEFT JOIN {part} e ON e.p_partkey = p.p_partkey - 1 AND e.p_type = 'MEDIUM' AND p.p_type IN ('SMALL', 'PROMO') AND p.p_size % 2 = 0
"""

NODES = """
    SELECT 'W' AS id, 'Workspace' AS kind, 'tpch' AS display_name, 'tpch' AS qualified_name,
           CAST(NULL AS STRING) AS crate_id, CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS item_kind,
           CAST(NULL AS STRING) AS file, CAST(NULL AS BIGINT) AS span_start, CAST(NULL AS BIGINT) AS span_end,
           CAST(NULL AS STRING) AS visibility, CAST(NULL AS STRING) AS attr_text, CAST(NULL AS STRING) AS crate_target_kind
    UNION ALL
    SELECT 'C' || CAST(n_nationkey AS STRING), 'Crate', n_name, n_name, 'C' || CAST(n_nationkey AS STRING), 'W', NULL, NULL, NULL, NULL, NULL, NULL,
           CASE n_regionkey WHEN 0 THEN 'lib' WHEN 2 THEN 'lib' WHEN 1 THEN 'bin' WHEN 3 THEN 'example' ELSE 'test' END
    FROM {nation}
    UNION ALL
    SELECT 'R' || CAST(n_nationkey AS STRING), 'Module', n_name, n_name, 'C' || CAST(n_nationkey AS STRING), 'C' || CAST(n_nationkey AS STRING), NULL, NULL, NULL, NULL, 'pub', NULL, NULL
    FROM {nation}
    UNION ALL
    SELECT 'M' || CAST(s_suppkey AS STRING), 'Module', CASE WHEN s_suppkey % 20 = 7 THEN 'NATION_' || CAST(s_suppkey % 23 AS STRING) ELSE s_name END, n_name || '::' || s_name, 'C' || CAST(n_nationkey AS STRING), 'R' || CAST(n_nationkey AS STRING), NULL, NULL, NULL, NULL,
           CASE s_suppkey % 3 WHEN 0 THEN 'pub' WHEN 1 THEN 'pub(crate)' ELSE 'private' END, NULL, NULL
    FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
    UNION ALL
    SELECT 'I' || CAST(k AS STRING), 'Item', p_name, n_name || '::' || s_name || '::' || p_name || '#' || CAST(k AS STRING),
           'C' || CAST(n_nationkey AS STRING), parent_id, item_kind, 'src/' || s_name || '.rs', k * 100, k * 100 + 10 + p_size,
           CASE p_size % 4 WHEN 0 THEN 'pub' WHEN 1 THEN 'pub(crate)' WHEN 2 THEN 'restricted' ELSE 'private' END,
           concat_ws(chr(10),
               CASE WHEN p_size % 3 = 0 THEN '/// ' || p_name END,
               CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5') THEN '#[derive(Debug, Clone)]'
                    WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14') THEN '#[derive(Debug, std::hash::Hash)]'
                    WHEN p_brand IN ('Brand#21', 'Brand#22') THEN '#[derive(Clone)]' END,
               CASE WHEN p_size % 5 = 0 THEN '#[must_use]' END,
               CASE WHEN p_size % 11 = 0 THEN '#[cfg(test)]' END), NULL
    FROM items
    UNION ALL
    SELECT DISTINCT 'X' || c_mktsegment, 'ExternalSymbol', c_mktsegment, 'std::' || c_mktsegment, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
           CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)
    FROM {customer}
"""

USAGES = """
    SELECT 'U' || CAST(l_orderkey AS STRING) || '-' || CAST(rn AS STRING) AS usage_id,
           'I' || CAST(nxt - nxt % 4 AS STRING) AS target, 'M' || CAST(l_suppkey AS STRING) AS consumer_module,
           'o' || CAST(l_orderkey AS STRING) AS file, l_orderkey AS start, rn AS stop,
           CASE l_returnflag WHEN 'A' THEN 'Read' WHEN 'N' THEN 'Write' WHEN 'R' THEN 'Test' ELSE 'Other' END AS category,
           'I' || CAST(l_partkey AS STRING) AS consumer_function, l_quantity AS weight
    FROM (
        SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS rn,
               lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt
        FROM {lineitem}
    ) WHERE nxt IS NOT NULL
"""

BINDINGS = """
    SELECT 'D' || CAST(k AS STRING) AS binding_id, home AS from_module,
           CASE WHEN item_kind IN ('Function', 'Method', 'Static') THEN 'Value' ELSE 'Type' END AS namespace,
           p_name AS visible_name, 'I' || CAST(k AS STRING) AS target, 'Declared' AS kind,
           CASE p_size % 4 WHEN 0 THEN 'Public' WHEN 1 THEN 'Crate' WHEN 2 THEN 'RestrictedTo' ELSE 'Private' END AS vis_tag,
           CASE p_size % 4 WHEN 1 THEN 'C' || CAST(n_nationkey AS STRING) WHEN 2 THEN CASE WHEN p_size % 8 = 2 THEN home ELSE 'R' || CAST(n_nationkey AS STRING) END END AS vis_node,
           FALSE AS is_explicit_pub_use
    FROM items
    UNION ALL
    SELECT 'B' || CAST(sup AS STRING) || '-' || CAST(k AS STRING), 'M' || CAST(sup AS STRING),
           CASE WHEN item_kind IN ('Function', 'Method', 'Static') THEN 'Value' ELSE 'Type' END,
           p_name, 'I' || CAST(k AS STRING), CASE WHEN k % 2 = 0 THEN 'NamedImport' ELSE 'GlobImport' END,
           CASE WHEN sup % 3 = 0 THEN 'Public' ELSE 'Private' END, CAST(NULL AS STRING), sup % 3 = 0
    FROM (SELECT DISTINCT l_suppkey AS sup, l_partkey AS part FROM {lineitem} WHERE l_quantity >= 48 AND l_discount >= 0.09) l
    JOIN items ON k = part AND home <> 'M' || CAST(sup AS STRING)
    UNION ALL
    SELECT 'E' || CAST(c_nationkey AS STRING) || c_mktsegment, 'R' || CAST(c_nationkey AS STRING), 'Type', c_mktsegment, 'X' || c_mktsegment,
           'ExternCrateImport', 'Private', CAST(NULL AS STRING), FALSE
    FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer})
"""

SIGNATURES = """
    SELECT 'I' || CAST(k AS STRING) AS target, p_size % 2 = 0 AS is_async,
           CASE WHEN item_kind = 'Method' THEN CASE p_size % 3 WHEN 0 THEN 'Ref' WHEN 1 THEN 'RefMut' ELSE 'Owned' END END AS self_param,
           CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'u32' WHEN 2 THEN 'u32,String' WHEN 3 THEN '&str,Vec<u8>,u32' ELSE 'u32,u32,String,Option<u8>' END AS param_types,
           CASE p_size % 6 WHEN 0 THEN '()' WHEN 1 THEN 'u32' WHEN 2 THEN 'Result<u32, Error>' ELSE 'Option<String>' END AS return_type
    FROM items WHERE item_kind IN ('Function', 'Method')
"""

STATICS = """
    SELECT 'I' || CAST(k AS STRING) AS target,
           CASE p_size % 4 WHEN 0 THEN 'LazyLock<Mutex<u32>>' WHEN 1 THEN 'OnceLock<String>' WHEN 2 THEN 'OnceCell<u8>' ELSE '[u8; 4]' END AS type_string,
           p_size % 2 = 1 AS is_mut
    FROM items WHERE item_kind = 'Static'
"""

# Functions as source text, in which the patterns of the audits occur; brackets stand for braces.
SOURCES = """
    SELECT 'I' || CAST(k AS STRING) AS id, translate(concat_ws(chr(10),
               CASE WHEN k % 5 = 0 THEN 'async fn f' ELSE 'fn f' END || CAST(k AS STRING) || '(x: u32) [',
               CASE WHEN k % 3 = 0 THEN '    let a = x.get().unwrap();' END,
               CASE WHEN k % 7 = 0 THEN '    let b = x.get().expect("b").unwrap();' END,
               CASE k % 11 WHEN 0 THEN '    panic!("no");' WHEN 1 THEN '    std::todo!();' WHEN 2 THEN '    unreachable!();' END,
               CASE WHEN k % 10 = 0 THEN '    let g = m.lock().unwrap();' WHEN k % 10 = 5 THEN '    let g = m.clone();' END,
               CASE WHEN k % 5 = 0 THEN '    call(x).await;' END,
               CASE WHEN k % 13 = 0 THEN '    // SAFETY: x is set' END,
               CASE WHEN k % 13 IN (0, 1) THEN '    unsafe [' || chr(10) || '        y.unwrap_unchecked(); std::mem::transmute::<u32, i32>(x);' || chr(10) || '    ]' END,
               CASE k % 6 WHEN 0 THEN '    loop [ step(); ]' WHEN 1 THEN '    loop [ if x > 1 [ break; ] ]' WHEN 2 THEN '    loop [' || chr(10) || '        go(x)?;' || chr(10) || '    ]' END,
               CASE WHEN k % 9 = 0 THEN '    f' || CAST(k AS STRING) || '(x - 1);' END,
               ']'), '[]', chr(123) || chr(125)) AS body
    FROM items WHERE item_kind IN ('Function', 'Method')
"""

PARTS = {"nodes": NODES, "usages": USAGES, "bindings": BINDINGS, "signatures": SIGNATURES, "statics": STATICS, "sources": SOURCES}
TABLES = ("part", "supplier", "nation", "customer", "lineitem")


_built: dict[tuple, dict[str, DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Application, folder, and when its tables were last written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in TABLES]
    return spark.sparkContext.applicationId, sf_dir, *(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The projected tables, written once for a state of the folder."""
    key = _state(spark, sf_dir)
    if key not in _built or not path_exists(spark, _built[key]["nodes"]._graphloom_path):
        tables = {t: read_table(spark, sf_dir, t) for t in TABLES}
        out = {"items": materialize(spark.sql(ITEMS, **{t: df for t, df in tables.items() if f"{{{t}}}" in ITEMS}), "graph-items")}
        for name, text in PARTS.items():
            sql = text.replace("FROM items", "FROM {items}").replace("JOIN items", "JOIN {items}")
            out[name] = materialize(spark.sql(sql, **{t: df for t, df in (tables | out).items() if f"{{{t}}}" in sql}), f"graph-{name}")
        _built[key] = out
    return _built[key]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): functions as source text."""
    return _tables(spark, sf_dir)["sources"].select(F.col("id").alias("doc_id"), F.col("body").alias("text"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph tables."""
    out = _tables(spark, sf_dir)
    nodes = out["nodes"].withColumn("attributes", F.filter(F.split(F.coalesce("attr_text", F.lit("")), "\n"), lambda a: a != ""))
    sigs = out["signatures"]
    params = F.transform(F.filter(F.split("param_types", ","), lambda t: t != ""), lambda t, i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("name"), t.alias("ty")))
    return Graph(nodes.drop("attr_text"), out["bindings"], out["usages"], sigs.withColumn("params", params).drop("param_types"), out["statics"])


def oracle(body: str) -> str:
    """``body`` over the graph tables it names, as one SQL text."""
    import re

    plain = {t: t for t in TABLES}
    names = [n for n in PARTS if re.search(rf"\b{n}\b", body)]
    ctes = []
    if any("items" in PARTS[n] for n in names):
        ctes.append(f"items AS ({ITEMS.format(**plain)})")
    ctes += [f"{n} AS ({PARTS[n].format(**plain)})" for n in names]
    head = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    body = body.replace("RECURSIVE", "").strip()
    if body.startswith("WITH"):
        return head + ", ".join(ctes) + ", " + body[4:]
    return head + ", ".join(ctes) + " " + body


def documents_chunks(docs: DataFrame) -> DataFrame:
    """Documents as text chunks."""
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("symbol_kind"), F.col("lang").alias("module_path"))
