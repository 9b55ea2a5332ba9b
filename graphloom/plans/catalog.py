"""All queries over the verification tables, with their oracle SQL.

Point queries look at part 0, supplier 0 and nation 3, found by id, since names
differ between scale factors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import chunking
from graphloom.functions.identity import node_id
from graphloom.operators import incremental, navigate, ranking, recipes, relations, search, spans, surface, text, traverse, vector
from graphloom.operators.graph import Graph, page
from graphloom.plans.projection import documents_chunks, graph, oracle, sources
from graphloom.session import materialize, new_path, read_table
from graphloom.sources import filters
from graphloom.streaming import windows

ITEM, MODULE, OTHER, CRATE = "I0", "M0", "M1", "C3"
COSINE = 0.35
RULES = (
    {"consumer": "NATION_1*", "producer": "NATION_2*", "severity": "error"},
    {"consumer": "*", "producer": "NATION_3", "except_": "NATION_4*", "kinds": ["*"], "severity": "warning"},
)

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, on_graph: bool = True):
    """Register a query under its function's name; graph queries get the graph."""

    def add(f):
        name = f.__name__
        _queries[name] = (lambda spark, sf_dir: f(graph(spark, sf_dir))) if on_graph else f
        if sql is not None:
            _sql[name] = oracle(sql) if on_graph else sql
        return f

    return add


def queries():
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def name_of(g: Graph, node: str) -> str:
    return g.nodes.where(F.col("id") == node).select("qualified_name").first()[0]


# Relations -----------------------------------------------------------------

SYMBOLS = """
    WITH home AS (SELECT id, crate_id FROM nodes WHERE crate_id IS NOT NULL),
    r AS (
        SELECT from_module AS m, target, 1 AS i, 0 AS u FROM bindings WHERE kind <> 'Declared'
        UNION ALL SELECT consumer_module, target, 0, 1 FROM usages
    ),
    sym AS (
        SELECT a.crate_id AS c, b.crate_id AS p, target, sum(i) AS i, sum(u) AS u
        FROM r JOIN home a ON a.id = m JOIN home b ON b.id = target WHERE a.crate_id <> b.crate_id GROUP BY 1, 2, 3
    ),
    edges AS (
        SELECT x.qualified_name AS consumer_crate, y.qualified_name AS producer_crate, CAST(count(*) AS BIGINT) AS symbols,
               CAST(sum(i) AS BIGINT) AS imports, CAST(sum(u) AS BIGINT) AS usages
        FROM sym JOIN nodes x ON x.id = c JOIN nodes y ON y.id = p GROUP BY 1, 2
    )
"""
VISIBLE = """
    WITH vis AS (
        SELECT target, vis_tag, vis_node, from_module FROM (
            SELECT b.*, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN from_module = n.parent_id THEN 0 ELSE 1 END, binding_id) AS r
            FROM bindings b JOIN nodes n ON n.id = b.target WHERE b.kind = 'Declared'
        ) WHERE r = 1
    )
"""
ENRICHED = """
    SELECT m.qualified_name AS module_name, visible_name, t.qualified_name AS target_name, namespace, b.kind,
           CASE vis_tag WHEN 'Public' THEN 'pub' WHEN 'Crate' THEN 'pub(crate=' || v.qualified_name || ')'
                        WHEN 'RestrictedTo' THEN 'pub(in ' || coalesce(v.qualified_name, '?') || ')' ELSE 'private' END AS visibility
    FROM bindings b JOIN nodes m ON m.id = from_module JOIN nodes t ON t.id = target LEFT JOIN nodes v ON v.id = vis_node
"""


@query(f"{SYMBOLS} SELECT * FROM edges")
def crate_edges(g):
    return relations.crate_edges(g)


@query(
    SYMBOLS.rstrip()
    + ","
    + VISIBLE.strip()[4:]
    + """,
    o AS (SELECT consumer_crate AS k, count(DISTINCT producer_crate) AS n FROM edges GROUP BY 1),
    a AS (SELECT producer_crate AS k, count(DISTINCT consumer_crate) AS n FROM edges GROUP BY 1),
    it AS (
        SELECT crate_id, count(*) AS n, count(*) FILTER (WHERE item_kind = 'Trait' OR (item_kind = 'TypeAlias' AND vis_tag = 'Public')) AS abstract
        FROM nodes LEFT JOIN vis ON target = id WHERE nodes.kind = 'Item' GROUP BY 1
    ),
    m AS (
        SELECT c.display_name AS crate_name, coalesce(o.n, 0) AS ce, coalesce(a.n, 0) AS ca, coalesce(it.n, 0) AS items, coalesce(it.abstract, 0) AS abstract
        FROM nodes c LEFT JOIN o ON o.k = c.display_name LEFT JOIN a ON a.k = c.display_name LEFT JOIN it ON it.crate_id = c.id WHERE c.kind = 'Crate'
    )
    SELECT crate_name, CAST(ce AS BIGINT) AS efferent, CAST(ca AS BIGINT) AS afferent, CAST(items AS BIGINT) AS item_count,
           round(CASE WHEN ce + ca = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ce + ca) END, 6) AS instability,
           round(CASE WHEN items = 0 THEN 0.0 ELSE CAST(abstract AS DOUBLE) / items END, 6) AS abstractness
    FROM m"""
)
def crate_dependency_metric(g):
    return relations.dependency_metric(g)


@query(
    SYMBOLS
    + """,
    best AS (
        SELECT c, p, s.qualified_name AS symbol, row_number() OVER (PARTITION BY c, p ORDER BY i + u DESC, s.qualified_name) AS r
        FROM sym JOIN nodes s ON s.id = target
    ),
    e AS (SELECT x.qualified_name AS cc, y.qualified_name AS pc, x.crate_target_kind AS k, symbol FROM best JOIN nodes x ON x.id = c JOIN nodes y ON y.id = p WHERE r = 1)
    SELECT CAST(0 AS BIGINT) AS rule_index, 'error' AS severity, cc AS consumer_crate, pc AS producer_crate, symbol AS sample
    FROM e WHERE k IN ('lib', 'bin') AND starts_with(cc, 'NATION_1') AND starts_with(pc, 'NATION_2')
    UNION ALL
    SELECT 1, 'warning', cc, pc, symbol FROM e WHERE pc = 'NATION_3' AND NOT starts_with(cc, 'NATION_4')"""
)
def forbidden_dependency_check(g):
    return relations.forbidden_dependencies(g, RULES)


@query(f"SELECT n.qualified_name AS caller, u.file, start, stop, category FROM usages u LEFT JOIN nodes n ON n.id = consumer_function WHERE target = '{ITEM}'")
def who_calls(g):
    return relations.who_calls(g, name_of(g, ITEM))


@query(f"SELECT coalesce(n.qualified_name, '') AS callee, u.file, start, stop, category FROM usages u LEFT JOIN nodes n ON n.id = target WHERE consumer_function = '{ITEM}'")
def calls_from(g):
    return relations.calls_from(g, name_of(g, ITEM))


@query(
    f"""SELECT n.qualified_name AS caller, c.display_name AS crate_name, u.file, start, stop
    FROM usages u JOIN nodes n ON n.id = consumer_function JOIN nodes c ON c.id = n.crate_id
    WHERE target = '{ITEM}' AND c.id = (SELECT min(x.crate_id) FROM usages y JOIN nodes x ON x.id = y.consumer_function WHERE y.target = '{ITEM}')"""
)
def callers_in_crate(g):
    callers = g.usages.where(F.col("target") == ITEM).join(g.nodes.select(F.col("id").alias("consumer_function"), "crate_id"), "consumer_function")
    return relations.callers_in_crate(g, name_of(g, ITEM), name_of(g, callers.agg(F.min("crate_id")).first()[0]))


@query(f"{ENRICHED} WHERE target = (SELECT min(target) FROM bindings WHERE kind = 'NamedImport') AND b.kind <> 'Declared'")
def who_imports(g):
    return relations.who_imports(g, name_of(g, g.bindings.where("kind = 'NamedImport'").agg(F.min("target")).first()[0]))


@query(f"SELECT m.qualified_name AS module_name, u.file, start, stop, category FROM usages u JOIN nodes m ON m.id = consumer_module WHERE target = '{ITEM}'")
def who_uses(g):
    return relations.who_uses(g, name_of(g, ITEM))


@query(
    f"""SELECT m.qualified_name AS module_name, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE category = 'Write') AS n_write,
    count(*) FILTER (WHERE category = 'Read') AS n_read, count(*) FILTER (WHERE category = 'Test') AS n_test, count(*) FILTER (WHERE category = 'Other') AS n_other
    FROM usages JOIN nodes m ON m.id = consumer_module WHERE target = '{ITEM}' GROUP BY 1"""
)
def who_uses_summary(g):
    return relations.who_uses_summary(g, name_of(g, ITEM))


@query(f"{ENRICHED} WHERE from_module = '{MODULE}' AND b.kind <> 'Declared'")
def imports_of(g):
    return relations.imports_of(g, name_of(g, MODULE))


def _visible(extra: str = "") -> str:
    above = f"(SELECT '{OTHER}' AS a UNION ALL SELECT parent_id FROM nodes WHERE id = '{OTHER}' UNION ALL SELECT crate_id FROM nodes WHERE id = '{OTHER}' UNION ALL SELECT 'W')"
    return f"""{ENRICHED} WHERE from_module = '{MODULE}' {extra} AND (vis_tag = 'Public'
        OR (vis_tag = 'Crate' AND vis_node = (SELECT crate_id FROM nodes WHERE id = '{OTHER}'))
        OR (vis_tag = 'RestrictedTo' AND vis_node IN (SELECT a FROM {above})))"""


@query(_visible())
def exports_of(g):
    return relations.exports_of(g, name_of(g, MODULE), name_of(g, OTHER))


@query(_visible("AND b.kind <> 'Declared'"))
def reexports_of(g):
    return relations.reexports_of(g, name_of(g, MODULE), name_of(g, OTHER))


@query(f"{ENRICHED} WHERE from_module = '{MODULE}' AND b.kind <> 'Declared' AND is_explicit_pub_use")
def declared_reexports(g):
    return relations.declared_reexports(g, name_of(g, MODULE))


@query(
    f"""WITH box AS (
        SELECT n.id, CASE WHEN n.kind IN ('Module', 'Crate', 'ExternalSymbol') THEN n.id
                          WHEN p.kind IN ('Module', 'Crate', 'ExternalSymbol') THEN p.id ELSE p.parent_id END AS dep
        FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id
    ), r AS (
        SELECT target, 1 AS i, 0 AS u, kind AS bk FROM bindings WHERE from_module = '{MODULE}' AND kind <> 'Declared'
        UNION ALL SELECT target, 0, 1, NULL FROM usages WHERE consumer_module = '{MODULE}'
    )
    SELECT d.qualified_name AS dependency, d.kind, CAST(sum(i) AS BIGINT) AS imports, CAST(sum(u) AS BIGINT) AS usages, count(DISTINCT target) AS symbols,
           coalesce(string_agg(DISTINCT bk, ',' ORDER BY bk), '') AS binding_kinds
    FROM r JOIN box ON box.id = target JOIN nodes d ON d.id = dep WHERE dep <> '{MODULE}' GROUP BY d.id, 1, 2"""
)
def module_dependencies(g):
    return relations.module_dependencies(g, name_of(g, MODULE))


@query(
    """SELECT n.qualified_name AS item, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (WHERE category = 'Test') AS tests,
    CASE WHEN count(*) FILTER (WHERE category = 'Test') = count(*) THEN 'test' WHEN count(*) FILTER (WHERE category = 'Test') = 0 THEN 'prod' ELSE 'mixed' END AS class
    FROM usages JOIN nodes n ON n.id = target GROUP BY 1"""
)
def test_vs_prod(g):
    return relations.test_or_prod(g)


@query(
    """WITH e AS (SELECT DISTINCT consumer_function AS s, target AS t FROM usages),
    r AS (
        SELECT qualified_name AS item, CAST((SELECT count(*) FROM e WHERE s = id) AS BIGINT) AS calls, CAST((SELECT count(*) FROM e WHERE t = id) AS BIGINT) AS callers
        FROM nodes WHERE item_kind IN ('Function', 'Method')
    )
    SELECT *, CASE WHEN calls = 0 AND callers = 0 THEN 'isolated' WHEN calls = 0 THEN 'leaf' WHEN callers = 0 THEN 'root'
                   WHEN callers >= 2 * calls THEN 'hub' ELSE 'midstream' END AS class FROM r"""
)
def hub_leaf_class(g):
    return relations.hubs_and_leaves(g)


@query(
    f"""SELECT m.qualified_name AS module_name, u.file, start, stop, category, (SELECT count(*) FROM usages WHERE target = '{ITEM}') AS total
    FROM usages u JOIN nodes m ON m.id = consumer_module WHERE target = '{ITEM}' ORDER BY u.file, start, stop, module_name LIMIT 5 OFFSET 3"""
)
def paged_listing(g):
    return page(relations.who_uses(g, name_of(g, ITEM)), ["file", "start", "stop", "module_name"], 3, 5)


# Traversal -----------------------------------------------------------------

CALLERS = f"""WITH RECURSIVE walk AS (
        SELECT consumer_function AS id, 1 AS d FROM usages WHERE target = '{ITEM}'
        UNION SELECT consumer_function, d + 1 FROM walk JOIN usages ON target = walk.id WHERE d < 3
    ), f AS (SELECT id, min(d) AS d FROM walk GROUP BY 1)"""


@query(
    f"""{CALLERS} SELECT count(*) FILTER (WHERE d <= 2) AS callers, count(*) FILTER (WHERE d = 1) AS direct,
    CAST(coalesce(max(d) FILTER (WHERE d <= 2), 0) AS BIGINT) AS depth_reached, count(*) FILTER (WHERE d > 2) > 0 AS truncated FROM f"""
)
def recursive_callers_count(g):
    return traverse.recursive_callers(g, name_of(g, ITEM), 2)


@query(
    f"""WITH RECURSIVE walk AS (
        SELECT target AS id, 1 AS d FROM usages WHERE consumer_function = '{ITEM}'
        UNION SELECT target, d + 1 FROM walk JOIN usages ON consumer_function = walk.id WHERE d < 3
    ) SELECT qualified_name AS callee, CAST(min(d) AS BIGINT) AS depth FROM walk JOIN nodes USING (id) GROUP BY nodes.id, 1"""
)
def call_graph_reach(g):
    return traverse.call_graph(g, name_of(g, ITEM), 3)


@query(
    """WITH RECURSIVE pub AS (SELECT DISTINCT target, from_module, visible_name FROM bindings WHERE kind <> 'Declared' AND is_explicit_pub_use),
    walk AS (
        SELECT from_module, visible_name, 1 AS d FROM pub WHERE target = (SELECT min(target) FROM pub)
        UNION SELECT pub.from_module, pub.visible_name, d + 1 FROM walk JOIN pub ON pub.target = walk.from_module WHERE d < 8
    ) SELECT qualified_name AS module, visible_name, CAST(min(d) AS BIGINT) AS depth FROM walk JOIN nodes ON id = from_module GROUP BY nodes.id, 1, 2"""
)
def re_export_chain(g):
    first = g.bindings.where("kind <> 'Declared' AND is_explicit_pub_use").agg(F.min("target")).first()[0]
    return traverse.re_export_chain(g, name_of(g, first))


@query(
    f"""WITH RECURSIVE up AS (
        SELECT id, qualified_name, kind, parent_id, 0 AS d FROM nodes WHERE id = '{MODULE}'
        UNION ALL SELECT n.id, n.qualified_name, n.kind, n.parent_id, d + 1 FROM up JOIN nodes n ON n.id = up.parent_id
    ) SELECT qualified_name, kind, CAST(d AS BIGINT) AS depth FROM up"""
)
def module_ancestors(g):
    return traverse.module_ancestors(g, name_of(g, MODULE))


@query(
    f"""WITH RECURSIVE down AS (
        SELECT id, display_name AS path, display_name AS name, kind, item_kind, 0 AS d FROM nodes WHERE id = '{CRATE}'
        UNION ALL SELECT n.id, path || '/' || n.display_name, n.display_name, n.kind, n.item_kind, d + 1 FROM down JOIN nodes n ON n.parent_id = down.id WHERE d < 4
    ) SELECT path, name, kind, item_kind, CAST(d AS BIGINT) AS depth FROM down"""
)
def module_tree(g):
    return traverse.module_tree(g, name_of(g, CRATE), 4)


@query(
    """WITH e AS (
        SELECT DISTINCT consumer_function AS s, target AS t FROM usages
        WHERE consumer_function IN (SELECT s.target FROM signatures s) AND target IN (SELECT s.target FROM signatures s)
    )
    SELECT s AS path, CAST(1 AS BIGINT) AS length FROM e WHERE s = t
    UNION ALL SELECT a.s || ' -> ' || a.t, 2 FROM e a JOIN e b ON b.s = a.t AND b.t = a.s WHERE a.s < a.t
    UNION ALL SELECT a.s || ' -> ' || a.t || ' -> ' || b.t, 3 FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t AND c.t = a.s
    WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t
    UNION ALL SELECT a.s || ' -> ' || a.t || ' -> ' || b.t || ' -> ' || c.t, 4 FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t JOIN e d ON d.s = c.t AND d.t = a.s
    WHERE a.s < a.t AND a.s < b.t AND a.s < c.t AND a.t <> b.t AND a.t <> c.t AND b.t <> c.t
    UNION ALL SELECT a.s || ' -> ' || a.t || ' -> ' || b.t || ' -> ' || c.t || ' -> ' || d.t, 5
    FROM e a JOIN e b ON b.s = a.t JOIN e c ON c.s = b.t JOIN e d ON d.s = c.t JOIN e f ON f.s = d.t AND f.t = a.s
    WHERE a.s < a.t AND a.s < b.t AND a.s < c.t AND a.s < d.t AND a.t <> b.t AND a.t <> c.t AND a.t <> d.t AND b.t <> c.t AND b.t <> d.t AND c.t <> d.t"""
)
def recursion_check(g):
    return traverse.recursion_check(g, 5)


# Surface and audits --------------------------------------------------------

DEAD = """
    WITH seen AS (
        SELECT DISTINCT target, n.crate_id FROM (
            SELECT target, from_module AS m FROM bindings WHERE kind <> 'Declared'
            UNION ALL SELECT target, consumer_module FROM usages
        ) JOIN nodes n ON n.id = m
    ), dead AS (
        SELECT c.display_name AS crate_name, i.qualified_name AS item, i.item_kind
        FROM (SELECT DISTINCT target FROM bindings WHERE kind = 'Declared' AND vis_tag = 'Public') b
        JOIN nodes i ON i.id = b.target JOIN nodes c ON c.id = i.crate_id
        WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.target = i.id AND seen.crate_id <> i.crate_id)
    )
"""


@query(f"{DEAD} SELECT * FROM dead WHERE crate_name = (SELECT display_name FROM nodes WHERE id = '{CRATE}')")
def dead_pub_in_crate(g):
    return surface.dead_pub(g).where(F.col("crate_name") == name_of(g, CRATE))


@query(f"{DEAD} SELECT display_name AS crate_name, CAST(count(item) AS BIGINT) AS dead FROM nodes LEFT JOIN dead ON crate_name = display_name WHERE kind = 'Crate' GROUP BY 1")
def dead_pub_report(g):
    return surface.dead_pub_report(g)


NAMED = """WITH x AS (
        SELECT n.display_name AS name, n.item_kind, c.id AS crate_id, c.display_name AS crate_name FROM nodes n JOIN nodes c ON c.id = n.crate_id
        WHERE c.crate_target_kind IN ('lib', 'bin') AND n.kind = 'Item'
    )"""
TYPE_KINDS = "('Struct', 'Enum', 'Trait', 'TypeAlias')"


@query(f"{NAMED} SELECT name, count(DISTINCT crate_id) AS crates, count(*) AS items FROM x WHERE item_kind IN {TYPE_KINDS} GROUP BY 1 HAVING count(DISTINCT crate_id) >= 2")
def overlaps_type_collisions(g):
    return surface.type_collisions(g, "local")


@query(f"{NAMED} SELECT crate_name, name, count(*) AS items FROM x WHERE item_kind IN {TYPE_KINDS} GROUP BY 1, 2 HAVING count(*) >= 2")
def overlaps_duplicates(g):
    return surface.duplicates_in_crate(g, "local")


@query(
    f"""{NAMED} SELECT name, count(DISTINCT crate_name) AS crates, string_agg(DISTINCT crate_name, ',' ORDER BY crate_name) AS crate_names
    FROM x WHERE item_kind = 'Function' GROUP BY 1 HAVING count(DISTINCT crate_name) >= 4"""
)
def overlaps_common_names(g):
    return surface.common_functions(g, "local")


@query(
    """SELECT m.display_name AS name, m.qualified_name AS module, c.display_name AS crate_name FROM nodes m JOIN nodes c ON c.id = m.crate_id
    WHERE m.kind = 'Module' AND m.display_name <> c.display_name AND m.display_name IN (SELECT display_name FROM nodes WHERE kind = 'Crate')"""
)
def overlaps_module_shadows(g):
    return surface.module_shadows(g, "all")


@query(
    VISIBLE
    + """, b AS (
        SELECT CASE WHEN vis_tag = 'Private' OR (vis_tag = 'RestrictedTo' AND vis_node = from_module) THEN 'module_private'
                    WHEN vis_tag = 'Crate' THEN 'pub_crate' WHEN vis_tag = 'Public' THEN 'pub' ELSE 'restricted_to' END AS k FROM vis
    )
    SELECT 'node:' || kind AS metric, CAST(count(*) AS DOUBLE) AS value FROM nodes GROUP BY 1
    UNION ALL SELECT 'item:' || item_kind, count(*) FROM nodes WHERE item_kind IS NOT NULL GROUP BY 1
    UNION ALL SELECT 'binding:' || kind, count(*) FROM bindings GROUP BY 1
    UNION ALL SELECT 'visibility:' || k, count(*) FROM b GROUP BY 1
    UNION ALL SELECT 'pub_crate_share', round(CAST(count(*) FILTER (WHERE k = 'pub_crate') AS DOUBLE) / count(*) FILTER (WHERE k IN ('pub', 'pub_crate')), 6) FROM b"""
)
def workspace_stats(g):
    return surface.workspace_stats(g)


@query(
    VISIBLE
    + """SELECT qualified_name AS item, item_kind, coalesce(vis_tag, 'Private') AS visibility FROM nodes LEFT JOIN vis ON target = id
    WHERE item_kind IN ('Struct', 'Enum', 'Union', 'Trait', 'TypeAlias') AND vis_tag = 'Public' AND NOT contains(qualified_name, '::tests::')"""
)
def crate_types(g):
    return surface.crate_types(g, pub_only=True, skip_tests=True)


@query("SELECT e.qualified_name AS enum, v.display_name AS variant, v.file, v.span_start FROM nodes v JOIN nodes e ON e.id = v.parent_id WHERE v.item_kind = 'EnumVariant'")
def enum_variants(g):
    return surface.all_enum_variants(g)


@query(
    """WITH a AS (SELECT qualified_name AS item, string_split(attr_text, chr(10)) AS xs FROM nodes WHERE kind = 'Item' AND attr_text <> '')
    SELECT item, CAST(i - 1 AS BIGINT) AS pos, xs[i] AS attribute FROM (SELECT item, xs, unnest(range(1, len(xs) + 1)) AS i FROM a)"""
)
def item_attributes(g):
    return surface.item_attributes(g)


@query(
    """WITH a AS (SELECT qualified_name AS item, unnest(string_split(attr_text, chr(10))) AS attribute FROM nodes WHERE kind = 'Item')
    SELECT item, attribute, 'attr' AS matched FROM a WHERE starts_with(attribute, '#[derive(')"""
)
def items_with_attribute(g):
    return surface.items_with_attribute(g, "derive")


@query(
    VISIBLE
    + """SELECT qualified_name AS item, item_kind, file, span_start FROM nodes JOIN vis ON target = id
    WHERE vis_tag = 'Public' AND item_kind IN ('Function', 'Struct', 'Enum', 'Union', 'Trait', 'TypeAlias', 'Const', 'Static', 'Method') AND NOT contains(attr_text, '///')"""
)
def missing_docs_audit(g):
    return surface.missing_docs(g)


@query(
    """WITH d AS (
        SELECT qualified_name AS item, CASE WHEN contains(attr_text, 'Debug, Clone') THEN 'Clone,Debug' WHEN contains(attr_text, 'hash::Hash') THEN 'Debug,Hash'
               WHEN contains(attr_text, 'derive(Clone)') THEN 'Clone' ELSE '' END AS derives
        FROM nodes WHERE item_kind IN ('Struct', 'Enum', 'Union')
    )
    SELECT item, derives, CASE derives WHEN 'Debug,Hash' THEN 'Clone' WHEN 'Clone' THEN 'Debug' ELSE 'Clone,Debug' END AS missing FROM d WHERE derives <> 'Clone,Debug'"""
)
def derive_audit(g):
    return surface.derive_audit(g)


@query(
    """WITH p AS (
        SELECT target, type_string, 'static mut' AS pattern FROM statics WHERE is_mut
        UNION ALL SELECT target, type_string, x FROM statics, (VALUES ('LazyLock'), ('OnceLock'), ('OnceCell')) v(x) WHERE contains(type_string, x)
    ) SELECT qualified_name AS item, type_string, pattern FROM p JOIN nodes ON id = target"""
)
def mut_static_audit(g):
    return surface.mutable_statics(g)


@query(
    """SELECT a.qualified_name AS alias, t.qualified_name AS reexported FROM nodes a
    JOIN bindings b ON b.from_module = a.parent_id AND b.visible_name = a.display_name AND b.is_explicit_pub_use AND b.target <> a.id
    JOIN nodes t ON t.id = b.target WHERE a.item_kind = 'TypeAlias'"""
)
def pub_use_pub_type_audit(g):
    return surface.pub_use_pub_type(g)


PARAMS = """CASE param_types WHEN '' THEN '' WHEN 'u32' THEN 'a0: u32' WHEN 'u32,String' THEN 'a0: u32, a1: String'
    WHEN '&str,Vec<u8>,u32' THEN 'a0: &str, a1: Vec<u8>, a2: u32' ELSE 'a0: u32, a1: u32, a2: String, a3: Option<u8>' END AS params"""


@query(
    f"""SELECT qualified_name AS item, is_async, self_param, {PARAMS}, return_type FROM signatures JOIN nodes ON id = target
    WHERE is_async AND param_types IN ('u32,String', '&str,Vec<u8>,u32', 'u32,u32,String,Option<u8>') AND contains(param_types, 'String') AND contains(return_type, 'u32')"""
)
def functions_with_filter(g):
    return surface.functions_with(g, is_async=True, min_params=2, param_type="String", returns="u32")


@query(f"SELECT qualified_name AS item, is_async, self_param, {PARAMS}, return_type FROM signatures JOIN nodes ON id = target")
def function_signature(g):
    return surface.functions_with(g)


@query(
    """WITH h AS (SELECT usage_id AS hit_id, n.file, n.span_start + 3 AS lo, n.span_start + 5 AS hi FROM usages JOIN nodes n ON n.id = target),
    m AS (
        SELECT hit_id, n.qualified_name AS item, row_number() OVER (PARTITION BY hit_id ORDER BY span_end - span_start, span_start, n.id) AS r
        FROM h JOIN nodes n ON n.file = h.file AND span_start <= lo AND hi <= span_end
    ) SELECT hit_id, item FROM m WHERE r = 1"""
)
def enclosing_item(g):
    at = g.nodes.select(F.col("id").alias("target"), F.col("file").alias("f"), "span_start")
    hits = g.usages.select(F.col("usage_id").alias("hit_id"), "target").join(at, "target").select("hit_id", F.col("f").alias("file"), (F.col("span_start") + 3).alias("lo"), (F.col("span_start") + 5).alias("hi"))
    return spans.enclosing_items(g, hits)


@query(
    """SELECT id, sha256('ws' || chr(0) || kind || chr(0) || qualified_name) AS node_id FROM nodes"""
)
def node_ids(g):
    return g.nodes.select("id", node_id(F.lit("ws"), F.col("kind"), F.col("qualified_name")).alias("node_id"))


# Text ----------------------------------------------------------------------


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    x AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, ls FROM l),
    y AS (SELECT doc_id, line, CAST(octet_length(encode(ls[line])) AS BIGINT) AS bytes FROM x)
    SELECT doc_id, line, CAST(coalesce(sum(bytes + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, bytes FROM y""",
    on_graph=False,
)
def line_offsets(spark, sf_dir):
    return text.line_offsets(read_table(spark, sf_dir, "documents"))


@query(
    """WITH l AS (SELECT conv_id, turn, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) END AS ls FROM conversations),
    w AS (SELECT *, lag(ls) OVER o AS p, lead(1) OVER o AS n FROM l WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
    c AS (SELECT *, CAST(ceil(len(ls) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS k, CAST(ceil(len(p) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS m FROM w)
    SELECT conv_id, turn, CASE WHEN m > 0 THEN array_to_string(p[1:m], chr(10)) END AS overlap_prev,
           CASE WHEN n = 1 AND k > 0 THEN array_to_string(ls[len(ls) - k + 1:], chr(10)) END AS overlap_next FROM c""",
    on_graph=False,
)
def chunk_overlap(spark, sf_dir):
    rows = chunking.overlap(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", "overlap_prev", "overlap_next")


@query("SELECT source, CAST(sum(greatest(1, ceil(octet_length(encode(text)) / 4.0))) AS BIGINT) AS tokens, count(*) AS chunks FROM documents GROUP BY 1", on_graph=False)
def token_estimates(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select("source", chunking.estimated_tokens(F.col("text")).alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("chunks"))


def _occurrences(needle: str) -> str:
    return f"CAST((length(html) - length(replace(html, '{needle}', ''))) // {len(needle)} AS BIGINT)"


@query(
    f"""WITH x AS (
        SELECT page_id AS doc_id, html, [trim(l, ' ') FOR l IN string_split(html, chr(10))] AS ls FROM pages
    ), y AS (
        SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines, CAST(len([l FOR l IN ls IF l <> '']) AS BIGINT) AS non_empty, CAST(len([l FOR l IN ls IF starts_with(l, '//')]) AS BIGINT) AS comments,
               {_occurrences("fn ")} AS n_fn, {_occurrences("struct ")} AS n_struct, {_occurrences("trait ")} AS n_trait,
               {" + ".join(_occurrences(b) for b in text.BRANCHES)} AS cyclomatic FROM x
    ) SELECT *, round(CASE WHEN n_fn = 0 THEN 0.0 ELSE CAST(cyclomatic AS DOUBLE) / n_fn END, 6) AS per_function FROM y""",
    on_graph=False,
)
def complexity_metrics(spark, sf_dir):
    return text.complexity(read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


def _hits(pattern: str) -> str:
    return f"len(regexp_extract_all(body, '{pattern}'))"


BODY_SQL = f"""WITH s AS (SELECT id AS doc_id, body, regexp_extract(body, 'fn (\\w+)', 1) || '(' AS own FROM sources),
    h AS (
        {" UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, {_hits(p)} AS hits FROM s" for n, p in text.CALLS.items())}
        UNION ALL SELECT doc_id, 'unbounded_loop', len([b FOR b IN regexp_extract_all(body, '{text.LOOP}', 1) IF NOT regexp_matches(b, '{text.EXIT}')]) FROM s
        UNION ALL SELECT doc_id, 'await_in_guard_scope', len(regexp_extract_all(regexp_extract(body, '{text.GUARDED}', 1), '\\.await\\b')) FROM s
        UNION ALL SELECT doc_id, 'self_recursion', (length(body) - length(replace(body, own, ''))) // length(own) - 1 FROM s
    )"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir)


def on_sources(sql: str):
    """Register a query over the functions' source text."""
    return query(oracle(sql), on_graph=False)


@on_sources(f"{BODY_SQL} SELECT doc_id, pattern, CAST(hits AS BIGINT) AS hits FROM h WHERE hits > 0")
def body_pattern_audit(spark, sf_dir):
    return text.body_audit(_sources(spark, sf_dir))


LINES_SQL = "WITH l AS (SELECT id AS doc_id, string_split(body, chr(10)) AS ls FROM sources), x AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM l)"


@on_sources(
    f"""{LINES_SQL}, p AS ({" UNION ALL ".join(f"SELECT doc_id, line, '{n}' AS pattern, ls FROM x WHERE regexp_matches(ls[line], '{p}')" for n, p in text.CALLS.items())})
    SELECT doc_id, line, pattern, array_to_string(ls[greatest(line - 1, 1):line + 1], chr(10)) AS context FROM p"""
)
def body_audit_context(spark, sf_dir):
    return text.body_context(_sources(spark, sf_dir))


@on_sources(
    f"""{LINES_SQL} SELECT doc_id, line, CAST(len(string_split(regexp_extract(array_to_string(ls[line:], chr(10)), '\\bunsafe\\s*({text.BLOCK})', 1), chr(10))) AS BIGINT) AS lines,
    len([y FOR y IN ls[greatest(line - 5, 1):line] IF contains(y, 'SAFETY')]) > 0 AS has_safety FROM x WHERE regexp_matches(ls[line], '\\bunsafe\\s*\\{{')"""
)
def unsafe_audit(spark, sf_dir):
    return text.unsafe_blocks(_sources(spark, sf_dir))


def _tokens_sql(column: str) -> str:
    return rf"[t FOR t IN regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}]+') IF t <> '' AND octet_length(encode(t)) <= 40]"


def _bm25_sql(chunks: str, queries: str, name: str = "top") -> str:
    """Common table expressions up to ``name`` (query_id, id, score, rank); chunks: id, content; queries: query_id, query."""
    return f"""{name}_c AS (SELECT id, {_tokens_sql("content")} AS ts FROM ({chunks})),
    {name}_q AS (SELECT query_id, unnest(list_distinct({_tokens_sql("query")})) AS token FROM ({queries})),
    {name}_n AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM {name}_c),
    {name}_e AS (SELECT id, len(ts) AS len, unnest(ts) AS token FROM {name}_c),
    {name}_tf AS (SELECT id, len, token, count(*) AS tf FROM {name}_e WHERE token IN (SELECT token FROM {name}_q) GROUP BY ALL),
    {name}_df AS (SELECT token, count(*) AS df FROM {name}_tf GROUP BY 1),
    {name}_s AS (
        SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
        FROM {name}_tf JOIN {name}_df USING (token) JOIN {name}_q USING (token), {name}_n GROUP BY 1, 2
    ), {name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM {name}_s)"""


BM25_SQL = "WITH " + _bm25_sql("SELECT doc_id AS id, text AS content FROM documents", "SELECT item_id AS query_id, text AS query FROM benchmark")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    asked = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return text.top_k(text.bm25(documents_chunks(read_table(spark, sf_dir, "documents")), asked), k)


@query(f"{BM25_SQL} SELECT query_id, id, score, rank FROM top WHERE rank <= 10", on_graph=False)
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir, 10)


# Vectors and fusion --------------------------------------------------------

COS = "list_sum([CAST(x.embedding[i] AS DOUBLE) * CAST(y.embedding[i] AS DOUBLE) FOR i IN range(1, 65)])"
NORM = "sqrt(list_sum([CAST({0}.embedding[i] AS DOUBLE) * CAST({0}.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]))"
KNN_SQL = f"""WITH s AS (
        SELECT y.vec_id AS query_id, x.vec_id AS id, round((1 + {COS} / ({NORM.format("x")} * {NORM.format("y")})) / 2, 6) AS score
        FROM embeddings x, embeddings y WHERE y.vec_id % 100 = 0
    ), knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM s)
"""


def _knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every vector whose id is divisible by 100 is a query against all."""
    v = read_table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector.nearest(v, asked, k)


@query(f"{KNN_SQL} SELECT query_id, id, score, rank FROM knn WHERE rank <= 10", on_graph=False)
def vector_search(spark, sf_dir):
    return _knn(spark, sf_dir, 10)


@query(f"{KNN_SQL} SELECT query_id, id, score, rank FROM knn JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 11 AND query_id <> id AND a.label = b.label AND score >= 0.5", on_graph=False)
def similar_to_item(spark, sf_dir):
    kinds = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    rows = _knn(spark, sf_dir, 11).where("query_id <> id AND score >= 0.5").join(kinds, "id")
    return rows.join(kinds.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id").where("label = own").select("query_id", "id", "score", "rank")


PAIRS_SQL = f"""WITH pairs AS (
        SELECT * FROM (
            SELECT x.vec_id AS id_a, y.vec_id AS id_b, round({COS} / ({NORM.format("x")} * {NORM.format("y")}), 6) AS score
            FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
        ) WHERE score >= {COSINE}
    )"""


@query(f"{PAIRS_SQL} SELECT * FROM pairs", on_graph=False)
def semantic_overlap_pairs(spark, sf_dir):
    return vector.overlap_pairs(read_table(spark, sf_dir, "embeddings"), COSINE)


@query(
    "WITH RECURSIVE "
    + PAIRS_SQL[5:]
    + """, e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
    walk AS (SELECT DISTINCT a AS start, a AS id FROM e UNION SELECT start, b FROM walk JOIN e ON e.a = walk.id),
    comp AS (SELECT start AS id, min(id) AS cluster FROM walk GROUP BY 1),
    s AS (SELECT cluster, count(*) AS size FROM comp GROUP BY 1)
    SELECT cluster, size, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score FROM pairs JOIN comp ON id = id_a JOIN s USING (cluster) GROUP BY 1, 2""",
    on_graph=False,
)
def semantic_overlap_clusters(spark, sf_dir):
    return vector.clusters(vector.overlap_pairs(read_table(spark, sf_dir, "embeddings"), COSINE))


# Hybrid search: documents that have a vector and an id divisible by 100 are the
# queries, by their text in BM25 over all documents and by their vector over all
# vectors; a document's text and vector share its id.
FUSED_SQL = (
    KNN_SQL.rstrip()
    + ", "
    + _bm25_sql("SELECT doc_id AS id, text AS content FROM documents", "SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)")
    + """, t AS (SELECT query_id, id, rank AS rt FROM top WHERE rank <= 100), v AS (SELECT query_id, id, rank AS rv FROM knn WHERE rank <= 100),
    f AS (
        SELECT k, query_id, id, round(coalesce(0.5 / (k + rt), 0) + coalesce(0.5 / (k + rv), 0), 8) AS score
        FROM (t FULL JOIN v USING (query_id, id)), (VALUES (10), (20), (40), (60), (80), (100)) ks(k)
    ), fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM f)"""
)
QUALITY_SQL = (
    FUSED_SQL
    + """, rel AS (SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0),
    tot AS (SELECT query_id, count(*) AS total FROM rel GROUP BY 1),
    hit AS (SELECT fused.*, CASE WHEN rel.id IS NULL THEN 0 ELSE 1 END AS h FROM fused LEFT JOIN rel ON rel.query_id = fused.query_id AND rel.id = fused.id WHERE rank <= 10),
    cum AS (SELECT *, sum(h) OVER (PARTITION BY k, query_id ORDER BY rank) AS c FROM hit),
    per AS (
        SELECT k, query_id, sum(h / log2(rank + 1)) AS dcg, max(CASE WHEN h = 1 THEN 1.0 / rank END) AS rr, sum(CASE WHEN h = 1 THEN CAST(c AS DOUBLE) / rank END) AS ap, sum(h) AS found, count(*) AS n
        FROM cum GROUP BY 1, 2
    ), q AS (
        SELECT k, query_id, round(coalesce(dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, CAST(least(total, 10) AS BIGINT) + 1)]), 0), 6) AS ndcg, round(coalesce(rr, 0), 6) AS mrr,
               round(coalesce(ap / total, 0), 6) AS map, round(CAST(found AS DOUBLE) / total, 6) AS recall, round(CAST(found AS DOUBLE) / n, 6) AS precision
        FROM per JOIN tot USING (query_id)
    )"""
)


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of each query the 100 best by text and by vector."""
    v, docs = read_table(spark, sf_dir, "embeddings"), read_table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 100 = 0").join(v.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    by_text = ranking.bm25_top(documents_chunks(docs), asked.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), 100)
    return materialize(by_text, "by-text"), materialize(_knn(spark, sf_dir, 100), "by-vector")


def _relevant(spark: SparkSession, sf_dir: str, *lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relevant are vectors with the query's label: those among the lists, and how many there are."""
    kinds = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    mine = kinds.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    listed = reduce(DataFrame.union, [x.select("query_id", "id") for x in lists]).distinct()
    pairs = listed.join(mine, "query_id").join(kinds, ["id", "label"]).select("query_id", "id")
    sizes = kinds.groupBy("label").agg(F.count("*").alias("n"))
    totals = mine.join(sizes, "label").groupBy("query_id").agg(F.sum("n").alias("total"))
    return materialize(pairs, "relevant"), materialize(totals, "relevant-totals")


@query(f"{FUSED_SQL} SELECT query_id, id, score, rank FROM fused WHERE k = 60 AND rank <= 10", on_graph=False)
def hybrid_rrf(spark, sf_dir):
    return search.fuse(*_lists(spark, sf_dir))


@query(f"{QUALITY_SQL} SELECT query_id, ndcg, mrr, map, recall, precision FROM q WHERE k = 60", on_graph=False)
def ndcg_mrr_map(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    pairs, totals = _relevant(spark, sf_dir, *lists)
    return search.quality(search.fuse(*lists, None), pairs, totals=totals)


@query(f"{QUALITY_SQL} SELECT CAST(k AS BIGINT) AS k, round(avg(ndcg), 5) AS ndcg FROM q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", on_graph=False)
def tune_k(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    pairs, totals = _relevant(spark, sf_dir, *lists)
    return search.tune_k(*lists, pairs, totals=totals)


PROMPT = "which must_use functions derive Hash or Debug in NATION_3"
SCORED_SQL = f"""WITH seed AS (SELECT '{ITEM}' AS id),
    {_bm25_sql("SELECT id, qualified_name || ' ' || coalesce(attr_text, '') AS content FROM nodes WHERE kind = 'Item'", f"SELECT 0 AS query_id, '{PROMPT}' AS query", "bm")},
    tx AS (SELECT nodes.id, coalesce(score, 0.0) AS text_score FROM nodes LEFT JOIN bm ON bm.id = nodes.id WHERE kind = 'Item'),
    e AS (SELECT DISTINCT consumer_function AS s, target AS t FROM usages),
    back AS (
        SELECT t, s FROM (
            SELECT e.t, e.s, row_number() OVER (PARTITION BY e.t ORDER BY floor(text_score * 1000) DESC, n.qualified_name) AS r
            FROM e JOIN tx ON tx.id = e.s JOIN nodes n ON n.id = e.s JOIN nodes d ON d.id = e.t
            WHERE d.item_kind IN ('Function', 'Method', 'AssocFunction', 'Struct', 'Enum', 'Union', 'Trait', 'TypeAlias')
        ) WHERE r <= 8
    ), hop AS (SELECT s AS a, t AS b FROM e UNION SELECT t, s FROM back),
    d1 AS (SELECT DISTINCT b AS id FROM hop JOIN seed ON a = id WHERE b NOT IN (SELECT id FROM seed)),
    d2 AS (SELECT DISTINCT b AS id FROM hop JOIN d1 ON a = id WHERE b NOT IN (SELECT id FROM seed) AND b NOT IN (SELECT id FROM d1)),
    d3 AS (SELECT DISTINCT b AS id FROM hop JOIN d2 ON a = id WHERE b NOT IN (SELECT id FROM seed) AND b NOT IN (SELECT id FROM d1) AND b NOT IN (SELECT id FROM d2)),
    f AS (SELECT id, 0 AS d FROM seed UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2 UNION ALL SELECT id, 3 FROM d3),
    scored AS (SELECT id, CAST(d AS BIGINT) AS distance, round(0.6 * text_score / (SELECT max(text_score) FROM tx) + 0.4 * (1.0 / (1 + d)), 6) AS score FROM f JOIN tx USING (id)),
    ranked AS (
        SELECT id, qualified_name AS item, item_kind, distance, score, CAST(row_number() OVER (ORDER BY CASE WHEN distance = 0 THEN 0 ELSE 1 END, score DESC, qualified_name) AS BIGINT) AS rank
        FROM scored JOIN nodes USING (id)
    )"""


def _codemap(g: Graph) -> DataFrame:
    items = g.nodes.where("kind = 'Item'")
    chunks = items.select("id", F.concat("qualified_name", F.lit(" "), F.array_join("attributes", "\n")).alias("content"))
    asked = items.sparkSession.createDataFrame([(0, PROMPT)], "query_id long, query string")
    scores = materialize(text.bm25(chunks, asked, "id").select("id", F.col("score").alias("text_score")), "codemap-text")
    seeds = items.where(F.col("id") == ITEM).select("id")
    return search.relevance(search.expand(g, seeds, scores, 3), scores)


@query(f"{SCORED_SQL} SELECT * FROM scored")
def codemap_score(g):
    return _codemap(g)


@query(f"{SCORED_SQL} SELECT item, distance, score, rank FROM ranked WHERE rank <= 80")
def codemap_prune(g):
    return search.prune(_codemap(g), g).select("item", "distance", "score", "rank")


@query(
    f"""{SCORED_SQL} SELECT a.item AS caller, b.item AS callee, CASE WHEN b.item_kind IN ('Function', 'Method', 'AssocFunction') THEN 'Calls' ELSE 'Uses' END AS edge
    FROM e JOIN ranked a ON a.id = e.s JOIN ranked b ON b.id = e.t WHERE a.rank <= 80 AND b.rank <= 80"""
)
def codemap_edges(g):
    return search.retained_edges(g, materialize(search.prune(_codemap(g), g), "codemap-kept"))


# State ---------------------------------------------------------------------

STATES_SQL = """WITH v1 AS (SELECT doc_id AS path, sha256(text) AS h FROM documents),
    v2 AS (
        SELECT doc_id AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0
        UNION ALL SELECT doc_id + 1000000000, sha256(text) FROM documents WHERE doc_id % 19 = 0
    )"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files, and a later state with files gone, altered and new."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    kept = d.where("path % 17 <> 0").withColumn("content", F.when(F.col("path") % 13 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    fresh = d.where("path % 19 = 0").withColumn("path", F.col("path") + 1000000000)
    return d, kept.unionByName(fresh)


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    first, later = _files(spark, sf_dir)
    return incremental.file_state(first), incremental.file_state(later)


@query(
    f"""{STATES_SQL} SELECT coalesce(v1.path, v2.path) AS path, CASE WHEN v1.h IS NULL THEN 'added' WHEN v2.h IS NULL THEN 'deleted' ELSE 'modified' END AS change
    FROM v1 FULL JOIN v2 ON v1.path = v2.path WHERE v1.h IS NULL OR v2.h IS NULL OR v1.h <> v2.h""",
    on_graph=False,
)
def merkle_diff(spark, sf_dir):
    return incremental.diff(*_states(spark, sf_dir))


@query(
    """SELECT doc_id AS id, 'vector' AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT vec_id, 'text' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""",
    on_graph=False,
)
def consistency_check(spark, sf_dir):
    return incremental.consistency(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query(
    f"""{STATES_SQL}, a AS (SELECT 'files' AS metric, count(*) AS before FROM v1 UNION ALL SELECT 'distinct', count(DISTINCT h) FROM v1),
    b AS (SELECT 'files' AS metric, count(*) AS after FROM v2 UNION ALL SELECT 'distinct', count(DISTINCT h) FROM v2)
    SELECT metric, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, CAST(after - before AS DOUBLE) AS delta FROM a JOIN b USING (metric)""",
    on_graph=False,
)
def snapshot_diff(spark, sf_dir):
    def stats(s: DataFrame) -> DataFrame:
        m = F.create_map(F.lit("files"), F.count("*"), F.lit("distinct"), F.count_distinct("content_hash"))
        return s.agg(m.alias("m")).select(F.explode("m").alias("metric", "value")).withColumn("value", F.col("value").cast("double"))

    return incremental.compare_metrics(*map(stats, _states(spark, sf_dir)))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN value END) AS p50,
           max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN value END) AS p95, max(CASE WHEN i = least(floor(n * 0.99), n - 1) THEN value END) AS p99
    FROM r GROUP BY 1""",
    on_graph=False,
)
def latency_percentiles(spark, sf_dir):
    return incremental.percentiles(read_table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT user_id, round(CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) / count(*), 6) AS error_rate, count(*) AS n FROM events GROUP BY 1", on_graph=False)
def error_rates(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    return rows.select("user_id", incremental.ratio(F.col("e"), F.col("n")).alias("error_rate"), "n")


@query("SELECT doc_id AS id, min(doc_id) OVER w AS first_id, count(*) OVER w AS size FROM documents WINDOW w AS (PARTITION BY sha256(text)) QUALIFY count(*) OVER w > 1", on_graph=False)
def exact_groups(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return vector.exact_pairs(docs, "doc_id", "h")


MESSAGES = "CASE event_type WHEN 'error' THEN 'Permission denied: ' || user_id WHEN 'view' THEN 'file NOT FOUND' WHEN 'click' THEN 'invalid utf-8 in ' || user_id ELSE 'timed out after ' || user_id END"


@query(
    f"""WITH m AS (SELECT lower({MESSAGES}) AS m FROM events)
    SELECT CASE WHEN contains(m, 'permission denied') OR contains(m, 'not found') OR contains(m, 'invalid utf') OR contains(m, 'is a directory') THEN 'Permanent' ELSE 'Transient' END AS category, count(*) AS n FROM m GROUP BY 1""",
    on_graph=False,
)
def errors_by_category(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select(incremental.error_category(F.expr(MESSAGES)).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT n_regionkey, CASE n_nationkey % 5 WHEN 0 THEN 'bm25' WHEN 1 THEN 'vector' ELSE 'merkle' END AS component, CASE WHEN n_nationkey % 3 = 0 OR n_regionkey = 2 THEN 'unhealthy' WHEN n_regionkey = 4 THEN 'degraded' ELSE 'healthy' END AS status FROM nation),
    c AS (SELECT count(*) FILTER (WHERE component IN ('bm25', 'vector') AND status = 'unhealthy') AS bad, count(*) FILTER (WHERE status <> 'healthy') AS odd FROM s)
    SELECT CASE WHEN bad = 2 THEN 'unhealthy' WHEN odd > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM c""",
    on_graph=False,
)
def health_rollup(spark, sf_dir):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    component = F.when(n % 5 == 0, F.lit("bm25")).when(n % 5 == 1, F.lit("vector")).otherwise(F.lit("merkle"))
    status = F.when((n % 3 == 0) | (r == 2), F.lit("unhealthy")).when(r == 4, F.lit("degraded")).otherwise(F.lit("healthy"))
    return incremental.health(read_table(spark, sf_dir, "nation").select(component.alias("component"), status.alias("status")))


@query(
    """WITH t AS (SELECT doc_id % 64 AS batch, CAST(greatest(1, ceil(octet_length(encode(text)) / 4.0)) AS BIGINT) AS n FROM documents),
    b AS (SELECT batch, sum(n) AS r, sum(least(n, 512)) AS c, min(least(n, 512)) AS lo, max(least(n, 512)) AS hi, max(least(n, 512)) * count(*) AS p FROM t GROUP BY 1)
    SELECT CAST(sum(r) AS BIGINT) AS raw_tokens, CAST(sum(c) AS BIGINT) AS capped_tokens, min(lo) AS shortest, max(hi) AS longest, CAST(sum(p) AS BIGINT) AS padded_tokens FROM b""",
    on_graph=False,
)
def token_batch_summary(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 64).alias("batch"), chunking.estimated_tokens(F.col("text")).alias("n"))
    return incremental.token_batches(rows)


@query("SELECT * FROM (" + _sql["crate_dependency_metric"] + ") ORDER BY efferent DESC, crate_name LIMIT 10", on_graph=False)
def metric_ranking(spark, sf_dir):
    return relations.rank_metric(relations.dependency_metric(graph(spark, sf_dir)), "efferent", 10)


@query(f"SELECT qualified_name AS item, display_name = (SELECT display_name FROM nodes WHERE id = '{ITEM}') AS is_exact, file, span_start AS start FROM nodes WHERE kind = 'Item' AND contains(lower(display_name), lower((SELECT display_name FROM nodes WHERE id = '{ITEM}')))")
def find_definition(g):
    return navigate.find_definition(g, g.nodes.where(F.col("id") == ITEM).select("display_name").first()[0])


@query(
    f"""WITH i AS (SELECT id, qualified_name AS item, file, span_start FROM nodes WHERE kind = 'Item' AND display_name = (SELECT display_name FROM nodes WHERE id = '{ITEM}') ORDER BY id LIMIT 50),
    r AS (SELECT item, file, span_start AS start, 'declaration' AS what FROM i UNION ALL SELECT item, u.file, start, 'usage' FROM usages u JOIN i ON i.id = target)
    SELECT item, file, start, min(what) AS what FROM r GROUP BY 1, 2, 3"""
)
def find_references(g):
    return navigate.references(g, g.nodes.where(F.col("id") == ITEM).select("display_name").first()[0])


PATHS = "CASE p_size % 8 WHEN 0 THEN 'src/.env.local' WHEN 1 THEN 'a/secrets/k.txt' WHEN 2 THEN 'deploy/id.pem' WHEN 3 THEN 'src/lib.rs' WHEN 4 THEN '.env' WHEN 5 THEN 'x/my_password_list' WHEN 6 THEN 'target/debug/a.rs' ELSE 'src/' || p_name || '.rs' END"


@query(f"""SELECT p_partkey, {PATHS} AS path, regexp_matches({PATHS}, '{"|".join(f"(?:{filters.glob_regex(x)})" for x in filters.SENSITIVE)}') AS sensitive FROM part""", on_graph=False)
def sensitive_paths(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.expr(PATHS).alias("path"))
    return rows.withColumn("sensitive", filters.is_sensitive(F.col("path")))


# Recipes -------------------------------------------------------------------


@query(
    """WITH o AS (SELECT consumer_function AS id, count(DISTINCT target) AS n FROM usages GROUP BY 1), u AS (SELECT target AS id, count(*) AS n FROM usages GROUP BY 1)
    SELECT qualified_name AS item, coalesce(o.n, 0) AS out_degree, coalesce(u.n, 0) AS usages, coalesce(o.n, 0) * coalesce(u.n, 0) AS priority
    FROM nodes LEFT JOIN o ON o.id = nodes.id LEFT JOIN u ON u.id = nodes.id WHERE item_kind IN ('Function', 'Method')"""
)
def blast_radius(g):
    return recipes.blast_radius(g)


def _density_sql(home: str) -> str:
    return f"""WITH h AS ({home}), x AS (SELECT a.c AS src, b.c AS dst FROM usages JOIN h a ON a.id = consumer_module JOIN h b ON b.id = target),
    d AS (SELECT src, count(*) FILTER (WHERE src = dst) AS internal, count(*) FILTER (WHERE src <> dst) AS external FROM x GROUP BY 1)
    SELECT qualified_name AS container, internal, external, round(CAST(internal AS DOUBLE) / (internal + external), 6) AS share, internal > external AS is_boundary FROM d JOIN nodes ON id = src"""


@query(
    _density_sql(
        """SELECT n.id, CASE WHEN n.kind IN ('Module', 'Crate', 'ExternalSymbol') THEN n.id WHEN p.kind IN ('Module', 'Crate', 'ExternalSymbol') THEN p.id ELSE p.parent_id END AS c
        FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id"""
    )
)
def boundary_density(g):
    return recipes.boundary_density(g)


@query(_density_sql("SELECT id, crate_id AS c FROM nodes WHERE crate_id IS NOT NULL"))
def crate_boundary_density(g):
    return recipes.boundary_density(g, "crate")


@query(
    """WITH x AS (SELECT consumer_function AS id, t.crate_id AS dst, count(*) AS n FROM usages JOIN nodes t ON t.id = target WHERE t.crate_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT i.qualified_name AS item, i.crate_id AS home, dst, n, row_number() OVER (PARTITION BY i.id ORDER BY n DESC, dst <> i.crate_id, dst) AS r FROM x JOIN nodes i ON i.id = x.id)
    SELECT item, a.qualified_name AS home, b.qualified_name AS best, n FROM r JOIN nodes a ON a.id = home JOIN nodes b ON b.id = dst WHERE r = 1 AND home <> dst"""
)
def misplaced_functions(g):
    return recipes.alignment(g)


@query(
    """WITH s AS (SELECT target, from_module AS m, 1 AS i FROM bindings WHERE kind <> 'Declared' UNION ALL SELECT target, consumer_module, 0 FROM usages),
    r AS (
        SELECT t.qualified_name AS item, count(DISTINCT CASE WHEN i = 1 THEN m END) AS importers, count(DISTINCT CASE WHEN i = 0 THEN m END) AS users,
               count(DISTINCT CASE WHEN c.crate_id <> t.crate_id THEN c.crate_id END) AS crates
        FROM nodes t LEFT JOIN s ON target = t.id LEFT JOIN nodes c ON c.id = m WHERE t.item_kind = 'Trait' GROUP BY 1
    ) SELECT *, CASE WHEN crates = 0 THEN 'seal' WHEN importers = 1 AND users <= 1 THEN 'inline' ELSE 'keep' END AS verdict FROM r"""
)
def trait_audit(g):
    return recipes.trait_audit(g)


@query(
    """WITH u AS (SELECT target, count(*) AS n, count(*) FILTER (WHERE category = 'Test') AS tests FROM usages GROUP BY 1)
    SELECT qualified_name AS item, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'dead' WHEN tests = n THEN 'test_only' WHEN tests = 0 THEN 'critical' ELSE 'mixed' END AS class
    FROM nodes LEFT JOIN u ON target = id WHERE item_kind = 'Method'"""
)
def method_fate(g):
    return recipes.method_fate(g)


@query("SELECT c.qualified_name AS crate_name, m.id AS root_id FROM nodes c JOIN nodes m ON m.parent_id = c.id AND m.kind = 'Module' AND m.qualified_name = c.qualified_name WHERE c.kind = 'Crate'")
def root_modules(g):
    return recipes.root_modules(g)


NAMES = ("NATION_3", "NATION_3::nowhere", "nowhere")


@query(
    """WITH a(name, parent) AS (VALUES ('NATION_3', ''), ('NATION_3::nowhere', 'NATION_3'), ('nowhere', '')),
    n AS (SELECT qualified_name, min(id) AS id, max(CASE WHEN kind = 'Module' THEN 1 ELSE 0 END) AS m FROM nodes GROUP BY 1)
    SELECT name, n.id, CASE WHEN n.id IS NULL THEN 'unresolved seed: ' || name || CASE WHEN p.m = 1 THEN ' (its module is there; it may be private or not indexed)' ELSE '' END END AS diagnostic
    FROM a LEFT JOIN n ON n.qualified_name = name LEFT JOIN n p ON p.qualified_name = parent"""
)
def codemap_seeds_by_name(g):
    return search.seeds_by_name(g, NAMES)


HITS_SQL = """WITH h AS (
        SELECT usage_id AS hit_id, coalesce(n.file, 'none') AS file, coalesce(n.span_start, 0) + 3 AS lo, coalesce(n.span_start, 0) + 5 AS hi, start AS rank, weight AS score FROM usages JOIN nodes n ON n.id = target WHERE category = 'Test'
    ), m AS (
        SELECT hit_id, n.id, n.item_kind, row_number() OVER (PARTITION BY hit_id ORDER BY span_end - span_start, span_start, n.id) AS r
        FROM h JOIN nodes n ON n.file = h.file AND span_start <= lo AND hi <= span_end
    ), x AS (SELECT h.*, id, item_kind FROM h LEFT JOIN m ON m.hit_id = h.hit_id AND r = 1),
    ok AS (SELECT * FROM x WHERE item_kind IN ('Function', 'Method', 'AssocFunction', 'Struct', 'Enum', 'Union', 'Trait', 'TypeAlias'))"""


def _search_hits(g: Graph) -> DataFrame:
    at = g.nodes.select(F.col("id").alias("target"), F.col("file").alias("f"), "span_start")
    rows = g.usages.where("category = 'Test'").join(at, "target")
    return rows.select(F.col("usage_id").alias("hit_id"), F.coalesce("f", F.lit("none")).alias("file"), (F.coalesce("span_start", F.lit(0)) + 3).alias("lo"), (F.coalesce("span_start", F.lit(0)) + 5).alias("hi"), F.col("start").alias("rank"), F.col("weight").alias("score"))


@query(f"{HITS_SQL} SELECT id, min(rank) AS rank FROM ok GROUP BY 1 ORDER BY 2, 1 LIMIT 20")
def codemap_seeds_by_hits(g):
    return search.seeds_by_hits(g, _search_hits(g))


@query(f"{HITS_SQL} SELECT count(*) FILTER (WHERE id IS NULL) AS unresolved, count(*) FILTER (WHERE id IS NOT NULL AND hit_id NOT IN (SELECT hit_id FROM ok)) AS other_kind FROM x")
def codemap_dropped_hits(g):
    return search.dropped_hits(g, _search_hits(g))


@query(f"{HITS_SQL} SELECT id, round(sum(score), 6) AS score FROM x WHERE id IS NOT NULL GROUP BY 1")
def bm25_by_node(g):
    return search.scores_by_node(g, _search_hits(g))


@on_sources(
    """SELECT sha256('src/a/' || id || '.rs' || chr(0) || id || chr(0) || '1' || chr(0) || '1') AS chunk_id, 'src/a/' || id || '.rs' AS file_path, 'crate::a::' || id AS module_path, id AS symbol_name, 'function' AS symbol_kind,
    CAST(1 AS BIGINT) AS line_start, CAST(2 AS BIGINT) AS line_end, array_to_string(string_split(body, chr(10))[1:2], chr(10)) AS content FROM sources"""
)
def chunk_files(spark, sf_dir):
    """The first two lines of every function as a chunk."""
    path = F.concat(F.lit("src/a/"), "doc_id", F.lit(".rs"))
    src = _sources(spark, sf_dir).select(path.alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("name"))
    symbols = src.select("path", "name", F.lit("function").alias("kind"), F.lit(1).cast("long").alias("line_start"), F.lit(2).cast("long").alias("line_end"))
    return chunking.chunk_files(src.select("path", "content"), symbols)


ASKED = "SELECT n_nationkey AS query_id, n_name || ' derive ' || chr(32) || CASE WHEN n_nationkey % 2 = 0 THEN 'Hash' ELSE 'must_use part_' || CAST(n_nationkey AS STRING) END AS query FROM {nation}"


@query(
    "WITH "
    + ", ".join(_bm25_sql(f"SELECT id, coalesce({f}, '') AS content FROM nodes WHERE kind = 'Item'", ASKED.format(nation="nation"), n) for n, f in (("a", "qualified_name"), ("b", "display_name"), ("d", "attr_text")))
    + """, s AS (SELECT query_id, id, round(sum(score), 6) AS score FROM (SELECT query_id, id, score FROM a UNION ALL SELECT query_id, id, score FROM b UNION ALL SELECT query_id, id, score FROM d) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank FROM s) SELECT * FROM r WHERE rank <= 10"""
)
def symbol_search(g):
    """BM25 over content, symbol name and documentation of all items."""
    items = g.nodes.where("kind = 'Item'").select("id", "qualified_name", "display_name", F.array_join("attributes", "\n").alias("docs"))
    crates = g.nodes.where("kind = 'Crate'").select(F.substring("id", 2, 9).cast("long").alias("n_nationkey"), F.col("display_name").alias("n_name"))
    asked = g.nodes.sparkSession.sql(ASKED, nation=crates)
    return text.top_k(text.bm25_fields(items, asked, ["qualified_name", "display_name", "docs"], "id"), 10)


@query(
    f"""WITH c AS ({_sql["semantic_overlap_clusters"].replace("WITH RECURSIVE ", "WITH RECURSIVE ", 1)}),
    r AS (SELECT *, CAST(row_number() OVER (ORDER BY avg_score DESC, size DESC, cluster) AS BIGINT) AS rank FROM c),
    p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE rank > 2)
    SELECT cluster, size, avg_score, min_score, rank, CAST(least(size, 40 - before) AS BIGINT) AS shown FROM p WHERE before < 40""",
    on_graph=False,
)
def overlap_cluster_page(spark, sf_dir):
    found = materialize(vector.clusters(vector.overlap_pairs(read_table(spark, sf_dir, "embeddings"), COSINE)), "clusters")
    return vector.cluster_page(found, 40, 2)


# Incremental index ---------------------------------------------------------

CHANGED_SQL = f"""{STATES_SQL}, k AS (SELECT coalesce(v1.path, v2.path) AS path, CASE WHEN v1.h IS NULL THEN 'added' WHEN v2.h IS NULL THEN 'deleted' WHEN v1.h <> v2.h THEN 'modified' ELSE 'same' END AS change FROM v1 FULL JOIN v2 ON v1.path = v2.path)"""


@query(f"{CHANGED_SQL} SELECT 2 AS run, change, count(*) AS files FROM k WHERE change <> 'same' GROUP BY 2 UNION ALL SELECT 1, 'added', count(*) FROM v1", on_graph=False)
def index_runs(spark, sf_dir):
    """Changes that three runs of the incremental index find: all files, a later state, nothing."""
    index = _index(spark, sf_dir)
    return index.log().groupBy("run", "change").agg(F.count("*").alias("files"))


@query(f"{CHANGED_SQL} SELECT path, h AS content_hash, CASE WHEN change = 'same' THEN 1 ELSE 2 END AS run FROM k JOIN v2 USING (path)", on_graph=False)
def index_state(spark, sf_dir):
    """The index after these runs: which run indexed each file last."""
    return _index(spark, sf_dir).open().select("path", "content_hash", "run")


def _index(spark: SparkSession, sf_dir: str) -> incremental.IncrementalIndex:
    first, later = _files(spark, sf_dir)
    index = incremental.IncrementalIndex(spark, new_path(spark, "index"), lambda files: files.select("path", F.octet_length("content").alias("bytes")))
    for files in (first, later, later):
        index.update(files)
    return index


# Streams -------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", on_graph=False)
def stream_tumbling(spark, sf_dir):
    return windows.run_available(windows.tumbling(windows.read_events(spark, f"{sf_dir}/events.parquet")), "tumbling")


@query("SELECT date_trunc('hour', ts) - to_hours(h) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(h) GROUP BY 1, 2", on_graph=False)
def stream_sliding(spark, sf_dir):
    return windows.run_available(windows.sliding(windows.read_events(spark, f"{sf_dir}/events.parquet")), "sliding")


@query(
    """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY user_id, k""",
    on_graph=False,
)
def stream_session(spark, sf_dir):
    return windows.run_available(windows.sessions(windows.read_events(spark, f"{sf_dir}/events.parquet")), "sessions")
