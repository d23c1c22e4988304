"""Coverage questions over a property graph as joins of node and edge frames (GRA-01 .. GRA-12).

nodes: id, label, props map<string,string>, lists map<string,array<string>>
edges: src, dst, type, evidence
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Graph:
    """Node and edge frames with the few access paths the questions use."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def label(self, name: str, prefix: str, /, **props: str) -> DataFrame:
        """Nodes of a label: ``<prefix>_id`` and the asked properties as columns."""
        return self.nodes.filter(F.col("label") == name).select(
            F.col("id").alias(f"{prefix}_id"), *[F.try_element_at("props", F.lit(p)).alias(f"{prefix}_{c}") for c, p in props.items()])

    def lists(self, name: str, prefix: str, prop: str) -> DataFrame:
        return self.nodes.filter(F.col("label") == name).select(
            F.col("id").alias(f"{prefix}_id"), F.coalesce(F.try_element_at("lists", F.lit(prop)), F.array().cast("array<string>"))
            .alias(f"{prefix}_{prop}"))

    def edge(self, kind: str, src: str, dst: str, evidence: bool = False) -> DataFrame:
        cols = [F.col("src").alias(f"{src}_id"), F.col("dst").alias(f"{dst}_id"), *([F.col("evidence")] if evidence else [])]
        return self.edges.filter(F.col("type") == kind).select(*cols)


_FLOW = {"name": "name", "number": "flow_number", "type": "flow_type", "automated": "automated"}


def graph_schema(g: Graph) -> DataFrame:
    """GRA-01: counts of labels and edge types and number of distinct properties per label."""
    labels = g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    props = g.nodes.select("label", F.explode(F.map_keys("props")).alias("p")).groupBy("label").agg(
        F.array_join(F.array_sort(F.collect_set("p")), ",").alias("properties"))
    kinds = g.edges.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(props, "label", "left").withColumn("kind", F.lit("node")).unionByName(
        kinds.withColumns({"kind": F.lit("edge"), "properties": F.lit(None).cast("string")}))


def services_per_line(g: Graph) -> DataFrame:
    """GRA-02: services of every product line."""
    return g.label("ProductLine", "line", name="name").join(g.edge("CONTAINS", "line", "svc"), "line_id", "left").groupBy(
        "line_name").agg(F.countDistinct("svc_id").alias("services"))


def features_per_service(g: Graph) -> DataFrame:
    """GRA-02: features and flows of every service; flows are counted per feature first."""
    feats = g.label("Service", "svc", name="name").join(g.edge("HAS_FEATURE", "svc", "feat"), "svc_id", "left")
    return feats.join(g.edge("HAS_FLOW", "feat", "flow"), "feat_id", "left").groupBy("svc_name").agg(
        F.countDistinct("feat_id").alias("features"), F.countDistinct("flow_id").alias("flows"))


def flows_per_feature(g: Graph) -> DataFrame:
    """GRA-02: flows of every feature with its service."""
    flows = g.edge("HAS_FLOW", "feat", "flow").groupBy("feat_id").agg(F.count(F.lit(1)).alias("flows"))
    return (g.label("Service", "svc", name="name").join(g.edge("HAS_FEATURE", "svc", "feat"), "svc_id")
            .join(g.label("Feature", "feat", name="name"), "feat_id").join(flows, "feat_id", "left")
            .select("feat_name", "svc_name", F.coalesce("flows", F.lit(0)).alias("flows")))


def symmetric_edges(g: Graph, kind: str) -> DataFrame:
    """GRA-03: edges of a type and pairs that run both ways.

    Each edge is counted under its unordered ends, so no edge is joined to another.
    """
    e = g.edges.filter(F.col("type") == kind)
    ends = e.filter("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.countDistinct("src").alias("ways"))
    pairs = ends.agg(F.count_if(F.col("ways") == 2))
    return e.agg(F.count(F.lit(1)).alias("edges")).withColumn("symmetric_pairs", pairs.scalar())


def graph_search(nodes: DataFrame, text: str, limit: int) -> DataFrame:
    """GRA-04: nodes whose name, description or display name contains a text, with a snippet."""
    def prop(p: str) -> Column:
        return F.try_element_at("props", F.lit(p))

    rule = F.lit(False)
    for p in ("name", "description", "display_name"):
        rule = rule | F.contains(F.lower(F.coalesce(prop(p), F.lit(""))), F.lit(text.lower()))
    return nodes.filter(rule).select("label", prop("name").alias("name"), F.substring(
        F.coalesce(prop("description"), prop("display_name"), F.lit("")), 1, 240).alias("snippet")).orderBy("label", "name").limit(limit)


def _named(df: DataFrame, col: str, name: str) -> DataFrame:
    return df.filter(F.contains(F.lower(col), F.lit(name.lower())))


def feature_detail(g: Graph, name: str) -> DataFrame:
    """GRA-05: features by name with service, product lines and flows."""
    feats = _named(g.label("Feature", "feat", name="name"), "feat_name", name)
    rows = feats.join(g.edge("HAS_FEATURE", "svc", "feat"), "feat_id").join(g.label("Service", "svc", name="name"), "svc_id")
    lines = g.edge("CONTAINS", "line", "svc").join(g.label("ProductLine", "line", name="name", sku="sku"), "line_id").select(
        "svc_id", F.concat("line_name", F.lit(" ("), F.coalesce("line_sku", F.lit("?")), F.lit(")")).alias("line"))
    flows = g.edge("HAS_FLOW", "feat", "flow").groupBy("feat_id").agg(F.count(F.lit(1)).alias("flows"))
    return rows.join(lines, "svc_id", "left").join(flows, "feat_id", "left").groupBy("feat_name", "svc_name", "flows").agg(
        F.array_sort(F.collect_set("line")).alias("product_lines")).withColumn("flows", F.coalesce("flows", F.lit(0)))


def list_flows(g: Graph, feature: str | None = None, flow_type: str | None = None, automated: int | None = None,
               limit: int | None = None) -> DataFrame:
    """GRA-06: flows by feature name, type and automation, each optional."""
    feats, flows = g.label("Feature", "feat", name="name"), g.label("Flow", "flow", **_FLOW)
    if feature is not None:
        feats = _named(feats, "feat_name", feature)
    if flow_type is not None:
        flows = flows.filter(F.lower("flow_type") == flow_type.lower())
    if automated is not None:
        flows = flows.filter(F.col("flow_automated") == str(automated))
    number = F.col("flow_number").cast("bigint")
    rows = (feats.join(g.edge("HAS_FLOW", "feat", "flow"), "feat_id").join(flows, "flow_id")
            .select("feat_name", number.alias("flow_number"), "flow_name", "flow_type", "flow_automated")
            .orderBy("feat_name", "flow_number", "flow_name"))
    return rows if limit is None else rows.limit(limit)


def flow_detail(g: Graph, name: str | None = None, number: int | None = None) -> DataFrame:
    """GRA-07: the first flow by number that fits, its conditions and the flows related to it (either way)."""
    flows = g.label("Flow", "flow", **_FLOW)
    pick = flows.filter((F.col("flow_number") == str(number)) if number is not None
                        else F.contains(F.lower("flow_name"), F.lit((name or "").lower())))
    one = pick.orderBy(F.col("flow_number").cast("bigint"), "flow_name").limit(1).select("flow_id", "flow_name")
    cond = g.label("DeviceCondition", "cond", name="name")

    def conditions(kind: str) -> DataFrame:
        return (one.join(g.edge(kind, "flow", "cond"), "flow_id").join(cond, "cond_id")
                .select("flow_name", F.lit(kind).alias("relation"), F.col("cond_name").alias("other")))

    both = g.edge("IS_DEPENDENT_ON", "flow", "other").union(
        g.edge("IS_DEPENDENT_ON", "other", "flow").select("flow_id", "other_id")).distinct()
    related = (one.join(both, "flow_id").join(flows.select(F.col("flow_id").alias("other_id"), F.col("flow_name").alias("other")), "other_id")
               .select("flow_name", F.lit("IS_DEPENDENT_ON").alias("relation"), "other").distinct())
    return conditions("REQUIRES_CONDITION").union(conditions("EXCLUDES_CONDITION")).union(related)


def _line_features(g: Graph, sku: str) -> DataFrame:
    line = g.label("ProductLine", "line", name="name", sku="sku")
    line = line.filter((F.lower("line_name") == sku.lower()) | (F.lower("line_sku") == sku.lower()))
    return (line.join(g.edge("CONTAINS", "line", "svc"), "line_id").join(g.label("Service", "svc", name="name"), "svc_id")
            .join(g.edge("HAS_FEATURE", "svc", "feat"), "svc_id").join(g.label("Feature", "feat", name="name"), "feat_id")
            .join(g.lists("Feature", "feat", "valid_device_skus"), "feat_id")
            .withColumn("fits", F.exists("feat_valid_device_skus", lambda x: F.lower(x).isin(sku.lower())
                                         | (F.lower(x) == F.lower("line_name")) | (F.lower(x) == F.lower("line_sku")))))


def applicable_flows(g: Graph, sku: str, limit: int) -> DataFrame:
    """GRA-08: flows of the features that name the product line or SKU."""
    return (_line_features(g, sku).filter("fits").join(g.edge("HAS_FLOW", "feat", "flow"), "feat_id")
            .join(g.label("Flow", "flow", **_FLOW), "flow_id").select("svc_name", "feat_name", "flow_name")
            .orderBy("svc_name", "feat_name", "flow_name").limit(limit))


def features_not_applicable(g: Graph, sku: str) -> DataFrame:
    """GRA-08: features of the line that do not name it."""
    return _line_features(g, sku).filter(~F.coalesce("fits", F.lit(False))).select("svc_name", "feat_name")


def list_conditions(g: Graph, category: str | None = None) -> DataFrame:
    """GRA-09: conditions with the numbers of flows that require and exclude them."""
    cond = g.label("DeviceCondition", "cond", name="name", category="category")
    if category is not None:
        cond = cond.filter(F.lower("cond_category") == category.lower())
    for kind, n in (("REQUIRES_CONDITION", "required_by"), ("EXCLUDES_CONDITION", "excluded_by")):
        counts = g.edge(kind, "flow", "cond").groupBy("cond_id").agg(F.countDistinct("flow_id").alias(n))
        cond = cond.join(counts, "cond_id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return cond.drop("cond_id")


def flows_for_condition(g: Graph, text: str) -> DataFrame:
    """GRA-10: flows gated by a condition, with the relation and its evidence."""
    cond = g.label("DeviceCondition", "cond", name="name", display="display_name")
    hit = cond.filter(F.contains(F.lower("cond_name"), F.lit(text.lower()))
                      | F.contains(F.lower(F.coalesce("cond_display", F.lit(""))), F.lit(text.lower())))
    gates = g.edges.filter(F.col("type").isin("REQUIRES_CONDITION", "EXCLUDES_CONDITION")).select(
        F.col("src").alias("flow_id"), F.col("dst").alias("cond_id"), F.col("type").alias("relation"), "evidence")
    return (hit.join(gates, "cond_id").join(g.label("Flow", "flow", **_FLOW), "flow_id")
            .join(g.edge("HAS_FLOW", "feat", "flow"), "flow_id").join(g.label("Feature", "feat", name="name"), "feat_id")
            .select("cond_name", "relation", "evidence", "feat_name", "flow_name"))


def coverage_gaps(g: Graph) -> DataFrame:
    """GRA-11: (gap, name, detail) rows of everything the graph leaves uncovered."""
    feats = g.label("Feature", "feat", name="name").join(g.edge("HAS_FEATURE", "svc", "feat"), "feat_id", "left_semi")
    has_flow = g.edge("HAS_FLOW", "feat", "flow")
    wanted = ("flow_type", "automated", "description", "flow_skill_path")
    flows = g.nodes.filter(F.col("label") == "Flow").select(
        F.col("id").alias("flow_id"), F.try_element_at("props", F.lit("name")).alias("flow_name"),
        F.try_element_at("props", F.lit("automated")).alias("automated"),
        F.filter(F.array(*[F.when(F.try_element_at("props", F.lit(p)).isNull(), F.lit(p)) for p in wanted]),
                 lambda x: x.isNotNull()).alias("missing")).join(has_flow, "flow_id", "left_semi")
    gates = g.edges.filter(F.col("type").isin("REQUIRES_CONDITION", "EXCLUDES_CONDITION"))

    def rows(gap: str, df: DataFrame, name: str, detail: Column | None = None) -> DataFrame:
        return df.select(F.lit(gap).alias("gap"), F.col(name).alias("name"),
                         (detail if detail is not None else F.lit("")).alias("detail"))

    parts = [
        rows("feature_without_flows", feats.join(has_flow, "feat_id", "left_anti"), "feat_name"),
        rows("flow_not_automated", flows.filter("automated = '0'"), "flow_name"),
        rows("flow_missing_properties", flows.filter(F.size("missing") > 0), "flow_name", F.array_join("missing", ",")),
        rows("flow_without_conditions", flows.join(gates.select(F.col("src").alias("flow_id")), "flow_id", "left_anti"), "flow_name"),
        rows("unused_condition", g.label("DeviceCondition", "cond", name="name").join(
            gates.select(F.col("dst").alias("cond_id")), "cond_id", "left_anti"), "cond_name"),
        rows("service_without_features", g.label("Service", "svc", name="name").join(
            g.edge("HAS_FEATURE", "svc", "feat"), "svc_id", "left_anti"), "svc_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def skill_paths(g: Graph) -> DataFrame:
    """GRA-12: stored paths of flows and features."""
    flows = (g.edge("HAS_FLOW", "feat", "flow").join(g.label("Flow", "flow", name="name", path="flow_skill_path"), "flow_id")
             .join(g.label("Feature", "feat", name="name"), "feat_id").select(
        F.lit("Flow").alias("kind"), F.col("flow_name").alias("name"), F.col("flow_path").alias("path"), F.col("feat_name").alias("parent")))
    feats = (g.lists("Feature", "feat", "skill_path").join(g.label("Feature", "feat", name="name"), "feat_id")
             .join(g.edge("HAS_FEATURE", "svc", "feat"), "feat_id").join(g.label("Service", "svc", name="name"), "svc_id").select(
        F.lit("Feature").alias("kind"), F.col("feat_name").alias("name"), F.explode("feat_skill_path").alias("path"),
        F.col("svc_name").alias("parent")))
    return flows.union(feats).distinct()
