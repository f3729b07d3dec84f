"""The property graph as node and edge tables: building, enriching, cleaning and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["h_label", "h_name", "type", "t_label", "t_name"]
NUMBER = r"(\d+(?:\.\d+)?)"


def nodes_of(mentions: DataFrame, name: str = "text", label: str = "label", order: list[str] | None = None) -> DataFrame:
    """Distinct (label, name); the first mention gives the other properties. min_by pre-aggregates, so hubs don't skew."""
    rest = [c for c in mentions.columns if c not in (name, label)]
    first = F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("p")
    return mentions.groupBy(F.col(label).alias("label"), F.col(name).alias("name")).agg(first).select("label", "name", "p.*")


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct nodes at either end; distinct before the union, so hubs shrink map-side."""
    h = edges.select(F.col("h_label").alias("label"), F.col("h_name").alias("name")).distinct()
    return h.unionByName(edges.select(F.col("t_label").alias("label"), F.col("t_name").alias("name")).distinct()).distinct()


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("label", "name").distinct()
    h = n.select(F.col("label").alias("h_label"), F.col("name").alias("h_name"))
    t = n.select(F.col("label").alias("t_label"), F.col("name").alias("t_name"))
    return edges.join(h, ["h_label", "h_name"], "left_semi").join(t, ["t_label", "t_name"], "left_semi")


def edges_of(relations: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Distinct edges between known nodes; the first relation gives source and evidence, confidence defaults to 1."""
    rel = relations if "confidence" in relations.columns else relations.withColumn("confidence", F.lit(None).cast("double"))
    known = with_both_ends(rel, nodes)
    first = F.min_by(F.struct("source", "evidence", "confidence"), F.struct(*order)).alias("p")
    return known.groupBy(*KEY).agg(first).select(*KEY, "p.source", "p.evidence", F.coalesce("p.confidence", F.lit(1.0)).alias("confidence"))


def _numbers(text: Column, pattern: str, groups: list[tuple[int, int]]) -> list[Column]:
    """Numbers of a pattern's groups; (value, side) pairs, south and west negative."""
    out = []
    for value, side in groups:
        v = F.regexp_extract(text, pattern, value).try_cast("double")
        out.append(v * F.when(F.upper(F.regexp_extract(text, pattern, side)).isin("S", "W"), -1.0).otherwise(1.0) if side else v)
    return out


def parse_coordinates(text: Column) -> Column:
    """struct<geo_type, lat, lon, value, lat_min, lat_max, lon_min, lon_max> of a coordinate text; null if it is none.

    Ranges are tried first, then a point, then a single coordinate; south and west are negative.
    """
    deg = r"\s*°?\s*([NSEWnsew])"
    box = rf"^\s*{NUMBER}\s*-\s*{NUMBER}{deg}\s*,\s*{NUMBER}\s*-\s*{NUMBER}{deg}\s*$"
    point = rf"^\s*{NUMBER}{deg}\s*,\s*{NUMBER}{deg}\s*$"
    plain = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
    single = rf"^\s*{NUMBER}\s*°\s*([NSEWnsew])\s*$"
    names = ["lat", "lon", "value", "lat_min", "lat_max", "lon_min", "lon_max"]
    # the numbers of the form that the text has, in order
    values = (
        F.when(text.rlike(box), F.array(F.lit(0.0), *_numbers(text, box, [(1, 3), (2, 3), (4, 6), (5, 6)])))
        .when(text.rlike(point), F.array(F.lit(1.0), *_numbers(text, point, [(1, 2), (3, 4)])))
        .when(text.rlike(plain), F.array(F.lit(1.0), *_numbers(text, plain, [(1, 0), (2, 0)])))
        .when(text.rlike(single), F.array(F.lit(2.0), *_numbers(text, single, [(1, 2)])))
    )

    def made(v: Column) -> Column:
        kind, null = F.get(v, 0), F.lit(None).cast("double")
        at = lambda k, i: F.when(kind == k, F.get(v, i)).otherwise(null)
        pick = lambda f, i, j: F.when(kind == 0, f(F.get(v, i), F.get(v, j))).otherwise(null)
        fields = [at(1, 1), at(1, 2), at(2, 1), pick(F.least, 1, 2), pick(F.greatest, 1, 2), pick(F.least, 3, 4), pick(F.greatest, 3, 4)]
        name = F.when(kind == 0, "bounding_box").when(kind == 1, "point").when(kind == 2, "coordinate")
        return F.struct(name.alias("geo_type"), *[f.alias(n) for f, n in zip(fields, names, strict=True)])

    # a lambda binds the numbers once, so they aren't computed again for each field
    return F.get(F.transform(F.filter(F.array(values), lambda v: v.isNotNull()), made), 0)


def geocode(name: Column, marine: list[tuple[str, float, float]], known: list[tuple[str, float, float]]) -> Column:
    """struct<geo_type, lat, lon> by marine names, then coordinates, then known names, each list in order; else null."""
    place = lambda kind, lat, lon: F.struct(F.lit(kind).alias("geo_type"), F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))
    parsed = parse_coordinates(name)
    rules = [F.when(name.contains(n), place("marine", a, o)) for n, a, o in marine]
    rules.append(F.when(parsed["lat"].isNotNull(), F.struct(F.lit("point").alias("geo_type"), parsed["lat"].alias("lat"), parsed["lon"].alias("lon"))))
    rules += [F.when(name.contains(n), place("land", a, o)) for n, a, o in known]
    return F.coalesce(*rules)


def merge_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of `new` that don't exist yet."""
    return edges.unionByName(new.select(*KEY).distinct().join(edges.select(*KEY), KEY, "left_anti"), allowMissingColumns=True)


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    return nodes.unionByName(new.dropDuplicates(["label", "name"]).join(nodes.select("label", "name"), ["label", "name"], "left_anti"), allowMissingColumns=True)


def merge_seeds(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, known: list[str], head: str = "INSTRUMENT", kind: str = "MEASURES", tail: str = "PARAMETER") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with seed pairs(head, tail) merged in: tails and edges are made where they are missing, heads too if
    the list of known names has them; pairs of other missing heads are passed over."""
    have = nodes.where(F.col("label") == head).select(F.col("name").alias("head")).distinct()
    listed = pairs.where(F.col("head").isin(*known)) if known else pairs.limit(0)
    good = pairs.join(have, "head", "left_semi").unionByName(listed).distinct()
    new = good.select(F.lit(head).alias("label"), F.col("head").alias("name")).unionByName(good.select(F.lit(tail).alias("label"), F.col("tail").alias("name")))
    made = good.select(F.lit(head).alias("h_label"), F.col("head").alias("h_name"), F.lit(kind).alias("type"), F.lit(tail).alias("t_label"), F.col("tail").alias("t_name"))
    return merge_nodes(nodes, new), merge_edges(edges, made)


def verification_samples(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """(sample, name, other): the first n satellites, regions with a place, and PROVIDES edges, each in order."""
    none = F.lit(None).cast("string")
    satellites = sample(nodes.where("label = 'SATELLITE'").select(F.lit("satellites").alias("sample"), "name", none.alias("other")), ["name"], n)
    place = F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string"))
    regions = sample(nodes.where("label = 'REGION' AND lat IS NOT NULL AND lon IS NOT NULL").select(F.lit("regions").alias("sample"), "name", place.alias("other")), ["name"], n)
    provides = sample(edges.where("type = 'PROVIDES'").select(F.lit("provides").alias("sample"), F.col("h_name").alias("name"), F.col("t_name").alias("other")), ["name", "other"], n)
    return satellites.unionByName(regions).unionByName(provides)


def derived_edges(nodes: DataFrame, rules: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """Edges by rules(label, text in the name, edge type, tail label, tail name); a small table of rules is broadcast."""
    r = nodes.sparkSession.createDataFrame(rules, "label string, needle string, type string, t_label string, t_name string")
    hits = nodes.select("label", "name").join(F.broadcast(r), "label").where(F.col("name").contains(F.col("needle")))
    return hits.select(F.col("label").alias("h_label"), F.col("name").alias("h_name"), "type", "t_label", "t_name").distinct()


def sample(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def label_counts(nodes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(kind, name, n) of nodes by label, zero for listed labels without nodes."""
    n = nodes.groupBy("label").agg(F.count("*").alias("n"))
    if labels is not None:
        n = nodes.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(n, "label", "left")
    return n.select(F.lit("node").alias("kind"), F.col("label").alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def type_counts(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    n = edges.groupBy("type").agg(F.count("*").alias("n"))
    if types is not None:
        n = edges.sparkSession.createDataFrame([(x,) for x in types], "type string").join(n, "type", "left")
    return n.select(F.lit("edge").alias("kind"), F.col("type").alias("name"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def statistics(nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Counts by label and type with their totals."""
    both = label_counts(nodes, labels).unionByName(type_counts(edges, types))
    total = both.groupBy("kind").agg(F.sum("n").alias("n")).select("kind", F.lit("total").alias("name"), "n")
    return both.unionByName(total)


def delete_edges(edges: DataFrame, invalid: DataFrame, dry_run: bool = False) -> DataFrame:
    """Edges without the invalid ones; a dry run only counts what would go, by type."""
    if dry_run:
        return edges.join(invalid.select(*KEY).distinct(), KEY, "left_semi").groupBy("type").agg(F.count("*").alias("n"))
    return edges.join(invalid.select(*KEY).distinct(), KEY, "left_anti")


def without(edges: DataFrame, head: str, kind: str, tail: str) -> DataFrame:
    """Heuristic deletion of one kind of edge between two labels."""
    return edges.where(~((F.col("h_label") == head) & (F.col("type") == kind) & (F.col("t_label") == tail)))


def orphans(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    return nodes.where(F.col("label").isin(*labels)).join(endpoints(edges), ["label", "name"], "left_anti")


def delete_orphans(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    return nodes.where(~F.col("label").isin(*labels)).unionByName(nodes.where(F.col("label").isin(*labels)).join(endpoints(edges), ["label", "name"], "left_semi"))


def cleanup_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Statistics before and after with their difference."""
    a = before.select("kind", "name", F.col("n").alias("before"))
    b = after.select("kind", "name", F.col("n").alias("after"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return a.join(b, ["kind", "name"], "full").select("kind", "name", zero("before").alias("before"), zero("after").alias("after"), (zero("after") - zero("before")).alias("delta"))


def cleanup_details(judged: DataFrame, orphaned: DataFrame, samples: int = 30, names: int = 20) -> DataFrame:
    """(part, name, n, samples) of a cleaning: of each edge type the valid and the invalid edges of judged(edge, valid), and
    of each label the orphan nodes; how many there are, and the first of them in order."""
    j = judged.select(F.when(F.col("valid"), "valid").otherwise("invalid").alias("part"), F.col("type").alias("name"), F.concat(F.col("h_name"), F.lit(" > "), F.col("t_name")).alias("one"))
    o = orphaned.select(F.lit("orphans").alias("part"), F.col("label").alias("name"), F.col("name").alias("one"))
    both = j.unionByName(o)
    counts = both.groupBy("part", "name").agg(F.count("*").alias("n"))
    most = F.when(F.col("part") == "orphans", names).otherwise(samples)
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("part", "name").orderBy("one"))).where(F.col("r") <= most)
    first = first.groupBy("part", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "one"))), lambda s: s["one"]).alias("samples"))
    return counts.join(first, ["part", "name"], "left")


def samples_by(rows: DataFrame, key: str, order: list[str], n: int, alias: str = "samples") -> DataFrame:
    """At most n rows a key as an array of structs, in order."""
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= n)
    cols = [c for c in rows.columns if c != key]
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", *cols))), lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias(alias))
