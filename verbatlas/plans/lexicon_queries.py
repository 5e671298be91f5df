"""Queries on relational tables in the roles of a lexicon: search, joins, paging, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from verbatlas.operators import dealing, dedup, graph, lexicon

from .registry import query, table


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 17")
def lex_by_slug(spark, d):
    return table(spark, d, "part").filter(F.col("p_partkey") == 17).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_discount = 0.1)")
def in_list_lookup(spark, d):
    keys = table(spark, d, "lineitem").filter("l_quantity >= 49 AND l_discount = 0.1").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(keys, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def contains_or(spark, d):
    return table(spark, d, "part").filter(lexicon.any_has([F.col("p_name"), F.col("p_type")], "Ring")).select("p_partkey", "p_name", "p_type")


@query("SELECT doc_id FROM documents WHERE text LIKE '%!%%' ESCAPE '!' OR text LIKE '%!_%' ESCAPE '!'")
def like_escaped(spark, d):
    """Wildcards in the searched text stand for themselves."""
    text = F.col("text")
    return table(spark, d, "documents").filter(F.contains(text, F.lit("%")) | F.contains(text, F.lit("_"))).select("doc_id")


@query(
    """SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_brand = 'Brand#4' AND p_type = 'PROMO'
    ORDER BY p_name, p_partkey LIMIT 5 OFFSET 5"""
)
def lex_filter_page(spark, d):
    """The second page of a filtered list; absent parameters do not filter."""
    chosen = lexicon.all_equal({"p_brand": "Brand#4", "p_type": "PROMO", "p_size": None})
    rows = table(spark, d, "part").filter(chosen).select("p_partkey", "p_name", "p_brand", "p_type")
    return lexicon.page(rows, ["p_name", "p_partkey"], 2, 5)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tionth')")
def trigram_search(spark, d):
    """Substring search over whole texts in one pass; lexicon.trigram_index serves repeated searches."""
    return table(spark, d, "documents").filter(lexicon.has(F.col("text"), "Tionth")).select("doc_id")


@query(
    """SELECT c_custkey, c_name FROM customer c WHERE contains(lower(c_name), '77') OR EXISTS (
    SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND contains(lower(o_orderpriority), 'urgent') AND o_totalprice > 400000)"""
)
def search_or_exists(spark, d):
    """Customers by their name or by an order of theirs."""
    orders = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    return lexicon.own_or_child(customer, orders, "c_custkey", lexicon.has(F.col("c_name"), "77"), lexicon.has(F.col("o_orderpriority"), "urgent"))


@query("SELECT item_id, marked FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN '' ELSE text END AS marked FROM benchmark) WHERE marked IS NULL OR marked = ''")
def null_or_blank(spark, d):
    marked = F.when(F.col("item_id") % 3 == 0, None).when(F.col("item_id") % 3 == 1, "").otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", marked.alias("marked")).filter(F.col("marked").isNull() | (F.col("marked") == ""))


@query(
    """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey = 17 THEN NULL ELSE p_partkey END AS v FROM part),
    b AS (SELECT s_suppkey, CASE WHEN s_suppkey % 500 = 5 THEN NULL ELSE s_suppkey * 2 END AS v FROM supplier)
    SELECT p_partkey, s_suppkey, a.v FROM a JOIN b ON a.v IS NOT DISTINCT FROM b.v"""
)
def null_safe_match(spark, d):
    """Keys that may be null, matched null with null."""
    a = table(spark, d, "part").select("p_partkey", F.nullif("p_partkey", F.lit(17)).alias("v"))
    b = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 500 != 5, F.col("s_suppkey") * 2).alias("w"))
    return a.join(b, a["v"].eqNullSafe(b["w"])).select("p_partkey", "s_suppkey", "v")


@query(
    """WITH a AS (SELECT CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 4 END AS v FROM part),
    b AS (SELECT CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey % 4 END AS v FROM supplier)
    SELECT a.v, count(*) AS pairs FROM a JOIN b ON a.v IS NOT DISTINCT FROM b.v GROUP BY a.v"""
)
def null_safe_counts(spark, d):
    """The pairs of whole tables per matching value, null among them; each side is counted before they meet."""
    a = table(spark, d, "part").groupBy(F.nullif(F.col("p_size") % 4, F.lit(0)).alias("v")).agg(F.count("*").alias("parts"))
    b = table(spark, d, "supplier").groupBy(F.nullif(F.col("s_nationkey") % 4, F.lit(0)).alias("w")).agg(F.count("*").alias("suppliers"))
    return a.join(b, a["v"].eqNullSafe(b["w"])).select("v", (F.col("parts") * F.col("suppliers")).alias("pairs"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def anti_done(spark, d):
    done = table(spark, d, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey, o_totalprice, (SELECT max(o_orderkey) FROM orders) AS max_key FROM orders WHERE o_orderkey >= 777 ORDER BY o_orderkey LIMIT 1")
def seek_ge(spark, d):
    """The first row from a key on."""
    orders = table(spark, d, "orders")
    top = orders.agg(F.max("o_orderkey").alias("max_key"))
    return orders.filter("o_orderkey >= 777").orderBy("o_orderkey").limit(1).select("o_orderkey", "o_totalprice").join(F.broadcast(top))


@query("SELECT l_partkey, count(*) AS rows FROM lineitem GROUP BY 1 HAVING bool_or(CASE WHEN l_linestatus = 'O' THEN 1 ELSE NULL END IS DISTINCT FROM 1)")
def unverified_any(spark, d):
    """Lexemes with a translation that is not verified; null is not verified either."""
    verified = F.when(F.col("l_linestatus") == "O", 1)
    rows = table(spark, d, "lineitem").select("l_partkey", (~verified.eqNullSafe(F.lit(1))).alias("open"))
    return rows.groupBy("l_partkey").agg(F.count("*").alias("rows"), F.bool_or("open").alias("open")).filter("open").drop("open")


@query(
    """SELECT d.doc_id, source, quality FROM documents d JOIN labels l USING (doc_id)
    WHERE source = 'src0' AND quality = 1 AND contains(lower(text), 'tion') AND toxic IS NOT NULL"""
)
def facet_filter(spark, d):
    docs = table(spark, d, "documents").filter((F.col("source") == "src0") & lexicon.has(F.col("text"), "tion")).select("doc_id", "source")
    labels = table(spark, d, "labels").filter("quality = 1 AND toxic IS NOT NULL").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select("doc_id", "source", "quality")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def inner_fk(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")




@query(
    """SELECT p_partkey, a.v AS core, b.v AS other FROM part
    LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY 1) a ON a.l_partkey = p_partkey
    LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F' GROUP BY 1) b ON b.l_partkey = p_partkey"""
)
def left_pivot(spark, d):
    """Two flavours of each lexeme side by side: one aggregate with two conditions instead of two joins."""
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'F' AND l_returnflag IN ('A', 'N')")
    flavour = lambda flag: F.min(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    wide = lines.groupBy("l_partkey").agg(flavour("A").alias("core"), flavour("N").alias("other"))
    return table(spark, d, "part").join(wide, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "core", "other")


@query("SELECT c_custkey, coalesce(n_name, c_name) AS shown FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 2")
def coalesce_fallback(spark, d):
    names = table(spark, d, "nation").filter("n_regionkey < 2")
    customer = table(spark, d, "customer")
    return customer.join(names, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", F.coalesce("n_name", "c_name").alias("shown"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_in(spark, d):
    nations = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(nations, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query(
    """SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS (
    SELECT 1 FROM lineitem b WHERE a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND b.l_linestatus = 'O')"""
)
def anti_unverified(spark, d):
    """Meanings without a verified translation: one grouping says it, no join is needed."""
    per = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(F.col("l_linestatus") == "O").alias("verified"))
    return per.filter(~F.col("verified")).select("l_partkey", "l_suppkey")


@query("SELECT count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)")
def orphan_count(spark, d):
    parents = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_partkey").join(parents, "l_partkey", "left_anti").agg(F.count("*").alias("orphans"))


_LANGS = ("A", "N", "R")


@query(
    "WITH m AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS v FROM lineitem WHERE l_quantity > 40) SELECT p_partkey, l_suppkey AS meaning, "
    + ", ".join(f"array_to_string(list(v ORDER BY v) FILTER (l_returnflag = '{x}'), ', ') AS lang_{x.lower()}" for x in _LANGS)
    + " FROM part LEFT JOIN m ON l_partkey = p_partkey GROUP BY 1, 2"
)
def lexeme_pivot(spark, d):
    """Lexeme, meaning, and its translations by language; a lexeme without a meaning has one row of nulls."""
    rows = table(spark, d, "lineitem").filter("l_quantity > 40")
    rows = rows.select("l_partkey", F.col("l_suppkey").alias("meaning"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("v")).distinct()
    texts = lambda x: F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == x, F.col("v"))))
    wide = rows.groupBy("l_partkey", "meaning").agg(*[texts(x).alias(f"lang_{x.lower()}") for x in _LANGS])
    out = table(spark, d, "part").select("p_partkey").join(wide, F.col("p_partkey") == F.col("l_partkey"), "left")
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).alias(c)
    return out.select("p_partkey", "meaning", *[joined(f"lang_{x.lower()}") for x in _LANGS])


@query(
    """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1) ON o_custkey = c_custkey"""
)
def first_match_join(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return lexicon.first_match(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", [], "o_orderkey", "o_orderstatus")


@query(
    """SELECT s_suppkey, s_acctbal, n_name, row_number() OVER (ORDER BY n_name, s_acctbal DESC, s_suppkey) AS place
    FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
)
def multi_sort(spark, d):
    """All rows with their places in the order of a column of another table, then of their own; no window over one task."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return lexicon.placed(rows.select("s_suppkey", "s_acctbal", "n_name"), "n_name", "s_acctbal", "s_suppkey")


@query(
    """SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40)
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def segment_page(spark, d):
    """A page of parents with the number of their children, 0 for none."""
    parents = lexicon.page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 3, 20)
    return parents.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("orders"))


@query("SELECT l_partkey, l_returnflag, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS joined FROM lineitem GROUP BY 1, 2")
def translation_concat(spark, d):
    values = F.array_join(F.array_sort(F.collect_set("l_linestatus")), ", ")
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(values.alias("joined"))


@query(
    """WITH p AS (SELECT *, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_name END AS v FROM part)
    SELECT p_partkey, CASE WHEN v IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY v) END AS dup_count,
    CASE WHEN v IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY v) - 1 END AS others,
    CASE WHEN v IS NULL THEN p_size > 45 ELSE bool_or(p_size > 45) OVER (PARTITION BY v) END AS any_flag FROM p"""
)
def dup_annotate(spark, d):
    """Headwords with the number of rows that share them."""
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 != 0, F.col("p_name")).alias("v"), "p_size")
    out = lexicon.duplicates(part, "v", F.col("p_size") > 45)
    return out.select("p_partkey", "dup_count", (F.col("dup_count") - 1).alias("others"), "any_flag")


@query(
    """SELECT p_brand, p_partkey, p_retailprice, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INT AS place FROM part) WHERE place <= 4"""
)
def topk_per_group(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return lexicon.top_per_group(part, "p_brand", [F.desc("p_retailprice"), "p_partkey"], 4)


@query("SELECT p_partkey, p_name FROM part ORDER BY md5('7' || p_partkey::VARCHAR), p_partkey LIMIT 1")
def sample_one(spark, d):
    """One random row, the same for the same seed."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return part.orderBy(F.md5(F.concat(F.lit("7"), F.col("p_partkey").cast("string")).cast("binary")), "p_partkey").limit(1)


@query("(SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5) UNION (SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 5)")
def head_tail_union(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return part.orderBy("p_partkey").limit(5).union(part.orderBy(F.desc("p_partkey")).limit(5)).distinct()


@query("SELECT 'customer' AS source_table, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def union_counts(spark, d):
    one = lambda name: table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("source_table"), "n")
    return one("customer").unionByName(one("supplier")).unionByName(one("part"))


@query("SELECT DISTINCT event_type FROM events")
def distinct_types(spark, d):
    return table(spark, d, "events").select("event_type").distinct()


# relations

_EDGES = "edges AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target, l_returnflag AS type FROM lineitem)"


def _links(spark, d):
    """Edges, with repeats."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("type"))


def _edges(spark, d):
    links = _links(spark, d)
    return dealing.distinct(links, links.count())


@query(f"WITH {_EDGES} SELECT source AS node, target AS other, type FROM edges UNION ALL SELECT target, source, type FROM edges WHERE source <> target")
def sym_neighbors(spark, d):
    return graph.undirected(_edges(spark, d))


@query(f"WITH {_EDGES} SELECT source AS node, target AS other, type, 'out' AS direction FROM edges WHERE source = 7 UNION ALL SELECT target, source, type, 'in' FROM edges WHERE target = 7")
def dir_neighbors(spark, d):
    return graph.directed(_edges(spark, d)).filter("node = 7")


@query(
    f"""WITH {_EDGES}, near AS (SELECT DISTINCT * FROM (SELECT source AS node, target AS other FROM edges UNION ALL SELECT target, source FROM edges) WHERE node <> other),
    lvl1 AS (SELECT node AS root, other AS parent FROM near WHERE node % 100 = 50 AND node IN (SELECT p_partkey FROM part)),
    lvl2 AS (SELECT root, min(parent) AS parent, other AS child FROM lvl1 JOIN near ON node = parent WHERE other <> root GROUP BY root, other),
    fresh AS (SELECT * FROM lvl2 WHERE NOT EXISTS (SELECT 1 FROM lvl1 WHERE lvl1.root = lvl2.root AND lvl1.parent = lvl2.child))
    SELECT root, parent, child FROM (SELECT *, row_number() OVER (PARTITION BY root, parent ORDER BY child) AS rn FROM fresh) WHERE rn <= 4"""
)
def two_hop(spark, d):
    """From every hundredth part: a query set that grows with the table."""
    roots = table(spark, d, "part").filter("p_partkey % 100 = 50").select(F.col("p_partkey").alias("root"))
    return graph.two_hops(_links(spark, d), roots, 4)


@query(
    f"""WITH {_EDGES}, old AS (SELECT DISTINCT source, target FROM edges WHERE type = 'A'), new AS (SELECT DISTINCT source, target FROM edges WHERE type = 'R' AND source <> target)
    SELECT source, target, 'add' AS action FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT source, target, 'remove' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)"""
)
def edge_diff(spark, d):
    edges = _links(spark, d)
    return graph.changes(edges.filter("type = 'A'"), edges.filter("type = 'R' AND source <> target"), ["source", "target"])


@query(
    f"""WITH {_EDGES} SELECT DISTINCT CASE WHEN type IN ('A', 'R') THEN least(source, target) ELSE source END AS source,
    CASE WHEN type IN ('A', 'R') THEN greatest(source, target) ELSE target END AS target, type FROM edges WHERE source <> target"""
)
def edge_normalize(spark, d):
    return graph.normalized(_links(spark, d), ["A", "R"])


@query(
    f"""WITH {_EDGES}, m AS (SELECT p_partkey AS old, p_partkey // 10 * 10 AS new FROM part WHERE p_partkey % 10 <> 0)
    SELECT DISTINCT * FROM (SELECT coalesce(a.new, source) AS source, coalesce(b.new, target) AS target, type FROM edges LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target) WHERE source <> target"""
)
def remap_edges(spark, d):
    mapping = table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("old"), F.expr("p_partkey div 10 * 10").alias("new"))
    return graph.remapped(_links(spark, d), mapping)


# duplicates


@query("SELECT text, count(DISTINCT doc_id) AS keys, min(doc_id) AS first FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def dup_groups(spark, d):
    return dedup.groups(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, source HAVING count(*) > 1)")
def dup_group_summary(spark, d):
    return dedup.summary(table(spark, d, "documents"), ["text", "source"])


_ROWS = "rows_ AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE l_partkey % 500 END AS meaning, l_returnflag AS value FROM lineitem)"


def _rows(spark, d):
    meaning = F.when(F.col("l_partkey") % 20 != 0, F.col("l_partkey") % 500)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), meaning.alias("meaning"), F.col("l_returnflag").alias("value"))


@query(f"WITH {_ROWS} SELECT count(*) - count(DISTINCT meaning::VARCHAR || '-' || coalesce(value, '')) AS surplus FROM rows_")
def dup_row_count(spark, d):
    return dedup.surplus(_rows(spark, d), "meaning", "value")


@query(
    """WITH c AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 5 THEN NULL ELSE conv_id % 40 END AS parent, role AS value FROM conversations)
    SELECT id, parent, value FROM (SELECT *, row_number() OVER (PARTITION BY parent, value ORDER BY id) AS rn FROM c) WHERE rn = 1 OR parent IS NULL"""
)
def dedup_rows(spark, d):
    rows = table(spark, d, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") <= 5, F.col("conv_id") % 40).alias("parent"), F.col("role").alias("value")
    )
    return dedup.deduplicated(rows, "parent", "value", "id")


@query(
    """WITH a AS (SELECT text, count(*) AS n, min(doc_id) AS left_id, min(lang) AS k FROM documents WHERE doc_id % 2 = 0 GROUP BY text),
    b AS (SELECT text, count(*) AS n, min(doc_id) AS right_id, min(CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END) AS k FROM documents WHERE doc_id % 2 = 1 GROUP BY text)
    SELECT md5(text) AS name, left_id, right_id, CASE WHEN a.n <> 1 OR b.n <> 1 THEN 'ambiguous' WHEN a.k IS NOT DISTINCT FROM b.k THEN 'merge' ELSE 'pos_mismatch' END AS outcome FROM a JOIN b USING (text)"""
)
def entity_match(spark, d):
    """Texts that two sources share, with what to do about them."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("name"), F.col("lang").alias("kind"))
    left = docs.filter("doc_id % 2 = 0")
    right = docs.filter("doc_id % 2 = 1").withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("kind")))
    return dedup.matched(left, right, "name", "kind", "doc_id")


@query("SELECT p_partkey, CASE WHEN rn = 1 THEN s ELSE s || '-' || rn END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS s, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def slug_unique(spark, d):
    return dedup.unique_slugs(table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("s")), "s", "p_partkey")


@query(
    """WITH new AS (SELECT c_custkey + 700 AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS v FROM customer), old AS (SELECT c_custkey AS id, c_mktsegment AS v FROM customer)
    SELECT coalesce(n.id, o.id) AS id, coalesce(n.v, o.v) AS v FROM old o FULL JOIN new n ON o.id = n.id"""
)
def upsert_merge(spark, d):
    customer = table(spark, d, "customer")
    old = customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    new = customer.select((F.col("c_custkey") + 700).alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("v"))
    return lexicon.upsert(old, new, "id")


@query("SELECT c_custkey AS id, c_name AS v FROM customer UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v"))
    return lexicon.insert_ignore(old, table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("v")), "id")


# audit log and library


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def audit_page(spark, d):
    rows = table(spark, d, "events").filter(lexicon.all_equal({"event_type": "error", "user_id": None}))
    page = lexicon.page(rows, [F.desc("ts"), F.desc("event_id")], 2, 50)
    return page.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "user_id")


@query(
    """WITH a AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS nation FROM customer), b AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name,
      CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, (c_nationkey % 24)::VARCHAR AS nation FROM customer)
    SELECT c_custkey, 'c_name' AS field, a.c_name AS old_value, b.c_name AS new_value FROM a JOIN b USING (c_custkey) WHERE a.c_name IS DISTINCT FROM b.c_name
    UNION ALL SELECT c_custkey, 'c_mktsegment', a.c_mktsegment, b.c_mktsegment FROM a JOIN b USING (c_custkey) WHERE a.c_mktsegment IS DISTINCT FROM b.c_mktsegment
    UNION ALL SELECT c_custkey, 'c_nationkey', a.nation, b.nation FROM a JOIN b USING (c_custkey) WHERE a.nation IS DISTINCT FROM b.nation"""
)
def audit_diff(spark, d):
    """One row for each changed field."""
    before = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    after = before.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"),
        F.when(F.col("c_custkey") % 3 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        (F.col("c_nationkey") % 24).alias("c_nationkey"),
    )
    return dedup.field_changes(before, after, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, strftime(max(ts), '%H:%M:%S') AS latest FROM events GROUP BY 1, 2")
def event_day(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return table(spark, d, "events").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "HH:mm:ss").alias("latest"))


@query(
    """SELECT doc_id, greatest(1, floor(length(text) / 1000 + 0.5))::BIGINT AS minutes, greatest(1, ceil(length(text) / 1800))::BIGINT AS pages,
    CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS title FROM documents"""
)
def reading_time(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").select(
        "doc_id",
        F.greatest(F.lit(1), F.floor(n / 1000 + 0.5)).cast("long").alias("minutes"),
        F.greatest(F.lit(1), F.ceil(n / 1800)).cast("long").alias("pages"),
        lexicon.shortened(F.col("text")).alias("title"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.2fB', floor(v / 1e9 * 100 + 0.5) / 100) WHEN v >= 1e6 THEN printf('%.2fM', floor(v / 1e6 * 100 + 0.5) / 100)
    WHEN v >= 1e3 THEN printf('%.2fK', floor(v / 1e3 * 100 + 0.5) / 100) ELSE floor(v)::BIGINT::VARCHAR END AS shown
    FROM (SELECT o_orderkey, o_totalprice * CASE o_orderkey % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1 ELSE 10000 END AS v FROM orders)"""
)
def compact_number(spark, d):
    scale = F.when(F.col("o_orderkey") % 3 == 0, 0.001).when(F.col("o_orderkey") % 3 == 1, 1).otherwise(10000)
    return table(spark, d, "orders").select("o_orderkey", lexicon.compact(F.col("o_totalprice") * scale).alias("shown"))
