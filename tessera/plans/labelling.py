"""Further queries: loose values, checks before training, sets and queues of labels, and a whole validation round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import values
from tessera.operators import checks, collect, labelled, match, metrics, rank, support, taxonomy
from tessera.plans.queries import ORDER_ROWS, SCORED, TREE, order_rows, query, rounded, said, t, tree
from tessera.sources import files
from tessera.streaming import state

LOOSE = """CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN '["b", "", "a", {"id": "c"}, {"id": 3}, 7, "b"]' WHEN 1 THEN '" one "' WHEN 2 THEN '{"id": "x"}' WHEN 3 THEN 'not json' END"""


def loose(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.expr(LOOSE).alias("raw"))


@query("m16_x15_label_ids", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ['a', 'b'] ELSE [] END AS plain, CASE WHEN event_id % 5 = 0 THEN ['', 'a', 'b', 'c'] ELSE [] END AS every, CASE WHEN event_id % 5 = 0 THEN ['b', '', 'a', 'c', 'b'] ELSE [] END AS ordered,
 CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN ['b', 'a', 'b'] WHEN 1 THEN ['one'] ELSE [] END AS strings FROM events""")
def m16(spark, sf_dir):
    raw = F.col("raw")
    return loose(spark, sf_dir).select("event_id", values.string_labels(raw).alias("plain"), values.label_set(raw).alias("every"), values.label_list(raw).alias("ordered"), values.as_strings(raw).alias("strings"))


@query("m12_m14_tags", """
SELECT user_id, list(event_type ORDER BY event_id)[1:3] AS names, list(event_id ORDER BY event_id)[1:3] AS counts, list_contains(list(event_type ORDER BY event_id)[1:3], 'click') AS clicked
FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 5) GROUP BY user_id""")
def m12(spark, sf_dir):
    from pyspark.sql import Window

    first = t(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 5")
    raw = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_type"].alias("name"), x["event_id"].alias("count"))))
    tags = first.groupBy("user_id").agg(raw.alias("raw")).select("user_id", values.compact_tags(F.col("raw"), 3).alias("tags"))
    names = F.transform("tags", lambda x: x["name"])
    return tags.select("user_id", names.alias("names"), F.transform("tags", lambda x: x["count"].cast("long")).alias("counts"), values.holds(names, F.lit("click")).alias("clicked"))


@query("x16_x18_payload", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'matched_song' ELSE 'matched_video_fallback' END AS reason, CAST(round_even(CAST(c_acctbal / 7.0 AS DOUBLE), 6) AS DOUBLE) AS score, [c_name, c_mktsegment] AS artists, ['i' || c_custkey] AS artist_ids,
 CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS album FROM customer""")
def x16(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    artists = F.concat(F.lit('[{"name": "'), "c_name", F.lit('", "id": "i'), "c_custkey", F.lit('"}, {"name": "'), "c_mktsegment", F.lit('", "id": 4}, "x"]'))
    album = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"name": "'), "c_mktsegment", F.lit('"}'))).otherwise(F.lit("[]"))
    p = values.payload(F.when(F.col("c_custkey") % 2 == 0, "song").otherwise("video"), {"score": (F.col("c_acctbal") / F.lit(7.0)).cast("double")}, artists, album)
    return c.select("c_custkey", p.alias("p")).select("c_custkey", "p.reason", "p.score", "p.artists", "p.artist_ids", F.col("p.album.name").alias("album"))


@query("m11_padded", "SELECT p_partkey, CAST(p_size AS INTEGER) AS n, CAST(50 AS INTEGER) AS padded, CAST(p_size AS INTEGER) AS kept FROM part")
def m11(spark, sf_dir):
    x = F.transform(F.sequence(F.lit(1), "p_size"), lambda i: i.cast("double"))
    p = t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"), values.padded(x, F.lit(50)).alias("p"))
    return p.select("p_partkey", "n", F.size("p.values").alias("padded"), F.size(F.filter("p.mask", lambda m: m)).alias("kept"))


@query("f14_complete", "SELECT vec_id, vec_id % 5 = 0 AS complete FROM embeddings")
def f14(spark, sf_dir):
    k = F.col("vec_id") % 5
    shape = F.array(F.lit(3), F.lit(64))
    meta = F.struct(F.when(k == 1, "other").otherwise("f").alias("fingerprint"), F.when(k == 2, "failed").otherwise("embedded").alias("status"), F.when(k == 3, F.array(F.lit(4), F.lit(64))).otherwise(shape).alias("windows_shape"), F.array_repeat(F.lit(1), F.when(k == 4, 2).otherwise(3)).alias("valid_samples"))
    return t(spark, sf_dir, "embeddings").select("vec_id", checks.complete(shape, F.size("embedding") == 64, meta, "f").alias("complete"))


@query("j15_v15_v16_training_rows", "SELECT vec_id, label AS target, CAST(label AS BIGINT) + 2 AS windows FROM embeddings JOIN documents ON doc_id = vec_id")
def j15(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("target")).join(t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id")
    n = checks.check_classes(e.select(F.col("target").alias("index")).distinct().withColumn("id", F.col("index").cast("string")))
    sections = e.select("vec_id", F.lit(0).alias("start"), (F.col("target") + 1).alias("end"), (F.col("target") + 2).cast("long").alias("windows"), (F.col("target") + 2).alias("counted"))
    rows = checks.check_targets(checks.required(checks.one_configuration(e.withColumn("print", F.lit("f")), "print", "f"), sections, "vec_id"), "vec_id", "target", n)
    return checks.check_sections(rows, "vec_id", "start", "end", "windows", "counted").select("vec_id", "target", "windows")


@query("n11_log_loss", "SELECT round(avg(-(list_extract(l, label + 1) - m - ln(list_sum(list_transform(l, lambda x: exp(x - m)))))), 6) AS loss, count(*) AS n FROM (SELECT label, l, list_max(l) AS m FROM (SELECT label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS l FROM embeddings))")
def n11(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("l"))
    return checks.log_loss(e, "l", "label").withColumn("loss", F.round("loss", 6))


@query("u1_u4_unions", """
SELECT kind, count(*) AS n, count(extra) AS with_extra FROM (
 SELECT 'bag' AS kind, c_mktsegment AS extra FROM customer UNION ALL SELECT 'bag', NULL FROM supplier
 UNION ALL SELECT 'new', NULL FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)
 UNION ALL SELECT 'allowed', NULL FROM (SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 3 UNION SELECT 'r' || r_regionkey FROM region)) GROUP BY kind""")
def u1(spark, sf_dir):
    c, s = t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier")
    bag = labelled.bag_union(c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("extra")), s.select(F.col("s_suppkey").alias("id")))
    new = labelled.only_new(c.select(F.col("c_nationkey").alias("k")), s.where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("k")), "k")
    nodes = tree(spark, sf_dir)
    legal = labelled.allowed(nodes.where("id in ('n0', 'n1', 'n2')"), nodes)
    none = F.lit(None).cast("string")
    every = bag.select(F.lit("bag").alias("kind"), "extra").union(new.select(F.lit("new"), none)).union(legal.select(F.lit("allowed"), none))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"))


@query("f1_f5_f6_f8_filters", """
SELECT 'text' AS kind, count(*) AS n FROM events WHERE event_id % 5 = 1 UNION ALL SELECT 'wanted', count(*) FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT 'short', count(*) FROM nation WHERE n_nationkey < 9
UNION ALL SELECT 'labelled', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'others', count(*) FROM orders WHERE o_orderstatus <> 'F'""")
def f1(spark, sf_dir):
    nodes = tree(spark, sf_dir)
    quotas = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), (F.col("n_nationkey") % 3).alias("quota"), (F.lit(9) - F.col("n_nationkey")).alias("shortfall"), F.col("n_nationkey").alias("place"))
    quotas = quotas.union(quotas.withColumn("id", F.lit("gone")).withColumn("shortfall", F.lit(0)))
    yes, no = labelled.by_status(t(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "labeled").when(F.col("o_orderstatus") == "O", "uncertain")))
    parts = [("text", loose(spark, sf_dir).where(labelled.is_text(F.col("raw")).isNotNull())), ("wanted", labelled.wanted(quotas, nodes, "quota")), ("short", labelled.short(quotas, "shortfall", "place")), ("labelled", yes), ("others", no)]
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in parts]
    return labelled.bag_union(*counted)


QUEUE = """
WITH l AS (SELECT o_orderkey, o_orderstatus, 'n' || c_nationkey AS leaf, 'r' || n_regionkey AS root, c_nationkey % 4 > 0 AS active, n_regionkey < 3 AS above, c_nationkey * 10 + 1 AS n, n_regionkey * 100 + 7 AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
q AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS retry, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN above THEN 1 ELSE 2 END WHEN active THEN 0 ELSE 2 END AS tier, CASE WHEN o_orderkey % 5 > 0 AND active THEN n WHEN above THEN m ELSE 1000000000 END AS first,
  CASE WHEN o_orderkey % 5 > 0 AND active AND above THEN m ELSE 1000000000 END AS second FROM l)
"""


@query("w8_w9_sorted_queue", QUEUE + "SELECT o_orderkey, CAST(retry AS INTEGER) AS retry, CAST(tier AS INTEGER) AS tier, CAST(first AS BIGINT) AS first, CAST(second AS BIGINT) AS second, row_number() OVER (ORDER BY retry, tier, first, second, o_orderkey) AS place FROM q")
def w9(spark, sf_dir):
    from pyspark.sql import Window

    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    root = F.concat(F.lit("r"), "n_regionkey")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.array(root)).otherwise(F.array(F.concat(F.lit("n"), "c_nationkey"), F.lit("unknown"))).alias("labels"))
    number = F.substring("id", 2, 9).cast("long")
    nodes = tree(spark, sf_dir)
    facts = nodes.select("id", F.col("parent").isNotNull().alias("is_leaf"), F.when(F.col("parent").isNull(), number < 3).otherwise(number % 4 > 0).alias("active"))
    n = nodes.select("id", F.when(F.col("parent").isNull(), number * 100 + 7).otherwise(number * 10 + 1).alias("n"))
    above = taxonomy.closure(nodes).where("depth > 0").select("id", "ancestor")
    q = match.queue(rows, facts, above, n, t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey")
    # The sort is the operator's; places are numbered to compare them.
    return q.withColumn("place", F.row_number().over(Window.orderBy("retry", "tier", "first", "second", "o_orderkey")).cast("long"))


@query("w11_viability_order", f"""
WITH s AS (SELECT label, count(*) AS n FROM ({ORDER_ROWS}) GROUP BY label), h AS (SELECT *, CASE WHEN n >= 100 THEN 'healthy' WHEN n >= 50 THEN 'borderline' ELSE 'at_risk' END AS health FROM s)
SELECT label, n, health FROM h""")
def w11(spark, sf_dir):
    return support.viability_order(order_rows(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "n", "label")


@query("w2_first_of", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def w2(spark, sf_dir):
    return rank.first_of(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("z1_training_rows", """
WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 60), n AS (SELECT event_type FROM s GROUP BY event_type HAVING count(*) >= 40) SELECT user_id, event_type FROM s JOIN n USING (event_type)""")
def z1(spark, sf_dir):
    return labelled.training_rows(t(spark, sf_dir, "events"), "user_id", "event_type", "value", 60, 40)


@query("z15_single_parent", """
WITH l AS (SELECT o_custkey, list_sort(list_distinct(list(CAST(n_regionkey AS INTEGER)))) AS roots FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY o_custkey),
m AS (SELECT roots[1] AS truth, CAST(o_custkey % 5 AS INTEGER) AS predicted FROM l WHERE len(roots) = 1), c AS (SELECT CAST(r_regionkey AS INTEGER) AS k FROM region)
SELECT a.k AS true_class, b.k AS predicted_class, count(truth) AS n FROM c a CROSS JOIN c b LEFT JOIN m ON truth = a.k AND predicted = b.k GROUP BY ALL""")
def z15(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").cast("int").alias("root"))
    l = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").join(F.broadcast(s), "l_suppkey")  # noqa: E741
    rows = l.groupBy("o_custkey").agg(F.array_sort(F.collect_set("root")).alias("roots")).withColumn("predicted", (F.col("o_custkey") % 5).cast("int"))
    return metrics.single_parent_confusion(rows, "roots", "predicted", t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("class")))


@query("t3_cool_downs", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'ok' WHEN event_type IN ('click', 'view') THEN 'global' END AS o FROM events),
g AS (SELECT *, coalesce(max(CASE WHEN o = 'ok' THEN event_id END) OVER (ORDER BY event_id), -1) AS since FROM e)
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY since ORDER BY event_id) = 1 THEN 45 ELSE 20 END AS minutes FROM g WHERE o = 'global'""")
def t3(spark, sf_dir):
    o = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type").isin("click", "view"), "global")
    return state.cool_downs(t(spark, sf_dir, "events").withColumn("o", o), "event_id", "o")


@query("x9_accents", "SELECT c_custkey, ['beyonce', trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')), 'sigur ros'] AS parts, list_sort([lower(c_name), 'beyonce', 'strasse']) AS every_key FROM customer")
def x9(spark, sf_dir):
    line = F.concat(F.lit("Beyoncé feat. "), "c_name", F.lit(" & Sigur Rós"))
    return t(spark, sf_dir, "customer").select("c_custkey", X.artist_parts(line).alias("parts"), X.union_keys(F.array("c_name", F.lit("BEYONCÉ")), F.array(F.lit("Beyoncé"), F.lit(" Straße "))).alias("every_key"))


def rounds(spark, sf_dir) -> tuple[DataFrame, ...]:
    """Orders as a labelling round: a seventh of them is the earlier round; a customer's orders of a priority are one track."""
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey"), "o_custkey")
    meta = [F.col("c_name").alias("artist"), F.col("o_orderpriority").alias("title"), F.lit("").alias("mbid"), F.array("c_name").alias("artists")]
    rows = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("c"), "o_orderkey").alias("candidate_id"), *meta, F.concat(F.lit('[{"id": "n'), "c_nationkey", F.lit('", "confidence": 0.9}]')).alias("labels"), F.when(F.col("o_orderstatus") == "F", "labeled").when(F.col("o_orderstatus") == "O", "uncertain").otherwise("maybe").alias("status"), F.lit("").alias("reason"))
    old, new = rows.where("seq % 7 = 0"), rows.where("seq % 7 > 0")
    known = new.select("seq", "candidate_id", "artist", "title", "mbid", "artists")
    keys = ["artist", "title", "mbid", "artists"]
    return new.select("seq", "candidate_id", "status", "labels", "reason"), known, known.where("seq % 3 > 0"), old.where("seq % 2 = 0").select(*keys, "labels"), old.where("seq % 2 = 1").select(*keys)


ROUND = f"""
WITH o AS (SELECT o_orderkey AS seq, lower(c_name) AS artist, lower(c_name) || '|' || o_orderpriority AS key, 'n' || c_nationkey AS id, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey),
old AS (SELECT * FROM o WHERE seq % 7 = 0), new AS (SELECT * FROM o WHERE seq % 7 > 0), named AS (SELECT * FROM new WHERE status = 'F'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS nth FROM named WHERE key NOT IN (SELECT key FROM old)), taken AS (SELECT * FROM fresh WHERE nth = 1),
each AS (SELECT id, artist, 'old' AS origin FROM old WHERE seq % 2 = 0 UNION ALL SELECT id, artist, 'new' FROM taken), nodes AS ({TREE}),
"""


@query("c9_validated_classes", ROUND + """
s AS (SELECT nodes.id, parent, position, count(*) FILTER (origin = 'old') AS old_tracks, count(*) FILTER (origin = 'new') AS new_tracks, count(DISTINCT artist) FILTER (origin = 'old') AS old_artists, count(DISTINCT artist) FILTER (origin = 'new') AS new_artists, count(DISTINCT artist) AS artists
  FROM nodes LEFT JOIN each ON each.id = nodes.id GROUP BY ALL), c AS (SELECT *, old_tracks + new_tracks AS tracks FROM s),
f AS (SELECT *, CASE WHEN parent IS NULL THEN 'parent_kept' WHEN tracks >= 100 AND artists >= 50 THEN 'strong_leaf' WHEN tracks >= 50 AND artists >= 30 THEN 'viable_leaf' ELSE 'drop_leaf' END AS status FROM c)
SELECT id, parent, position, old_tracks, new_tracks, tracks, old_artists, new_artists, artists, status, status <> 'drop_leaf' AS active FROM f""")
def c9(spark, sf_dir):
    return labelled.validated(*rounds(spark, sf_dir), tree(spark, sf_dir)).classes


@query("c9_validated_summary", ROUND + """
n AS (SELECT count(*) AS outputs, count(*) FILTER (status = 'P') AS issues, count(*) AS joined, count(*) FILTER (seq % 3 = 0) AS fallbacks, count(*) FILTER (status <> 'F') AS others FROM new),
m AS (SELECT count(*) FILTER (nth > 1) AS within, count(*) FILTER (nth = 1) AS accepted FROM fresh), e AS (SELECT count(*) AS earlier FROM named WHERE key IN (SELECT key FROM old))
SELECT outputs, issues, joined, fallbacks, earlier, within, accepted, others FROM n, m, e""")
def c9b(spark, sf_dir):
    return labelled.validated(*rounds(spark, sf_dir), tree(spark, sf_dir)).summary


@query("c2_c4_rescue_tiers")
def c2(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.col("o_orderpriority").alias("genre"), (k % 3 + 1).cast("int").alias("tier"), (F.col("o_custkey") % 97).alias("artist"), F.col("o_custkey").alias("key"), k.alias("seq")).groupBy("genre", "tier", "artist", "key").agg(F.min("seq").alias("seq"))
    needed = rows.select("genre").distinct().withColumns({"needed": F.lit(120), "place": F.col("genre")})
    c = t(spark, sf_dir, "customer")
    known = c.where("c_acctbal > 9000").select((F.col("c_custkey") % 97).alias("artist"))
    return collect.rescued(rows, c.where("c_acctbal < 0").select(F.col("c_custkey").alias("key")), "genre", "key", "artist", known, [F.col("seq"), F.col("key")], needed, 3).select("genre", "tier", "artist", "key", "evidence")


@query("s10_by_extension", """
WITH f AS (SELECT user_id, 'f' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS stem, CAST(event_id % 4 AS INTEGER) AS k FROM events), p AS (SELECT user_id, stem || ['.opus', '.MP3', '.m4a', '.txt'][k + 1] AS path, [2, 1, 3, 9][k + 1] AS rank FROM f)
SELECT user_id, path FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank, path) = 1""")
def s10(spark, sf_dir):
    extension = F.element_at(F.array(*[F.lit(x) for x in (".opus", ".MP3", ".m4a", ".txt")]), (F.col("event_id") % 4 + 1).cast("int"))
    listing = t(spark, sf_dir, "events").select("user_id", F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 9, "0"), extension).alias("path"))
    return files.first_by_extension(listing, "user_id", "path", [".mp3", ".opus", ".m4a"])


PATHS = ("pooled", "sequence")


@query("s12_embedding_path", """
SELECT vec_id, """ + ", ".join(f"CASE CAST(vec_id % 5 AS INTEGER) WHEN 0 THEN 'd' || vec_id WHEN 1 THEN 'e' || vec_id WHEN 2 THEN '{p[0]}' || vec_id WHEN 3 THEN 'l' || vec_id ELSE 'embeddings/muq/v' || vec_id || '.npy' END AS {p}" for p in PATHS) + " FROM embeddings")
def s12(spark, sf_dir):
    k, name = F.col("vec_id") % 5, lambda x: F.concat(F.lit(x), "vec_id")
    paths = lambda n, x: F.when(k == n, F.create_map(F.lit("muq"), name(x)))
    row = F.struct(F.when(k == 0, name("d")).alias("direct"), paths(1, "e").alias("embedding_paths"), paths(2, "p").alias("pooled_paths"), paths(2, "s").alias("sequence_paths"), F.when(k == 3, name("l")).alias("legacy_path"), F.lit("muq").alias("encoder"), name("v").alias("video_id"))
    return t(spark, sf_dir, "embeddings").select("vec_id", row.alias("row")).select("vec_id", *[files.embedding_path("row", p).alias(p) for p in PATHS])


@query("a27_weight_modes", """
WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS raw FROM n)
SELECT label, 1.0::DOUBLE AS plain, round(raw / avg(raw) OVER (), 6) AS balanced FROM r""")
def a27(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("label")
    modes = [support.class_weights(e, "label", how, e.distinct()).select("label", F.col("weight").alias(name)) for how, name in (("none", "plain"), ("balanced", "balanced"))]
    return rounded(modes[0].join(modes[1], "label"), "balanced")


@query("z9_subset_accuracy", f"WITH s AS (SELECT lang, truth = CAST(score >= 0.5 AS INTEGER) AS hit FROM ({SCORED})) SELECT round(avg(CAST(every AS INTEGER)), 6) AS subset_accuracy FROM (SELECT bool_and(hit) AS every FROM s GROUP BY lang)")
def z9(spark, sf_dir):
    return rounded(metrics.subset_accuracy(said(spark, sf_dir), "lang", "truth", "said"), "subset_accuracy")
