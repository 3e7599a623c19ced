"""Traps of single operators, on hand-made rows."""

import difflib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import checks, collect, identity, match, metrics, rank, series, split, support, taxonomy, validate, vectors
from tessera.sources import files, recorded
from tessera.streaming import state


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_norm_folds_what_lower_does_not(spark):
    r = one(spark, a=X.norm(F.lit("  Straße ﬁ  Été ")), b=X.normalize(F.lit("日本 Été!")), c=X.norm(F.lit(None).cast("string")))
    assert (r.a, r.b, r.c) == ("strasse fi ete", "ete", None)


def test_sequence_similarity_is_ratcliff_obershelp(spark):
    pairs = [("abc def", "abd ef"), ("", "x"), ("same", "same"), ("a" * 300, "a" * 250 + "b")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.sequence_similarity("a", "b").alias("s")).collect()
    for r in rows:
        assert r.s == (1.0 if r.a == r.b else 0.0 if not r.a or not r.b else difflib.SequenceMatcher(None, r.a, r.b).ratio())


def test_version_flags_are_substrings(spark):
    r = one(spark, v=X.version(F.lit("Alive (Someone Remix)")), d=X.duration_seconds(F.lit(None).cast("string"), F.lit("1:02:03")))
    assert r.v.live and r.v.remix and r.v.remix_name == "someone" and r.d == 3723


def test_error_families_in_order(spark):
    r = one(spark, a=X.error_class(F.lit("ERROR: Sign in to confirm you're not a bot")), b=X.error_class(F.lit("Video unavailable")), c=X.error_class(F.lit("?")))
    assert (r.a.kind, r.b.code, r.c.code) == ("global", "unavailable", "unclassified_download_error")


def test_taxonomy_faults(spark):
    cyclic = spark.createDataFrame([("a", "b", 0), ("b", "a", 1)], "id string, parent string, position int")
    with pytest.raises(taxonomy.BrokenTaxonomy):
        taxonomy.closure(cyclic)
    assert taxonomy.closure(cyclic, on_cycle="stop").count() == 4
    with pytest.raises(taxonomy.BrokenTaxonomy):
        taxonomy.check(spark.createDataFrame([("a", "x", 0)], "id string, parent string, position int"))


def test_greedy_is_not_transitive(spark):
    rows = spark.createDataFrame([(1, ["m", "a"]), (2, ["m", "b"]), (3, ["b"]), (4, ["z"]), (5, [])], "seq long, keys array<string>")
    got = {r.seq: (r.accepted, r.clash) for r in identity.greedy(rows, "keys", "seq").collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None), 5: (True, None)}


def test_greedy_against_a_fold(spark):
    rng = np.random.default_rng(1)
    data = [(i, sorted({f"k{x}" for x in rng.integers(0, 120, 2)})) for i in range(200)]
    held, want = {}, {}
    for i, keys in data:
        clash = min((held[k] for k in keys if k in held), default=None)
        want[i] = clash is None
        if clash is None:
            held.update(dict.fromkeys(keys, i))
    got = {r.seq: r.accepted for r in identity.greedy(spark.createDataFrame(data, "seq long, keys array<string>"), "keys", "seq").collect()}
    assert got == want


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in identity.components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_pool_lookup_is_asymmetric(spark):
    rows = spark.createDataFrame([("g", "t1", "t1", 1), ("g", "m1", "t1", 2), ("g", "m2", "t2", 3), ("g", "t2", "t2", 4)], "genre string, primary string, text string, seq long")
    assert {r.row: r.merged_into for r in identity.pooled(rows, "genre", "primary", "text", "seq").collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_latest_before_or_after_the_filter(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "k string, s long, ok boolean")
    assert rank.latest(rows, ["k"], [F.col("s")], F.col("ok")).count() == 0
    assert rank.latest(rows, ["k"], [F.col("s")], F.col("ok"), filter_first=True).first().s == 1


def test_early_stop_needs_more_than_the_margin(spark):
    values = [0.1, 0.2, 0.2 + 5e-7, 0.2, 0.3]
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, e int, m double")
    r = rank.early_stop(rows, ["run"], "e", "m", 3).first()
    assert (r.best_epoch, r.stopped_at) == (4, None)
    assert rank.early_stop(rows, ["run"], "e", "m", 2).first().stopped_at == 3


def test_zero_support_and_flat_series(spark):
    classes = spark.createDataFrame([(0,), (1,)], "class int")
    m = metrics.per_class(metrics.confusion(spark.createDataFrame([(0, 0)], "t int, p int"), "t", "p", classes))
    assert {r["class"]: r.f1 for r in m.collect()} == {0: 1.0, 1: 0.0}
    flat = spark.createDataFrame([("a", 1.0)] * 3, "k string, v double")
    assert {r.scaled for r in series.robust_scale(flat, "k", "v").collect()} == {0.0}


def test_blocks_ties_and_short_series(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 1.0, 1.0])] + [("b", 0, 2.0)], "k string, i int, v double")
    got = {r.k: (r.start, r.end) for r in series.best_block(rows, "k", "i", "v", 2).collect()}
    assert got == {"a": (2, 4), "b": (0, 1)}
    assert series.block_width(2.5, 1.0) == 2 and series.block_width(0.1, 5) == 1


def test_tempo_folds_and_keeps_its_bounds(spark):
    got = [one(spark, t=series.folded_tempo(F.lit(float(x)))).t for x in (0, 30, 60, 120, 121, 500, -1)]
    assert got == [0.0, 60.0, 60.0, 120.0, 60.5, 62.5, 0.0]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "k int, v array<float>")
    assert [r["std"] for r in vectors.normalization(rows, "v").orderBy("dim").collect()] == [1.0, 2.0]
    assert one(spark, a=vectors.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))).a == 1
    r = vectors.linear_scores(rows, "k", "v", np.eye(2), np.zeros(2), (np.eye(2), np.array([-2.0, 0.0]))).orderBy("k").collect()
    assert [x.scores for x in r] == [[0.0, 2.0], [1.0, 6.0]]
    with pytest.raises(ValueError):
        vectors.check_size(rows.union(spark.createDataFrame([(3, [1.0])], rows.schema)), "v")


def test_issues_see_booleans_and_strings(spark):
    out = spark.createDataFrame([(1, "a", "labeled", '[{"id": "x", "confidence": true}, "y"]'), (2, "a", "labeled", '[{"id": "x", "confidence": 0.5}, {"id": "p", "confidence": 1}]'), (3, None, "labeled", "[]"), (4, "b", "labeled", "not json")], "seq long, candidate_id string, status string, labels string")
    got = validate.issues(out, spark.createDataFrame([("a",), ("b",)], "candidate_id string"), spark.createDataFrame([("x",), ("p",)], "id string"), spark.createDataFrame([("x", "p")], "id string, ancestor string"))
    assert sorted((r.seq, r.issue) for r in got.collect()) == [(1, "invalid_confidence"), (1, "label_not_object"), (2, "duplicate_output_candidate_id"), (2, "redundant_parent_child"), (3, "missing_candidate_id"), (4, "labeled_without_labels")]


def test_policies(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["b"],), (["a", "b"],)], "t array<string>")
    got = {tuple(r.t): (r.reason, r.target) for r in split.single_label(rows, "t", F.array(F.lit("a")), several="other", other="o").collect()}
    assert got == {(): ("zero_parent_dropped", None), ("a",): ("single_parent", "a"), ("b",): ("excluded_parent_dropped", None), ("a", "b"): ("ambiguous_to_other", "o")}
    with pytest.raises(ValueError):
        split.single_label(rows, "t", F.array(F.lit("a")), zero="other")


def test_targets_are_checked():
    with pytest.raises(ValueError):
        support.check_targets(expected_yield=0.0)


def test_rescue_serves_earlier_genres_first(spark):
    rows = spark.createDataFrame([("g1", "k1", "a", 1), ("g1", "k2", "a", 2), ("g2", "k1", "a", 1), ("g2", "k3", "b", 2), ("g2", "k9", "c", 3)], "genre string, key string, artist string, o int")
    needed = spark.createDataFrame([("g1", 1, 0), ("g2", 1, 1)], "genre string, needed int, place int")
    got = collect.rescue(rows, spark.createDataFrame([("k9",)], "key string"), "genre", "key", "artist", [F.col("o")], needed, 2)
    assert sorted((r.genre, r.key) for r in got.collect()) == [("g1", "k1"), ("g2", "k3")]


def test_resolved_song_video_or_neither(spark):
    tracks = spark.createDataFrame([(1, "Ann", "Sunrise"), (2, "Bob", "Night Drive"), (3, "Cy", "Rain")], "candidate_id int, artist string, title string")
    hits = "candidate_id int, video_id string, result_title string, result_artists array<string>, seq int"
    songs = spark.createDataFrame([(1, "s1", "Sunrise", ["Ann"], 1), (2, "s2", "Other", ["X"], 1)], hits)
    videos = spark.createDataFrame([(2, "v2", "Bob - Night Drive (Official Video)", ["BobVEVO"], 1), (2, "v3", "Night Drive karaoke", ["Bob"], 2)], hits)
    got = {r.candidate_id: (r.status, r.video_id) for r in match.resolved(tracks, songs, videos).collect()}
    assert got[1] == ("resolved", "s1") and got[3] == ("unresolved", None)


def test_json_lines_dialects(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n[2]\n{"a": 3}\n{"a": ')
    assert [r.a for r in files.json_lines(spark, str(path), "a long", "tolerant_last_line").orderBy("seq").collect()] == [1, 3]
    for dialect in ("strict", "skip_non_objects"):
        with pytest.raises(files.BadLine):
            files.json_lines(spark, str(path), "a long", dialect)
    assert files.json_lines(spark, str(tmp_path / "none"), "a long", "strict_optional").count() == 0


def test_readers(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    r = files.arrays(spark, str(tmp_path / "v.npy")).first()
    assert r["shape"] == [2, 3] and r.vector == [0, 1, 2, 3, 4, 5]
    (tmp_path / "p.csv").write_text("id,f1,support\na,x,y\nb,0.5,3\n,1,1\n")
    assert [(r.id, r.support) for r in files.performance(spark, str(tmp_path / "p.csv")).orderBy("id").collect()] == [("a", 0), ("b", 3)]
    nodes = files.taxonomy(spark, "nodes:\n- {id: a, label: A}\n- {id: b, label: B, parent: a, aliases: [x]}\n")
    assert [(n.id, n.parent, n.position) for n in nodes.orderBy("position").collect()] == [("a", None, 0), ("b", "a", 1)]


def test_recorded_children_and_source(spark):
    got = one(spark, a=recorded.children(F.lit('{"t": {"n": 1}}'), "$.t", "struct<n: int>"), b=recorded.children(F.lit('{"t": [{"n": 1}, {"n": 2}]}'), "$.t", "struct<n: int>"), c=recorded.children(F.lit("{}"), "$.t", "struct<n: int>"))
    assert [len(got.a), len(got.b), len(got.c)] == [1, 2, 0]
    spark.dataSource.register(recorded.RecordedSource)
    assert spark.read.format("recorded").option("responses", json.dumps([{"endpoint": "e", "key": "k", "response": {"x": 1}}])).load().count() == 1


def test_retry_machine_in_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "transient"), ("a", 2, "ok"), ("b", 3, "transient"), ("b", 4, "transient"), ("c", 5, "terminal"), ("c", 6, "ok"), ("d", 7, "global")], "k string, s long, o string")
    want = {"a": ("downloaded", 2), "b": ("transient_exhausted", 2), "c": ("terminal", 1), "d": ("open", 1)}
    assert {r.k: (r.state, r.tries) for r in state.retries(rows, "k", "s", "o", 2).collect()} == want
    rows.coalesce(1).sortWithinPartitions("s").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    out = state.available(state.retry_stream(stream, "k", "o", 2), "retries", "update")
    assert {r.k: (r.state, r.tries) for r in out.collect()} == want


def test_pool_equals_a_loop(spark):
    import random

    r = random.Random(8)
    rows = []
    for s in range(300):
        text = r.choice(["t1", "t2", "t3", "t4", None])
        rows.append((r.choice(["g", "h", None]), r.choice([text, text, "m1", "m2", "m3"]), text, s))
    pool, want = {}, {}
    for g, p, x, s in rows:
        entry = pool.get((g, p), pool.get((g, x)))
        if entry is None:
            entry = pool[g, p] = s
        want[s] = entry
    got = identity.pooled(spark.createDataFrame(rows, "g string, p string, t string, s long"), "g", "p", "t", "s").collect()
    assert {x.row: x.merged_into for x in got} == want and len(got) == len(rows)


def test_rows_without_an_artist_keep_a_split_of_their_own(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, None), (4, None), (4, "b"), (5, None)]
    got = {x.row: x.component for x in split.disjoint_split(spark.createDataFrame(rows, "row long, artist string"), "row", "artist", "s").collect()}
    assert got == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5}


def test_deep_trees_and_cycles(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, i) for i in range(40)], "id string, parent string, position int")
    assert taxonomy.closure(nodes).where("id = 'n39'").count() == 40
    assert {x.root for x in taxonomy.roots(nodes).collect()} == {"n0"}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    with pytest.raises(taxonomy.BrokenTaxonomy):
        taxonomy.closure(ring)
    assert taxonomy.closure(ring, on_cycle="stop").count() == 4
    tree = spark.createDataFrame([("r", None), ("m", "r"), ("l", "m")], "id string, parent string")
    scores = spark.createDataFrame([(1, "r", 0.1), (1, "m", 0.2), (1, "l", 0.9)], "s int, id string, p double")
    assert {x.id: x.p for x in metrics.projected(scores, tree, "s", "id", "p").collect()} == {"r": 0.9, "m": 0.9, "l": 0.9}


def test_keys_fold_accents_and_line_ends(spark):
    none = F.lit(None).cast("array<string>")
    row = one(spark, end=X.norm(F.lit("abc\u2028")), names=X.union_keys(F.array(F.lit("Beyonc\u00e9"), F.lit("BEYONCE"), F.lit(None)), none), parts=X.artist_parts(F.lit("Beyonc\u00e9 feat. Sigur R\u00f3s")))
    assert (row.end, row.names, row.parts) == ("abc", ["beyonce"], ["beyonce", "sigur ros"])


def test_checks_name_what_is_wrong(spark):
    rows = spark.createDataFrame([(i, i % 3, 0, 2, 4, 4) for i in range(9)], "id int, y int, s int, e int, w int, c int")
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "index int, id string")
    assert checks.check_classes(classes) == 3 and checks.check_targets(rows, "id", "y", 3).count() == 9 and checks.check_sections(rows, "id", "s", "e", "w", "c").count() == 9
    for call in (
        lambda: checks.check_classes(classes.where("index <> 1")),
        lambda: checks.check_targets(rows, "id", "y", 2),
        lambda: checks.check_targets(rows.withColumn("y", F.col("y") > 0), "id", "y", 2),
        lambda: checks.check_sections(rows.withColumn("e", F.lit(5)), "id", "s", "e", "w", "c"),
        lambda: checks.required(rows, rows.where("id > 6").select("id"), "id"),
        lambda: checks.one_configuration(rows.withColumn("f", F.lit("x")), "f", "y"),
        lambda: checks.check_request({"view": "whole"}, {"view": "center"}),
        lambda: checks.representation_plan("effnet", "mlp", "center"),
    ):
        with pytest.raises(checks.BadInput):
            call()
    assert checks.representation_plan("muq", "mlp", "center") == ("sequence", "pooled") and checks.representation_plan("effnet", "attention", "whole") == ("sequence", "sequence")
    near = spark.range(1).select(checks.alike(F.array(F.lit(1.0)), F.array(F.lit(1.0 + 1e-7))).alias("a"), checks.alike(F.array(F.lit(1.0)), F.array(F.lit(1.1))).alias("b")).first()
    assert (near.a, near.b) == (True, False)


def test_a_clear_result_of_the_first_query_is_taken_at_once(spark):
    tracks = spark.createDataFrame([(1, "Aphex Twin", "Windowlicker"), (2, None, "x"), (3, "Nobody", "Nothing here")], "candidate_id int, artist string, title string")
    songs = spark.createDataFrame(
        [(1, "one", "Windowlicker", ["Aphex Twin"], 1, 0), (1, "two", "Windowlicker", ["Aphex Twin"], 2, 1), (2, "y", "x", ["x"], 1, 0), (3, "z", "Else", ["Other"], 1, 0)],
        "candidate_id int, video_id string, result_title string, result_artists array<string>, seq int, query_no int",
    )
    got = {x.candidate_id: x for x in match.resolved(tracks, songs, songs.limit(0)).collect()}
    assert (got[1].status, got[1].video_id, got[1].source) == ("resolved", "one", "song")
    assert got[2].reason == "missing_artist_or_title" and got[3].status == "unresolved"


def test_follow_appends_new_keys_once(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.range(3).write.parquet(source)
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        q = state.follow(spark.readStream.schema("id long").parquet(source), log, "id", 1)
        q.processAllAvailable()
        state.stop(q)
        assert sorted(r.id for r in spark.read.parquet(log).collect()) == list(range(n))


def test_rescue_in_tiers_equals_a_loop(spark):
    import random

    r = random.Random(3)
    rows = [(g, tier, f"a{r.randrange(6)}", r.randrange(100)) for g in ("g1", "g2", "g3") for tier in (1, 2, 3) for _ in range(14)]
    rows = [(g, tier, a, f"{a}-{s % 9}", s) for g, tier, a, s in rows]
    rows = list({(x[0], x[1], x[3]): x for x in rows}.values())
    needed, most, gone, old = [("g1", 7, 0), ("g2", 12, 1), ("g3", 9, 2)], 3, {"a1-1", "a2-2"}, {"a0", "a3"}
    taken, want = set(gone), []
    for genre, quota, _ in needed:
        mine, count = [], {}
        for tier in (1, 2, 3):
            left = sorted((x for x in rows if x[:2] == (genre, tier)), key=lambda x: (x[2] in old, x[4], x[3]))
            while True:  # a pass takes one row of each artist
                passed, gained = set(), False
                for x in left:
                    if len(mine) < quota and x[3] not in taken and x[2] not in passed and count.get(x[2], 0) < most and x[3] not in {m[3] for m in mine}:
                        passed.add(x[2])
                        count[x[2]] = count.get(x[2], 0) + 1
                        mine.append(x)
                        gained = True
                if not gained:
                    break
        taken |= {x[3] for x in mine}
        want += [(x[0], x[1], x[3]) for x in mine]
    d = spark.createDataFrame(rows, "genre string, tier int, artist string, key string, s int")
    got = collect.rescued(d, spark.createDataFrame([(k,) for k in gone], "key string"), "genre", "key", "artist", spark.createDataFrame([(a,) for a in old], "artist string"), [F.col("s"), F.col("key")], spark.createDataFrame(needed, "genre string, needed int, place int"), most)
    assert sorted((x.genre, x.tier, x.key) for x in got.collect()) == sorted(want)
    assert {(x.tier, x.evidence.strength) for x in got.collect()} <= {(1, "medium"), (2, "weak"), (3, "weak")}


def test_large_json_lines_are_numbered_across_parts(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"a": {i}}}\r\n' if i % 7 else "\n" for i in range(1, 2001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.json_lines(spark, str(tmp_path / "*.jsonl"), "a long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2 * sum(i % 7 > 0 for i in range(1, 2001)) and all(r.a == r.seq for r in rows)


def test_loose_taxonomies_keep_the_last_of_an_id(spark, tmp_path):
    path = tmp_path / "t.yaml"
    path.write_text("nodes:\n- {id: a, label: A}\n- {id: b, label: B, parent: a}\n- {id: a, label: C}\n- {label: D}\n- word\n")
    got = files.taxonomy_file(spark, str(path), loose=True).orderBy("position").collect()
    assert [(r.id, r.label, r.position) for r in got] == [("a", "C", 0), ("b", "B", 1)]


def test_maps_of_a_document_of_several_lines(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{\n "classes": {\n  "a": {"n": 1},\n  "b": {"n": 2}\n }\n}\n')
    assert sorted((r.key, r.n) for r in files.json_map(spark, str(path), "classes", "n: long").collect()) == [("a", 1), ("b", 2)]


def test_sinks_publish_whole_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string")
    files.write_json(rows, str(tmp_path / "j"))
    files.write_json(rows, str(tmp_path / "j"))
    files.write_csv(rows, str(tmp_path / "c"))
    files.write_csv(rows.limit(0), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert {(r.n, r.s) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("1", "a,b"), ("2", None)}
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 0


def test_pauses_double_up_to_a_minute():
    assert [state.backoff(i) for i in (0, 1, 5, 6, 9)] == [1, 2, 32, 60, 60] and state.backoff(1, 0.5) == 2.5


def test_a_class_without_rows_raises(spark):
    rows = spark.createDataFrame([("a",)], "label string")
    with pytest.raises(ValueError, match="b"):
        support.class_weights(rows, "label", classes=spark.createDataFrame([("a",), ("b",)], "label string"))
