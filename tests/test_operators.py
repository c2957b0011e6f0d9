"""Operators on small tables: quality, changes, joins, summaries, upserts, ads, sources and streams."""

import datetime
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from quotelake.functions import arrays, rules
from quotelake.operators import ads, changes, joins, quality, representative, summaries, upsert
from quotelake.plans import relational
from quotelake.sources import readers, sinks
from quotelake.streaming import incremental

D = datetime.date


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def test_representative_is_the_lower_middle_row(spark):
    frame = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 2.0, 3), ("a", 9.0, 4), ("b", 5.0, 5), (None, 7.0, 6), (None, 8.0, 7), ("c", None, 8)], "k string, v double, id int")
    got = representative.representative_rows(frame, ["k"], "v", ["id"])
    assert rows(got, "k", "id", "n") == [("a", 2, 4), ("b", 5, 1), (None, 6, 2)]


def test_versus_verdicts(spark):
    frame = spark.createDataFrame([("x", "me", 1.0), ("x", "o", 2.0), ("y", "me", 3.0), ("y", "o", 2.0), ("z", "me", 2.0), ("z", "o", 1.0), ("z", "p", 3.0), ("u", "me", 1.0), ("w", "o", 1.0)], "line string, s string, v double")
    assert dict(rows(representative.versus(frame, ["line"], "s", "v", "me"), "line", "verdict")) == {"x": "wins", "y": "loses", "z": "middle", "u": "alone", "w": "none"}


def test_comparable_lines_need_sellers_and_agreement(spark):
    data = [("a", s, v) for s, v in (("p", 1.0), ("p", 2.0), ("q", 3.0), ("r", 4.0))] + [("b", "p", 1.0), ("b", "q", 1.0), ("c", "p", 0.0), ("c", "q", 1.0), ("c", "r", 50.0)]
    got = representative.comparable_lines(spark.createDataFrame(data, "line string, s string, v double"), ["line"], "s", "v")
    assert rows(got, "line", "sellers", "median", "within", "trusted") == [("a", 3, 3.0, 2.0, True), ("c", 3, 1.0, 1.0, False)]


def test_deduplicate_keeps_columns_apart_and_counts(spark):
    data = [("x", "c1", 1, "long quote", 1), ("x", "c1", 1, "q", 2), ("x", "c2", 1, "q", 3), (None, None, 1, "a", 4), (None, None, 1, "b", 5)]
    got = quality.deduplicate(spark.createDataFrame(data, "f string, col string, v int, quote string, at int"), ["f", "col", "v"], [F.length("quote")], "at")
    assert rows(got, "f", "col", "quote", "occurrences") == [("x", "c1", "long quote", 2), ("x", "c2", "q", 1), (None, None, "a", 2)]


def test_ambiguity(spark):
    def verdicts(data):
        frame = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "id int, doc string, s string, v double, cond string, col string")
        return [(r["ambiguous"], r["reason"]) for r in quality.mark_ambiguous(frame, ["doc", "s"], "v", ["cond", "col"]).orderBy("id").collect()]

    assert verdicts([("d", "s", 1.0, "a", None), ("d", "s", 2.0, None, None), ("d", "s", 3.0, None, None)]) == [(True, "cond")] * 3
    assert verdicts([("d", "s", 1.0, "a", None), ("d", "s", 2.0, "b", None)]) == [(False, None)] * 2
    assert verdicts([("d", "s", 1.0, None, None), ("d", "s", 1.0, None, None), ("e", "s", 2.0, None, None)]) == [(False, None)] * 3
    assert verdicts([("d", None, 1.0, None, None), ("d", None, 2.0, None, None)]) == [(False, None)] * 2


def test_versions(spark):
    data = [(1, "b", "pf", "f", D(2026, 7, 1), False, None), (2, "b", "pf", "f", D(2026, 8, 1), False, None), (3, "b", "pf", "en", D(2026, 8, 1), True, None), (4, "b", "pf", "old", D(2024, 1, 1), False, None), (5, "b", "pj", "old", D(2024, 1, 1), False, "VIITOR"), (6, "c", "pf", "en", D(2026, 8, 1), True, None)]
    frame = spark.createDataFrame(data, "id int, bank string, seg string, fam string, day date, en boolean, state string")
    got = quality.mark_versions(frame, "bank", "seg", "fam", "day", translated=F.col("en"), state="state")
    assert dict(rows(got, "id", "version_state")) == {1: "ISTORIC", 2: "IN_VIGOARE", 3: "DUBLURA", 4: "ISTORIC", 5: "VIITOR", 6: "IN_VIGOARE"}


def test_current_hides_and_keeps_the_rest(spark):
    frame = spark.createDataFrame([(1, None), (2, "ISTORIC"), (3, "IN_VIGOARE"), (4, "IN_VIGOARE"), (5, "VIITOR")], "id int, state string")
    hidden = spark.createDataFrame([(4,), (4,), (99,)], "id int")
    visible = quality.current(frame, "id", "state", [hidden])
    assert rows(visible, "id") == [(1,), (3,)]


def test_version_diff(spark):
    schema = "id int, service string, label string, kind string, band string, v double"

    def kinds(old, new):
        a, b = (spark.createDataFrame([(i + k, *r) for i, r in enumerate(d)], schema) for k, d in ((0, old), (100, new)))
        return sorted((r["kind"], r["old_value"], r["new_value"]) for r in _diff(a, b).collect())

    def _diff(a, b):
        out = changes.version_diff(a.withColumnRenamed("kind", "what"), b.withColumnRenamed("kind", "what"), ["service", "label", "what"], "band", "v", ["service", "what"], "id")
        return out.where("kind <> 'price' or not old_value <=> new_value").select("kind", F.coalesce("old_value", F.lit(-1.0)).alias("old_value"), F.coalesce("new_value", F.lit(-1.0)).alias("new_value"))

    one = ("s", "l", "fee", "b", 15.0)
    assert kinds([one], [("s", "l", "fee", "b", 20.0)]) == [("price", 15.0, 20.0)]
    assert kinds([one], [one]) == []
    assert kinds([one], [("s", "other", "fee", "b", 15.0)]) == [("reformatted", 15.0, 15.0)]
    assert kinds([one], [("s", "l", "fee", "c", 15.0)]) == [("band", 15.0, 15.0)]
    assert kinds([one], [("t", "l", "fee", "b", 15.0)]) == [("appeared", -1.0, 15.0), ("disappeared", 15.0, -1.0)]
    assert kinds([one], [("s", "l", "rate", "b", 15.0)]) == [("appeared", -1.0, 15.0), ("disappeared", 15.0, -1.0)]


def test_as_of_with_keys_and_gaps(spark):
    facts = spark.createDataFrame([(1, "a", D(2026, 1, 1)), (2, "a", D(2026, 3, 15)), (3, "a", D(2026, 9, 1)), (4, "b", D(2026, 9, 1)), (5, None, D(2026, 9, 1)), (6, "a", D(2026, 3, 10))], "id int, k string, day date")
    series = spark.createDataFrame([("a", D(2026, 3, 10), 1.0), ("a", D(2026, 3, 20), 2.0), ("b", D(2026, 10, 1), 3.0)], "k string, d date, v double")
    assert rows(joins.as_of(facts, "day", series, "d", "v", ["k"]), "id", "v") == [(1, None), (2, 1.0), (3, 2.0), (4, None), (5, None), (6, 1.0)]


def test_most_alike_and_reachable(spark):
    left = spark.createDataFrame([("b", "tarife persoane fizice"), ("b", "altceva"), ("c", "tarife")], "block string, a string")
    right = spark.createDataFrame([("b", "tarife persoane fizice 2"), ("b", "tarife persoane"), ("d", "tarife")], "block string, b string")
    assert rows(joins.most_alike(left, right, "block", "a", "b", 0.9), "a", "b") == [("tarife persoane fizice", "tarife persoane fizice 2")]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src int, dst int")
    assert rows(joins.reachable(links, spark.createDataFrame([(1,)], "node int"), 3)) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None, D(2026, 1, 1)), (2, "manual", "x", D(2026, 1, 1))], "id int, how string, text string, seen date")
    new = spark.createDataFrame([(1, None, "t", D(2025, 1, 1)), (2, "auto", "y", D(2026, 2, 1)), (3, "auto", "z", D(2026, 2, 1))], old.schema)
    once = upsert.upsert(old, new, ["id"], {"seen": "greatest"}, keep_old=F.col("how") == "manual")
    assert rows(once) == [(1, "a", "t", D(2026, 1, 1)), (2, "manual", "x", D(2026, 1, 1)), (3, "auto", "z", D(2026, 2, 1))]
    assert rows(upsert.upsert(once, new, ["id"], {"seen": "greatest"}, keep_old=F.col("how") == "manual")) == rows(once)
    assert rows(upsert.insert_new(upsert.insert_new(old, new, ["id"]), new, ["id"]), "id") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        upsert.guard_shrink(old, old.limit(1), "text")
    with pytest.raises(ValueError):
        upsert.reconcile(5, old)
    assert rows(upsert.kept_until(old, "seen", "seen", F.lit(D(2026, 1, 15)))) == []


def test_rules_and_arrays(spark):
    frame = spark.createDataFrame([("MAPS:0-1000:;YOUTUBE:400000-450000:",), ("A:5-9:;B:5-:",), ("A:0-1000:",), ("",), (None,)], "p string")
    assert [r[0] for r in frame.select(arrays.main_platform(F.col("p"))).collect()] == ["YOUTUBE", "A+B", "sub_1000", "fara_date", "fara_date"]
    path = spark.createDataFrame([("Cards > Fees > Emit",), ("none",)], "p string")
    assert [r[0] for r in path.select(rules.nearest_level(F.col("p"), [("card", "Card"), ("fee", "Fee")])).collect()] == ["fee", None]


def test_ads_and_campaigns(spark):
    shown = spark.createDataFrame([("1", D(2026, 9, 1), D(2026, 9, 10), 5, ads.OPEN, "M:0-1000:"), ("1", D(2026, 7, 1), D(2026, 7, 2), 3, 9, ""), ("2", D(2026, 9, 1), D(2026, 9, 1), 1, 2, "")], "advertiser_id string, first_shown date, last_shown date, times_shown_lower_bound long, times_shown_upper_bound long, platforme string")
    who = spark.createDataFrame([("1", "bank", "banca"), ("2", "agency", "agentie")], "advertiser_id string, banca string, rol string")
    got = ads.ads_summary(ads.enrich_ads(shown, who), ["banca"]).first()
    assert (got["banca"], got["ads"], got["low"], got["high"], got["open"], got["active7"], got["active90"], got["new30"]) == ("bank", 2, 8, 9, True, 1, 2, 1)
    pieces = [("c", 2, "T2", D(2026, 1, 1), D(2026, 12, 31), None, False, True), ("c", 1, "T1", None, None, "b", True, True), ("d", 1, "X", D(2020, 1, 1), D(2026, 1, 1), None, True, False)]
    merged = ads.merge_campaign(spark.createDataFrame(pieces, "campaign string, rank int, title string, start date, end date, benefit string, deduced boolean, fetched boolean"), F.lit(D(2026, 9, 1)))
    assert rows(merged, "campaign", "title", "benefit", "state", "reasons") == [("c", "T1", "b", "activa", []), ("d", "X", None, "de_verificat", ["window_too_long", "year_deduced", "not_fetched"])]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": None}]))
    assert rows(readers.json_records(spark, str(tmp_path / "a.json"), "x int")) == [(1,), (None,)]
    (tmp_path / "k.json").write_text(json.dumps({"p": {"d": "1"}, "q": {"d": None}}))
    assert rows(readers.json_by_key(spark, str(tmp_path / "k.json"), "d string")) == [("p", "1"), ("q", None)]
    (tmp_path / "j.log").write_text('{"s": "BLOCAT", "n": 1}\n{"s": "OK"}\n{bad BLOCAT\n')
    good, bad = readers.journal(spark, str(tmp_path / "j.log"), "s string, n int", "BLOCAT")
    assert rows(good) == [("BLOCAT", 1)] and bad.count() == 1
    (tmp_path / "c.csv").write_text('a,b,n\n" x","line\n""two""",\n ,,5\n')
    assert rows(readers.csv(spark, str(tmp_path / "c.csv"), "a string, b string, n int", verbatim=True)) == [(" x", 'line\n"two"', None), ("\u00a0", None, 5)]
    pack = tmp_path / "pack"
    pack.mkdir()
    (pack / "one.bin").write_bytes(b"1")
    files = readers.raw_files(spark, str(pack))
    digest = files.first()["hash"]
    assert readers.check_manifest(files, spark.createDataFrame([("one.bin", digest)], "name string, sha256 string")).count() == 0
    with pytest.raises(ValueError, match="two.bin: missing"):
        readers.require_manifest(files, spark.createDataFrame([("one.bin", digest), ("two.bin", "x")], "name string, sha256 string"))
    for day in ("2026-01-01", "2026-02-01"):
        spark.range(2 if day > "2026-01-15" else 5).write.parquet(str(tmp_path / f"snap_{day}"))
    both = spark.read.parquet(*(str(tmp_path / f"snap_{d}") for d in ("2026-01-01", "2026-02-01")))
    assert readers.newest_snapshot(both).count() == 2
    (tmp_path / "fx.xml").write_text('<D><Cube date="2026-09-01"><Rate currency="EUR">5.07</Rate><Rate currency="HUF" multiplier="100">1.3</Rate></Cube></D>')
    assert rows(readers.exchange_rates(spark, str(tmp_path / "fx.xml"))) == [(D(2026, 9, 1), "EUR", 5.07), (D(2026, 9, 1), "HUF", 0.013)]
    sinks.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), str(tmp_path / "t"), ["k"])
    sinks.overwrite_partitions(spark.createDataFrame([("b", 3)], "k string, v int"), str(tmp_path / "t"), ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "t")), "k", "v") == [("a", 1), ("b", 3)]
    assert sinks.markdown(spark.createDataFrame([("x|y", None)], "a string, b int"), "T").endswith("| x\\|y |  |")


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "url string, ts timestamp, hash string"
    t = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    spark.createDataFrame([("a", t(1), "x"), ("a", t(2), "x"), ("b", t(1), None)], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("a", t(3), "y"), ("b", t(4), "z")], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = incremental.document_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(out), "url", "state", "changes") == [("a", "NESCHIMBAT", 0), ("a", "NOU", 0), ("a", "SCHIMBAT", 1), ("b", "NEDESCARCAT", 0), ("b", "NOU", 0)]


def test_upsert_stream(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 5)], "id int, name string, seen int").write.parquet(f"{target}/0")
    version = [0]

    def read():
        return spark.read.parquet(f"{target}/{version[0]}")

    def write(df):
        df.write.mode("overwrite").parquet(f"{target}/{version[0] + 1}")
        version[0] += 1

    spark.createDataFrame([(1, None, 7), (2, "b", 1)], "id int, name string, seen int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, name string, seen int").parquet(str(tmp_path / "in"))
    incremental.upsert_stream(stream, read, write, ["id"], {"seen": "greatest"}, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(read()) == [(1, "a", 7), (2, "b", 1)]


def test_document_states_and_resume(spark):
    known = spark.createDataFrame([("u1", "o", "h"), ("u2", "o", "h"), ("u3", "o", "h"), ("u4", "p", "h"), ("u5", "o", "h")], "url string, owner string, hash string")
    seen = spark.createDataFrame([("u1", "o", "h", True), ("u2", "o", "g", True), ("u5", "o", None, False), ("u6", "o", "a", True), ("u6", "o", "b", True), ("u7", "o", "a", True)], "url string, owner string, hash string, ok boolean")
    crawled = spark.createDataFrame([("o",)], "owner string")
    assert dict(rows(incremental.document_states(known, seen, crawled), "url", "state")) == {"u1": "NESCHIMBAT", "u2": "SCHIMBAT", "u3": "LIPSA", "u4": "NEVERIFICAT", "u5": "NEDESCARCAT", "u6": "AMBIGUU", "u7": "NOU"}
    todo, done = spark.createDataFrame([("a",), ("b",)], "bank string"), spark.createDataFrame([("a", D(2026, 1, 1), "ok"), ("b", D(2026, 1, 1), "failed")], "bank string, day date, status string")
    assert rows(incremental.remaining(todo, done, ["bank"], F.lit(D(2026, 1, 1)))) == [("b",)]


def test_summaries(spark):
    lines = spark.createDataFrame([("d", p, "footer") for p in range(5)] + [("d", 1, "once"), ("d", 2, "twice"), ("d", 3, "twice")], "doc string, page int, line string")
    assert rows(summaries.page_furniture(lines, "doc", "page", "line"), "line") == [("footer",), ("twice",)]
    frame = spark.createDataFrame([("b",), ("",), (None,), ("a",)], "x string")
    assert [r["x"] for r in frame.orderBy(*summaries.blanks_last(F.col("x"), True)).collect()][:2] == ["b", "a"]


def test_most_alike_part_is_another_part(spark, small):
    from difflib import SequenceMatcher

    parts = spark.createDataFrame(
        [(k, f"{name}{k % 3}", brand, 1, "T") for k, (name, brand) in enumerate([("green steel plate ", "A"), ("green steel plates ", "A"), ("rose tin cup ", "B")] * 4)] + [(90, "alone in its block", "C", 1, "T")],
        "p_partkey long, p_name string, p_brand string, p_size int, p_type string",
    )
    left = parts.select("p_partkey", "p_name", F.col("p_brand").alias("block"))
    right = parts.select(F.col("p_partkey").alias("other_partkey"), F.col("p_name").alias("other"), F.col("p_brand").alias("block"))
    twice = left.unionByName(left.where("p_partkey = 0"))
    got = sorted((r["p_partkey"], r["other_partkey"], r["other"]) for r in joins.most_alike(twice, right, "block", "p_name", "other", 0.9, ids=("p_partkey", "other_partkey")).collect())
    rows_ = parts.collect()
    want = []
    for p in rows_:
        near = [(SequenceMatcher(None, p["p_name"], o["p_name"], autojunk=False).ratio(), o["p_name"], -o["p_partkey"]) for o in rows_ if o["p_brand"] == p["p_brand"] and o["p_partkey"] != p["p_partkey"]]
        near = [x for x in near if x[0] >= 0.9]
        if near:
            want += [(p["p_partkey"], -max(near)[2], max(near)[1])] * (2 if p["p_partkey"] == 0 else 1)
    assert got == sorted(want) and len(got) > 10
    registered = relational.join20_most_alike(spark, small)
    assert registered.where("p_partkey = other_partkey").isEmpty()


def plain_middle(rows, cap=None):
    """The lower middle row of each cell by plain sorting."""
    cells = {}
    for k, v, i, tag in rows:
        if v is not None and v == v and abs(v) != float("inf") and (cap is None or v <= cap):
            cells.setdefault(k, []).append((v, (i is not None, i), tag))
    return {k: (sorted(r)[(len(r) + 1) // 2 - 1][0], sorted(r)[(len(r) + 1) // 2 - 1][1][1], len(r)) for k, r in cells.items()}


def test_representative_of_outliers_hot_prices_and_odd_values(spark):
    rng = random.Random(4)
    rows = [("outlier", rng.random() * 100, i, "a") for i in range(3000)] + [("outlier", 1e12, -1, "a")]
    rows += [("hot", 7.0 if i % 3 else rng.random() * 14, rng.randrange(10**6), "b") for i in range(6000)]
    rows += [("one", 7.0, i, "c") for i in range(5000)] + [("equal", 1.0, 5, "d")] * 400 + [("nulltie", 2.0, None if i % 2 else i, "e") for i in range(301)]
    rows += [("odd", v, i, "f") for i, v in enumerate([float("nan"), float("inf"), float("-inf"), None, 3.0, 4.0])] + [("none", float("nan"), 1, "g"), (None, 5.0, 1, "h"), (None, 6.0, 2, "h")]
    frame = spark.createDataFrame(rows, "k string, v double, id long, tag string").repartition(5)
    got = {r["k"]: (r["v"], r["id"], r["n"]) for r in representative.representative_rows(frame, ["k"], "v", ["id", "tag"]).collect()}
    assert got == plain_middle(rows)
    capped = representative.matrix(frame, "k", "tag", "v", ["id"], cap=50.0, keep=["id"]).collect()
    want = plain_middle(rows, 50.0)
    assert {r["k"]: (r["value"], r["id"], r["n"]) for r in capped} == want
    assert {r["k"]: r["implausible"] for r in capped}["outlier"] == sum(v > 50 for k, v, *_ in rows if k == "outlier")


def test_representative_by_text_and_date_ties(spark):
    rows = [("c", 1.0, f"name{i % 17:02d}é{i}", datetime.date(2024, 1, 1) + datetime.timedelta(days=i % 40)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k string, v double, s string, d date")
    by_text, by_date = (representative.representative_rows(frame, ["k"], "v", t).first() for t in (["s", "d"], ["d", "s"]))
    assert by_text["s"] == sorted(r[2] for r in rows)[999] and (by_date["d"], by_date["s"]) == sorted((r[3], r[2]) for r in rows)[999]


def test_most_alike_equals_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 24))) for _ in range(60)]
    near = [w[:k] + rng.choice("xyz") + w[k + 1 :] for w in words for k in [rng.randrange(len(w) + 1)]]
    left = [(i, "hot" if i % 3 else "b", w) for i, w in enumerate(words + near + [None])]
    right = [(i, "hot" if i % 3 else "b", w) for i, w in enumerate(near + words + words[:5])]
    got = joins.most_alike(spark.createDataFrame(left, "a_id int, block string, a string"), spark.createDataFrame(right, "b_id int, block string, b string"), "block", "a", "b", 0.85, ("a_id", "b_id"))
    found = {r["a_id"]: (r["b"], round(r["share"], 9), r["b_id"]) for r in got.collect()}
    want = {}
    for i, block, a in left:
        scored = [(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), b, -j) for j, other, b in right if a is not None and other == block and i != j]
        best = max((s for s in scored if s[0] >= 0.85), default=None)
        if best:
            want[i] = (best[1], round(best[0], 9), -best[2])
    assert found == want and len(want) > 60


def test_most_alike_compares_texts_once_whatever_their_copies(spark):
    """Copies of a text have each other, the smallest id but their own; the only row of a text has the best of the others."""
    rows = [(k, "green apple pie" if k % 2 else "green apple pies", "x") for k in range(200)] + [(900, "blue berry tart", "x"), (901, "blue berry tarts", "x"), (902, "alone", "x"), (903, None, "x"), (None, "blue berry tart", "x")]
    left = spark.createDataFrame(rows, "id int, t string, b string")
    right = left.select(F.col("id").alias("other_id"), F.col("t").alias("other"), "b")
    found = joins.most_alike(left, right, "b", "t", "other", 0.9, ids=("id", "other_id"))
    got = {r.id: (r.other, r.other_id) for r in found.collect()}
    want = {}
    for i, t, _ in rows:
        near = [(difflib.SequenceMatcher(None, t, u, autojunk=False).ratio(), u, -j) for j, u, _ in rows if i is not None and j is not None and t and u and i != j]
        if near and max(near)[0] >= 0.9:
            want[i] = (max(near)[1], -max(near)[2])
    assert got == want and got[0] == ("green apple pies", 2) and got[900] == ("blue berry tarts", 901)
