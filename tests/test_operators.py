import difflib
import itertools
import random
import zipfile

from dossier.functions import fuzzy
from dossier.operators import filters, graph, joins, search, windows
from dossier.sources import files
from dossier.streaming import detectors
from pyspark.sql import functions as F


def slow_ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return 200 * t[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randrange(9))) for _ in "ab")
        assert fuzzy.ratio(a, b) == slow_ratio(a, b)


def test_fuzzy_pairs(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["ann lee", "anna lee", "ann  lee", ""]
    got = {(r.a, r.b): r.score for r in joins.fuzzy_pairs(spark.createDataFrame([(n,) for n in names + [None, "ann lee"]], "name string")).collect()}
    want = {(a, b): fuzzy.ratio(a, b) for a, b in itertools.combinations(sorted({n for n in names if n}), 2) if fuzzy.ratio(a, b) >= 80}
    assert got == want


def test_matcher(spark):
    row = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string").select(fuzzy.matcher_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in row] == [difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 0.0]


def test_hamming(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(30)]
    hashes = base + [b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(1, 12))) for b in base]
    got = {(r.a, r.b): r.distance for r in joins.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")).collect()}
    want = {(i, j): (hashes[i] ^ hashes[j]).bit_count() for i, j in itertools.combinations(range(len(hashes)), 2) if (hashes[i] ^ hashes[j]).bit_count() <= 8}
    assert got == want


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p ><w:r><w:t xml:space="preserve">three</w:t></w:r></w:p>')
    (tmp_path / "b.docx").write_bytes(b"broken")
    assert {r.name[-6:]: r.text for r in files.read_docx(spark, f"{tmp_path}/*.docx").collect()} == {"a.docx": "One & two\n\nthree", "b.docx": None}
    (tmp_path / "c.txt").write_text("a\nb")
    assert files.read_text(spark, f"{tmp_path}/c.txt").first().text == "a\nb"
    rows = spark.createDataFrame([("a.PDF", bytearray(b"%PDF-1")), ("b.png", bytearray(b"%PDF")), ("c.exe", bytearray(b"")), ("d.md", bytearray(b"x"))], "name string, content binary")
    got = rows.select(files.kind_of(F.col("name")).alias("k"), filters.file_errors(F.col("name"), F.col("content")).alias("e")).collect()
    assert [(r.k, r.e) for r in got] == [("pdf", ""), ("image", ""), (None, "empty; dangerous extension"), ("text", "unrecognized type")]
    words = spark.createDataFrame([(1, 0, 0, 0, 1, "b", 90.0), (1, 0, 0, 0, 0, "a", 80.0), (1, 0, 0, 1, 0, "c", 70.0), (1, 0, 1, 0, 0, "d", 100.0), (1, 0, 1, 0, 1, "no", -1.0)], "doc_id int, block int, par int, line int, place int, word string, conf double")
    assert tuple(files.assembled_lines(words).first()) == (1, "a b\nc\n\nd", 0.85)


def test_metadata_filter(spark):
    rows = spark.createDataFrame([(1, {"date": "2024-05-01", "type": "a"}), (2, {"type": "b"}), (3, {"date": "2025-01-01", "type": "a"})], "id int, metadata map<string,string>")
    kept = lambda w: [r.id for r in filters.metadata_filter(rows, w).orderBy("id").collect()]
    assert kept({"date_range": ("2024-01-01", "2024-12-31")}) == [1, 2]
    assert kept({"type": ["a", "c"]}) == [1, 3] and kept({"owner": "x"}) == []


def test_graph_helpers(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("a", "c", "x"), ("c", "c", "y")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted(r.id for r in graph.relation_path(edges, start, ["x", "y"]).collect()) == ["c", "c"]
    assert graph.neighbours(edges, "in").where("id = 'c'").count() == 3
    assert search.boosted(spark.createDataFrame([(1, 1, "Anna and Bo", 0.5)], "query_id int, doc_id int, text string, score double"), spark.createDataFrame([(1, "anna"), (1, "bo"), (1, "cy")], "query_id int, entity string")).first().score == 0.6


def test_streams_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null")
    # two of each time, so that ties count
    events = events.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/in")
    events = spark.read.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    def same(streamed, name, batch):
        rows = run(streamed, name)
        columns = sorted(rows.columns)
        got = sorted(map(tuple, rows.select(*columns).collect()))
        assert got == sorted(map(tuple, batch.select(*columns).collect())) and got

    wide = {"delay": "60 days"}
    same(detectors.failure_alerts(stream(), seconds=864_000, least=2, **wide), "alerts", windows.failures_in_window(events, "error", "signup", 864_000, 2))
    rate = windows.access_rate(events, 864_000, 3).join(events.select("event_id", "user_id"), "event_id")
    same(detectors.access_scores(stream(), seconds=864_000, most=3, **wide), "rate", rate)
    same(detectors.first_sightings(stream(), "event_type", **wide), "novel", windows.novelty(events, "event_type"))
    same(detectors.staged_hits(stream(), "signup", "view", 864_000, **wide), "staged", windows.staged(events, "signup", "view", 864_000))
    same(detectors.chained(stream(), ["event_id", "event_type"], **wide), "chain", windows.chained(events, "user_id", ["ts", "event_id"], ["event_id", "event_type"]))
    allowed = run(detectors.token_bucket(stream(), per_minute=0.0001, burst=2, **wide), "bucket")
    assert allowed.count() == events.count() and allowed.where("not allowed").count() > 0
    assert run(detectors.rates(stream(), "1 day"), "rates", "complete").selectExpr("sum(n)").first()[0] == events.count()
    assert run(detectors.sessions(stream(), "5 hours"), "sessions", "complete").count() == windows.session_spans(events, "5 hours").count()


def test_state_expires(spark, tmp_path):
    """Old failures neither count nor stay; files come one in a batch."""
    for i, day in enumerate((1, 1, 20, 20)):
        spark.createDataFrame([(i, 7, "error", f"2024-01-{day:02d} 00:0{i}:00")], "event_id long, user_id long, event_type string, ts string").selectExpr("event_id", "user_id", "event_type", "cast(ts as timestamp) as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    detectors.failure_alerts(stream, seconds=300, least=2).writeStream.format("memory").queryName("expiring").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.event_id, r.failures) for r in spark.table("expiring").collect()) == [(1, 2), (3, 2)]


def test_track_stages(spark, tmp_path):
    from dossier.operators import records

    rows = [("a", i, i, ["submitted", "verification", "printed", "delivered"][i % 4], ["", "Otto", ""][i % 3], ["Roads", ""][i % 2]) for i in range(7)] + [("b", 3, 9, "submitted", "", None)]
    schema = "application_id string, at long, event_id long, stage string, officer string, department string"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    detectors.track_stages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    last = spark.read.parquet(f"{tmp_path}/out/v=2").select("application_id", "stage", "officer", "department", "n_events")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, records.stage_changes(spark.createDataFrame(rows, schema)).select(*last.columns).collect()))
