import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folio import schemas
from folio.operators import catalog, enrich, mutate, search
from folio.sources import files, ingest
from folio.sources.library import Library
from folio.streaming import limits


def guides(spark, rows):
    full = [(i, t, c, "txt", f"{i}.txt", g, p, m, None, n, n) for n, (i, t, c, g, p, m) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.GUIDES)


@pytest.fixture
def some(spark):
    return guides(
        spark,
        [
            ("a", "Zelda", "boss strategy guide", "g1", 0, None),
            ("b", "Mario", "Bosses everywhere boss", None, None, "{}"),
            ("c", "Metroid", "walkthrough of café", "g1", 5, '{"tags":[]}'),
            ("d", "Boss", "complete walk through", "g2", None, '{"platform":"NES","tags":["x","y","x"],"summary":"s","aiAnalyzedAt":4}'),
        ],
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_lists(some):
    assert ids(catalog.guide_page(some, 2, 1)) == ["c", "b"]
    assert ids(catalog.recently_read(some)) == ["c", "a"]
    assert ids(catalog.missing(some, "tags")) == ["a", "b", "c"] and ids(catalog.missing(some, "metadata")) == ["a", "b", "c"]
    assert ids(catalog.guide_filter(some, "NES", ["x", "z"])) == ["d"] and ids(catalog.guide_filter(some, "", [])) == ["a", "b", "c", "d"]
    assert ids(catalog.guide_filter(some, tags=["x", "y"], match="all")) == ["d"] and ids(catalog.guide_filter(some, tags=["x", "z"], match="all")) == []
    assert sorted(r.tag for r in catalog.guide_tags(some).collect()) == ["x", "y"]
    assert catalog.content(some, "a").first().filename == "Zelda.txt"
    assert "content" not in catalog.guides_of_game(some, "g1").columns and ids(catalog.guides_of_game(some, "g1")) == ["c", "a"]


def test_joins(spark, some):
    games = spark.createDataFrame([("g1", "B", None, "NES", 0.0, "not_started", None, '{"external_id":"7"}', 1, 1), ("g2", "A", None, "", 0.0, "completed", None, None, 2, 2), ("g3", "C", None, None, 0.0, "completed", None, None, 3, 3)], schemas.GAMES)
    assert [(r.id, r.guide_count) for r in catalog.with_guide_count(games, some).collect()] == [("g2", 1), ("g1", 2), ("g3", 0)]
    assert [r.game and r.game.id for r in catalog.with_games(some, games).collect()] == ["g2", "g1", None, "g1"]
    assert ids(catalog.by_external_id(games, "7")) == ["g1"] and [r.platform for r in catalog.listed(games, "platform").collect()] == ["NES"]
    assert ids(catalog.games_by_status(games, "completed")) == ["g3", "g2"]
    with pytest.raises(ValueError):
        catalog.search_titles(games, "  ")
    assert ids(catalog.union_distinct(games.limit(1).select("id"), games.select("id")).orderBy("_bucket", "id")) == ["g1", "g2", "g3"]


def test_note_order(spark):
    notes = spark.createDataFrame([("n1", "g", 5, "x", 1, 1), ("n2", "g", None, "x", 3, 3), ("n3", "g", 1, "x", 2, 2), ("n4", "g", None, "x", 0, 0)], schemas.NOTES)
    assert ids(catalog.notes_of(notes, "g")) == ["n3", "n1", "n4", "n2"]


def test_bm25_golden(spark):
    docs = spark.createDataFrame([("0", "boss strategy guide"), ("1", "Bosses everywhere boss"), ("2", "walkthrough of café"), ("3", "complete walk through"), ("4", '["boss","strategy"]')], "id string, t string")
    index = search.index(docs, ["t"])
    got = {r.doc_id: r.score for r in search.score(*index, "boss").collect()}
    want = {"1": -1.3479212253829e-06, "4": -1.1323529411765e-06, "0": -9.7160883280757e-07}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-17 for k in want)
    hit = lambda q: sorted(r.doc_id for r in search.score(*index, q).collect())
    assert hit("cafe") == ["2"] and hit("walk*") == ["2", "3"] and hit('"strategy guide"') == ["0"] and hit("boss NOT guide") == ["1", "4"]
    assert hit("boss strategy") == ["0", "4"] and hit("everywhere OR complete") == ["1", "3"] and hit("(boss OR walk) AND complete") == ["3"] and hit("t:boss") == ["0", "1", "4"]
    for bad in ("c++", '"open', "role-playing", "", "AND x", "(a"):
        with pytest.raises(search.QuerySyntaxError):
            search.parse(bad)


def test_two_buckets(some):
    out = search.search(some, search.index(search.meta_docs(some), ["title", "tags"]), search.index(search.content_docs(some), ["content"]), "boss", 1).collect()
    assert [(r.id, r.bucket) for r in out] == [("d", "guides"), ("b", "content")]


def test_changes(spark, some):
    after = mutate.update(some, "guides", spark.createDataFrame([("a", "New", 1)], "id string, title string, nope int"), 99)
    row = after.filter("id = 'a'").first()
    assert (row.title, row.updated_at, row.content) == ("New", 99, "boss strategy guide") and after.count() == 4
    assert mutate.set_position(some, "b", 7, 50).filter("id = 'b'").first().last_read_position == 7
    with pytest.raises(mutate.ConstraintError):
        mutate.set_position(some, "b", -1, 50)
    meta = spark.createDataFrame([("b", '{"aiAnalyzedAt": 12}')], "id string, metadata string")
    assert mutate.set_metadata(some, meta, 60).filter("id = 'b'").first().ai_analyzed_at == 12
    with pytest.raises(mutate.ConstraintError):
        mutate.insert(some, "guides", spark.createDataFrame([("T", "c", "exe", "p")], "title string, content string, format string, file_path string"), 1)
    with pytest.raises(mutate.ConstraintError):
        mutate.insert(some, "guides", spark.createDataFrame([("T", "c", "txt", "p", "{bad")], "title string, content string, format string, file_path string, metadata string"), 1)
    with pytest.raises(mutate.ConstraintError):
        mutate.insert(some, "guides", spark.createDataFrame([("a", "T", "c", "txt", "p")], "id string, title string, content string, format string, file_path string"), 1)
    more = mutate.insert(some, "guides", spark.createDataFrame([("T", "c", "txt", "p")], "title string, content string, format string, file_path string"), 77)
    assert more.count() == 5 and more.filter("title = 'T'").first().created_at == 77
    notes = mutate.insert(spark.createDataFrame([], schemas.NOTES), "notes", spark.createDataFrame([("a", " hi ")], "guide_id string, content string"), 3, some)
    assert notes.first().content == "hi"
    with pytest.raises(mutate.ConstraintError):
        mutate.insert(spark.createDataFrame([], schemas.NOTES), "notes", spark.createDataFrame([("zz", "hi")], "guide_id string, content string"), 3, some)


def test_cascades(spark, some):
    c = mutate.Catalog.empty(spark)
    notes = spark.createDataFrame([("n1", "a", 1, "x", 1, 1), ("n2", "b", 1, "x", 1, 1)], schemas.NOTES)
    c = mutate.Catalog(some, spark.createDataFrame([("g1", "t", None, None, 0.0, "completed", None, None, 1, 1)], schemas.GAMES), c.bookmarks, notes, c.achievements)
    gone = spark.createDataFrame([("a",)], "id string")
    after = c.delete_guides(gone)
    assert sorted(ids(after.guides)) == ["b", "c", "d"] and ids(after.notes) == ["n2"]
    after = c.delete_games(spark.createDataFrame([("g1",)], "id string"))
    assert [r.game_id for r in after.guides.orderBy("id").collect()] == [None, None, None, "g2"] and after.games.count() == 0


def test_enrichment(spark, some):
    def model(p):
        if "Mario" in p:
            raise RuntimeError("down")
        return 'so: {"gameName": "G", "platform": "", "author": "X", "tags": ["t", 1]} .' if "JSON" in p else "sum"

    done = {r.id: r for r in enrich.run_batch(some, model).collect()}
    assert done["a"].result.gameName == "G" and done["a"].result.tags == ["t"] and done["a"].result.platform is None and done["b"].error == "down"
    assert tuple(enrich.counters(enrich.run_batch(some, model)).first()) == (4, 3, 1)
    out = {r.id: json.loads(r.metadata) for r in enrich.analyse_all(some, model, 9).collect()}
    assert out["d"]["platform"] == "NES" and out["d"]["summary"] == "sum" and out["b"]["aiAnalysisError"] == "down" and out["b"]["aiAnalyzedAt"] == 9
    answers = spark.createDataFrame([("no json",), ("{bad",), ("{bad}",)], "a string").select(enrich.from_answer(F.col("a")).alias("r")).collect()
    assert answers[0].r is not None and answers[2].r is None


def test_rate_limit(spark):
    rows = spark.createDataFrame([("k", t, str(t)) for t in (7, 12, 16, 18)], "key string, ts long, id string")
    got = [r.allowed for r in limits.rate_limit(rows, 10, 2).orderBy("ts").collect()]
    assert got == [True, True, False, True]
    rows = spark.createDataFrame([("k", t, str(t), t == 700) for t in (0, 100, 500, 600, 700)], "key string, ts long, id string, done boolean")
    assert [r.ts for r in limits.throttle(rows).orderBy("ts").collect()] == [0, 500, 700]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("k", t, str(t)) for t in (7, 12, 16, 18)], "key string, ts long, id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts long, id string").parquet(str(tmp_path / "in"))
    q = limits.rate_limit_stream(stream, 10, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("ts").collect()] == [True, True, False, True]
    seen = []

    def broken(_):
        if seen:
            raise RuntimeError

    limits.publish(stream, [broken, seen.append], str(tmp_path / "p"), snapshot=["now"]).awaitTermination(120)
    assert seen[0] == ["now"] and sum(map(len, seen[1:])) == 4


def test_ingest(spark, tmp_path):
    root = tmp_path / "tree/snes/12-star-road/faqs"
    root.mkdir(parents=True)
    (root / "1-star-road-guide.txt").write_bytes(b"Star Road FAQ by Bob\nboss \xff\n")
    (root / "2-star-road-maps.HTM").write_text("<title>Maps</title><p>x")
    (tmp_path / "tree/readme.md").write_text("# Read me\n")
    (tmp_path / "tree/skip.bin").write_text("no")
    games = spark.createDataFrame([], schemas.GAMES)
    assert ingest.ingest(spark, str(tmp_path / "tree"), str(tmp_path / "out"), games, 5) == {"imported": 3, "skipped": 0, "errors": 0}
    library = Library(spark, str(tmp_path / "out"))
    got = {r.title: r for r in library.table("guides").collect()}
    assert set(got) == {"Star Road FAQ", "Maps", "Read me"} and json.loads(got["Maps"].metadata)["platform"] == "SNES" and "�" in got["Star Road FAQ"].content
    made = library.table("games").collect()
    assert [(g.title, json.loads(g.metadata)["external_id"]) for g in made] == [("Star Road", "12")]
    assert got["Maps"].game_id == got["Star Road FAQ"].game_id == made[0].id and got["Read me"].game_id is None


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.7Z", b"1")
        z.writestr("two.txt", b"2")
    (tmp_path / "b.zip").write_bytes(b"broken")
    rows = files.scan_zip(spark, str(tmp_path), ".7z").collect()
    assert sorted((r.entry or "", r.error is None) for r in rows) == [("", False), ("x/one.7Z", True)]


def test_whole_conversations_sorted(spark):
    from folio.plans import registry

    out = [(r.conv_id, r.turn) for r in registry.queries()["turns_sorted_all"](spark, "/root/testdata/sf0.01").collect()]
    assert len(out) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count() and max(out)[0] >= 50
    assert out == sorted(out, key=lambda r: (r[0], r[1] is None, r[1] or 0))
