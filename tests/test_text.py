import pytest
from pyspark.sql import functions as F

from folio.functions import params, porter
from folio.functions import text as T


def ask(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.title_from_filename, "a/522595-the_legend-of-zelda-faq-1234.txt", "The Legend of Zelda"),
        (T.clean_title, "Zelda FAQ v1.2 by Bob", "Zelda FAQ v1.2"),
        (T.clean_title, "Zelda FAQ by Bob v1.2", "Zelda FAQ"),
        (T.clean_title, "== *** A   title --- ", "== A title"),
        (T.decode_entities, "&amp;lt;", "&lt;"),
        (T.decode_entities, "&amp;quot;", '"'),
        (T.platform, "Xbox 360 guide", "Xbox"),
        (T.platform, "éNES", "NES"),
        (T.platform, "NESx", None),
        (T.detect_format, "a.HTM", "html"),
        (T.detect_format, "b.markdown", "md"),
        (T.detect_format, "c.xyz", "txt"),
        (T.detect_format, "noext", "txt"),
        (T.js_trim, "  x﻿　", "x"),
        (T.author, "intro\nWritten by: Jo Do \n", "Jo Do"),
        (T.author, "none\nJane Doe\n", "Jane Doe"),
        (T.author, "nothing here", None),
        (T.version, "Version: 2.0.", "2.0."),
        (T.normalize_platform, "Xbox-360", "Xbox 360"),
        (T.normalize_platform, "3rd", "3DO"),
        (T.normalize_platform, "zzz", None),
        (T.markdown_title, "x\n#  Hello \n", "Hello"),
        (T.html_title, "<TITLE a>\n A &amp; B </title><h1>C</h1>", "A &amp; B"),
        (T.html_to_text, "<p>a<br/>b</p><script>var x='</p>'</script><div> c </div>", "a\nb\n\nc\n"),
        (T.mime, "md", "text/markdown"),
        (T.title_from_content, "=====\n\n            Short One\nA longer plain line here\n", "A longer plain line here"),
        (T.title_from_content, "            Centered X\nplain line number two\n", "Centered X"),
        (T.title_from_content, "first line of text\nMy FAQ v2.0\n", "My FAQ"),
        (T.title_from_content, "ab\n\n", None),
    ],
)
def test_scalar(spark, f, given, want):
    assert ask(spark, f, given) == want


def test_paths(spark):
    g = ask(spark, T.game_from_path, "/x/snes/588442-super-metroid/faqs/10114-super-metroid-guide.txt")
    assert (g.external_id, g.name, g.platform) == ("588442", "Super Metroid", "SNES")
    for path, want in (("12-zelda-faqs-1.txt", ("12", "Zelda", None)), ("12-faqs.txt", ("12", "Unknown Game", None)), ("readme.txt", (None, "Readme", None)), ("/a/b/faqs/7-x-y.txt", ("7", "X Y", None))):
        assert tuple(ask(spark, T.game_from_path, path)) == want


def test_parse(spark):
    p = ask(spark, T.parse, "  \n", "x.txt")
    assert p.title == "X (Empty Guide)" and p.content == T.EMPTY_CONTENT and p.author is None
    assert ask(spark, T.parse, "", "d/y.pdf").content == T.PDF_CONTENT + "y.pdf"
    assert ask(spark, T.parse, "<title>Hi</title><p>Version: 1.5", "z.html").version == "1.5"
    assert ask(spark, T.html_to_text, "<script>" + "<" * 20_000) is not None  # no stack overflow


def test_tags_and_names(spark):
    assert ask(spark, T.auto_tags, "A boss in stock, 100%", "my-faq.txt") == ["FAQ", "Boss Guide", "Complete Guide", "Table of Contents"]
    art = "\n".join(["+-=*/+-=*/+-="] * 6)
    assert "ASCII Art" in ask(spark, T.auto_tags, art, "a.txt") and not ask(spark, T.ascii_art, "\n".join(["+-=*/+-=*/+-="] * 5))
    assert ask(spark, T.download_name, 'a\\b "c"\r\nd', "txt") == "a_b 'c' d.txt"


@pytest.mark.parametrize(("pct", "want"), [(-50, (0, "not_started")), (0.5, (0.5, "in_progress")), (150, (100, "completed"))])
def test_completion(spark, pct, want):
    assert tuple(spark.range(1).select(T.completion(F.lit(float(pct))).alias("c")).first().c) == want


def test_like_is_ascii_and_has_no_escape(spark):
    rows = spark.createDataFrame([("Éa\\b",), ("éA\\b",), ("x",)], "t string")
    assert [r.t for r in rows.filter(T.like_ascii(F.col("t"), "%a\\B%")).collect()] == ["Éa\\b", "éA\\b"]
    assert rows.filter(T.like_ascii(F.col("t"), "%é%")).count() == 1


def test_params():
    assert [params.page(1, x).limit for x in ("0", "-5", "500", "abc", "10abc", None)] == [20, 1, 100, 20, 10, 20]
    assert params.page("3", 10).offset == 20 and params.page("-2").page == 1
    assert params.tags("a, ,b") == ["a", "b"] and params.tag_match("ALL") == "any" and params.status("nope") is None
    assert params.page(1, 10).envelope(21, platform="")["pagination"]["totalPages"] == 3
    assert (params.init_progress("download", 50), params.init_progress("extract", 1, 2), params.init_progress("import", 5, 0)) == (15, 45, 260)


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "electriciti": "electr", "adjustable": "adjust", "adoption": "adopt", "controll": "control", "bosses": "boss", "walkthrough": "walkthrough", "generalizations": "gener", "sky": "sky", "rate": "rate", "cease": "ceas"}
    assert {w: porter.stem(w) for w in pairs} == pairs and porter.fold("Café") == "cafe"


def test_auto_tags_of_documents(spark):
    """The registered query runs the default rules, the ASCII-art rule too, over every document."""
    import re

    from folio.plans import registry

    def art(text):
        return sum(len(x) > 10 and len(re.sub(r"[\w\s]", "", x, flags=re.A)) > 0.3 * len(x) for x in text.split("\n")[:100]) > 5

    sf, got = "/root/testdata/sf0.01", {}
    for r in registry.queries()["auto_tags"](spark, sf).collect():
        got[r.doc_id] = r.tags
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {k: list(dict.fromkeys(t for p, t in T.CONTENT_TAGS if re.search(p, x[:8000].lower()) or (t == "ASCII Art" and art(x)))) for k, x in texts.items()}
    assert got == want and any("ASCII Art" in t for t in want.values())
