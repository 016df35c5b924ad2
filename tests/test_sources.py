"""Dates, pages, listening files, robots."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from nightjar.functions import dates, html
from nightjar.operators import rules
from nightjar.sources import listening, structured

TODAY = dt.date(2026, 8, 12)


@pytest.mark.parametrize(
    ("said", "date", "time"),
    [
        ("Onsdag 11. november 2026", "2026-11-11", None), ("Den 27. august", "2026-08-27", None), ("3. februar", "2027-02-03", None), ("(ons.) 11.11.26", "2026-11-11", None),
        ("27. august kl. 20.00", "2026-08-27", "20:00"), ("2026-08-13T20:30", "2026-08-13", "20:30"), ("Sidst 1. maj 2025, igen 2. september 2026", "2026-09-02", None),
    ],
)
def test_best_date(said, date, time):
    assert dates.best(said, TODAY)[:2] == (date, time)


def test_no_date():
    assert dates.best("13/32/2026", TODAY) is None and dates.best(None, TODAY) is None and dates.find("30.02.2026", TODAY) == []


def test_listening_files():
    plays, problem = listening.read_text(json.dumps([{"ts": "2026-01-01", "ms_played": 5, "master_metadata_album_artist_name": "A", "master_metadata_track_name": "t"}]))
    assert problem is None and plays[0]["artist"] == "A" and plays[0]["ms"] == 5
    assert listening.read_text("{}") == ([], None)
    assert listening.read_text("{bad")[1]
    assert listening.read_text("") == ([], None) and listening.read_text(None) == ([], None)
    names = [p["artist"] for p in listening.read_text("Earth, Wind\nMew")[0]]
    assert names == ["Earth, Wind", "Mew"]  # no artist column: a typed list after all
    csv_ = 'Artist Name;Track\n"Tyler, ""T""";x\n'
    assert listening.read_text(csv_)[0][0]["artist"] == 'Tyler, "T"'
    lib = {"artists": [{"name": "A"}], "playlists": [{"name": "P", "items": [{"track": {"artistName": "B"}}]}]}
    assert {p["from"] for p in listening.read_text(json.dumps(lib))[0]} == {"library-artist", "playlist", "generic-artist-object"}


def test_zip_source(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x/plays.csv", "artist\nMew")
        z.writestr("Technical/log.json", "{}")
    listening.register(spark)
    rows = spark.read.format("zip_entries").option("paths", str(path)).load().collect()
    assert [r["entry"] for r in rows] == ["x/plays.csv"]
    with pytest.raises(ValueError, match="Not a zip"):
        list(listening.entries(b"no", "n"))
    raw = io.BytesIO()
    zipfile.ZipFile(raw, "w").close()
    with pytest.raises(ValueError, match="no files"):
        list(listening.entries(raw.getvalue(), "n"))


def test_json_ld(spark):
    good = '<script type="application/ld+json">{"@type":"Event","name":"A","startDate":"2026-01-01"}</script>'
    bad = '<script type="application/ld+json">{"@type":["Thing","http://schema.org/MusicEvent"],"name":"B",}</script><script type="application/ld+json">{no</script>'
    pages = spark.createDataFrame([(1, good + good), (2, bad), (3, None), (4, "")], "k int, html string")
    assert sorted((r["k"], r["name"]) for r in structured.json_ld_events(pages, "k").collect()) == [(1, "A"), (2, "B")]
    s = pages.filter("k = 2").select(structured.json_ld_stats(F.col("html")).alias("s")).first()["s"]
    assert (s["blocks"], s["repaired"], s["failed"]) == (2, 1, 1)


def test_strip_and_status(spark):
    row = spark.createDataFrame([("<nav>n</nav><p>S&#xF8;n &amp; &#248;</p><script>x</script>",)], "h string").select(html.strip_tags(F.col("h")).alias("x")).first()
    assert row["x"] == "Søn & ø"
    df = spark.createDataFrame([("UDSOLGT: Mew",), ("AFLYST Mew",), ("Kassettebåndsmusikquiz",), ("Efterklang",)], "t string")
    got = df.select(html.clean_title(F.col("t")), html.detect_status(F.col("t")), html.looks_non_musical(F.col("t"))).collect()
    assert got[0][0] == "Mew" and got[1][1] == "cancelled" and got[2][2] and not got[3][2]


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y$\n\nUser-agent: z\nDisallow: /\n")], "host string, text string")
    paths = spark.createDataFrame([("h", p) for p in ("/x", "/x/y", "/x/y/z", "/q")], "host string, path string")
    got = {r["path"]: r["allowed"] for r in rules.robots_allowed(paths, rules.robots_groups(files), "path").collect()}
    assert got == {"/x": False, "/x/y": True, "/x/y/z": False, "/q": True}


def test_references(spark):
    """Pairs of surrogates join; lone ones and what is no character become U+FFFD."""
    df = spark.createDataFrame([("<p>&#55357;&#56832; &#128512; &#xD83D; &#x110000; &#233;</p>",)], "h string")
    assert df.select(html.strip_tags(F.col("h")).alias("x")).first()["x"] == "\U0001f600 \U0001f600 � � é"


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ('artist,track\nMew,"' + "x" * 200_000 + '"\n', None), ("[" * 100_000 + "]" * 100_000, "nested too deeply"), ('{"playlists":[{"items":[{"track":"x"}]}]}', None),
        ('[{"track_metadata":"x"}]', None), ('{"playlists":[{"items":3}]}', None), ('[{"track_metadata":{"artist_name":"A"},"listened_at":1e300}]', None), ("{bad", "not valid JSON"),
    ],
)
def test_listening_never_raises(text, problem):
    assert listening.read_text(text)[1] == problem


def test_listening_row_bound():
    plays, problem = listening.read_text("artist,track\n" + "Mew,x\n" * 5, most_rows=3)
    assert len(plays) == 3 and problem == "only the first 3 rows were read"
    assert listening.read_text("artist,track\n" + "Mew,x\n" * 3, most_rows=3)[1] is None


def test_deep_json(spark):
    """Text that is nested too deeply, or isn't JSON, has no members; others of the table do."""
    rows = [(1, "[" * 100_000 + "]" * 100_000), (2, '{"a":[{"start":"no"},{"dato":"2026-03-04","start":"2026-05-06"}]}'), (3, "{"), (4, None)]
    df = spark.createDataFrame(rows, "k int, j string")
    assert [(r["k"], str(r["date"])) for r in structured.dig_date(df, "k", "j").collect()] == [(2, "2026-03-04")]  # of one object's members, in the keys' order


def test_hydration_ties(spark):
    """Of equal room, day and title the first in document order stays."""
    node = lambda s: json.dumps({"title": "Mew", "startDate": "2026-09-01", "venue": {"name": "V"}, "slug": "m", "state": {"name": s}})
    page = f'<script id="__NEXT_DATA__">[{node("Aflyst")},{node("")}]</script>'
    got = structured.hydration_events(spark.createDataFrame([(1, page)], "k int, html string"), "k").collect()
    assert [(r["title"], r["status"], r["venue_name"], r["artists"]) for r in got] == [("Mew", "cancelled", "V", ["Mew"])]


def test_dates_overlap():
    """Each way of writing a date is read on its own: a label in reach decides, and the time beside it is found."""
    assert [d.date for d in dates.find("1.2.26 maj 2027-03-04", TODAY)] == ["2027-03-04", "2027-05-26", "2026-02-01"]
    assert dates.best("12. september 2026. Dato: 3. oktober 2026 kl. 19.30", TODAY)[:2] == ("2026-10-03", "19:30")
