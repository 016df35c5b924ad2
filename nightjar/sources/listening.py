"""Listening exports: JSON shapes, CSV, typed lists and zip archives, as play records."""

from __future__ import annotations

import csv
import io
import itertools
import json
import math
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PLAY = "artist string, track string, ms double, at string, plays double, `from` string"
PLAYS = f"array<struct<{PLAY.replace(' ', ':').replace(',:', ',')}>>"
# fixed values: default lengths in ms, and the shapes' fields
LIBRARY_MS = {"artists": 360_000, "tracks": 240_000, "albums": 300_000, "playlists": 150_000}
CSV_MS, MARQUEE_MS, LISTEN_MS, GENERIC_MS, LIST_MS, CSV_ROWS = 210_000, 240_000, 210_000, 180_000, 3_000_000, 400_000
HEADERS = {
    "artist": ("artist name", "artist", "artistname", "album artist", "artist_name", "kunstner", "container artist name", "song artist"),
    "track": ("song name", "track name", "track", "title", "song", "track_name"),
    "ms": ("play duration milliseconds", "ms_played", "msplayed", "milliseconds played", "duration ms"),
    "at": ("event start timestamp", "timestamp", "date played", "ts", "end time", "date", "play date time", "last played date"),
    "plays": ("plays", "playcount", "play count", "count"),
    "both": ("track description", "description"),
}
ENTRY_KEEP, ENTRY_SKIP = r"(?i)\.(json|csv|txt)$", "__MACOSX|Technical|Identity|Payments|Inferences|SearchQueries|Userdata|Address|Voice"


def _number(v) -> float:
    try:
        return float(v) if not isinstance(v, bool) and v not in (None, "") and math.isfinite(float(v)) else 0.0
    except (TypeError, ValueError):
        return 0.0


def _play(artist, source, ms, track=None, at=None, plays=None) -> dict:
    text = lambda v: None if v is None else str(v)
    return {"artist": text(artist), "track": text(track), "ms": float(ms), "at": text(at) or None, "plays": plays, "from": source}


def _classic(end):
    return end.replace(" ", "T") + ":00Z" if isinstance(end, str) and len(end) == 16 and end[10] == " " else end


def _epoch(v):
    try:
        return pd.Timestamp(v, unit="s", tz="UTC").isoformat() if isinstance(v, (int, float)) and v else None
    except (ValueError, OverflowError):  # no time that there is
        return None


def _meta(o: dict) -> dict:
    meta = o.get("track_metadata")
    return meta if isinstance(meta, dict) else {}


#: shape, what an object of it has, how it is read; the first that fits the first object holds for all
SHAPES = (
    ("spotify-extended", lambda o: "ms_played" in o and ("master_metadata_album_artist_name" in o or "master_metadata_track_name" in o), lambda o: _play(o.get("master_metadata_album_artist_name"), "spotify-extended", _number(o.get("ms_played")), o.get("master_metadata_track_name"), o.get("ts") or o.get("offline_timestamp"))),
    ("spotify-classic", lambda o: "msPlayed" in o and "artistName" in o, lambda o: _play(o.get("artistName"), "spotify-classic", _number(o.get("msPlayed")), o.get("trackName"), _classic(o.get("endTime")))),
    ("spotify-marquee", lambda o: "artistName" in o and "segment" in o, lambda o: _play(o.get("artistName"), "spotify-marquee", MARQUEE_MS)),
    ("listenbrainz", lambda o: bool(_meta(o).get("artist_name") or _meta(o).get("artist_credit_name")), lambda o: _play(_meta(o).get("artist_name") or _meta(o).get("artist_credit_name"), "listenbrainz", LISTEN_MS, _meta(o).get("track_name"), _epoch(o.get("listened_at")))),
    (
        "generic-artist-object",
        lambda o: any(k in o for k in ("artist", "artistName", "name")) and "ms_played" not in o and "msPlayed" not in o,
        lambda o: _play(o.get("artist") or o.get("artistName") or o.get("name"), "generic-artist-object", GENERIC_MS, o.get("track") or o.get("trackName") or o.get("title"), o.get("ts") or o.get("endTime") or o.get("date"), _number(o.get("playcount") if o.get("playcount") is not None else o.get("plays")) or None),
    ),
)


def read_json(data, out: list[dict]) -> None:
    """Plays of a parsed export; wrappers are read by name and once more by shape."""
    if isinstance(data, dict):
        lists = {k: v for k, v in data.items() if isinstance(v, list)}
        for a in lists.get("artists", ()):
            if name := a if isinstance(a, str) else isinstance(a, dict) and a.get("name"):
                out.append(_play(name, "library-artist", LIBRARY_MS["artists"]))
        for kind in ("tracks", "albums"):
            out += [_play(t["artist"], f"library-{kind[:-1]}", LIBRARY_MS[kind], t.get("track") if kind == "tracks" else None) for t in lists.get(kind, ()) if isinstance(t, dict) and t.get("artist")]
        for p in lists.get("playlists", ()):
            items = p.get("items") if isinstance(p, dict) else None
            for item in items if isinstance(items, list) else ():
                track = item.get("track") if isinstance(item, dict) else None
                if isinstance(track, dict) and track.get("artistName"):
                    out.append(_play(track["artistName"], "playlist", LIBRARY_MS["playlists"], track.get("trackName"), item.get("addedDate")))
        for v in lists.values():
            if v and isinstance(v[0], (dict, list)):
                read_json(v, out)
        return
    rows = [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []
    shape = next((read for _, fits, read in SHAPES if rows and fits(rows[0])), None)
    if shape:
        out += [p for p in map(shape, rows) if p["artist"]]


def sniff(text: str) -> str:
    """The commonest of comma, semicolon and tab in the first 4,000 characters; a comma wins ties."""
    head = text[:4000]
    return max(",;\t", key=lambda d: (head.count(d), d == ","))


def column(header: list[str], names: tuple[str, ...]) -> int | None:
    """Exact names first, in their order; then the first header that has one as whole words."""
    low = [h.strip().lower().strip('"') for h in header]
    for n in names:
        if n in low:
            return low.index(n)
    return next((i for i, h in enumerate(low) if any(f" {n} " in f" {h.replace('_', ' ')} " for n in names)), None)


def read_csv(text: str, out: list[dict], most: int = CSV_ROWS) -> tuple[bool, str | None]:
    """Plays of a table's first ``most`` rows: if it has an artist column, and what went wrong."""
    csv.field_size_limit(1 << 30)
    table = csv.reader(io.StringIO(text.lstrip("\ufeff"), newline=""), delimiter=sniff(text))
    header = next(table, None)
    at = {k: column(header, names) for k, names in HEADERS.items()} if header else {}
    if at.get("artist") is None and at.get("both") is None:
        return False, None
    for row in itertools.islice(table, most):
        get = lambda k: row[at[k]] if at[k] is not None and at[k] < len(row) else None  # noqa: E731, B023
        artist, track = get("artist"), get("track")
        if not artist and (get("both") or "").find(" - ") > 0:
            artist, _, rest = get("both").partition(" - ")
            track = track or rest
        if len(row) >= 2 and artist and artist.strip():
            plays = _number(get("plays")) or None
            out.append(_play(artist.strip(), "csv", _number(get("ms")) if at["ms"] is not None else (plays or 1) * CSV_MS, track, get("at"), plays))
    return True, f"only the first {most} rows were read" if next(table, None) is not None else None


def read_text(text: str, zipped: bool = False, most_rows: int = CSV_ROWS) -> tuple[list[dict], str | None]:
    """(plays, problem) of one file; malformed input is a problem of that file and never raises."""
    out: list[dict] = []
    body = (text or "").lstrip("\ufeff").strip()
    if body[:1] in ("{", "["):
        try:
            read_json(json.loads(body), out)
        except ValueError:
            return [], "not valid JSON"
        except RecursionError:
            return [], "nested too deeply"
        except (TypeError, AttributeError, KeyError):
            return [], "not a listening export"
        return out, None
    if "\n" in body and any(d in body[:500] for d in ",;\t"):
        try:
            found, problem = read_csv(body, out, most_rows)
        except csv.Error:
            return [], "not a valid table"
        if found:
            return out, problem
    if not zipped:  # a typed list, the dearest first
        names = [x.strip() for x in body.split("\n")]
        out = [_play(n, "manual", LIST_MS / (1 + math.log2(i + 2))) for i, n in enumerate(n for n in names if n and len(n) < 120)]
    return out, None


def parse_plays(text: Column, zipped: bool = False) -> Column:
    """Struct of ``plays`` (array) and ``problem`` of a file's text."""

    @F.pandas_udf(f"struct<plays:{PLAYS},problem:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_text(t, zipped) for t in s], columns=["plays", "problem"])

    return run(text)


def plays_of(files: DataFrame, text: str = "text", user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Play rows, and problem rows, of a table of files."""
    parsed = files.withColumn("p", parse_plays(F.col(text)))
    return parsed.select(user, F.explode("p.plays").alias("x")).select(user, "x.*"), parsed.filter("p.problem IS NOT NULL").select(user, "p.problem")


def entries(raw: bytes, archive: str) -> Iterator[tuple]:
    """(archive, entry, size, text) of an archive's listening files; others are never inflated."""
    import re

    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ValueError("Not a zip file") from e
    infos = z.infolist()
    if not infos:
        raise ValueError("Zip contains no files")
    for i in infos:
        if i.is_dir() or not re.search(ENTRY_KEEP, i.filename) or re.search(ENTRY_SKIP, i.filename):
            continue
        if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError("Unsupported compression method")
        yield archive, i.filename, i.file_size, z.read(i).decode("utf-8", "replace")


def unzip(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Entries of archives in a binary column (as ``binaryFile`` reads them), from any store that Spark reads."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f[path], f[content], strict=True):
                yield pd.DataFrame(list(entries(bytes(raw), p)), columns=["archive", "entry", "size", "text"])

    return files.select(path, content).mapInPandas(run, "archive string, entry string, size long, text string")


def listening_stats(payload: DataFrame, text: str = "text") -> DataFrame:
    """(name, plays, rank) of a statistics answer: payload.artists[] in order."""
    rows = payload.select(F.posexplode(F.from_json(text, "payload struct<artists: array<struct<artist_name: string, listen_count: long>>>").payload.artists).alias("rank", "a"))
    return rows.select(F.col("a.artist_name").alias("name"), F.col("a.listen_count").alias("plays"), "rank")


def register(spark: SparkSession) -> None:
    """Make ``zip_entries`` known, with filters on names taken at planning."""
    from nightjar.sources.archives import ZipSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(ZipSource)
