"""Fixed names and schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ExportFormat:
    """Key names of an export record; `provider` prefixes the two URI keys."""

    provider: str = "app"

    @property
    def track_uri(self) -> str:
        return f"{self.provider}_track_uri"

    @property
    def episode_uri(self) -> str:
        return f"{self.provider}_episode_uri"

    @property
    def required(self) -> list[str]:
        return ["ts", "ms_played"]

    @property
    def known(self) -> list[str]:
        # The record keys of the export format.
        return [
            "ts",
            "username",
            "platform",
            "ms_played",
            "conn_country",
            "ip_addr",
            "user_agent",
            "master_metadata_track_name",
            "master_metadata_album_artist_name",
            "master_metadata_album_album_name",
            self.track_uri,
            "episode_name",
            "episode_show_name",
            self.episode_uri,
            "audiobook_title",
            "audiobook_uri",
            "audiobook_chapter_uri",
            "audiobook_chapter_title",
            "reason_start",
            "reason_end",
            "shuffle",
            "skipped",
            "offline",
            "offline_timestamp",
            "incognito_mode",
        ]

    def mapped(self) -> dict[str, str]:
        """Record key -> fact column, for every key that reaches the fact table."""
        return {
            "ts": "ts_utc",
            "ms_played": "ms_played",
            "master_metadata_track_name": "track_name",
            "master_metadata_album_artist_name": "artist_name",
            "master_metadata_album_album_name": "album_name",
            self.track_uri: "track_uri",
            "episode_name": "episode_name",
            "episode_show_name": "episode_show",
            self.episode_uri: "episode_uri",
            "reason_start": "reason_start",
            "reason_end": "reason_end",
            "shuffle": "shuffle",
            "skipped": "skipped_raw",
            "offline": "offline",
            "incognito_mode": "incognito",
            "platform": "platform",
            "conn_country": "conn_country",
        }


SKIP_MS = 30_000
SUBSTANTIAL_MS = 30_000


def _field(name: str, dtype: T.DataType, meaning: str) -> T.StructField:
    return T.StructField(name, dtype, True, {"comment": meaning})


_S, _B, _L, _TS = T.StringType(), T.BooleanType(), T.LongType(), T.TimestampNTZType()

PLAYS = T.StructType(
    [
        _field("play_id", _L, "dense surrogate id, stable within one rebuild only"),
        _field("ts_utc", _TS, "when the play ended, UTC"),
        _field("ts_local", _TS, "ts_utc on the wall clock of the configured zone"),
        _field("ms_played", _L, "milliseconds played, NULL when unreadable"),
        _field("track_name", _S, "NULL for episodes"),
        _field("artist_name", _S, "NULL for episodes"),
        _field("album_name", _S, "NULL for episodes"),
        _field("track_uri", _S, "NULL for episodes"),
        _field("track_id", _S, "third part of track_uri"),
        _field("episode_name", _S, "NULL for music"),
        _field("episode_show", _S, "NULL for music"),
        _field("episode_uri", _S, "NULL for music"),
        _field("content_type", _S, "music, podcast or unknown"),
        _field("reason_start", _S, "why the play began"),
        _field("reason_end", _S, "why the play ended, e.g. trackdone or fwdbtn"),
        _field("shuffle", _B, "shuffle mode"),
        _field("skipped_raw", _B, "the export's own skip flag, often NULL or unreliable"),
        _field("offline", _B, "played offline"),
        _field("incognito", _B, "private session"),
        _field("platform", _S, "device or client"),
        _field("conn_country", _S, "country of the connection"),
        _field("played_date", T.DateType(), "local day"),
        _field("played_year", T.ShortType(), "local year"),
        _field("played_month", T.DateType(), "first day of the local month"),
        _field("played_hour", T.ByteType(), "local hour 0-23"),
        _field("played_dow", T.ByteType(), "local ISO weekday, 1 Monday to 7 Sunday"),
        _field("is_skip", _B, "reason_end is fwdbtn and ms_played below the skip threshold; a heuristic"),
        _field("is_substantial", _B, "ms_played reaches the substantial threshold"),
    ]
)

RAW_PLAYS = T.StructType(
    [
        T.StructField("ingest_run_id", _L),
        T.StructField("source_file", _S),
        T.StructField("source_index", _L),
        T.StructField("payload", _S),
    ]
)

INGESTED_FILES = T.StructType(
    [
        T.StructField("file_hash", _S),
        T.StructField("source_file", _S),
        T.StructField("ingest_run_id", _L),
        T.StructField("ingested_at", _TS),
    ]
)

INGEST_RUNS = T.StructType(
    [
        T.StructField("run_id", _L),
        T.StructField("started_at", _TS),
        T.StructField("finished_at", _TS),
        T.StructField("files_ingested", T.IntegerType()),
        T.StructField("files_skipped_already_ingested", T.IntegerType()),
        T.StructField("row_count", _L),
        T.StructField("unknown_fields", T.ArrayType(_S)),
        T.StructField("status", _S),
        T.StructField("notes", _S),
        T.StructField("attempt", _S),
        T.StructField("plays_version", _S),
        T.StructField("total_plays", _L),
        T.StructField("settings", _S),
    ]
)
