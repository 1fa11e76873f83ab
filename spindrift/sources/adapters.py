"""Interfaces to services outside: speech to text, language models, speech, video and footage. Only offline stand-ins are here; a deployment brings its own."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.text import collapse
from ..operators import ledger
from ..operators.cache import search_name
from ..storage import stored


class ChatModel(Protocol):
    def reply(self, model: str, system: str, user: str) -> str: ...


class SpeechToText(Protocol):
    def segments(self, path: str) -> list[tuple[float, float, str]]: ...


class VideoModel(Protocol):
    name: str

    def estimate(self, shots: int, seconds: float) -> float: ...

    def generate(self, prompt: str, seconds: float, seed: int) -> str: ...


class Footage(Protocol):
    def search(self, query: str) -> list[dict]: ...


class AudioSource(Protocol):
    def download(self, url: str, stem: str) -> str:
        """Fetches a recording's audio beside stem; the path of the file."""
        ...


class Fetcher(Protocol):
    def fetch(self, link: str, path: str) -> None: ...


#: Says a text into a file; the seconds it takes.
Synth = Callable[[str, str], float]
#: The seconds that a file takes.
Probe = Callable[[str], float]


class ProviderError(Exception):
    """A failure that lets a chain move on to its next provider."""


@dataclass
class CannedChat:
    """Replies from a table of cues, the first cue that the prompt holds."""

    replies: dict[str, str]

    def reply(self, model: str, system: str, user: str) -> str:
        return next((r for cue, r in self.replies.items() if cue in user), "{}")


@dataclass
class CannedSpeech:
    """Segments of two seconds from given texts."""

    texts: dict[str, list[str]]

    def segments(self, path: str) -> list[tuple[float, float, str]]:
        return [(2.0 * i, 2.0 * i + 2, t) for i, t in enumerate(self.texts.get(path, []))]


@dataclass
class FakeVideo:
    name: str
    usd_per_second: float = 0.0
    fails: bool = False

    def estimate(self, shots: int, seconds: float) -> float:
        return shots * seconds * self.usd_per_second

    def generate(self, prompt: str, seconds: float, seed: int) -> str:
        if self.fails:
            raise ProviderError(self.name)
        return f"{self.name}/{hashlib.sha1(f'{prompt}{seconds}{seed}'.encode()).hexdigest()[:12]}.mp4"


@dataclass
class CannedFootage:
    """Videos from a table of queries; the queries asked are counted by `asked`, if it is given."""

    videos: dict[str, list[dict]]
    asked: Callable[[str], None] | None = None

    def search(self, query: str) -> list[dict]:
        if self.asked:
            self.asked(query)
        return self.videos.get(query, [])


@dataclass
class CannedAudio:
    """Paths as a download would write them; links it doesn't know fail."""

    known: set[str]
    suffix: str = "m4a"

    def download(self, url: str, stem: str) -> str:
        if url not in self.known:
            raise ProviderError(f"no audio for {url}")
        return f"{stem}.{self.suffix}"


def paced(characters_a_second: float = 4.0) -> Synth:
    """A stand-in voice that takes time in proportion to the text and writes nothing."""
    return lambda text, path: round(len(text) / characters_a_second, 3)


class Chain:
    """Providers in order; after a ProviderError the next one serves this and all later calls, other errors pass through."""

    def __init__(self, providers: list[VideoModel]):
        if not providers:
            raise ValueError("a chain needs a provider")
        self.providers, self.active = providers, 0

    def estimate(self, shots: int, seconds: float) -> float:
        """The dearest of those left."""
        return max(p.estimate(shots, seconds) for p in self.providers[self.active :])

    def generate(self, prompt: str, seconds: float, seed: int) -> str:
        while True:
            try:
                return self.providers[self.active].generate(prompt, seconds, seed)
            except ProviderError:
                if self.active + 1 == len(self.providers):
                    raise
                self.active += 1


REGISTRY: dict[str, Callable[[], VideoModel]] = {"fake": lambda: FakeVideo("fake")}


def provider(names: str) -> Chain | None:
    """A chain from comma-separated names; none for '' or 'none'."""
    wanted = [n.strip().lower() for n in names.split(",") if n.strip()]
    if wanted in ([], ["none"]):
        return None
    if unknown := [n for n in wanted if n not in REGISTRY]:
        raise ValueError(f"unknown provider {unknown[0]}")
    return Chain([REGISTRY[n]() for n in wanted])


def unfenced(reply: Column) -> Column:
    """A JSON reply without the code fence around it."""
    return F.regexp_replace(F.trim(reply), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")


def parsed(reply: Column, schema: str) -> Column:
    """A reply as a struct; null where it is no JSON of that kind."""
    return F.from_json(unfenced(reply), schema, {"mode": "PERMISSIVE"})


def chat(rows: DataFrame, service: ChatModel, model: str, system: str, user: str = "prompt") -> DataFrame:
    """rows with reply, and the tokens in and out that the call is billed by. The replies are stored before they are returned, so each row is asked once (once more only if a task is lost), however often the result is read."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies = [service.reply(model, system, u) for u in b[user]]
            yield b.assign(reply=replies, input_tokens=[int((len(u) + len(system)) / 1.3) + 1 for u in b[user]], output_tokens=[int(len(r) / 1.3) + 1 for r in replies])

    return stored(rows.mapInPandas(call, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", reply string, input_tokens long, output_tokens long"))


def chat_costs(replies: DataFrame, stage: str, provider: str, model: str, note: Column) -> DataFrame:
    """The two ledger rows (tokens in and out) of each of chat's replies."""
    usage = replies.select(F.lit(stage).alias("stage"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), "input_tokens", "output_tokens", F.lit(False).alias("estimated"), note.alias("note"))
    return ledger.llm_rows(usage)


FOUND = "query string, name string, videos string"


def searched(queries: DataFrame, kept: DataFrame, service: Footage, default: str) -> tuple[DataFrame, DataFrame]:
    """queries(query) with videos (JSON), and the rows to add to the cache kept(query, name, videos).

    White space in queries is collapsed; an empty one is the default. Each different query that the cache lacks is asked once; the answers are stored before they are returned. The number of rows to add is the number of requests.
    """
    tidy = queries.withColumn("_q", collapse(F.col("query"), default)).withColumn("_name", search_name(F.col("_q")))
    missing = tidy.select(F.col("_q").alias("query"), F.col("_name").alias("name")).distinct().join(kept.select("name").distinct(), "name", "left_anti").select("query", "name")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(videos=[json.dumps(service.search(q), ensure_ascii=False) for q in b["query"]])

    added = stored(missing.mapInPandas(ask, FOUND))
    known = kept.select("name", "videos").unionByName(added.select("name", "videos")).groupBy("name").agg(F.max("videos").alias("videos"))
    return tidy.join(known.withColumnRenamed("name", "_name"), "_name", "left").select(*queries.columns, "videos"), added


def downloaded(recordings: DataFrame, source: AudioSource, folder: str) -> DataFrame:
    """recordings(video_id, url) with audio_path, stored: each is fetched once."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"video_id": b["video_id"], "url": b["url"], "audio_path": [source.download(u, f"{folder}/{v}/01_raw") for v, u in zip(b["video_id"], b["url"], strict=True)]})

    return stored(recordings.select("video_id", "url").mapInPandas(fetch, "video_id string, url string, audio_path string"))


def probed(files: DataFrame, probe: Probe, path: str = "path") -> DataFrame:
    """files with seconds, as the probe measures them; nothing for a null path."""

    @F.pandas_udf("double")
    def measure(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else float(probe(p)))

    return files.withColumn("seconds", measure(F.col(path)))


def trimmed(wanted: DataFrame, kept: DataFrame, fetcher: Fetcher, folder: str, most_seconds: float) -> DataFrame:
    """(id, path) of wanted(id, link): a file for each id that holds its first seconds; those in kept(path) are not fetched again. Each other id is fetched once, and the result stored."""
    size = f"{most_seconds:g}s"
    named = wanted.groupBy("id").agg(F.min("link").alias("link")).withColumn("path", F.concat(F.lit(f"{folder}/"), F.col("id").cast("string"), F.lit(f"_{size}.mp4")))
    there = named.join(kept.select("path").distinct(), "path", "left_semi").select("id", "path")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for link, path in zip(b["link"], b["path"], strict=True):
                fetcher.fetch(link, path)
            yield b[["id", "path"]]

    kind = dict(wanted.dtypes)["id"]
    missing = named.join(kept.select("path").distinct(), "path", "left_anti").select("id", "path", "link")
    return there.unionByName(stored(missing.mapInPandas(fetch, f"id {kind}, path string")))


def spoken(lines: DataFrame, synth: Synth, folder: str) -> DataFrame:
    """(clip, pos, text, path, seconds) of lines(clip, pos, text): a file for each line, said once by the given voice; a line of no length stops the query. timeline.running_spans gives their places in the whole, with the gap after each."""

    def say(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = [f"{folder}/{c}_line_{p:02d}.mp3" for c, p in zip(b["clip"], b["pos"], strict=True)]
            seconds = [float(synth(t, p)) for t, p in zip(b["text"], paths, strict=True)]
            if silent := [t for t, s in zip(b["text"], seconds, strict=True) if s <= 0]:
                raise ProviderError(f"no audio for {silent[0][:30]!r}")
            yield b.assign(path=paths, seconds=seconds)

    kinds = dict(lines.dtypes)
    return stored(lines.select("clip", "pos", "text").mapInPandas(say, f"clip {kinds['clip']}, pos {kinds['pos']}, text string, path string, seconds double"))


def transcribe(chunks: DataFrame, service: SpeechToText) -> DataFrame:
    """(video_id, chunk, pos, start, end, text) from chunks(video_id, chunk, path, offset): times of each chunk moved by its offset."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.video_id, r.chunk, i, r.offset + s, r.offset + e, t) for r in b.itertuples() for i, (s, e, t) in enumerate(service.segments(r.path))]
            yield pd.DataFrame(rows, columns=["video_id", "chunk", "pos", "start", "end", "text"])

    return chunks.mapInPandas(call, "video_id string, chunk long, pos long, start double, end double, text string")


class MetadataSource(DataSource):
    """spark.read.format('recordings').option('items', JSON list): metadata of recordings from a stand-in."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return "video_id string, title string, channel string, duration double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("items", "[]")))


class _Reader(DataSourceReader):
    def __init__(self, items: list[dict]):
        self.items = items

    def read(self, partition) -> Iterator[tuple]:
        for x in self.items:
            yield x.get("video_id"), x.get("title"), x.get("channel"), x.get("duration")


def converted(text: Column, table: dict[str, str]) -> Column:
    """Characters replaced one for one by a conversion table, trimmed; the stand-in for dictionary conversion between scripts."""
    return F.trim(F.translate(text, "".join(table), "".join(table.values())))
