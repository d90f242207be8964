"""Messages of transcription and language services as rows, and requests as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmura.functions.text import is_blank, utrim


def _event(kind: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit("") if text is None else F.coalesce(text, F.lit(""))).alias("text"))


def server_event(json: Column, session: Column | str = "transcription") -> Column:
    """Struct (kind, text) of a realtime message, by its type and the kind of the session.

    ``session`` is 'transcription', 'translation', 'model' or 'assist'. What an assist session's model says is its text;
    in the others it is the second text beside the transcript. A translation's text comes first, the original second.
    Messages that are no JSON object, have another type or a value of the wrong kind are 'Other'.
    """
    kind, get = F.get_json_object(json, "$.type"), lambda p: F.get_json_object(json, p)
    assist = (F.lit(session) if isinstance(session, str) else session) == "assist"
    said = "conversation.item.input_audio_transcription."
    return (
        F.when(kind == said + "delta", _event("Delta", get("$.delta")))
        .when(kind == said + "completed", _event("Completed", get("$.transcript")))
        .when(kind == said + "failed", _event("Failed", get("$.error.message")))
        .when((kind == "response.output_text.delta") & assist, _event("Delta", get("$.delta")))
        .when((kind == "response.output_text.done") & assist, _event("Completed", get("$.text")))
        .when(kind == "response.output_text.delta", _event("AuxDelta", get("$.delta")))
        .when(kind == "response.output_text.done", _event("AuxDone", get("$.text")))
        .when(kind == "session.output_transcript.delta", _event("Delta", get("$.delta")))
        .when(kind == "session.input_transcript.delta", _event("AuxDelta", get("$.delta")))
        .when(kind == "error", _event("Error", get("$.error.message")))
        .otherwise(_event("Other"))
    )


def transcript_event(json: Column) -> Column:
    """Struct (kind, text) of a message of a service that sends whole segments: AddTranscript is a Delta, Error its reason or else its type."""
    kind, get = F.get_json_object(json, "$.message"), lambda p: F.get_json_object(json, p)
    reason = F.coalesce(F.nullif(get("$.reason"), F.lit("")), get("$.type"))
    return F.when(kind == "AddTranscript", _event("Delta", get("$.metadata.transcript"))).when(kind == "Error", _event("Error", reason)).otherwise(_event("Other"))


def content_event(json: Column) -> Column:
    """Struct (kind, text) of a message of a service that answers in speech: only the transcription of what it heard counts, or an error."""
    heard, wrong = F.get_json_object(json, "$.serverContent.inputTranscription.text"), F.get_json_object(json, "$.error.message")
    return F.when(heard.isNotNull(), _event("Delta", heard)).when(wrong.isNotNull(), _event("Error", wrong)).otherwise(_event("Other"))


# Languages of the hint to a service that answers in speech.
HINTS = {"yue": "Cantonese", "zh": "Mandarin Chinese", "en": "English", "ja": "Japanese", "ko": "Korean"}


def hint_language(code: Column) -> Column:
    """The language's name for a hint; null where the service finds it out."""
    return F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])[code]


def changed_params(given: Column, defaults: Column) -> Column:
    """Of a map of values those that differ from the map of defaults, or have none there."""
    return F.map_filter(given, lambda k, v: ~F.map_contains_key(defaults, k) | ~v.eqNullSafe(defaults[k]))


def assist_params(given: Column) -> Column:
    """A struct (temperature, top_p, frequency_penalty, presence_penalty, max_tokens, context_tokens, system_prompt) within its ranges.

    Token counts below 1 are unset, the prompt is trimmed. ``given`` is a struct with the same fields.
    """
    between = lambda c, lo, hi: F.when(given[c].isNotNull(), F.greatest(F.least(given[c].cast("double"), F.lit(hi)), F.lit(lo))).alias(c)
    count = lambda c: F.when(given[c] > 0, given[c].cast("bigint")).alias(c)
    return F.struct(between("temperature", 0.0, 2.0), between("top_p", 0.0, 1.0), between("frequency_penalty", -2.0, 2.0), between("presence_penalty", -2.0, 2.0), count("max_tokens"), count("context_tokens"), utrim(given["system_prompt"]).alias("system_prompt"))


def overlay_params(base: Column, given: Column) -> Column:
    """``base`` (:func:`assist_params`) with what the string map ``given`` has, within the ranges; a token count of 0 changes nothing."""
    value = lambda c, default, lo, hi: F.when(F.map_contains_key(given, F.lit(c)), F.greatest(F.least(F.coalesce(given[c].try_cast("double"), F.lit(default)), F.lit(hi)), F.lit(lo))).otherwise(base[c]).alias(c)
    n = given["max_tokens"].try_cast("bigint")
    return F.struct(value("temperature", 1.0, 0.0, 2.0), value("top_p", 1.0, 0.0, 1.0), value("frequency_penalty", 0.0, -2.0, 2.0), value("presence_penalty", 0.0, -2.0, 2.0), F.when(n > 0, F.least(n, F.lit(2**32 - 1))).otherwise(base["max_tokens"]).alias("max_tokens"), base["context_tokens"].alias("context_tokens"), base["system_prompt"].alias("system_prompt"))


def endpoint(name: Column, url: Column, protocol: Column, model: Column) -> Column:
    """Struct (name, base_url, protocol, model, error) of an endpoint's fields, trimmed, without the URL's last slashes."""
    name, url, model = utrim(name), F.regexp_replace(utrim(url), "/+$", ""), utrim(model)
    missing = (F.coalesce(name, F.lit("")) == "") | (F.coalesce(url, F.lit("")) == "") | (F.coalesce(model, F.lit("")) == "")
    wrong = F.when(missing, "name, base URL, and model id are all required").when(~url.rlike("^https?://"), "base URL must start with http:// or https://")
    return F.struct(name.alias("name"), url.alias("base_url"), F.when(protocol == "chat", "chat").otherwise("openai").alias("protocol"), model.alias("model"), wrong.alias("error"))


def encoder_dir(file: Column) -> Column:
    """The folder of a model file's encoder: without extension and without a trailing tag such as -q5_0."""
    return F.concat(F.regexp_replace(F.regexp_replace(file, r"\.[^.]*$", ""), r"-q[\x00-\x7f]_[\x00-\x7f]$", ""), F.lit("-encoder.mlmodelc"))


def memory_bytes(meminfo: Column) -> Column:
    """Bytes of the MemTotal line of a memory report; null without one."""
    return F.nullif(F.regexp_extract(meminfo, r"(?m)^MemTotal:\s*(\d+)(?:\s|$)", 1), F.lit("")).try_cast("bigint") * 1024


def transcription_text(json: Column) -> Column:
    """The text of a whole transcription."""
    return F.coalesce(utrim(F.get_json_object(json, "$.text")), F.lit(""))


def chat_text(json: Column) -> Column:
    """The content of a chat completion's first choice; empty without one."""
    return F.coalesce(F.get_json_object(json, "$.choices[0].message.content"), F.lit(""))


def candidate_text(json: Column) -> Column:
    """All text parts of the first candidate, joined."""
    parts = F.from_json(F.get_json_object(json, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p.text.isNotNull()), lambda p: p.text), ""), F.lit(""))


def diarized(messages: DataFrame, key: str, json: str) -> DataFrame:
    """(key, id, start_ms, end_ms, speaker, text) of diarized transcriptions.

    Blank segments are left out; ids count what is kept; labels become numbers by first appearance among the kept.
    """
    kind = "array<struct<start:double,end:double,text:string,speaker:string>>"
    d = messages.select(F.col(key).alias("k"), F.posexplode(F.from_json(F.get_json_object(F.col(json), "$.segments"), kind)).alias("pos", "s")).filter(~is_blank(F.col("s.text")))
    first = F.min("pos").over(Window.partitionBy("k", "label"))
    d = d.select("k", "pos", F.col("s.speaker").alias("label"), "s.start", "s.end", utrim(F.col("s.text")).alias("text")).withColumn("first", F.when(F.col("label").isNotNull(), first))
    order = Window.partitionBy("k").orderBy("pos")
    n = F.dense_rank().over(Window.partitionBy("k").orderBy(F.col("first").asc_nulls_last())) - 1
    ms = lambda c: F.greatest(F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1000), F.lit(0.0)).cast("bigint")
    return d.select(F.col("k").alias(key), (F.row_number().over(order) - 1).cast("bigint").alias("id"), ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.when(F.col("label").isNotNull(), n).alias("speaker"), "text")


def event_lines(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, order, json) of a server-sent event stream: the data lines that hold JSON."""
    body = utrim(F.regexp_extract(F.col(line), r"^data:(.*)$", 1))
    return lines.select(key, order, body.alias("json")).filter((F.col("json") != "") & (F.col("json") != "[DONE]") & F.try_parse_json("json").isNotNull())


def streamed_chat(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, text): the deltas of a streamed chat completion, joined."""
    d = event_lines(lines, key, order, line).withColumn("delta", F.get_json_object("json", "$.choices[0].delta.content")).filter("delta IS NOT NULL")
    return d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "delta"))), lambda x: x.delta), "").alias("text"))


def embeddings(messages: DataFrame, key: str, json: str, dim: int) -> DataFrame:
    """(key, index, embedding): vectors of a response by their index (else their place), of unit length; another dimension is an error."""
    kind = "array<struct<index:int,embedding:array<double>>>"
    d = messages.select(key, F.posexplode(F.from_json(F.get_json_object(F.col(json), "$.data"), kind)).alias("pos", "e"))
    v = F.when(F.size("e.embedding") == dim, F.col("e.embedding")).otherwise(F.raise_error(F.format_string("embedding of %d, not %d", F.size("e.embedding"), F.lit(dim))).cast("array<double>"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return d.select(key, F.coalesce("e.index", "pos").alias("index"), F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v).alias("embedding"))


def chat_body(model: Column, system: Column, user: Column, temperature: Column, max_tokens: Column) -> Column:
    """A chat request; what is null is not in it."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.filter(F.array(message("system", system), message("user", user)), lambda m: m.content.isNotNull())
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), temperature.alias("temperature"), max_tokens.alias("max_tokens")))


def turn_detection(threshold: Column, prefix_ms: Column, silence_ms: Column) -> Column:
    """Voice detection settings, the missing ones at their defaults."""
    return F.to_json(F.struct(F.lit("server_vad").alias("type"), F.coalesce(threshold, F.lit(0.5)).alias("threshold"), F.coalesce(prefix_ms, F.lit(300)).alias("prefix_padding_ms"), F.coalesce(silence_ms, F.lit(500)).alias("silence_duration_ms")))


def audio_append(samples: Column) -> Column:
    """A wire message with samples as 16-bit little-endian base64."""
    return F.to_json(F.struct(F.lit("input_audio_buffer.append").alias("type"), F.base64(_pcm_bytes(samples)).alias("audio")))


def _pcm_bytes(samples: Column) -> Column:
    value = lambda x: (F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int")
    two = lambda v: F.concat(F.lpad(F.hex(v.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(v, 8).bitwiseAND(255)), 2, "0"))
    return F.unhex(F.array_join(F.transform(samples, lambda x: two(value(x))), ""))


def params(given: Column, specs: dict[str, tuple[str, object]]) -> Column:
    """Struct of typed parameters from a string map: what is absent or does not read as its type takes the default."""
    of = lambda k, t, d: F.coalesce(given[k].try_cast(t), F.lit(d).cast(t)).alias(k)
    return F.struct(*[of(k, t, d) for k, (t, d) in specs.items()])


def typed_params(json: Column, specs: dict[str, tuple[str, object]]) -> Column:
    """Struct of parameters from a JSON object, by ``specs`` (kind, default); what has another JSON type takes the default.

    Kinds are 'float' (any number), 'int', 'bool' and 'text'. A number in quotes is a text.
    """
    v = F.try_parse_json(json)
    kinds = {"float": ("double", r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "int": ("bigint", r"^BIGINT$"), "bool": ("boolean", r"^BOOLEAN$"), "text": ("string", r"^STRING$")}

    def of(name: str, kind: str, default: object) -> Column:
        to, pattern = kinds[kind]
        found = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.coalesce(F.when(found.rlike(pattern), F.try_variant_get(v, f"$.{name}", to)), F.lit(default).cast(to)).alias(name)

    return F.struct(*[of(n, kind, default) for n, (kind, default) in specs.items()])


# Families that transcribe, statuses of a call that may be tried again.
SPEECH_FAMILIES = ("whisper", "whisper-cpp", "streaming-transducer", "sense-voice", "paraformer", "parakeet", "apple-speech")
AGAIN = (429, 500, 502, 503, 504)


def is_asr(family: Column) -> Column:
    """Whether a family transcribes, in any spelling of its name."""
    plain = F.regexp_replace(F.lower(family), "[^a-z0-9]", "")
    return plain.isin([f.replace("-", "") for f in SPEECH_FAMILIES])


def retry_delay_ms(status: Column, retry_after: Column, attempt: Column, most_ms: int = 30_000) -> Column:
    """Wait before another try: what the answer says in seconds, else half a second doubled each time; null where another try is no use.

    A null status is a call that got no answer.
    """
    seconds = utrim(retry_after).try_cast("bigint")
    wait = F.coalesce(F.when(status.isNotNull() & (seconds >= 0), seconds * 1000), (500 * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1)).cast("bigint"))
    return F.when(status.isNull() | status.isin([*AGAIN]), F.least(wait, F.lit(most_ms)))


def text_result(text: Column, samples: Column, rate: int = 16_000) -> Column:
    """An engine's text as one segment (text, start_ms, end_ms) of a clip of so many samples; null where it is empty."""
    return F.when(text != "", F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("start_ms"), (samples * 1000 / rate).cast("bigint").alias("end_ms")))


def worker_threads(override: Column, cores: Column) -> Column:
    """Threads of an engine: a whole number of 1 or more that was set, else the cores, 1 at least."""
    n = utrim(override).try_cast("bigint")
    return F.when(n >= 1, n).otherwise(F.greatest(cores.cast("bigint"), F.lit(1)))


def catalog_sizes(catalog: DataFrame) -> DataFrame:
    """(id, n_files, size_bytes, n_languages) of a model catalog with nested files."""
    size = F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + F.coalesce(f.size_bytes, F.lit(0)))
    return catalog.select("id", F.size("files").alias("n_files"), size.alias("size_bytes"), F.size("languages").alias("n_languages"))


def catalog_by_language(catalog: DataFrame) -> DataFrame:
    """(lang, models, smallest): how many models know a language, and the smallest of them."""
    d = catalog_sizes(catalog).join(catalog.select("id", F.explode("languages").alias("lang")), "id")
    return d.groupBy("lang").agg(F.count("*").alias("models"), F.min_by("id", F.struct("size_bytes", "id")).alias("smallest"))
