"""Stateful operators as folds: what begins, what a row does, what the end does.

The same fold runs over a stored changelog (rows in order past a state) and as a streaming query with checkpointed state.
A row is (key, order, *values); ``step`` and ``finish`` yield result rows that begin with the key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Fold:
    """``values`` are input columns after key and order; ``result`` is a DDL of result columns after the key."""

    values: tuple[str, ...]
    result: str
    begin: Callable[[], dict]
    step: Callable[[dict, tuple], Iterator[tuple]]
    finish: Callable[[tuple, dict], Iterator[tuple]] = lambda key, state: iter(())


def streaming_ids() -> Fold:
    """Decoder results (text, is_endpoint) as partials and finals that share ids.

    An endpoint with text is its final and the id goes up; one without drops what was held and the id is used again; at
    the end an open partial becomes final.
    """

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        k, o, text, endpoint = row
        text = (text or "").strip()
        if endpoint:
            if text:
                yield k, o, state["id"], text, "Final"
                state["id"] += 1
            state["held"] = None
        elif text and text != state["held"]:
            state["held"], state["at"] = text, o
            yield k, o, state["id"], text, "Partial"

    def finish(key: tuple, state: dict) -> Iterator[tuple]:
        if state["held"]:
            yield key[0], state["at"], state["id"], state["held"], "Final"
            state["held"] = None

    return Fold(("text", "is_endpoint"), "o {order}, id bigint, text string, status string", lambda: {"id": 0, "held": None, "at": None}, step, finish)


def utterances(hangover_ms: int = 700) -> Fold:
    """Frames (speech, ms, start) as utterances (utterance, start, n_frames, speech_ms); silence adds up while one is open."""

    def close(k: object, s: dict) -> Iterator[tuple]:
        if s["n"]:
            yield k, s["u"], s["start"], s["n"], s["ms"]
            s.update(u=s["u"] + 1, n=0, ms=0, quiet=0)

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, _, speech, ms, start = row
        if speech:
            if not s["n"]:
                s["start"] = start
            s["n"], s["ms"], s["quiet"] = s["n"] + 1, s["ms"] + ms, 0
        elif s["n"]:
            s["quiet"] += ms
            if s["quiet"] >= hangover_ms:
                yield from close(k, s)

    return Fold(("speech", "ms", "start"), "utterance bigint, start bigint, n_frames bigint, speech_ms bigint", lambda: {"u": 0, "n": 0, "ms": 0, "quiet": 0, "start": None}, step, lambda k, s: close(k[0], s))


def online_clusters(threshold: float = 0.5) -> Fold:
    """Vectors (vector, reliable) as speaker numbers.

    Vectors count with length 1. Each goes to the most similar sum of vectors so far, or to a new cluster below the
    threshold. Reliable vectors refine the sum they join; unreliable ones below the threshold take the nearest cluster.
    Equal similarity goes to the later cluster. Null and empty vectors have no direction: their similarity is 0.
    """

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        k, o, v, sure = row
        x, sums = np.asarray(v if v is not None else [], float), state["sums"]
        if (norm := np.linalg.norm(x)) > np.finfo(np.float32).eps:
            x = x / norm
        best, at = -2.0, -1
        for i, s in enumerate(sums):
            n = np.linalg.norm(s)
            like = float(s @ x / n) if n > np.finfo(np.float32).eps and len(s) == len(x) else 0.0
            if like >= best:
                best, at = like, i
        if at < 0 or best < threshold and sure:
            sums.append(x.copy())
            at = len(sums) - 1
        elif best >= threshold and sure and len(sums[at]) == len(x):
            sums[at] = sums[at] + x
        yield k, o, at

    return Fold(("vector", "reliable"), "o {order}, speaker int", lambda: {"sums": []}, step)


#: How a session's texts close (fixed values): by kind the mode; by mode the pause in ms.
MODES = {"transcription": "done", "assist": "done", "translation": "gap", "model": "dual"}
GAPS = {"gap": 1200, "dual": 2000}


def accumulate(kind: str = "transcription") -> Fold:
    """Engine events (kind, text, at_ms) of a session as final texts (n, text, aux_text).

    Delta and AuxDelta append, Completed and AuxDone replace, with an empty text too; Failed and Error close what is held
    at once; others count for nothing, nor for the pause. A transcription or assist session closes when the text is
    completed and has no second text; a translation after a pause; a model session when both texts are done, or one is and
    a pause went by. Pauses are seen at the next event. The end closes what is open; what has no text is not emitted.
    """
    mode = MODES[kind]
    gap = GAPS.get(mode)

    def close(k: object, s: dict) -> Iterator[tuple]:
        main, aux = s["main"], s["aux"] if mode != "done" else ""
        if main or aux:
            yield k, s["n"], main, aux or None
            s["n"] += 1
        s.update(main="", aux="", done=False, aux_done=False)

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, _, event, text, at = row
        if event not in ("Delta", "Completed", "AuxDelta", "AuxDone", "Failed", "Error"):
            return
        waited = gap is not None and s["last"] is not None and at is not None and at - s["last"] >= gap
        if waited and (mode == "gap" or s["done"] or s["aux_done"]):
            yield from close(k, s)
        s["last"] = at if at is not None else s["last"]
        if event == "Delta":
            s["main"] += text or ""
        elif event == "AuxDelta":
            s["aux"] += text or ""
        elif event == "Completed":
            s["main"], s["done"] = text or "", True
        elif event == "AuxDone":
            s["aux"], s["aux_done"] = text or "", True
        if event in ("Failed", "Error") or (mode == "done" and s["done"]) or (mode == "dual" and s["done"] and s["aux_done"]):
            yield from close(k, s)

    fresh = lambda: {"n": 0, "main": "", "aux": "", "done": False, "aux_done": False, "last": None}
    return Fold(("kind", "text", "at_ms"), "n bigint, text string, aux_text string", fresh, step, lambda k, s: close(k[0], s))


def capture(window_ms: int = 8000) -> Fold:
    """Frames (utterance, opens_ms, speech_ms, ms, decode_ms, closed) of a stream as decoding jobs (o, id, status, start_ms, length_ms, flushed).

    ``utterance`` is the segmenter's number of the open utterance (null in silence), ``speech_ms`` its length so far and
    ``closed`` whether it ends with this frame. Every ``partial_ms`` of frames an open utterance gives a partial of its
    last ``window_ms``; the partials of an utterance and its final share an id, taken when the first of them is sent.
    ``flushed`` marks the final of an utterance that the stream's end closes. Ids are the stream's own; :func:`murmura.streaming.batch.capture_jobs` numbers those of sibling streams together.
    """

    def job(s: dict, k: object, o: object, status: str, start: int, length: int, flushed: bool = False) -> tuple:
        if s["open"] is None:
            s["open"], s["next"] = s["next"], s["next"] + 1
        return k, o, s["open"], status, start, length, flushed

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, o, utterance, opens, speech, ms, decode, closed = row
        if utterance is not None:
            s["held"] = (o, opens, speech)
        if closed and s["held"]:
            yield job(s, k, o, "Final", s["held"][1], s["held"][2])
            s.update(open=None, since=0, held=None)
        s["since"] += ms or 0
        if s["since"] >= (500 if not decode else min(1500, max(300, decode))):
            s["since"] = 0
            if s["held"]:
                _, start, length = s["held"]
                cut = max(0, length - window_ms)
                yield job(s, k, o, "Partial", start + cut, length - cut)

    def finish(key: tuple, s: dict) -> Iterator[tuple]:
        if s["held"]:
            yield job(s, key[0], s["held"][0], "Final", s["held"][1], s["held"][2], True)
            s.update(open=None, held=None)

    fresh = lambda: {"open": None, "next": 0, "since": 0, "held": None}
    return Fold(("utterance", "opens_ms", "speech_ms", "ms", "decode_ms", "closed"), "o {order}, id bigint, status string, start_ms bigint, length_ms bigint, flushed boolean", fresh, step, finish)


def dictation() -> Fold:
    """Segments (text, status) as the dictated text after each: finals, then the open partial (o, text).

    Pieces join by a space only before one that begins with an ASCII letter or digit.
    """

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, o, text, status = row
        text = (text or "").strip()
        if status == "Final":
            s["done"], s["open"] = joined(s["done"], text), ""
        else:
            s["open"] = text
        yield k, o, joined(s["done"], s["open"])

    def joined(a: str, b: str) -> str:
        return a + (" " if a and b[:1].isascii() and b[:1].isalnum() else "") + b

    return Fold(("text", "status"), "o {order}, text string", lambda: {"done": "", "open": ""}, step)


def rolling_summary(summarize: Callable[[str, str], str | None], recent_chars: int = 6000) -> Fold:
    """Transcripts so far (transcript) as a model's context (o, context): a summary of what is long ago, and the recent rest.

    What exceeds ``recent_chars`` is cut at a line and folded into the summary by ``summarize(summary, text)``; where that
    gives null the summary stays and the text is tried again. A transcript shorter than what is summarised begins anew.
    Rows whose transcript did not grow, and blank contexts, give nothing.
    """

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, o, full = row
        full = full or ""
        if len(full) == s["seen"]:
            return
        s["seen"] = len(full)
        if len(full) < s["chars"]:
            s["summary"], s["chars"] = "", 0
        recent = full[s["chars"] :]
        cut = recent.rfind("\n", 0, len(recent) - recent_chars) + 1 if len(recent) > recent_chars else 0
        if cut > 0 and (folded := summarize(s["summary"], recent[:cut])) is not None:
            s["summary"], s["chars"] = folded.strip(), s["chars"] + cut
            recent = full[s["chars"] :]
        context = f"Summary of earlier conversation:\n{s['summary']}\n\nRecent conversation:\n{recent}" if s["summary"] else recent
        if context.strip():
            yield k, o, context

    return Fold(("transcript",), "o {order}, context string", lambda: {"summary": "", "chars": 0, "seen": 0}, step)


def jitter_buffer(cap: int = 12_000) -> Fold:
    """Frames of two streams (side, samples) as pairs for :func:`mixer` (o, first, second).

    Frames of the second stream wait, up to ``cap`` samples, the oldest being dropped; a frame of the first takes as many
    as it has itself, or fewer.
    """

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, o, side, samples = row
        x = [float(v) for v in samples] if samples is not None else []
        if side == "second":
            s["held"] = (s["held"] + x)[-cap:]
        else:
            yield k, o, x, s["held"][: len(x)]
            s["held"] = s["held"][len(x) :]

    return Fold(("side", "samples"), "o {order}, first array<double>, second array<double>", lambda: {"held": []}, step)


def assist_triggers(every_ms: int = 15_000) -> Fold:
    """Rows (at, speech, manual) that fire: manual ones, and new speech at least ``every_ms`` after the last firing."""

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, o, now, heard, asked = row
        s["new"] = s["new"] or bool(heard)
        if asked or s["new"] and (s["last"] is None or now - s["last"] >= every_ms):
            s["new"], s["last"] = False, now
            yield k, o, now

    return Fold(("at", "speech", "manual"), "o {order}, at bigint", lambda: {"new": False, "last": None}, step)


def echoes(chars: int = 6, window_ms: int = 5000, like: float = 0.8) -> Fold:
    """Rows (letters, source, status, end_ms) that are admitted; ``letters`` is the text's echo key.

    Final system rows are remembered until the latest end so far is past theirs by the window, oldest first; a
    microphone row that is like a remembered one is dropped.
    """

    def distance(a: str, b: str) -> int:
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        return before[-1]

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, o, key, source, status, end = row
        s["now"] = max(s["now"], end or 0)
        held: deque = s["held"]
        while held and held[0][0] + window_ms < s["now"]:
            held.popleft()
        if source == "mic" and len(key or "") >= chars:
            if any(1 - distance(key, t) / max(len(key), len(t)) >= like for _, t in held):
                return
        if source == "system" and status == "Final" and len(key or "") >= chars:
            held.append((end, key))
        yield k, o

    return Fold(("letters", "source", "status", "end_ms"), "o {order}", lambda: {"now": 0, "held": deque()}, step)


def mixer(attack: float = 0.7, release: float = 0.1, silence: float = 1e-4) -> Fold:
    """Frames of two streams (first, second) mixed by shares of their followed peaks; the mix never clips.

    A level rises fast and falls slowly; below ``silence`` in sum both streams count half. Where the second frame is
    shorter, the rest of the first is scaled alone.
    """

    def follow(level: float, peak: float) -> float:
        return level + (attack if peak > level else release) * (peak - level)

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        k, o, a, b = row
        a, b = np.asarray(a if a is not None else [], float), np.asarray(b if b is not None else [], float)
        s["a"], s["b"] = follow(s["a"], float(np.abs(a).max(initial=0))), follow(s["b"], float(np.abs(b).max(initial=0)))
        total = s["a"] + s["b"]
        share = s["a"] / total if total >= silence else 0.5
        out, n = a * share, min(len(a), len(b))
        out[:n] += b[:n] * (1 - share)
        yield k, o, np.clip(out, -1, 1).tolist(), share

    return Fold(("first", "second"), "o {order}, mixed array<double>, share double", lambda: {"a": 0.0, "b": 0.0}, step)
